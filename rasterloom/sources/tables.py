"""Cubes and catalogues out of the star-schema tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.cube import Cube, Grid, clean
from rasterloom.operators.temporal import within
from rasterloom.sources.catalog import BandInfo, Collection, mosaic

EVENT_BANDS = ("click", "error", "purchase", "signup", "view")
EVENT_GRID = Grid(8, 8, (0.0, 0.0, 8.0, 8.0))
SCENE_BANDS = ("quantity", "price", "discount", "tax")
SCENE_GRID = Grid(16, 16, (0.0, 0.0, 16.0, 16.0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_order(df: DataFrame, by: str) -> DataFrame:
    """Rows of a Parquet table with ``_order``: by a column of whole numbers, equal ones as the rows stand in the table.

    Files stand in the order of their names.  The order is one number, which aggregations by hash can hold.
    """
    files, file = sorted(df.inputFiles()), F.lit(0)
    place = F.col("_metadata.row_index").alias("_row")
    if len(files) > 1:
        # a path may begin with one slash or three
        short = lambda path: F.regexp_replace(path, "^([^:/]+):/+", "$1:/")
        known = df.sparkSession.createDataFrame([(i, f) for i, f in enumerate(files)], "_file long, _path string").withColumn("_path", short("_path"))
        df = df.select("*", place, short("_metadata.file_path").alias("_in")).join(F.broadcast(known), F.col("_in") == F.col("_path"), "left").drop("_in", "_path")
        file = F.coalesce("_file", F.lit(0))
    else:
        df = df.select("*", place)
    order = F.col(by).cast("decimal(38,0)") * F.lit(10**18).cast("decimal(19,0)") + file.cast("decimal(38,0)") * F.lit(10**12).cast("decimal(13,0)") + F.col("_row").cast("decimal(38,0)")
    return df.withColumn("_order", order.cast("decimal(38,0)")).drop("_row", "_file")


def first_by_order(column: str) -> Column:
    """A column's value, nulls left out, in the first row by ``_order``."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col("_order")))


def events_cube(spark: SparkSession, sf_dir: str, hours: int = 24, temporal_extent: list | None = None) -> Cube:
    """Mean value by event type, users on an 8 x 8 grid, a slice per ``hours``.

    An extent (its ends are starts of slices) is a predicate on the stored column, so it
    reaches the Parquet scan.
    """
    ev = table(spark, sf_dir, "events")
    if temporal_extent:
        ev = ev.where(within(temporal_extent, F.col("ts").cast("timestamp_ntz")))
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    at = day if hours == 24 else (day + F.make_dt_interval(hours=(F.floor(F.hour("ts") / hours) * hours).cast("int"))).cast("timestamp_ntz")
    rows = ev.select(at.alias("t"), (F.col("user_id") % 8).cast("int").alias("y"), (F.expr("user_id div 8") % 8).cast("int").alias("x"), "event_type", clean(F.col("value")).alias("value"))
    cells = rows.groupBy("t", "y", "x").agg(*[F.avg(F.when(F.col("event_type") == b, F.col("value"))).alias(b) for b in EVENT_BANDS])
    return Cube(cells, EVENT_BANDS, EVENT_GRID).dense(rows.select("t").distinct())


def scenes(spark: SparkSession, sf_dir: str, start: datetime | None = None, end: datetime | None = None) -> Collection:
    """Line items as scenes: one per month and line number, pixels by part and supplier.

    Ship dates from ``start`` to the end of the month of ``end`` are read.
    """
    li = table(spark, sf_dir, "lineitem")
    if start:
        li = li.where(F.col("l_shipdate") >= F.lit(start.replace(day=1, hour=0, minute=0, second=0, microsecond=0)).cast(li.schema["l_shipdate"].dataType))
    if end:
        li = li.where(F.col("l_shipdate") < F.lit(end + timedelta(days=31)).cast(li.schema["l_shipdate"].dataType))
    month = F.date_trunc("month", F.col("l_shipdate")).cast("timestamp_ntz")
    rows = with_row_order(li, "l_orderkey").select(month.alias("t"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 16).cast("int").alias("y"), (F.col("l_suppkey") % 16).cast("int").alias("x"), "_order", *[f"l_{c}" for c in ("quantity", "extendedprice", "discount", "tax")])
    # a group's name, not a row's: conditions on names are tested on groups
    name = F.concat_ws("-", F.date_format(F.min("t"), "yyyy-MM"), F.min("line").cast("string"))
    source = dict(zip(SCENE_BANDS, ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), strict=True))
    pixels = rows.groupBy("t", "line", "y", "x").agg(name.alias("item_id"), *[first_by_order(c).alias(b) for b, c in source.items()]).select("item_id", "y", "x", *source)
    box = [F.lit(float(v)).alias(n) for n, v in zip(("west", "south", "east", "north"), SCENE_GRID.bounds, strict=True)]
    items = rows.groupBy("t", "line").agg(F.min("t").alias("datetime"), name.alias("item_id")).select(F.col("item_id").alias("id"), F.lit("scenes").alias("collection"), "datetime", *box, F.create_map(F.lit("line"), F.element_at(F.split("item_id", "-"), -1)).alias("properties"))
    return Collection("scenes", items, pixels, SCENE_GRID, {b: BandInfo() for b in SCENE_BANDS}, lambda a, b: scenes(spark, sf_dir, a, b))


def scene_cube(spark: SparkSession, sf_dir: str) -> Cube:
    """All scenes, a mosaic per month."""
    c = scenes(spark, sf_dir)
    return mosaic(c.items, c.pixels, list(SCENE_BANDS), c.grid).dense(c.items.select(F.col("datetime").alias("t")).distinct())


def order_catalog(spark: SparkSession, sf_dir: str) -> Collection:
    """Orders as items, placed by customer."""
    o = table(spark, sf_dir, "orders")
    west = (F.col("o_custkey") % 360 - 180).cast("double")
    south = (F.col("o_custkey") % 180 - 90).cast("double")
    props = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"), F.lit("totalprice"), F.col("o_totalprice").cast("string"))
    items = o.select(F.col("o_orderkey").cast("string").alias("id"), F.lit("orders").alias("collection"), F.col("o_orderdate").cast("timestamp_ntz").alias("datetime"), west.alias("west"), south.alias("south"), (west + 1).alias("east"), (south + 1).alias("north"), props.alias("properties"))
    return Collection("orders", items, items.limit(0), EVENT_GRID)
