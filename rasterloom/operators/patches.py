"""Piecewise bilinear functions over lines and pixels, as a table of patches.

A patch is a rectangle, closed on all sides, with values at four nodes; between the nodes a function is
bilinear, beyond them constant.  Points meet patches in an equi-join on buckets of lines and pixels, which are about as
large as an image's patches, so a point looks at a few of them whatever the number of images and patches.  Of
patches that hold a point the one of the highest ``rank`` counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.cube import column_names

#: Columns of a patch beside its image: rank, the rectangle, the nodes, values by line and pixel.
FIELDS = ("rank", "l0", "l1", "p0", "p1", "nl0", "nl1", "np0", "np1", "v00", "v01", "v10", "v11")


def of_vectors(table: DataFrame) -> DataFrame:
    """Patches of ``table(item_id, line, pixel ARRAY, value ARRAY)``: vectors along pixels at some lines of each image.

    Vectors are first brought to the nodes of the image's first one.  Vectors and nodes that repeat count once; an image with one
    vector, or vectors with one node, is constant along lines or pixels.
    """
    by_image = Window.partitionBy("item_id")
    once = table.where("line is not null and size(pixel) > 0").groupBy("item_id", "line").agg(F.max(F.struct("pixel", "value")).alias("v"))
    rows = once.withColumn("nodes", F.array_distinct(F.min_by("v.pixel", "line").over(by_image)))
    even = rows.select("item_id", "line", "nodes", F.transform("nodes", lambda x: interpolate(x, F.col("v.pixel"), F.col("v.value"))).alias("here"))
    along = Window.partitionBy("item_id").orderBy("line")
    pairs = even.withColumns({"line1": F.lead("line").over(along), "there": F.lead("here").over(along), "only": F.count("*").over(by_image) == 1})
    pairs = pairs.where("line1 is not null or only").withColumns({"line1": F.coalesce("line1", "line"), "there": F.coalesce("there", "here")})
    last = F.greatest(F.size("nodes") - 2, F.lit(0))
    cells = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), last))).withColumn("j", F.least(F.col("i") + 1, F.size("nodes") - 1))
    at = lambda c, k: F.get(c, F.col(k))
    return cells.select(
        "item_id", F.lit(0).cast("long").alias("rank"), F.col("line").alias("l0"), F.col("line1").alias("l1"), at("nodes", "i").alias("p0"), at("nodes", "j").alias("p1"),
        F.col("line").alias("nl0"), F.col("line1").alias("nl1"), at("nodes", "i").alias("np0"), at("nodes", "j").alias("np1"),
        at("here", "i").alias("v00"), at("here", "j").alias("v01"), at("there", "i").alias("v10"), at("there", "j").alias("v11"),
    )


def of_strips(strips: DataFrame) -> DataFrame:
    """Patches of ``strips(item_id, rank, l0, l1, p0, p1, at ARRAY, value ARRAY)``: rectangles whose values run along lines."""
    n = F.size("at")
    cut = strips.where("size(at) > 0 and size(value) = size(at)").withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))))
    cut = cut.withColumn("j", F.least(F.col("i") + 1, n - 1))
    here, there, v, w = F.get("at", F.col("i")), F.get("at", F.col("j")), F.get("value", F.col("i")), F.get("value", F.col("j"))
    low, high = F.when(F.col("i") == 0, F.col("l0")).otherwise(F.greatest("l0", here)), F.when(F.col("j") == n - 1, F.col("l1")).otherwise(F.least("l1", there))
    out = cut.select("item_id", F.col("rank").cast("long").alias("rank"), low.alias("l0"), high.alias("l1"), "p0", "p1", here.alias("nl0"), there.alias("nl1"), F.col("p0").alias("np0"), F.col("p1").alias("np1"), v.alias("v00"), v.alias("v01"), w.alias("v10"), w.alias("v11"))
    return out.where("l0 <= l1 and p0 <= p1")


def interpolate(x: Column, nodes: Column, values: Column) -> Column:
    """Linear between ascending nodes, the edge's value beyond."""
    last = F.size(nodes) - 1
    i = F.greatest(F.lit(0), F.least(F.size(F.filter(nodes, lambda a: a < x)) - 1, last - 1))
    low, high = F.get(nodes, i), F.get(nodes, i + 1)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(x - low, high - low)))
    return F.when(last == 0, F.get(values, F.lit(0))).otherwise(F.get(values, i) * (1 - t) + F.get(values, i + 1) * t)


def look_up(points: DataFrame, patches: DataFrame, name: str, line: str = "line", pixel: str = "pixel", item: str = "item_id", extend: bool = True) -> DataFrame:
    """Add to ``points`` the value of their image's patches.

    ``extend`` gives points outside of an image's patches the value at the nearest edge of their bounding box; else such points, like
    those in a gap between patches, get NULL.  Points of images without patches, and those without a line or pixel, get NULL.
    """
    frames = patches.groupBy(F.col("item_id").alias("_item")).agg(
        F.min("l0").alias("_l0"), F.max("l1").alias("_l1"), F.min("p0").alias("_p0"), F.max("p1").alias("_p1"), F.count_distinct("l0").alias("_nl"), F.count_distinct("p0").alias("_np")
    )

    def bucket(v: Column, low: str, high: str, n: str) -> Column:
        share = F.try_divide(v - F.col(low), F.col(high) - F.col(low)) * F.col(n)
        return F.least(F.floor(F.coalesce(share, F.lit(0.0))), F.col(n) - 1).cast("long")

    lines, pixels = ("_l0", "_l1", "_nl"), ("_p0", "_p1", "_np")
    placed = patches.join(frames, F.col("item_id") == F.col("_item"))
    for at, (low, high), frame in (("_lb", ("l0", "l1"), lines), ("_pb", ("p0", "p1"), pixels)):
        placed = placed.withColumn(at, F.explode(F.sequence(bucket(F.col(low), *frame), bucket(F.col(high), *frame))))
    held = placed.groupBy("_item", "_lb", "_pb").agg(F.collect_list(F.struct(*FIELDS)).alias("_patches"))

    own, x, y, key = column_names(points, 4, name)
    p = points.withColumns({own: F.col(f"`{line}`").cast("double"), key: F.col(f"`{item}`").cast("string")})
    p = p.withColumn(x, F.col(f"`{pixel}`").cast("double")).withColumnRenamed(own, y)
    p = p.join(frames.withColumnRenamed("_item", "_frame"), F.col(key) == F.col("_frame"), "left")
    if extend:
        p = p.withColumns({y: F.greatest(F.least(F.col(y), F.col("_l1")), F.col("_l0")), x: F.greatest(F.least(F.col(x), F.col("_p1")), F.col("_p0"))})
        for n, of in ((y, line), (x, pixel)):
            p = p.withColumn(n, F.when(F.col(f"`{of}`").isNotNull(), F.col(n)))
    inside = F.col(y).between(F.col("_l0"), F.col("_l1")) & F.col(x).between(F.col("_p0"), F.col("_p1"))
    p = p.withColumns({"_lb": F.when(inside, bucket(F.col(y), *lines)), "_pb": F.when(inside, bucket(F.col(x), *pixels))}).drop("_l0", "_l1", "_p0", "_p1", "_nl", "_np", "_frame")
    both = p.join(held.withColumnsRenamed({"_item": "_i", "_lb": "_bl", "_pb": "_bp"}), (F.col(key) == F.col("_i")) & (F.col("_lb") == F.col("_bl")) & (F.col("_pb") == F.col("_bp")), "left")
    fits = F.filter("_patches", lambda b: F.col(y).between(b["l0"], b["l1"]) & F.col(x).between(b["p0"], b["p1"]))
    best = F.array_max(fits)
    share = lambda v, low, high: F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(v - low, high - low))), F.lit(0.0))

    def value(b: Column) -> Column:
        t, s = share(F.col(y), b["nl0"], b["nl1"]), share(F.col(x), b["np0"], b["np1"])
        return (b["v00"] * (1 - s) + b["v01"] * s) * (1 - t) + (b["v10"] * (1 - s) + b["v11"] * s) * t

    found = F.get(F.transform(F.array(best), value), F.lit(0))
    return both.withColumn(name, found).select(*[f"`{c}`" for c in points.columns if c != name], f"`{name}`")
