"""Catalogues of scenes, and cubes out of them.

An item is a row ``id, collection, datetime, west, south, east, north, properties
MAP<STRING,STRING>``, and perhaps its footprint as ``geometry`` (GeoJSON); its pixels are rows ``item_id, y, x`` and a column per band, in a table
that shares the grid of the cube asked for or is resampled to it.  Filters on time and
extent are plain predicates that reach the Parquet scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.cube import REDUCED, Cube, Footprints, Grid, clean, reproject_bounds
from rasterloom.errors import FeatureUnsupported, ItemsLimitExceeded, NoDataAvailable, OutputLimitExceeded, ProcessParameterInvalid, TemporalExtentEmpty
from rasterloom.operators.resample import to_grid
from rasterloom.operators.temporal import parse_time
from rasterloom.sources.intersects import intersecting

MAX_ITEMS = 20
MAX_PIXELS = 100_000_000
#: Item ids that become a list in a predicate; more of them meet the pixels in the join alone.
MAX_LISTED = 1000
#: Cells beyond an extent that a resampling kernel may read.
KERNEL_REACH = 3


@dataclass(frozen=True)
class BandInfo:
    """How stored numbers become values."""

    scale: float = 1.0
    offset: float = 0.0
    nodata: float | None = None
    like: str | None = None  #: a band whose missing pixels are missing here too


@dataclass(frozen=True)
class Collection:
    """A table of items and a table of their pixels."""

    id: str
    items: DataFrame
    pixels: DataFrame
    grid: Grid
    bands: dict[str, BandInfo] = field(default_factory=dict)
    #: The part of the collection between two times (either may be None) or a little more, by predicates on stored columns.
    narrow: Callable[[datetime | None, datetime | None], Collection] | None = None
    #: How cells of a grid are read where pixels don't lie on ``grid``: of items, band names, their infos, a grid and a method.
    reader: Callable[[DataFrame, list[str], dict[str, BandInfo], Grid, str], Cube] | None = None

    def between(self, temporal_extent: list | None) -> Collection:
        """Narrowed to an extent, where the collection knows how."""
        if self.narrow is None or temporal_extent is None:
            return self
        return self.narrow(*(None if x in (None, "..") else parse_time(x) for x in temporal_extent))

    def describe(self) -> dict:
        """Dimensions and bands, from one aggregation of the items."""
        r = self.items.agg(F.min("datetime"), F.max("datetime"), F.min("west"), F.min("south"), F.max("east"), F.max("north")).first()
        when = [None if x is None else x.isoformat() for x in r[:2]]
        dims = {
            "x": {"type": "spatial", "axis": "x", "extent": [r[2], r[4]]},
            "y": {"type": "spatial", "axis": "y", "extent": [r[3], r[5]]},
            "t": {"type": "temporal", "extent": when},
            "bands": {"type": "bands", "values": sorted(self.bands)},
        }
        return {"id": self.id, "type": "Collection", "cube:dimensions": dims, "summaries": {"bands": [{"name": b} for b in sorted(self.bands)]}}


def normalize_summaries(summaries: dict) -> dict:
    """Single values become lists; ranges stay."""
    return {k: v if isinstance(v, (list, dict)) else [v] for k, v in summaries.items()}


def _prop(name: str) -> Column:
    # a map's item, and no coalesce around a test, so that plain columns behind the map are pushed to the scan
    return F.col("properties").getItem(name.removeprefix("properties."))


def _compare(op: Callable[[Column, Column], Column]) -> Callable[[Column, dict], Column]:
    def test(p: Column, args: dict) -> Column:
        other = args.get("y", args.get("x") if not _is_ref(args.get("x")) else None)
        if isinstance(other, bool):
            return op(p.try_cast("boolean"), F.lit(other))
        if isinstance(other, (int, float)):
            return op(p.try_cast("double"), F.lit(float(other)))
        return op(p, F.lit(other))

    return test


def _is_ref(x: Any) -> bool:
    return isinstance(x, dict) and ("from_parameter" in x or "from_node" in x)


def _pattern(args: dict) -> str:
    return args.get("pattern", args.get("y", ""))


PREDICATES: dict[str, Callable[[Column, dict], Column]] = {
    "eq": _compare(lambda a, b: a == b),
    "neq": _compare(lambda a, b: a != b),
    "lt": _compare(lambda a, b: a < b),
    "lte": _compare(lambda a, b: a <= b),
    "gt": _compare(lambda a, b: a > b),
    "gte": _compare(lambda a, b: a >= b),
    "between": lambda p, a: p.try_cast("double").between(float(a["min"]), float(a["max"])),
    "in": lambda p, a: p.isin([str(v) for v in a.get("values", a.get("data", []))]),
    "array_contains": lambda p, a: p.isin([str(v) for v in a.get("data", a.get("values", []))]),
    "starts_with": lambda p, a: p.startswith(_pattern(a)),
    "ends_with": lambda p, a: p.endswith(_pattern(a)),
    "contains": lambda p, a: p.contains(_pattern(a)),
    "is_null": lambda p, a: p.isNull(),
}


def _node_test(nodes: dict, name: str, p: Column) -> Column | None:
    node = nodes[name]
    args, process = node.get("arguments", {}), node["process_id"]

    def sub(x: Any) -> Column | None:
        if isinstance(x, dict) and "from_node" in x:
            return _node_test(nodes, x["from_node"], p)
        if isinstance(x, dict) and "process_id" in x:
            return _node_test({"_": x}, "_", p)
        raise ProcessParameterInvalid("an expression of a filter is a node")

    if process in ("and", "or"):
        parts = args.get("expressions") or [args["x"], args["y"]]
        out = None
        for part in filter(lambda c: c is not None, map(sub, parts)):
            out = part if out is None else out & part if process == "and" else out | part
        return out
    if process == "not":
        inner = sub(args.get("expression", args.get("x")))
        return None if inner is None else ~inner
    if any(isinstance(v, dict) and "from_parameter" in v and v["from_parameter"] not in ("value", "x") for v in args.values()):
        return None  # an unknown parameter: the filter is left out
    return PREDICATES.get(process, PREDICATES["eq"])(p, args)


def property_filter(properties: dict | None) -> Column:
    """All conditions together; a value stands for equality, a graph for its result node."""
    out = F.lit(True)
    for name, rule in (properties or {}).items():
        p = _prop(name)
        if isinstance(rule, dict) and "from_parameter" in rule:
            continue
        if isinstance(rule, dict) and ("process_graph" in rule or any(isinstance(v, dict) and "process_id" in v for v in rule.values())):
            nodes = rule.get("process_graph", rule)
            last = next((n for n, v in nodes.items() if v.get("result")), list(nodes)[-1])
            test = _node_test(nodes, last, p)
            if test is None:
                continue
        else:
            test = _compare(lambda a, b: a == b)(p, {"y": rule})
        out = out & test
    return out


def search(
    collection: Collection, spatial_extent: dict | None = None, temporal_extent: list | None = None, properties: dict | None = None, ids: list[str] | None = None,
    intersects: dict | None = None, sortby: str | list[str] | None = None, fields: list[str] | None = None, limit: int | None = None,
) -> DataFrame:
    """Items that meet an extent and a geometry, lie in ``[start, end)`` and fulfil the conditions.

    ``sortby`` names fields, with a leading ``-`` for falling order and ``properties.`` before a property (numbers by value);
    ties go by id.  With ``limit`` only the first ones are kept, by id where no order is asked for; ``fields`` are the columns returned.
    """
    df = collection.between(temporal_extent).items
    if spatial_extent:
        b = tuple(float(spatial_extent[k]) for k in ("west", "south", "east", "north"))
        b = reproject_bounds(b, int(spatial_extent.get("crs") or 4326), 4326)
        df = df.where((F.col("west") < b[2]) & (F.col("east") > b[0]) & (F.col("south") < b[3]) & (F.col("north") > b[1]))
    if temporal_extent is not None:
        start, end = (None if x in (None, "..") else parse_time(x) for x in temporal_extent)
        if start is None and end is None:
            raise TemporalExtentEmpty("an extent has a start or an end")
        if start and end and end <= start:
            raise TemporalExtentEmpty("the end is not after the start")
        if start:
            df = df.where(F.col("datetime") >= F.lit(start).cast("timestamp_ntz"))
        if end:
            df = df.where(F.col("datetime") < F.lit(end).cast("timestamp_ntz"))
    if properties:
        df = df.where(property_filter(properties))
    if ids is not None:
        listed = [str(i) for i in ids]
        df = df.where(F.col("id").isin(listed)) if len(listed) <= MAX_LISTED else df.join(df.sparkSession.createDataFrame([(i,) for i in listed], "id string").distinct(), "id", "left_semi")
    if intersects is not None:
        df = intersecting(df, intersects)
    if sortby or limit is not None:
        df = df.orderBy(*sort_order([sortby] if isinstance(sortby, str) else sortby or []))
    if limit is not None:
        df = df.limit(limit)
    return df.select(*fields) if fields else df


def sort_order(sortby: list[str]) -> list[Column]:
    """Columns of an order, the id last; missing values come last either way."""
    out = []
    for rule in sortby:
        down, name = rule.startswith("-"), rule.lstrip("+-")
        if name.startswith("properties."):
            value = _prop(name)
            keys = [value.try_cast("double"), value]
        elif name in ("id", "collection", "datetime", "west", "south", "east", "north"):
            keys = [F.col(name)]
        else:
            raise ProcessParameterInvalid(f"items have no field {name!r} to sort by")
        out += [k.desc_nulls_last() if down else k.asc_nulls_last() for k in keys]
    return [*out, F.col("id").asc()]


def output_size(bounds: tuple[float, float, float, float], dx: float | None, dy: float | None, width: int | None = None, height: int | None = None) -> tuple[int, int]:
    """Both sides as asked; one side, the other in proportion; neither, the finest cells' number."""
    if width and height:
        return width, height
    if not dx or not dy:
        return width or 1024, height or 1024
    w = max(1, round((bounds[2] - bounds[0]) / dx))
    h = max(1, round((bounds[3] - bounds[1]) / dy))
    if width:
        return width, max(1, round(width * h / w))
    if height:
        return max(1, round(height * w / h)), height
    return w, h


def read_bands(collection: Collection, bands: list[str]) -> list[Column]:
    """Stored numbers to values: nodata and NaN are missing, then scale and offset."""
    out = []
    for b in bands:
        info = collection.bands[b]
        v = clean(F.col(f"`{b}`"))
        if info.nodata is not None:
            v = F.nullif(v, F.lit(float(info.nodata)))
        if (info.scale, info.offset) != (1.0, 0.0):
            v = v * info.scale + info.offset
        if info.like:
            v = F.when(F.col(f"`{info.like}`").isNotNull(), v)
        out.append(v.alias(b))
    return out


def load_collection(
    collection: Collection, spatial_extent: dict | None = None, temporal_extent: list | None = None, bands: list[str] | None = None, properties: dict | None = None,
    width: int | None = None, height: int | None = None, max_items: int = MAX_ITEMS, max_pixels: int = MAX_PIXELS, method: str = "near",
    target_crs: int | str | None = None, tile_buffer: float | None = None,
) -> Cube:
    """Search, check limits, mosaic the items of each timestamp, cut to the extent.

    In a mosaic each band takes the first valid value, in the order of item ids.  Ids and
    times of the items found are all that reaches the driver.  They and the extent's rows and columns are
    predicates on the pixels, ahead of the mosaic.  ``target_crs`` is the projection of the
    cube, ``tile_buffer`` a number of cells more on every side.
    """
    items = search(collection, spatial_extent, temporal_extent, properties)
    names = list(bands or [next(iter(collection.bands))])
    missing = [b for b in names if b not in collection.bands]
    if missing:
        raise ProcessParameterInvalid(f"the collection has no band {missing[0]}")
    if "geometry" in items.columns:
        # they are read again as the cube's footprints
        items = items.select("id", "datetime", F.col("geometry").cast("string").alias("geometry")).limit(max_items + 1).persist()
    found = items.select("id", "datetime").limit(max_items + 1).collect()
    if not found:
        raise NoDataAvailable("no item matches")
    if len(found) > max_items:
        raise ItemsLimitExceeded(f"more than {max_items} items match")
    g = collection.grid
    crs = g.crs if target_crs is None else parse_crs(target_crs)
    bounds = reproject_bounds(g.bounds, g.crs, crs)
    if spatial_extent:
        b = tuple(float(spatial_extent[k]) for k in ("west", "south", "east", "north"))
        bounds = reproject_bounds(b, int(spatial_extent.get("crs") or 4326), crs)
    fine = Grid(g.width, g.height, reproject_bounds(g.bounds, g.crs, crs), crs)
    w, h = output_size(bounds, fine.dx, fine.dy, width, height)
    if tile_buffer:
        n, dx, dy = math.ceil(tile_buffer), (bounds[2] - bounds[0]) / w, (bounds[3] - bounds[1]) / h
        bounds = bounds[0] - n * dx, bounds[1] - n * dy, bounds[2] + n * dx, bounds[3] + n * dy
        w, h = w + 2 * n, h + 2 * n
    target = Grid(w, h, bounds, crs)
    times = tuple(sorted({r[1] for r in found}))
    if w * h * len(times) * len(names) > max_pixels:
        raise OutputLimitExceeded(f"{w} x {h} cells at {len(times)} times in {len(names)} bands are more than {max_pixels} values")
    listed = items.sparkSession.createDataFrame([(r[0], r[1]) for r in found], items.select("id", "datetime").schema)
    marks = Footprints(items.select(F.col("datetime").alias("t"), "geometry")) if "geometry" in items.columns else None
    if collection.reader is not None:
        return replace(collection.reader(listed, names, collection.bands, target, method), times=times, footprints=marks).dense(list(times))
    pixels = collection.between(temporal_extent).pixels.select("item_id", "y", "x", *read_bands(collection, names))
    if len(found) <= MAX_LISTED:
        pixels = pixels.where(F.col("item_id").isin([r[0] for r in found]))
    if target != g:
        y0, y1, x0, x1 = g.window(reproject_bounds(bounds, crs, g.crs), KERNEL_REACH)
        pixels = pixels.where(F.col("y").between(y0, y1) & F.col("x").between(x0, x1))
    # where each time has one item there is nothing to choose from
    cube = replace(mosaic(listed, pixels, names, g, single=len(times) == len(found)), times=times, footprints=marks)
    return cube.dense(list(times)) if target == g else to_grid(cube, target, method)


def parse_crs(value: int | str) -> int:
    """A number of a projection, or its name such as ``EPSG:3857``."""
    text = str(value).upper().removeprefix("EPSG:")
    if not text.isdigit():
        raise ProcessParameterInvalid(f"{value!r} names no projection")
    return int(text)


def mosaic(items: DataFrame, pixels: DataFrame, bands: list[str], grid: Grid, single: bool = False) -> Cube:
    """One slice per timestamp out of the pixels of its items; ``single`` if each timestamp has one item."""
    when = items.select(F.col("id").alias("item_id"), F.col("datetime").alias("t"))
    rows = pixels.join(when, "item_id")
    if not single:
        first = [F.min_by(F.col(f"`{b}`"), F.when(F.col(f"`{b}`").isNotNull(), F.col("item_id"))).alias(b) for b in bands]
        rows = rows.groupBy("t", "y", "x").agg(*first)
    return Cube(rows.select("t", "y", "x", *[f"`{b}`" for b in bands]), tuple(bands), grid)


def stac_items(spark: SparkSession, url: str) -> DataFrame:
    """Items out of documents: an item, a folder of them, or the catalogue or collection above them.

    A static catalogue is the folder of its document; links out of it are not followed.
    """
    fields = "type string, id string, collection string, bbox array<double>, geometry string, properties map<string,string>"
    reader = spark.read.schema(fields).option("multiLine", True)
    raw = reader.json(url)
    if not raw.where(F.col("type").isin("Catalog", "Collection")).isEmpty():
        raw = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(url.rsplit("/", 1)[0] if url.endswith(".json") else url)
    at = F.try_to_timestamp(F.coalesce(F.try_element_at("properties", F.lit("datetime")), F.try_element_at("properties", F.lit("start_datetime")))).cast("timestamp_ntz")
    corners = [F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(("west", "south", "east", "north"))]
    items = raw.where(at.isNotNull() & ~F.coalesce(F.col("type").isin("Catalog", "Collection"), F.lit(False)))
    return items.select("id", "collection", at.alias("datetime"), *corners, "properties", "geometry")


def load_stac(spark: SparkSession, path: str, pixels: DataFrame, grid: Grid, known: dict[str, BandInfo], **how: Any) -> Cube:
    """A cube out of the documents of ``stac_items`` and a table of pixels."""
    return load_collection(Collection("stac", stac_items(spark, path), pixels, grid, known), **how)


def load_url(spark: SparkSession, url: str, format: str | None = None, options: dict | None = None) -> Cube:  # noqa: A002
    """One image out of a GeoTIFF, on its own grid, or out of a Parquet table ``y, x`` and bands.

    ``options`` may hold ``bands``, ``width``, ``height``, ``bounds``, ``crs`` and ``time``; the bands are
    otherwise all other columns, the grid as large as the table's cells need (one aggregation).
    """
    o = options or {}
    if (format or "").lower() in ("gtiff", "tiff", "tif") or (format is None and url.lower().endswith((".tif", ".tiff"))):
        from rasterloom.sources.geotiff import load_image

        return load_image(spark, url, o.get("bands"), o.get("time", REDUCED))
    if format is not None and format.lower() != "parquet":
        raise FeatureUnsupported(f"an image is read from GTiff or Parquet, not {format}")
    df = spark.read.parquet(url)
    bands = list(o.get("bands") or [c for c in df.columns if c not in ("y", "x")])
    w, h = o.get("width"), o.get("height")
    if not w or not h:
        last = df.agg(F.max("x"), F.max("y")).first()
        w, h = w or (last[0] or 0) + 1, h or (last[1] or 0) + 1
    grid = Grid(int(w), int(h), tuple(map(float, o.get("bounds") or (0, 0, w, h))), parse_crs(o.get("crs", 4326)))
    return load_table(spark, url, bands, grid, o.get("time", REDUCED))


def load_table(spark: SparkSession, path: str, bands: list[str], grid: Grid, at: Any = REDUCED) -> Cube:
    """One image out of a Parquet table ``y, x`` and bands, stamped with a fixed time."""
    df = spark.read.parquet(path)
    return Cube(df.select(F.lit(parse_time(at)).cast("timestamp_ntz").alias("t"), "y", "x", *[clean(F.col(f"`{b}`")).alias(b) for b in bands]), tuple(bands), grid, has_t=False, times=(parse_time(at),))
