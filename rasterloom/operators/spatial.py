"""Polygons: masks and aggregation."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.cube import KEYS, Cube, Grid, reproject_bounds
from rasterloom.errors import FeatureUnsupported, OutputLimitExceeded, ProcessParameterInvalid
from rasterloom.functions.maths import col
from rasterloom.functions.reducers import Series

Ring = list[tuple[float, float]]
#: Rows of the grid in one piece of a shape's work.
STRIP = 64
#: Polygons up to which a mask tests them in place.
FEW_POLYGONS = 8
#: Values of features that may come to the driver as one document.
MAX_VALUES = 1_000_000
_TYPES = {"Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection", "Feature", "FeatureCollection"}


def geometries(geojson: dict) -> list[dict]:
    """The geometries of a GeoJSON object, one per feature."""
    kind = geojson.get("type") if isinstance(geojson, dict) else None
    if kind not in _TYPES:
        raise ProcessParameterInvalid(f"{kind!r} is no GeoJSON type")
    if kind == "FeatureCollection":
        return [g for f in geojson.get("features") or [] for g in geometries(f)]
    if kind == "Feature":
        return geometries(geojson["geometry"]) if geojson.get("geometry") else []
    if kind == "GeometryCollection":
        return [g for x in geojson.get("geometries") or [] for g in geometries(x)]
    return [geojson]


def rings(geometry: dict, crs_from: int = 4326, crs_to: int = 4326) -> list[Ring]:
    """All rings of a polygon or multi-polygon, in the target's coordinates."""
    kind = geometry["type"]
    if kind == "Polygon":
        found = geometry["coordinates"]
    elif kind == "MultiPolygon":
        found = [r for p in geometry["coordinates"] for r in p]
    else:
        raise FeatureUnsupported(f"{kind} has no area")
    out = []
    for ring in found:
        ring = [tuple(map(float, p[:2])) for p in ring]
        if crs_from != crs_to:
            ring = [reproject_bounds((x, y, x, y), crs_from, crs_to)[:2] for x, y in ring]
        out.append(ring if ring[0] == ring[-1] else [*ring, ring[0]])
    return out


def _edges(found: list[Ring]) -> Column:
    """Edges as an array literal of (x1, y1, x2, y2)."""
    pairs = [(*a, *b) for r in found for a, b in zip(r[:-1], r[1:], strict=True)]
    names = ("x1", "y1", "x2", "y2")
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, e, strict=True)]) for e in pairs])


def contains(edges: Column, px: Column, py: Column) -> Column:
    """Even-odd rule: an odd number of edges lies to the right."""
    crossed = F.filter(edges, lambda e: ((e["y1"] > py) != (e["y2"] > py)) & (px < F.try_divide((e["x2"] - e["x1"]) * (py - e["y1"]), e["y2"] - e["y1"]) + e["x1"]))
    return F.size(crossed) % 2 == 1


def overlaps(edges: Column, px: Column, py: Column, dx: float, dy: float) -> Column:
    """Whether the cell around a centre shares an area with the polygon.

    Its centre is inside, or an edge passes through its inner part (separating axes of a
    segment and a box).
    """
    rx, ry = dx / 2, dy / 2

    def hit(e: Column) -> Column:
        hx, hy = (e["x2"] - e["x1"]) / 2, (e["y2"] - e["y1"]) / 2
        mx, my = (e["x1"] + e["x2"]) / 2 - px, (e["y1"] + e["y2"]) / 2 - py
        return (F.abs(mx) < rx + F.abs(hx)) & (F.abs(my) < ry + F.abs(hy)) & (F.abs(hx * my - hy * mx) < rx * F.abs(hy) + ry * F.abs(hx))

    return contains(edges, px, py) | F.exists(edges, hit)


def _boxed(found: list[Ring]) -> tuple[float, float, float, float]:
    xs, ys = [x for r in found for x, _ in r], [y for r in found for _, y in r]
    return min(xs), min(ys), max(xs), max(ys)


def mask_polygon(data: Cube, mask: dict, replacement: float | None = None, inside: bool = False) -> Cube:
    """Replace valid values of cells whose centres are outside (or inside) of all polygons.

    Without a polygon nothing changes.  A few polygons are tested in place; of many, the cells whose
    centres they hold are made first and joined.
    """
    found = [rings(g, 4326, data.grid.crs) for g in geometries(mask) if g["type"] in ("Polygon", "MultiPolygon")]
    if not found:
        return data
    df = data.df
    if len(found) <= FEW_POLYGONS:
        px, py = data.grid.centre()
        held = F.lit(False)
        for r in found:
            west, south, east, north = _boxed(r)
            held = held | (px.between(west, east) & py.between(south, north) & contains(_edges(r), px, py))
    else:
        cells = _cells_of(data, found, lambda e, px, py: contains(e, px, py)).select("y", "x", F.lit(True).alias("_in")).distinct()
        df, held = df.join(cells, ["y", "x"], "left"), F.coalesce("_in", F.lit(False))
    new = F.lit(None).cast("double") if replacement is None else F.lit(float(replacement))
    hit = held if inside else ~held
    return data.with_df(df, times=data.times).select({b: F.when(data.band(b).isNotNull() & hit, new).otherwise(data.band(b)) for b in data.bands})


def cutline(data: Cube, footprints: dict | list[dict | None] | None = None) -> Cube:
    """Only what lies in one of the footprints (geometries in degrees); other cells are NULL.

    Without a list they are those that the cube carries along from its items; a cube that has none is not cut.
    A missing footprint in a list is that of nothing, and only areas count; where none is left, every value
    is missing.
    """
    if footprints is None:
        from rasterloom.operators.footprints import cut_to_footprints

        return cut_to_footprints(data)
    given = [f for f in (footprints if isinstance(footprints, list) else [footprints]) if f is not None]
    shapes = [g for f in given for g in geometries(f) if g["type"] in ("Polygon", "MultiPolygon")]
    if not shapes:
        return data.select({b: F.lit(None).cast("double") for b in data.bands})
    return mask_polygon(data, {"type": "GeometryCollection", "geometries": shapes})


def union_of_footprints(footprints: list[dict | None]) -> list[dict] | None:
    """The footprint of images together: none, that is everything, where one of them has none."""
    return None if not footprints or any(f is None for f in footprints) else list(footprints)


def _cells_of(data: Cube, shapes: list[list[Ring]], test: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """``(feature_index, y, x)`` of the cells in a shape's bounding box that pass a test of its edges.

    Shapes are a table.  Strips of ``STRIP`` rows, each with the edges that reach it, are dealt out before
    cells are made, so neither a large shape nor many shapes are one task's work.
    """
    spark, g = data.df.sparkSession, data.grid
    rows = []
    for i, found in enumerate(shapes):
        y0, y1, x0, x1 = g.window(_boxed(found))
        rows.append((i, max(0, y0), min(g.height - 1, y1), max(0, x0), min(g.width - 1, x1), [(*a, *b) for r in found for a, b in zip(r[:-1], r[1:], strict=True)]))
    edge = "edges array<struct<x1: double, y1: double, x2: double, y2: double>>"
    table = spark.createDataFrame(rows, f"feature_index int, y0 int, y1 int, x0 int, x1 int, {edge}")
    return strips_to_cells(table, g, ["feature_index"], test)


def strips_to_cells(table: DataFrame, grid: Grid, keys: list[str], test: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """``keys, y, x`` of the cells that pass a test, out of shapes ``keys, y0, y1, x0, x1, edges``."""
    spark, g = table.sparkSession, grid
    strips = table.where("y0 <= y1 and x0 <= x1").withColumn("s", F.explode(F.sequence(F.expr(f"y0 div {STRIP}"), F.expr(f"y1 div {STRIP}"))))
    strips = strips.withColumn("y0", F.greatest("y0", F.col("s") * STRIP).cast("int")).withColumn("y1", F.least("y1", F.col("s") * STRIP + STRIP - 1).cast("int"))
    north, south = g.bounds[3] - F.col("y0") * g.dy, g.bounds[3] - (F.col("y1") + 1) * g.dy
    near = F.filter("edges", lambda e: (F.greatest(e["y1"], e["y2"]) >= south) & (F.least(e["y1"], e["y2"]) <= north))
    strips = strips.select(*keys, "y0", "y1", "x0", "x1", near.alias("edges"))
    strips = strips.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, "y0")
    cells = strips.withColumn("y", F.explode(F.sequence("y0", "y1"))).withColumn("x", F.explode(F.sequence("x0", "x1")))
    return cells.where(test(F.col("edges"), *g.centre())).select(*keys, "y", "x")


def covered_cells(data: Cube, geojson: dict) -> DataFrame:
    """``(feature_index, y, x)`` of the cells that share an area with each polygon."""
    g = data.grid
    shapes = [rings(x, 4326, g.crs) for x in geometries(geojson)]
    if not shapes:
        raise ProcessParameterInvalid("there is no geometry")
    return _cells_of(data, shapes, lambda e, px, py: overlaps(e, px, py, g.dx, g.dy))


@dataclass(frozen=True)
class Zones:
    """What ``aggregate_spatial`` gives, with the features that its rows belong to."""

    rows: DataFrame
    features: dict
    target_dimension: str | None = None

    def collection(self, limit: int = MAX_VALUES) -> dict:
        """A feature collection in the driver, if it has no more than ``limit`` values."""
        if self.rows.limit(limit + 1).count() > limit:
            raise OutputLimitExceeded("there are too many values for one document; write a table instead")
        return feature_collection(self.rows, self.features, self.target_dimension)

    def table(self) -> DataFrame:
        """``date, feature_index, value``."""
        return self.rows.select(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), "feature_index", "value")


def zonal_statistics(data: Cube, geometries: dict, reducer: Callable, target_dimension: str | None = None, context: Any = None) -> Zones:
    """``aggregate_spatial`` whose result can be saved with its features."""
    return Zones(aggregate_spatial(data, geometries, reducer, target_dimension, context), geometries, target_dimension)


def aggregate_spatial(data: Cube, geometries: dict, reducer: Callable, target_dimension: str | None = None, context: Any = None) -> DataFrame:
    """``(feature_index, t, value, total_count, valid_count)`` of the first band.

    A cell belongs to a feature if they share an area, so one cell may belong to several.
    A feature without cells has no row.
    """
    band = data.band(data.bands[0])
    cells = covered_cells(data, geometries)
    rows = data.df.select(*KEYS, band).join(cells, ["y", "x"])
    value = col(reducer(Series(band, F.struct("t", "y", "x")), context)).cast("double")
    return rows.groupBy("feature_index", "t").agg(value.alias("value"), F.count(F.lit(1)).alias("total_count"), F.count(band).alias("valid_count"))


def feature_collection(rows: DataFrame, geojson: dict, target_dimension: str | None = None) -> dict:
    """The features with ``values`` by timestamp; the table has a row per feature and time."""
    features = [{"type": "Feature", "geometry": g, "properties": {"values": {}}} for g in geometries(geojson)]
    for r in rows.orderBy("feature_index", "t").toLocalIterator():
        one = r["value"]
        if target_dimension:
            one = {"value": one, "total_count": r["total_count"], "valid_count": r["valid_count"]}
        features[r["feature_index"]]["properties"]["values"][r["t"].isoformat()] = one
    return {"type": "FeatureCollection", "features": [f for f in features if f["properties"]["values"]]}


def xyz_to_bbox(data: dict, context: Any = None) -> dict:
    """The extent of a web map tile, in metres."""
    if not all(k in data for k in "xyz"):
        raise ProcessParameterInvalid("a tile has x, y and z")
    half = math.pi * 6378137.0
    size = 2 * half / 2 ** data["z"]
    west, north = -half + data["x"] * size, half - data["y"] * size
    return {"west": west, "south": north - size, "east": west + size, "north": north, "crs": 3857}


def xyz_to_tileinfo(x: int, y: int, z: int, stage: str = "test", context: Any = None) -> dict:
    return {"x": x, "y": y, "z": z, "stage": stage, "context": context or {}}
