"""Items that meet a geometry: which of a table's footprints share a point with a given one.

The geometry's edges are cut into bands of latitude, one value for all items; an item's edges meet those of its bands, so a
search is a filter that moves and holds no items.  A polygon that crosses no edge is inside of the other one or holds it,
which vertices of each part tell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.cube import column_names
from rasterloom.operators.footprints import edges_of
from rasterloom.operators.spatial import contains, geometries, rings

#: Bands of latitude into which a geometry is cut, at most; one for each so many edges.
BANDS, EDGES = 512, 16
_EDGE = "struct<x1: double, y1: double, x2: double, y2: double>"


def segments(geometry: dict) -> tuple[list[tuple[float, float, float, float]], list[tuple[float, float]], bool]:
    """Edges of a geometry, one vertex of each of its parts, and whether it has an area.  A point is an edge of no length."""
    edges, firsts, area = [], [], False
    for g in geometries(geometry):
        kind, c = g["type"], g["coordinates"]
        if kind in ("Polygon", "MultiPolygon"):
            parts, area = rings(g), True
        elif kind in ("LineString", "MultiLineString"):
            parts = [[tuple(map(float, p[:2])) for p in line] for line in ([c] if kind == "LineString" else c)]
        else:
            parts = [[tuple(map(float, p[:2]))] * 2 for p in ([c] if kind == "Point" else c)]
        for part in parts:
            firsts.append(part[0])
            edges += [(*a, *b) for a, b in zip(part[:-1], part[1:], strict=True)]
    return edges, firsts, area


def crosses(a: Column, b: Column) -> Column:
    """Whether two edges share a point, ends included."""

    def side(e: Column, x: Column, y: Column) -> Column:
        return F.signum((e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"]))

    boxes = F.lit(True)
    for c in "xy":
        one, two = (a[f"{c}1"], a[f"{c}2"]), (b[f"{c}1"], b[f"{c}2"])
        boxes = boxes & (F.least(*one) <= F.greatest(*two)) & (F.least(*two) <= F.greatest(*one))
    return boxes & (side(a, b["x1"], b["y1"]) * side(a, b["x2"], b["y2"]) <= 0) & (side(b, a["x1"], a["y1"]) * side(b, a["x2"], a["y2"]) <= 0)


def _bands(edges: list[tuple[float, float, float, float]]) -> tuple[list[list], float, float, int]:
    """The edges by band of latitude, the first one's lower end, their height and number."""
    south, north = min(min(e[1], e[3]) for e in edges), max(max(e[1], e[3]) for e in edges)
    n = max(1, min(BANDS, len(edges) // EDGES))
    height = (north - south) / n or 1.0
    rows: list[list] = [[] for _ in range(n)]
    for e in edges:
        low, high = (min(n - 1, max(0, math.floor((f(e[1], e[3]) - south) / height))) for f in (min, max))
        for band in range(low, high + 1):
            rows[band].append(e)
    return rows, south, height, n


def intersecting(items: DataFrame, geometry: dict) -> DataFrame:
    """The items whose footprint shares a point with a geometry in degrees.

    A footprint is the item's ``geometry`` (GeoJSON) or, without one that has an area, its bounding box.
    """
    edges, firsts, area = segments(geometry)
    if not edges:
        return items.limit(0)
    spark = items.sparkSession
    xs, ys = [v for e in edges for v in (e[0], e[2])], [v for e in edges for v in (e[1], e[3])]
    near = items.where((F.col("west") <= max(xs)) & (F.col("east") >= min(xs)) & (F.col("south") <= max(ys)) & (F.col("north") >= min(ys)))
    corners = [("west", "south"), ("east", "south"), ("east", "north"), ("west", "north")]
    box = F.array(*[F.struct(*[F.col(c).cast("double").alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), (*a, *b), strict=True)]) for a, b in zip(corners, [*corners[1:], corners[0]], strict=True)])
    own, low, high, theirs = column_names(items, 4)
    shape = F.coalesce(F.nullif(edges_of(F.col("geometry")), F.array().cast(f"array<{_EDGE}>")), box) if "geometry" in items.columns else box
    bands, south, height, n = _bands(edges)
    # one value for the whole search, of which an item takes its own bands
    given = spark.createDataFrame([(bands,)], f"bands array<array<{_EDGE}>>").scalar()
    place = lambda v: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v - south) / height))).cast("int")
    ends = {name: place(f(F.transform(own, lambda e: g(e["y1"], e["y2"])))) for name, f, g in ((low, F.array_min, F.least), (high, F.array_max, F.greatest))}
    placed = near.withColumn(own, shape).withColumns(ends).withColumn(theirs, F.slice(given, F.col(low) + 1, F.col(high) - F.col(low) + 1))
    hit = F.exists(theirs, lambda band: F.exists(band, lambda b: F.exists(own, lambda a: crosses(a, b))))
    if area:
        # a vertex of the footprint in the geometry: all edges that its parallel crosses are in the vertex's own band
        hit = hit | F.exists(own, lambda e: contains(F.get(theirs, place(e["y1"]) - F.col(low)), e["x1"], e["y1"]))
    vertices = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in firsts])
    hit = hit | F.exists(vertices, lambda v: contains(F.col(own), v["x"], v["y"]))
    return placed.where(hit).drop(own, low, high, theirs)
