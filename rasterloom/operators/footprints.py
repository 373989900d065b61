"""Footprints of items: geometries that a cube carries along, and the cells that they hold.

A cube's footprints are a table ``t, geometry``: GeoJSON in degrees, beside the pixels and independent of the grid.
A row without a time holds for all times, one without a geometry holds every cell.  Where slices are reduced their
footprints count together: a cell is inside if any of them holds it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.cube import Cube, Footprints, Grid, reproject
from rasterloom.operators.spatial import contains, strips_to_cells

_RINGS = "struct<coordinates: array<array<array<double>>>>"
_MANY = "struct<coordinates: array<array<array<array<double>>>>>"


def rings_of(geometry: Column) -> Column:
    """All rings of a GeoJSON polygon or multi-polygon (or of a feature with one); NULL where there is no area."""
    inner = F.coalesce(F.get_json_object(geometry, "$.geometry"), geometry)
    kind = F.get_json_object(inner, "$.type")
    return F.when(kind == "Polygon", F.from_json(inner, _RINGS)["coordinates"]).when(kind == "MultiPolygon", F.flatten(F.from_json(inner, _MANY)["coordinates"]))


def edges_of(geometry: Column, crs_from: int = 4326, crs_to: int = 4326) -> Column:
    """Edges of all rings as ``x1, y1, x2, y2`` in another projection; open rings are closed."""

    def of_ring(ring: Column) -> Column:
        places = F.transform(ring, lambda p: F.struct(*[c.alias(n) for n, c in zip("xy", reproject(p[0], p[1], crs_from, crs_to), strict=True)]))
        return F.transform(
            places, lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.get(places, (i + 1) % F.size(places))["x"].alias("x2"), F.get(places, (i + 1) % F.size(places))["y"].alias("y2"))
        )

    return F.flatten(F.transform(rings_of(geometry), of_ring))


def cells_of_geometries(shapes: DataFrame, grid: Grid, keys: list[str], test: Callable[[Column, Column, Column], Column] = contains) -> DataFrame:
    """``keys, y, x``: the cells of each row's ``geometry`` (degrees) by a test of their centres.

    Geometries without an area hold no cell.
    """
    table = shapes.select(*keys, edges_of(F.col("geometry"), 4326, grid.crs).alias("edges")).where("size(edges) > 0")
    xs, ys = F.transform("edges", lambda e: e["x1"]), F.transform("edges", lambda e: e["y1"])
    rows = {"y0": F.floor((grid.bounds[3] - F.array_max(ys)) / grid.dy), "y1": F.floor((grid.bounds[3] - F.array_min(ys)) / grid.dy)}
    cols = {"x0": F.floor((F.array_min(xs) - grid.bounds[0]) / grid.dx), "x1": F.floor((F.array_max(xs) - grid.bounds[0]) / grid.dx)}
    box = {n: F.greatest(F.lit(0), F.least(F.lit(size - 1), v)) for of, size in ((rows, grid.height), (cols, grid.width)) for n, v in of.items()}
    meets = (rows["y1"] >= 0) & (rows["y0"] < grid.height) & (cols["x1"] >= 0) & (cols["x0"] < grid.width)
    table = table.where(meets).withColumns({n: v.cast("int") for n, v in box.items()})
    return strips_to_cells(table, grid, keys, test)


def inside(footprints: Footprints, data: Cube) -> tuple[DataFrame, Column]:
    """The cube's rows with what is needed to tell, and a test whether a row's cell is inside of its footprints."""
    df, grid = footprints.df, data.grid
    shapes = df.where("geometry is not null")
    always = cells_of_geometries(shapes.where("t is null").select("geometry"), grid, []).distinct().withColumn("_always", F.lit(True))
    timed = cells_of_geometries(shapes.where("t is not null"), grid, ["t"]).distinct().withColumn("_timed", F.lit(True))
    whole = F.bool_or(F.col("geometry").isNull())
    times = df.where("t is not null").groupBy("t").agg(whole.alias("_whole"))
    any_time = df.where("t is null").agg(F.count("*").alias("n"), whole.alias("whole")).first()
    rows = data.df.join(always, ["y", "x"], "left").join(timed, ["t", "y", "x"], "left").join(times, "t", "left")
    # a time that has no footprint at all, not even one of all times, is not cut
    held = F.coalesce("_always", "_timed", "_whole", F.lit(any_time[0] == 0)) | F.lit(bool(any_time[1]))
    known = F.coalesce("_whole", F.lit(False))
    return rows, held | known


def cut_to_footprints(data: Cube) -> Cube:
    """Only what lies in the cube's own footprints; a cube without any is left as it is."""
    if data.footprints is None:
        return data
    rows, held = inside(data.footprints, data)
    out = rows.select("t", "y", "x", *[F.when(held, data.band(b)).alias(b) for b in data.bands])
    return data.with_df(out, times=data.times)
