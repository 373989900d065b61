"""Operators on two cubes."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import functions as F

from rasterloom.cube import KEYS, Cube
from rasterloom.errors import IncompatibleDataCubes, OverlapResolverMissing
from rasterloom.functions.maths import col
from rasterloom.operators.resample import resample_cube_spatial


def merge_cubes(cube1: Cube, cube2: Cube, overlap_resolver: Callable | None = None, context: Any = None) -> Cube:
    """The union of timestamps and of bands.

    Where both cubes have a timestamp, bands of one cube only go side by side, and shared ones
    go through the resolver.  As cubes are dense, a row tells that a cube has a timestamp.
    Bands without names of their own overlap.  The second cube is brought to the first one's
    grid, nearest cells.
    """
    if not cube1.bands:
        return cube2
    if not cube2.bands:
        return cube1
    if not (cube1.has_bands and cube2.has_bands) and len(cube1.bands) == len(cube2.bands):
        cube2 = cube2.select({a: cube2.band(b) for a, b in zip(cube1.bands, cube2.bands, strict=True)})
    if cube1.grid != cube2.grid:
        cube2 = resample_cube_spatial(cube2, cube1, "near")
    shared = [b for b in cube1.bands if b in cube2.bands]
    if shared and overlap_resolver is None:
        if set(cube1.labels()) & set(cube2.labels()):
            raise OverlapResolverMissing(f"both cubes have {', '.join(shared)} at the same time")
    a = cube1.df.select(*KEYS, F.struct(*[cube1.band(b) for b in cube1.bands]).alias("_a"))
    c = cube2.df.select(*KEYS, F.struct(*[cube2.band(b) for b in cube2.bands]).alias("_b"))
    df = a.join(c, list(KEYS), "full_outer")
    one, two = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    columns = {}
    for b in [*cube1.bands, *(x for x in cube2.bands if x not in cube1.bands)]:
        if b not in cube2.bands:
            columns[b] = F.col("_a").getField(b)
        elif b not in cube1.bands:
            columns[b] = F.col("_b").getField(b)
        else:
            x, y = F.col("_a").getField(b), F.col("_b").getField(b)
            value = F.when(one & ~two, x).when(two & ~one, y)
            columns[b] = value if overlap_resolver is None else value.otherwise(col(overlap_resolver(x, y, context)))
    known = None if cube1.times is None or cube2.times is None else tuple(sorted({*cube1.times, *cube2.times}))
    marks = None if cube1.footprints is None else cube1.footprints.joined(cube2.footprints)
    return Cube(df, (), cube1.grid, cube1.has_t or cube2.has_t, times=known, footprints=marks).select(columns)


def mask(data: Cube, mask: Cube, replacement: float | None = None) -> Cube:
    """Replace valid values where a mask is valid and not 0.

    A mask of one slice holds for all, one of one band for all bands; else timestamps and
    numbers of bands must match.  A mask of another cell size is brought to the data's grid,
    nearest cells; its extent must be the same.
    """
    if mask.grid.crs != data.grid.crs or mask.grid.bounds != data.grid.bounds:
        raise IncompatibleDataCubes("mask and data have different extents")
    if len(mask.bands) not in (1, len(data.bands)):
        raise IncompatibleDataCubes(f"the mask has {len(mask.bands)} bands, the data {len(data.bands)}")
    if mask.grid != data.grid:
        mask = resample_cube_spatial(mask, data, "near")
    times = mask.labels()
    if not times:
        raise IncompatibleDataCubes("the mask is empty")
    keys = ["y", "x"] if len(times) == 1 else list(KEYS)
    if len(times) > 1:
        absent = set(data.labels()) - set(times)
        if absent:
            raise IncompatibleDataCubes(f"the mask has nothing at {min(absent)}")
    active = [mask.band(b).isNotNull() & (mask.band(b) != 0) for b in mask.bands]
    m = mask.df.select(*keys, *[F.coalesce(c, F.lit(False)).alias(f"_m{i}") for i, c in enumerate(active)])
    df = data.df.join(m, keys, "left")
    new = F.lit(None).cast("double") if replacement is None else F.lit(float(replacement))
    out = {}
    for i, b in enumerate(data.bands):
        on = F.col(f"_m{i if len(mask.bands) > 1 else 0}")
        out[b] = F.when(data.band(b).isNotNull() & on, new).otherwise(data.band(b))
    return data.with_df(df, times=data.times).select(out)
