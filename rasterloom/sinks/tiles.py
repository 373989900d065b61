"""All web map tiles of a zoom level in one job."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.cube import Cube, Grid, reproject_bounds
from rasterloom.errors import ProcessParameterInvalid
from rasterloom.operators.resample import to_grid
from rasterloom.sinks.save import png

#: Half the side of the square that web maps show, in metres.
HALF = math.pi * 6378137.0
MAX_SIDE = 1024


def zoom_grid(grid: Grid, z: int, size: int = 256) -> tuple[Grid, int, int]:
    """The cells of the tiles of a zoom level that meet a grid, with the column and row of the first tile."""
    west, south, east, north = reproject_bounds(grid.bounds, grid.crs, 3857)
    side, last = 2 * HALF / 2**z, 2**z - 1
    x0, x1 = (min(last, max(0, math.floor((v + HALF) / side))) for v in (west, math.nextafter(east, -math.inf)))
    y0, y1 = (min(last, max(0, math.floor((HALF - v) / side))) for v in (north, math.nextafter(south, math.inf)))
    bounds = (-HALF + x0 * side, HALF - (y1 + 1) * side, -HALF + (x1 + 1) * side, HALF - y0 * side)
    return Grid((x1 - x0 + 1) * size, (y1 - y0 + 1) * size, bounds, 3857), x0, y0


def tiles_of(data: Cube, z: int, size: int = 256, method: str = "near") -> DataFrame:
    """``z, x, y, png``: the tiles of a zoom level that have a value, of a cube of one slice.

    The cube is brought to the level's cells, cells are dealt to their tiles by one shuffle, and each tile, which holds ``size``
    by ``size`` cells whatever the cube, is encoded in a task.
    """
    if not 1 <= size <= MAX_SIDE:
        raise ProcessParameterInvalid(f"a tile has 1 to {MAX_SIDE} cells a side")
    if len(data.labels()) > 1:
        raise ProcessParameterInvalid("a map takes one slice; reduce time first")
    grid, x0, y0 = zoom_grid(data.grid, z, size)
    cells = to_grid(data, grid, method)
    bands = list(data.bands)
    some = F.coalesce(*[cells.band(b) for b in bands]).isNotNull()
    rows = cells.df.where(some).select(
        F.expr(f"cast(x div {size} + {x0} as int)").alias("tile_x"), F.expr(f"cast(y div {size} + {y0} as int)").alias("tile_y"),
        (F.col("x") % size).cast("int").alias("column"), (F.col("y") % size).cast("int").alias("row"), *[cells.band(b).alias(f"_{i}") for i, b in enumerate(bands)],
    )

    def encode(tile: pa.Table) -> pa.Table:
        image = np.full((len(bands), size, size), np.nan)
        row, column = tile["row"].to_numpy(), tile["column"].to_numpy()
        for i in range(len(bands)):
            image[i, row, column] = tile[f"_{i}"].to_numpy()
        place = {"z": pa.array([z], pa.int32()), "x": pa.array([tile["tile_x"][0].as_py()], pa.int32()), "y": pa.array([tile["tile_y"][0].as_py()], pa.int32())}
        return pa.table({**place, "png": pa.array([png(image)], pa.binary())})

    return rows.groupBy("tile_x", "tile_y").applyInArrow(encode, "z int, x int, y int, png binary")
