"""Other grids: nearest cells, aggregates of cells, kernels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.cube import Cube, Grid, reproject, reproject_bounds
from rasterloom.errors import ProcessParameterInvalid


def _cubic(a: float) -> Callable[[Column], Column]:
    def k(d: Column) -> Column:
        near = (a + 2) * d * d * d - (a + 3) * d * d + 1
        far = a * d * d * d - 5 * a * d * d + 8 * a * d - 4 * a
        return F.when(d <= 1, near).when(d < 2, far).otherwise(0.0)

    return k


def _spline(d: Column) -> Column:
    near = F.lit(2 / 3) - d * d + d * d * d / 2
    return F.when(d <= 1, near).when(d < 2, F.pow(2 - d, F.lit(3.0)) / 6).otherwise(0.0)


def _lanczos(d: Column) -> Column:
    x = d * F.pi()
    return F.when(d == 0, 1.0).when(d < 3, 3 * F.sin(x) * F.sin(x / 3) / (x * x)).otherwise(0.0)


KERNELS: dict[str, tuple[int, Callable[[Column], Column]]] = {
    "bilinear": (1, lambda d: F.greatest(1 - d, F.lit(0.0))),
    "cubic": (2, _cubic(-0.5)),
    "cubicspline": (2, _spline),
    "lanczos": (3, _lanczos),
}
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "average": F.avg,
    "mode": lambda v: F.mode(v, True),
    "max": F.max,
    "min": F.min,
    "med": F.median,
    "q1": lambda v: F.percentile(v, F.lit(0.25)),
    "q3": lambda v: F.percentile(v, F.lit(0.75)),
    "rms": lambda v: F.sqrt(F.avg(v * v)),
    "sum": F.sum,
}
METHODS = {"near", "nearest", *KERNELS, *AGGREGATES}


def to_grid(data: Cube, grid: Grid, method: str = "near") -> Cube:
    """The cube on another grid.

    ``near`` takes the source cell under a target cell's centre.  Aggregates are over the
    source cells whose centres lie in a target cell.  Kernels weigh the valid source cells
    around a target centre; where the cell under the centre is missing, so is the result.
    Target cells without source values are missing.
    """
    method = {"nearest": "near", "cubic_spline": "cubicspline"}.get(method, method)
    if method not in METHODS:
        raise ProcessParameterInvalid(f"no method is named {method!r}")
    if data.grid == grid:
        return data
    old, spark = data.grid, data.df.sparkSession
    bands = list(data.bands)
    times = data.labels()
    if method in AGGREGATES:
        px, py = reproject(*old.centre(), old.crs, grid.crs)
        cells = old.cells(spark).select("y", "x", F.floor((grid.bounds[3] - py) / grid.dy).cast("int").alias("_y"), F.floor((px - grid.bounds[0]) / grid.dx).cast("int").alias("_x"))
        cells = cells.where(F.col("_y").between(0, grid.height - 1) & F.col("_x").between(0, grid.width - 1))
        df = data.df.join(cells, ["y", "x"]).groupBy("t", F.col("_y").alias("y"), F.col("_x").alias("x"))
        out = df.agg(*[AGGREGATES[method](data.band(b)).cast("double").alias(b) for b in bands])
        return data.with_df(out, grid=grid).dense(times)
    shift = grid.shift(old)
    if method == "near" and shift:
        # cells of the same size, side by side with the old ones: another numbering
        dy, dx = shift
        y, x = F.col("y") - dy, F.col("x") - dx
        inside = data.df.where(F.col("y").between(dy, dy + grid.height - 1) & F.col("x").between(dx, dx + grid.width - 1))
        return data.with_df(inside.select("t", y.cast("int").alias("y"), x.cast("int").alias("x"), *[data.band(b) for b in bands]), grid=grid).dense(times)
    px, py = reproject(*grid.centre(), grid.crs, old.crs)
    fx, fy = (px - old.bounds[0]) / old.dx, (old.bounds[3] - py) / old.dy
    cells = grid.cells(spark).select(F.col("y").alias("_y"), F.col("x").alias("_x"), fx.alias("_fx"), fy.alias("_fy"))
    if method == "near":
        cells = cells.select("_y", "_x", F.floor("_fy").cast("int").alias("y"), F.floor("_fx").cast("int").alias("x"))
        out = cells.join(data.df, ["y", "x"]).select("t", F.col("_y").alias("y"), F.col("_x").alias("x"), *[data.band(b) for b in bands])
        return data.with_df(out, grid=grid).dense(times)
    radius, kernel = KERNELS[method]
    at = F.sequence(F.lit(1 - radius), F.lit(radius))
    cells = cells.withColumn("_iy", F.explode(at)).withColumn("_ix", F.explode(at))
    cells = cells.withColumn("y", (F.floor(F.col("_fy") - 0.5) + F.col("_iy")).cast("int")).withColumn("x", (F.floor(F.col("_fx") - 0.5) + F.col("_ix")).cast("int"))
    weight = kernel(F.abs(F.col("_fy") - 0.5 - F.col("y"))) * kernel(F.abs(F.col("_fx") - 0.5 - F.col("x")))
    cells = cells.where(F.col("y").between(0, old.height - 1) & F.col("x").between(0, old.width - 1)).withColumn("_w", weight)
    cells = cells.where(F.col("_fy").between(0, old.height) & F.col("_fx").between(0, old.width))
    cells = cells.withColumn("_c", (F.floor("_fy") == F.col("y")) & (F.floor("_fx") == F.col("x")))
    df = cells.join(data.df, ["y", "x"]).groupBy("t", F.col("_y").alias("y"), F.col("_x").alias("x"))

    def weighed(v: Column) -> Column:
        total = F.try_divide(F.sum(F.col("_w") * v), F.sum(F.when(v.isNotNull(), F.col("_w"))))
        return F.when(F.bool_or(F.col("_c") & v.isNotNull()), total)

    return data.with_df(df.agg(*[weighed(data.band(b)).alias(b) for b in bands]), grid=grid).dense(times)


def resample_cube_spatial(data: Cube, target: Cube, method: str = "near") -> Cube:
    """The first cube on the second one's grid."""
    return to_grid(data, target.grid, method)


def resample_spatial(data: Cube, projection: int | None = None, resolution: float | list[float] = 0, align: str = "upper-left", method: str = "near") -> Cube:
    """Another projection, another cell size, or both; with neither nothing changes.

    Without a resolution the number of cells stays.  Grids start at the upper left corner;
    other alignments are accepted and mean the same.
    """
    res = resolution[0] if isinstance(resolution, (list, tuple)) else resolution
    if projection is None and not res:
        return data
    crs = projection or data.grid.crs
    bounds = reproject_bounds(data.grid.bounds, data.grid.crs, crs)
    grid = Grid.covering(bounds, res, crs) if res else Grid(data.grid.width, data.grid.height, bounds, crs)
    return to_grid(data, grid, method)


