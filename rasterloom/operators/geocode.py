"""Radar geometry: where the cells of a map grid lie in an image, and the image on that grid.

An image in radar geometry has no grid of its own on the map, only control points: rows
``item_id, line, pixel, x, y`` with coordinates in ``crs``.  A thin-plate spline through them
leads from coordinates to lines and pixels.  It is solved once per image, in the task that holds the image's
points, and evaluated block by block of cells; a cell's image pixels are then met
through blocks of the image.  Lines and pixels count from the outer corner of the first one, so halves are centres.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom import projections
from rasterloom.cube import Cube, Grid, reproject
from rasterloom.errors import ProcessParameterInvalid
from rasterloom.sources.catalog import mosaic

#: Control points of an image; their system of equations is one task's.
MAX_POINTS = 4096
#: Cells along a side of a block of the grid, and lines and pixels along one of the image.
CELLS, PIXELS = 128, 256
#: Products of cells and control points that are held at a time.
AT_ONCE = 1 << 21

SPLINE = "item_id string, knots_x array<double>, knots_y array<double>, line array<double>, pixel array<double>, x0 double, y0 double, scale double, west double, south double, east double, north double"


def _bending(squared: np.ndarray) -> np.ndarray:
    """r^2 log r out of r^2; 0 at 0."""
    return 0.5 * squared * np.log(np.where(squared > 0, squared, 1.0))


def _terms(x: np.ndarray, y: np.ndarray, kx: np.ndarray, ky: np.ndarray) -> np.ndarray:
    """A column per knot, then 1, x and y."""
    bent = _bending((x[:, None] - kx) ** 2 + (y[:, None] - ky) ** 2)
    return np.column_stack([bent, np.ones_like(x), x, y])


def solve(x: np.ndarray, y: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[float, float, float]]:
    """Knots, coefficients (a column per value) and scaling of the spline through points.

    Coordinates are moved and scaled to -1..1 first, which keeps the system well conditioned and does
    not change the spline.  Points given more than once count once.
    """
    x0, y0 = (x.min() + x.max()) / 2, (y.min() + y.max()) / 2
    scale = max(x.max() - x.min(), y.max() - y.min()) / 2 or 1.0
    points, first = np.unique(np.column_stack([(x - x0) / scale, (y - y0) / scale]), axis=0, return_index=True)
    kx, ky = points[:, 0], points[:, 1]
    terms = _terms(kx, ky, kx, ky)
    system = np.zeros((len(kx) + 3, len(kx) + 3))
    system[: len(kx)] = terms
    system[len(kx) :, : len(kx)] = terms[:, len(kx) :].T
    right = np.zeros((len(system), values.shape[1]))
    right[: len(kx)] = values[first]
    # fewer than three points, or all on a line, leave the plane open: the smallest one is taken
    return kx, ky, np.linalg.lstsq(system, right, rcond=1e-13)[0], (x0, y0, scale)


def splines(points: DataFrame) -> DataFrame:
    """One row per image: knots and coefficients of the spline from ``x, y`` to ``line, pixel``.

    Points with a null or non-finite number are left out; an image without points has no row.
    """
    names = ("x", "y", "line", "pixel")
    ok = F.lit(True)
    for n in names:
        ok = ok & F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    given = points.select(F.col("item_id").cast("string").alias("item_id"), *[F.col(n).cast("double").alias(n) for n in names]).where(ok)

    def fit(table: pa.Table) -> pa.Table:
        if table.num_rows > MAX_POINTS:
            raise ValueError(f"an image has {MAX_POINTS} control points at most")
        rows = table.sort_by([(n, "ascending") for n in names])
        x, y, line, pixel = (rows[n].to_numpy() for n in names)
        kx, ky, c, (x0, y0, scale) = solve(x, y, np.column_stack([line, pixel]))
        ends = [float(v) for v in (x.min(), y.min(), x.max(), y.max())]
        return pa.table({
            "item_id": [rows["item_id"][0].as_py()], "knots_x": [kx], "knots_y": [ky], "line": [c[:, 0]], "pixel": [c[:, 1]], "x0": [x0], "y0": [y0], "scale": [scale],
            **dict(zip(("west", "south", "east", "north"), ([e] for e in ends), strict=True)),
        })

    return given.groupBy("item_id").applyInArrow(fit, SPLINE)


def _place(grid: Grid, crs: int):
    """Blocks of cells, each with a spline, to their cells with line and pixel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                y, x = (a.ravel() for a in np.mgrid[row["top"] : min(row["top"] + CELLS, grid.height), row["left"] : min(row["left"] + CELLS, grid.width)])
                px, py = projections.transform(grid.bounds[0] + (x + 0.5) * grid.dx, grid.bounds[3] - (y + 0.5) * grid.dy, grid.crs, crs, projections.ARRAYS)
                px, py = (px - row["x0"]) / row["scale"], (py - row["y0"]) / row["scale"]
                kx, ky, c = np.array(row["knots_x"]), np.array(row["knots_y"]), np.column_stack([row["line"], row["pixel"]])
                step = max(1, AT_ONCE // (len(kx) + 3))
                found = np.vstack([_terms(px[s : s + step], py[s : s + step], kx, ky) @ c for s in range(0, len(x), step)])
                cols = [pa.array([row["item_id"]] * len(x), pa.string()), pa.array(y, pa.int32()), pa.array(x, pa.int32()), pa.array(found[:, 0]), pa.array(found[:, 1])]
                yield pa.RecordBatch.from_arrays(cols, names=["item_id", "y", "x", "line", "pixel"])

    return run


def box_on(grid: Grid, crs: int, margin: float) -> tuple[Column, Column, Column, Column]:
    """First and last row and column of the cells that meet the box of an image's points, a little wider."""
    pad = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south")) * margin
    west, east, south, north = F.col("west") - pad, F.col("east") + pad, F.col("south") - pad, F.col("north") + pad
    n = projections.SIDE_POINTS - 1

    def sides(i: Column) -> Column:
        x, y = west + (east - west) * i / n, south + (north - south) * i / n
        ends = ((x, south), (x, north), (west, y), (east, y))
        return F.array(*[F.struct(*[c.alias(k) for k, c in zip("xy", reproject(*p, crs, grid.crs), strict=True)]) for p in ends])

    points = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n)), sides))
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    rows = [F.floor((grid.bounds[3] - v) / grid.dy) for v in (F.array_max(y), F.array_min(y))]
    cols = [F.floor((v - grid.bounds[0]) / grid.dx) for v in (F.array_min(x), F.array_max(x))]
    return F.greatest(rows[0], F.lit(0)), F.least(rows[1], F.lit(grid.height - 1)), F.greatest(cols[0], F.lit(0)), F.least(cols[1], F.lit(grid.width - 1))


def inverse_map(curves: DataFrame, grid: Grid, crs: int = 4326, margin: float = 0.05) -> DataFrame:
    """``item_id, y, x, line, pixel``: where the cells of a grid lie in each image.

    ``curves`` are the ``splines`` of control points in ``crs``.  Cells of the blocks that meet the box of an image's points
    (wider by ``margin`` of its size) are made; lines and pixels are fractions and may lie outside of the image.
    """
    y0, y1, x0, x1 = box_on(grid, crs, margin)
    asked = curves.withColumns({"y0_": y0, "y1_": y1, "x0_": x0, "x1_": x1}).where("y0_ <= y1_ and x0_ <= x1_")
    tops = F.explode(F.transform(F.sequence(F.expr(f"y0_ div {CELLS}"), F.expr(f"y1_ div {CELLS}")), lambda i: i * CELLS))
    lefts = F.explode(F.transform(F.sequence(F.expr(f"x0_ div {CELLS}"), F.expr(f"x1_ div {CELLS}")), lambda i: i * CELLS))
    asked = asked.withColumn("top", tops).withColumn("left", lefts).select("top", "left", *curves.columns).repartition("item_id", "top", "left")
    return asked.mapInArrow(_place(grid, crs), "item_id string, y int, x int, line double, pixel double")


# Kernels of a distance in pixels, with how far they reach; the same ones as between grids.


def _cubic(d: np.ndarray) -> np.ndarray:
    return np.where(d <= 1, 1.5 * d**3 - 2.5 * d**2 + 1, np.where(d < 2, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2, 0.0))


def _spline(d: np.ndarray) -> np.ndarray:
    return np.where(d <= 1, 2 / 3 - d * d + d**3 / 2, np.where(d < 2, (2 - d) ** 3 / 6, 0.0))


def _lanczos(d: np.ndarray) -> np.ndarray:
    return np.where(d < 3, np.sinc(d) * np.sinc(d / 3), 0.0)


KERNELS: dict[str, tuple[int, Callable[[np.ndarray], np.ndarray]]] = {
    "near": (0, lambda d: np.ones_like(d)),
    "bilinear": (1, lambda d: np.maximum(1 - d, 0.0)),
    "cubic": (2, _cubic),
    "cubicspline": (2, _spline),
    "lanczos": (3, _lanczos),
}

_BLOCK = ["item_id", "by", "bx"]


def sample(image: np.ndarray, line: np.ndarray, pixel: np.ndarray, method: str) -> np.ndarray:
    """Values of ``image`` (bands, lines, pixels; NaN is missing) at fractions of lines and pixels.

    Missing pixels have no weight; where the pixel at the position itself is missing, so is the result.
    """
    reach, kernel = KERNELS[method]
    n_lines, n_pixels = image.shape[1:]
    row, col = np.floor(line).astype(np.int64), np.floor(pixel).astype(np.int64)
    inside = (row >= 0) & (row < n_lines) & (col >= 0) & (col < n_pixels)
    here = image[:, np.clip(row, 0, n_lines - 1), np.clip(col, 0, n_pixels - 1)]
    here = np.where(inside, here, np.nan)
    if not reach:
        return here
    first_row, first_col = np.floor(line - 0.5).astype(np.int64), np.floor(pixel - 0.5).astype(np.int64)
    total, weights = np.zeros_like(here), np.zeros_like(here)
    for i in range(1 - reach, reach + 1):
        r = first_row + i
        wr = kernel(np.abs(line - 0.5 - r))
        for j in range(1 - reach, reach + 1):
            c = first_col + j
            ok = (r >= 0) & (r < n_lines) & (c >= 0) & (c < n_pixels)
            v = image[:, np.clip(r, 0, n_lines - 1), np.clip(c, 0, n_pixels - 1)]
            w = np.where(ok, wr * kernel(np.abs(pixel - 0.5 - c)), 0.0)
            valid = ~np.isnan(v)
            total += np.where(valid, v, 0.0) * w
            weights += valid * w
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isnan(here) | (weights == 0), np.nan, total / weights)


def _gather(bands: list[str], method: str):
    """A stream of blocks: first the pixels of each, then the cells that ask for them."""
    reach = KERNELS[method][0]
    side = PIXELS + 2 * reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, image = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("item_id").to_pylist()
            by, bx, role = (batch.column(c).to_numpy() for c in ("by", "bx", "role"))
            changed = np.array([True] + [a != b for a, b in zip(names[1:], names[:-1], strict=True)])
            changed[1:] |= (by[1:] != by[:-1]) | (bx[1:] != bx[:-1]) | (role[1:] != role[:-1])
            starts = np.r_[np.flatnonzero(changed), batch.num_rows]
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                key, part = (names[s], by[s], bx[s]), batch.slice(s, e - s)
                if key != now:
                    now, image = key, np.full((len(bands), side, side), np.nan)
                line, pixel = (part.column(c).to_numpy() - k * PIXELS + reach for c, k in (("line", by[s]), ("pixel", bx[s])))
                if role[s] == 0:
                    values = np.array([part.column(f"_{i}").to_numpy(zero_copy_only=False) for i in range(len(bands))], dtype=np.float64)
                    image[:, line.astype(np.int64), pixel.astype(np.int64)] = values
                else:
                    found = sample(image, line, pixel, method)
                    cols = [part.column(c) for c in ("item_id", "y", "x", "line", "pixel")] + [pa.array(v, from_pandas=True) for v in found]
                    yield pa.RecordBatch.from_arrays(cols, names=["item_id", "y", "x", "line", "pixel", *bands])

    return run


def warp(pixels: DataFrame, positions: DataFrame, bands: list[str], method: str = "near") -> DataFrame:
    """Images in their own lines and pixels, ``pixels(item_id, line, pixel, bands)``, at ``positions(item_id, y, x, line, pixel)``.

    Returns positions with the bands, a row per position that lies in a block with pixels.  Image pixels are dealt into
    blocks and copied to a neighbour's rim as far as the kernel reaches; the cells of a block stream past its pixels, so a task
    holds one block however many cells ask for it.  Of pixels with equal line and pixel one is taken.
    """
    method = {"nearest": "near", "cubic_spline": "cubicspline"}.get(method, method)
    if method not in KERNELS:
        raise ProcessParameterInvalid(f"images are sampled by {', '.join(KERNELS)}, not {method}")
    reach = KERNELS[method][0]
    source = pixels.select(F.col("item_id").cast("string").alias("item_id"), F.col("line").cast("long").alias("line"), F.col("pixel").cast("long").alias("pixel"), *[F.col(f"`{b}`").cast("double").alias(f"_{i}") for i, b in enumerate(bands)])
    source = source.where("item_id is not null and line is not null and pixel is not null")
    blocks = {b: F.explode(F.sequence(F.floor((F.col(c) - reach) / PIXELS), F.floor((F.col(c) + reach) / PIXELS))) for b, c in (("by", "line"), ("bx", "pixel"))}
    for name, block in blocks.items():
        source = source.withColumn(name, block)
    cells = positions.select(F.col("item_id").cast("string").alias("item_id"), "y", "x", F.col("line").cast("double").alias("line"), F.col("pixel").cast("double").alias("pixel"))
    cells = cells.where("item_id is not null and line is not null and pixel is not null and not isnan(line) and not isnan(pixel)")
    cells = cells.withColumns({"by": F.floor(F.col("line") / PIXELS), "bx": F.floor(F.col("pixel") / PIXELS)})
    # only blocks that hold pixels are asked
    held = source.select(*_BLOCK).distinct()
    cells = cells.join(held, _BLOCK, "left_semi")
    none = [F.lit(None).cast("double").alias(f"_{i}") for i in range(len(bands))]
    keys = [F.col("item_id"), F.col("by").cast("long").alias("by"), F.col("bx").cast("long").alias("bx")]
    left = source.select(*keys, F.lit(0).cast("long").alias("role"), F.col("line").cast("double").alias("line"), F.col("pixel").cast("double").alias("pixel"), F.lit(0).alias("y"), F.lit(0).alias("x"), *[f"_{i}" for i in range(len(bands))])
    right = cells.select(*keys, F.lit(1).cast("long").alias("role"), "line", "pixel", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *none)
    stream = left.unionByName(right).repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "role")
    names = ", ".join(f"`{b}` double" for b in bands)
    return stream.mapInArrow(_gather(bands, method), f"item_id string, y int, x int, line double, pixel double, {names}")


def geocode(pixels: DataFrame, points: DataFrame, bands: list[str], grid: Grid, crs: int = 4326, method: str = "bilinear") -> DataFrame:
    """Radar images on a map grid: ``item_id, y, x`` and the bands, rows only where an image has a value."""
    out = warp(pixels, inverse_map(splines(points), grid, crs), bands, method)
    return out.where(F.coalesce(*[F.col(f"`{b}`") for b in bands]).isNotNull()).drop("line", "pixel")


def load_radar(items: DataFrame, pixels: DataFrame, points: DataFrame, bands: list[str], grid: Grid, crs: int = 4326, method: str = "bilinear") -> Cube:
    """A cube on a map grid out of radar images: each is geocoded, those of one time make a mosaic.

    ``items`` has ``id`` and ``datetime``; ``pixels`` and ``points`` are those of ``geocode``.
    """
    asked = items.select(F.col("id").cast("string").alias("item_id"))
    found = geocode(pixels.join(asked, "item_id", "left_semi"), points.join(asked, "item_id", "left_semi"), bands, grid, crs, method)
    return mosaic(items.select(F.col("id").cast("string").alias("id"), "datetime"), found, bands, grid).dense(items.select(F.col("datetime").alias("t")))
