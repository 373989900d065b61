"""Terrain, radar and colour."""

from __future__ import annotations

import math
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.cube import KEYS, Cube, Grid, column_names
from rasterloom.errors import FeatureUnsupported, ProcessParameterInvalid
from rasterloom.functions.maths import arccos
from rasterloom.operators import patches


#: Cells along a side of a block whose gradients are one task's work.
BLOCK = 128


def gradients(data: Cube, value: Column) -> DataFrame:
    """``t, y, x, _r, _c``: differences of a value down the rows and along the columns.

    They are central, one-sided at the edges, and missing where a neighbour is.  Cells are dealt into blocks with
    copies of the cells around them, so one shuffle serves both directions.
    """
    g = data.grid
    if min(g.width, g.height) < 2:
        raise ProcessParameterInvalid("a gradient needs two cells at least")
    near = {n: F.explode(F.sequence(F.floor((F.col(c) - 1) / BLOCK), F.floor((F.col(c) + 1) / BLOCK))) for n, c in (("by", "y"), ("bx", "x"))}
    rows = data.df.select(*KEYS, value.alias("z")).withColumn("by", near["by"]).withColumn("bx", near["bx"])
    rows = rows.where((F.col("by") >= 0) & (F.col("bx") >= 0))

    def along(z: np.ndarray, first: int, size: int) -> np.ndarray:
        """Differences down the rows of a block whose row 1 is row ``first`` of the image."""
        out, last = (z[2:, 1:-1] - z[:-2, 1:-1]) / 2, size - 1 - first
        if first == 0:
            out[0] = z[2, 1:-1] - z[1, 1:-1]
        if 0 <= last < BLOCK:
            out[last] = z[last + 1, 1:-1] - z[last, 1:-1]
        return out

    def differ(block: pa.Table) -> pa.Table:
        y0, x0 = block["by"][0].as_py() * BLOCK, block["bx"][0].as_py() * BLOCK
        y, x = block["y"].to_numpy() - y0, block["x"].to_numpy() - x0
        z = np.full((BLOCK + 2, BLOCK + 2), np.nan)
        z[y + 1, x + 1] = block["z"].to_numpy()
        own = np.flatnonzero((y >= 0) & (y < BLOCK) & (x >= 0) & (x < BLOCK))
        down, right = along(z, y0, g.height), along(z.T, x0, g.width).T
        part = block.select(list(KEYS)).take(pa.array(own))
        for name, d in (("_r", down), ("_c", right)):
            part = part.append_column(name, pa.array(d[y[own], x[own]], from_pandas=True))
        return part

    return rows.groupBy("t", "by", "bx").applyInArrow(differ, "t timestamp_ntz, y int, x int, _r double, _c double")


def hillshade(data: Cube, azimuth: float = 315, angle_altitude: float = 45, buffer: int = 3, zfactor: float = 1.0) -> Cube:
    """Shaded relief of the first band, 0 to 255, without ``buffer`` cells at the edges."""
    g = data.grid
    df = gradients(data, data.band(data.bands[0]) * float(zfactor))
    r, c = F.col("_r"), F.col("_c")
    slope = math.pi / 2 - F.atan(F.sqrt(r * r + c * c))
    aspect = F.atan2(-r, c)
    az, alt = math.radians(azimuth), math.radians(angle_altitude)
    shade = math.sin(alt) * F.sin(slope) + math.cos(alt) * F.cos(slope) * F.cos(F.lit(az) - aspect)
    value = F.floor(F.greatest(255 * (shade + 1) / 2, F.lit(0.0))).cast("double")
    inner = F.col("y").between(buffer, g.height - 1 - buffer) & F.col("x").between(buffer, g.width - 1 - buffer)
    out = df.where(inner).select("t", (F.col("y") - buffer).cast("int").alias("y"), (F.col("x") - buffer).cast("int").alias("x"), F.when(r.isNotNull() & c.isNotNull(), value).alias("hillshade"))
    b = g.bounds
    grid = Grid(g.width - 2 * buffer, g.height - 2 * buffer, (b[0] + buffer * g.dx, b[1] + buffer * g.dy, b[2] - buffer * g.dx, b[3] - buffer * g.dy), g.crs)
    return data.with_df(out, ["hillshade"], grid=grid, times=data.times)


#: Coefficient and the ending of the band with its constants.
COEFFICIENTS = {"beta0": "beta0_lut", "sigma0-ellipsoid": "sigma0_lut", "gamma0-ellipsoid": "gamma0_lut"}
POLARISATIONS = ("vv", "vh", "hh", "hv")


def sar_backscatter(
    data: Cube, coefficient: str | None = "gamma0-terrain", elevation_model: str | None = None, mask: bool = False, contributing_area: bool = False,
    local_incidence_angle: bool = False, ellipsoid_incidence_angle: bool = False, noise_removal: bool = True, options: dict | None = None,
) -> Cube:
    """``(DN^2 - noise) / A^2`` per polarisation, from bands of the cube.

    ``A`` is the band ``<polarisation>_<coefficient>_lut`` and the noise ``<polarisation>_noise_lut``.
    Powers below the noise are 0.  A pixel is valid if every polarisation's number is above 0.
    """
    if coefficient is not None and coefficient not in COEFFICIENTS:
        raise FeatureUnsupported(f"{coefficient} needs a terrain model; there are {', '.join(COEFFICIENTS)}")
    if elevation_model is not None or contributing_area or local_incidence_angle:
        raise FeatureUnsupported("terrain models are not used")
    pols = [b for b in data.bands if b.lower() in POLARISATIONS]
    if not pols:
        raise ProcessParameterInvalid("the cube has no band named after a polarisation")

    def need(name: str) -> Column:
        if name not in data.bands:
            raise ProcessParameterInvalid(f"the band {name} is missing")
        return data.band(name)

    valid = F.lit(True)
    for p in pols:
        valid = valid & F.coalesce(data.band(p) > 0, F.lit(False))
    out: dict[str, Column] = {}
    for p in pols:
        power = data.band(p) * data.band(p)
        if noise_removal:
            power = F.greatest(power - need(f"{p}_noise_lut"), F.lit(0.0))
        if coefficient is not None:
            a = need(f"{p}_{COEFFICIENTS[coefficient]}")
            power = F.try_divide(power, a * a)
        out[p] = F.when(valid, power)
    if ellipsoid_incidence_angle:
        out["ellipsoid_incidence_angle"] = F.when(valid, need(f"{pols[0]}_ellipsoid_incidence_angle"))
    if mask:
        out["mask"] = F.when(valid, F.lit(1.0))
    return data.select(out)


def incidence_angle(sigma: Column, gamma: Column) -> Column:
    """Degrees, from the constants of the two coefficients."""
    ratio = F.try_divide(gamma, sigma)
    return F.degrees(arccos(F.greatest(F.least(ratio * ratio, F.lit(1.0)), F.lit(-1.0))))


def lut_bilinear(points: DataFrame, lut: DataFrame, name: str = "value") -> DataFrame:
    """Add to ``points(line, pixel, ...)`` the value of a table ``lut(line, pixel, value)``.

    The table is a full grid of lines and pixels.  Between its nodes values are bilinear,
    beyond them those of the edge.
    """
    n = lut.agg(F.count("*"), F.count_distinct("line"), F.count_distinct("pixel")).first()
    if n[0] != n[1] * n[2] or n[1] < 2 or n[2] < 2:
        raise ProcessParameterInvalid("the table is no grid of two by two nodes at least")
    nodes = F.array_sort(F.collect_list(F.struct(F.col("pixel").cast("double").alias("pixel"), F.col("value").cast("double").alias("value"))))
    table = lut.groupBy(F.lit("").alias("item_id"), F.col("line").cast("double").alias("line")).agg(nodes.alias("v"))
    table = table.select("item_id", "line", "v.pixel", "v.value")
    (own,) = column_names(points, 1, name)
    return patches.look_up(points.withColumn(own, F.lit("")), patches.of_vectors(table), name, item=own).drop(own)


def _bands_of(letters: str, n: int) -> list[int]:
    return [i for i, c in enumerate("RGB"[:n]) if c in letters.upper()]


def color_formula(data: Cube, formula: str) -> Cube:
    """Steps on bands of 0 to 255: ``Gamma RGB g``, ``Sigmoidal RGB contrast bias``, ``Saturation s``.

    Saturation scales the distance from the luma 0.299 R + 0.587 G + 0.114 B.  Results
    are cut to 0 to 255.
    """
    v = [data.band(b) / 255.0 for b in data.bands]
    words = formula.replace(",", " ").split()
    at = 0
    while at < len(words):
        step = words[at].lower()
        if step == "gamma":
            g = float(words[at + 2])
            for i in _bands_of(words[at + 1], len(v)):
                v[i] = F.pow(F.greatest(v[i], F.lit(0.0)), F.lit(1 / g))
            at += 3
        elif step == "sigmoidal":
            k, bias = float(words[at + 2]), float(words[at + 3])
            low, high = 1 / (1 + math.exp(k * bias)), 1 / (1 + math.exp(k * (bias - 1)))
            for i in _bands_of(words[at + 1], len(v)):
                v[i] = (1 / (1 + F.exp(k * (bias - v[i]))) - low) / (high - low)
            at += 4
        elif step == "saturation":
            s = float(words[at + 1])
            if len(v) >= 3:
                luma = 0.299 * v[0] + 0.587 * v[1] + 0.114 * v[2]
                v[:3] = [luma + (x - luma) * s for x in v[:3]]
            at += 2
        else:
            raise ProcessParameterInvalid(f"no step is named {words[at]!r}")
    return data.select({b: F.when(data.band(b).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(255.0), x * 255.0))) for b, x in zip(data.bands, v, strict=True)})


#: Anchor colours; a map runs straight from one to the next over 0 to 255.
ANCHORS = {
    "gray": ((0, 0, 0), (255, 255, 255)),
    "red-green": ((165, 0, 38), (255, 255, 191), (0, 104, 55)),
    "blue-red": ((0, 0, 255), (255, 255, 255), (255, 0, 0)),
    "heat": ((0, 0, 0), (255, 0, 0), (255, 255, 0), (255, 255, 255)),
}


def get_colormap(name: str) -> dict[int, tuple[int, int, int, int]]:
    """256 colours by value."""
    if name not in ANCHORS:
        raise ProcessParameterInvalid(f"no colour map is named {name!r}")
    a = ANCHORS[name]
    out = {}
    for v in range(256):
        i, f = divmod(v * (len(a) - 1) / 255, 1)
        low, high = a[int(i)], a[min(int(i) + 1, len(a) - 1)]
        out[v] = (*(round(p + (q - p) * f) for p, q in zip(low, high, strict=True)), 255)
    return out


def colormap(data: Cube, colormap: dict | str) -> Cube:
    """Red, green, blue and opacity of the first band's values; other values are missing."""
    table = get_colormap(colormap) if isinstance(colormap, str) else {int(k): tuple(v) for k, v in colormap.items()}
    pairs = [x for k, c in table.items() for x in (F.lit(int(k)), F.array(*[F.lit(float(p)) for p in (*c, 255)[:4]]))]
    colour = F.try_element_at(F.create_map(*pairs), data.band(data.bands[0]).cast("int"))
    return data.select({n: F.get(colour, F.lit(i)) for i, n in enumerate(("red", "green", "blue", "alpha"))})


PROCESSES: dict[str, Any] = {"hillshade": hillshade, "sar_backscatter": sar_backscatter, "color_formula": color_formula, "colormap": colormap, "get_colormap": get_colormap}
