"""Radar annotations: calibration and noise documents as tables of vectors, evaluated for pixels.

A document (XML) holds vectors along range at some lines, and of noise also blocks with factors along
azimuth.  ``vectors`` turns documents into rows ``item_id, line, pixel ARRAY, value ARRAY``; what they mean between
vectors and nodes is a table of patches, which points of any number of images meet in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.cube import Cube, column_names
from rasterloom.errors import ProcessParameterInvalid
from rasterloom.functions.maths import arccos
from rasterloom.operators import patches
from rasterloom.operators.patches import interpolate  # noqa: F401

#: Names of elements in the annotations, by the ending of the band that they become.
CALIBRATION = {"sigma0_lut": "sigmaNought", "beta0_lut": "betaNought", "gamma0_lut": "gamma", "dn_lut": "dn"}
ANGLE = "ellipsoid_incidence_angle"
NUMBERS = "struct<_VALUE: string, _count: int>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``value``: whole documents, one per file."""
    return spark.read.text(path, wholetext=True)


def _numbers(element: Column) -> Column:
    return F.transform(F.split(F.trim(element["_VALUE"]), r"\s+"), lambda x: x.cast("double"))


def _of_items(documents: DataFrame) -> DataFrame:
    """``item_id, value``; documents without an item are all those of one nameless image."""
    item = F.col("item_id").cast("string") if "item_id" in documents.columns else F.lit("")
    return documents.select(item.alias("item_id"), "value")


def vectors(documents: DataFrame, listed: str, vector: str, value: str) -> DataFrame:
    """``item_id, line, pixel, value`` of the elements ``listed``/``vector`` of documents, values from ``value``."""
    schema = f"{listed} struct<{vector}: array<struct<line: double, pixel: {NUMBERS}, {value}: {NUMBERS}>>>"
    one = _of_items(documents).select("item_id", F.explode(F.from_xml("value", F.lit(schema))[listed][vector]).alias("v"))
    return one.select("item_id", "v.line", _numbers(F.col("v.pixel")).alias("pixel"), _numbers(F.col(f"v.{value}")).alias("value"))


def calibration(documents: DataFrame, coefficient: str) -> DataFrame:
    """Vectors of a calibration constant, by the ending of its band."""
    return vectors(documents, "calibrationVectorList", "calibrationVector", CALIBRATION[coefficient])


def noise(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Range vectors, and blocks ``item_id, rank, l0, l1, p0, p1, at, value`` with factors along azimuth.

    Older documents have one list of vectors and no blocks.  A later block (of the higher rank) counts where several hold a pixel.
    """
    found = vectors(documents, "noiseRangeVectorList", "noiseRangeVector", "noiseRangeLut")
    found = found.unionByName(vectors(documents, "noiseVectorList", "noiseVector", "noiseLut"))
    ends = {"firstAzimuthLine": "l0", "lastAzimuthLine": "l1", "firstRangeSample": "p0", "lastRangeSample": "p1"}
    schema = f"noiseAzimuthVectorList struct<noiseAzimuthVector: array<struct<{', '.join(f'{e}: double' for e in ends)}, line: {NUMBERS}, noiseAzimuthLut: {NUMBERS}>>>"
    listed = F.from_xml("value", F.lit(schema))["noiseAzimuthVectorList"]["noiseAzimuthVector"]
    rows = _of_items(documents).select("item_id", F.posexplode(listed).alias("rank", "b"))
    return found, rows.select("item_id", "rank", *[F.col(f"b.{e}").alias(n) for e, n in ends.items()], _numbers(F.col("b.line")).alias("at"), _numbers(F.col("b.noiseAzimuthLut")).alias("value"))


def evaluate(points: DataFrame, table: DataFrame, name: str, line: str = "line", pixel: str = "pixel", item: str | None = None) -> DataFrame:
    """Add to ``points`` the value of a table of vectors: bilinear between them, constant beyond.

    ``item`` is the column that names a point's image; without it all points are of the one image of the table.
    """
    return _evaluate(points, patches.of_vectors(table), name, line, pixel, item)


def _evaluate(points: DataFrame, table: DataFrame, name: str, line: str, pixel: str, item: str | None, extend: bool = True) -> DataFrame:
    if item is not None:
        return patches.look_up(points, table, name, line, pixel, item, extend)
    if table.isEmpty():
        raise ProcessParameterInvalid("an annotation has one vector at least")
    (own,) = column_names(points, 1, name)
    one = table.withColumn("item_id", F.lit(""))
    return patches.look_up(points.withColumn(own, F.lit("")), one, name, line, pixel, own, extend).drop(own)


def noise_of(points: DataFrame, documents: DataFrame, name: str, line: str = "line", pixel: str = "pixel", item: str | None = None) -> DataFrame:
    """Add the thermal noise: its range table times the factor of the last azimuth block that holds the pixel, or 1."""
    table, blocks = noise(documents)
    out = evaluate(points, table, name, line, pixel, item)
    strips = patches.of_strips(blocks)
    (factor,) = column_names(out, 1)
    if item is not None:
        out = patches.look_up(out, strips, factor, line, pixel, item, extend=False)
    elif strips.isEmpty():
        return out
    else:
        out = _evaluate(out, strips, factor, line, pixel, None, extend=False)
    return out.withColumn(name, F.col(f"`{name}`") * F.coalesce(factor, F.lit(1.0))).drop(factor)


def angle_of(points: DataFrame, documents: DataFrame, name: str, line: str = "line", pixel: str = "pixel", item: str | None = None) -> DataFrame:
    """Add the incidence angle on the ellipsoid in degrees, from the constants of two coefficients."""
    sigma, gamma = column_names(points, 2, name)
    out = evaluate(points, calibration(documents, "sigma0_lut"), sigma, line, pixel, item)
    out = evaluate(out, calibration(documents, "gamma0_lut"), gamma, line, pixel, item)
    ratio = F.try_divide(F.col(gamma), F.col(sigma))
    angle = F.degrees(arccos(F.greatest(F.least(ratio * ratio, F.lit(1.0)), F.lit(-1.0))))
    return out.withColumn(name, angle).drop(sigma, gamma)


def with_annotations(data: Cube, calibrations: dict[str, DataFrame], noises: dict[str, DataFrame] | None = None, coefficient: str = "sigma0_lut") -> Cube:
    """A cube in radar geometry (rows are lines, columns pixels) with the bands that calibration needs.

    Documents are given by polarisation, the name of a band.
    """
    df, bands = data.df, list(data.bands)
    for pol, documents in calibrations.items():
        df = evaluate(df, calibration(documents, coefficient), f"{pol}_{coefficient}", "y", "x")
        bands.append(f"{pol}_{coefficient}")
    for pol, documents in (noises or {}).items():
        df = noise_of(df, documents, f"{pol}_noise_lut", "y", "x")
        bands.append(f"{pol}_noise_lut")
    return data.with_df(df, bands, times=data.times)
