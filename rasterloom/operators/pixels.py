"""Callbacks on pixels, band arithmetic, dimensions and labels."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.cube import REDUCED, Cube, Grid
from rasterloom.errors import DimensionExists, LabelExists, LabelMismatch, LabelNotAvailable, LabelsNotEnumerated, ProcessParameterInvalid
from rasterloom.functions.maths import col, normalized_difference
from rasterloom.functions.reducers import Bands, Values
from rasterloom.operators.temporal import parse_time


def apply(data: Cube, process: Callable, context: Any = None) -> Cube:
    """A function of one value on every value."""
    return data.select({b: col(process(data.band(b), context)) for b in data.bands})


def _field(name: str) -> Callable[[Column], Column]:
    return lambda s: s[name]


def apply_dimension(data: Cube, process: Callable, dimension: str, target_dimension: str | None = None, context: Any = None) -> Cube:
    """A function of all values along a dimension.

    Along bands: an expression per pixel; the result's bands replace the cube's.  Along time:
    a cell's values become an array, and the result an array of the same length; with
    ``target_dimension`` the timestamps become bands named by them instead.
    """
    from rasterloom.cube import dimension as named

    if named(dimension) == "bands":
        out = process(Bands([data.band(b) for b in data.bands], data.bands), context)
        if isinstance(out, Column) or not isinstance(out, list):
            return data.select({"band1": col(out)}, has_bands=False)
        names = out.names if isinstance(out, Bands) and len(out.names) == len(out) else data.bands if len(out) == len(data.bands) else [f"band{i + 1}" for i in range(len(out))]
        return data.select(dict(zip(names, map(col, out), strict=True)))
    times = data.labels()
    if len(times) <= 1 and target_dimension is None:
        return data
    pixel = F.array_sort(F.collect_list(F.struct(F.col("t"), *[data.band(b) for b in data.bands])))
    df = data.df.groupBy("y", "x").agg(pixel.alias("_s"))
    results = {}
    for b in data.bands:
        values = F.transform(F.col("_s"), _field(b))
        out = process(Values(values), context)
        results[b] = out.array() if isinstance(out, (Values, Bands)) else out
    if target_dimension is not None:
        many = len(data.bands) > 1
        columns = {f"{b}_{t.isoformat()}" if many else t.isoformat(): F.get(results[b], F.lit(i)) for b in data.bands for i, t in enumerate(times)}
        out = df.select(F.lit(REDUCED).cast("timestamp_ntz").alias("t"), "y", "x", *[c.cast("double").alias(n) for n, c in columns.items()])
        return data.with_df(out, list(columns), has_t=False)
    checked = [F.when(F.size(r) == F.size("_s"), r).otherwise(F.raise_error(F.lit("the number of values along time has changed")).cast("array<double>")).alias(b) for b, r in results.items()]
    df = df.select("y", "x", F.transform("_s", lambda s: s["t"]).alias("_t"), *checked)
    zipped = F.arrays_zip("_t", *[data.band(b) for b in data.bands])
    out = df.select("y", "x", F.explode(zipped).alias("_z"))
    return data.with_df(out.select(F.col("_z._t").alias("t"), "y", "x", *[F.col("_z").getField(b).alias(b) for b in data.bands]), times=tuple(times))


def array_element_of_cube(data: Cube, index: int | None = None, label: str | None = None) -> Cube:
    """One band of every slice."""
    if index is None and label is None:
        raise ProcessParameterInvalid("array_element needs an index or a label")
    if label is not None:
        if label not in data.bands:
            raise IndexError(f"there is no band {label!r}")
        name = label
    else:
        if not 0 <= index < len(data.bands):
            raise IndexError(f"there are {len(data.bands)} bands only")
        name = data.bands[index]
    return data.select({name: data.band(name)})


def image_indexes(data: Cube, indexes: list[int]) -> Cube:
    """Bands by their places from 1."""
    if not all(isinstance(i, int) and 1 <= i <= len(data.bands) for i in indexes):
        raise ProcessParameterInvalid(f"places of bands are 1 to {len(data.bands)}")
    names = [data.bands[i - 1] for i in indexes]
    unique = [n if n not in names[:k] else f"{n}_{k + 1}" for k, n in enumerate(names)]
    return data.select({u: data.band(n) for u, n in zip(unique, names, strict=True)})


def find_band(data: Cube, key: int | str) -> str:
    """By place from 1, exact name, name in any case, or name before a ``_b<n>`` ending."""
    if isinstance(key, bool):
        raise ProcessParameterInvalid("true and false are no bands")
    if isinstance(key, int) or (isinstance(key, str) and key.isdigit() and key not in data.bands):
        i = int(key)
        if not 1 <= i <= len(data.bands):
            raise ProcessParameterInvalid(f"places of bands are 1 to {len(data.bands)}")
        return data.bands[i - 1]
    for same in (lambda b: b == key, lambda b: b.lower() == key.lower(), lambda b: re.sub(r"_b\d+$", "", b.lower()) == key.lower()):
        found = [b for b in data.bands if same(b)]
        if len(found) == 1:
            return found[0]
        if found:
            raise ProcessParameterInvalid(f"{key!r} may be any of {', '.join(found)}")
    raise ProcessParameterInvalid(f"there is no band {key!r}")


def _index(data: Cube, name: str, a: int | str, b: int | str, target_band: str | None) -> Cube:
    value = normalized_difference(data.band(find_band(data, a)), data.band(find_band(data, b)))
    if target_band is None:
        return data.select({name: value})
    if target_band in data.bands:
        raise ProcessParameterInvalid(f"there is a band {target_band!r} already")
    return data.select({x: data.band(x) for x in data.bands} | {target_band: value})


def ndvi(data: Cube, nir: int | str = "nir", red: int | str = "red", target_band: str | None = None) -> Cube:
    """(nir - red) / (nir + red), as the only band or one more."""
    return _index(data, "ndvi", nir, red, target_band)


def ndwi(data: Cube, nir: int | str, swir: int | str, target_band: str | None = None) -> Cube:
    """(nir - swir) / (nir + swir), as the only band or one more."""
    return _index(data, "ndwi", nir, swir, target_band)


def add_dimension(data: Cube, name: str, label: Any, type: str = "other") -> Cube:  # noqa: A002
    """Name the band of a cube that has no bands, or add an empty slice at a timestamp."""
    if type == "spatial":
        raise ProcessParameterInvalid("a spatial dimension can't be added")
    if type == "bands":
        if len(data.bands) > 1:
            raise DimensionExists("the cube has bands already")
        return data.select({str(label): data.band(data.bands[0])}, has_bands=True)
    try:
        at = parse_time(label)
    except ProcessParameterInvalid:
        at = REDUCED
    if at in data.labels():
        raise LabelExists(f"there is a slice at {at} already")
    spark = data.df.sparkSession
    empty = data.grid.cells(spark).select(F.lit(at).cast("timestamp_ntz").alias("t"), "y", "x", *[F.lit(None).cast("double").alias(b) for b in data.bands])
    return data.with_df(data.df.unionByName(empty), has_t=True, times=tuple(sorted([*data.labels(), at])))


def rename_labels(data: Cube, dimension: str, target: list, source: list | None = None) -> Cube:
    """New names by place, or of the named labels.  Labels along time are dates."""
    from rasterloom.cube import dimension as named

    time = named(dimension) == "t"
    new = [parse_time(x) if time else str(x) for x in target]
    old: list = data.labels() if time else list(data.bands)
    if len(set(new)) != len(new):
        raise LabelExists("the new labels are not distinct")
    if source:
        if len(source) != len(target):
            raise LabelMismatch(f"{len(target)} labels for {len(source)}")
        if not time and not data.has_bands:
            raise LabelsNotEnumerated("the bands have no names of their own")
        src = [parse_time(x) if time else str(x) for x in source]
    else:
        if len(new) != len(old):
            raise LabelMismatch(f"{len(new)} labels for {len(old)}")
        src = old
    missing = [s for s in src if s not in old]
    if missing:
        raise LabelNotAvailable(f"there is no label {missing[0]}")
    taken = [n for n in new if n in old and n not in src]
    if taken:
        raise LabelExists(f"there is a label {taken[0]} already")
    names = dict(zip(src, new, strict=True))
    if not time:
        return data.select({names.get(b, b): data.band(b) for b in data.bands}, has_bands=True)
    pairs = [x for s, n in names.items() for x in (F.lit(s).cast("timestamp_ntz"), F.lit(n).cast("timestamp_ntz"))]
    moved = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("t")), F.col("t"))
    marks = None if data.footprints is None else data.footprints.relabelled(F.array(moved))
    return data.with_df(data.df.withColumn("t", moved), times=tuple(sorted(names.get(t, t) for t in old)), footprints=marks)


def create_data_cube(frame: DataFrame) -> Cube:
    """An empty cube: no bands, no rows.  ``frame`` names the session."""
    spark = frame.sparkSession
    return Cube(spark.createDataFrame([], "t timestamp_ntz, y int, x int"), (), Grid(1, 1, (0.0, 0.0, 1.0, 1.0)), has_bands=False)


def to_image(data: Cube, at: datetime = REDUCED) -> Cube:
    """A cube of one slice; its timestamp is fixed, so that results can be repeated."""
    return data.with_df(data.df.withColumn("t", F.lit(at).cast("timestamp_ntz")), has_t=False, times=(at,))


