"""Filters and aggregations along time."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, datetime, timedelta, timezone
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.cube import KEYS, REDUCED, Cube, dimension
from rasterloom.errors import DimensionNotAvailable, DistinctDimensionLabelsRequired, LabelMismatch, ProcessParameterInvalid, TemporalExtentEmpty
from rasterloom.functions.maths import col
from rasterloom.functions.reducers import Bands, Series

_CLOCK = re.compile(r"(\d\d):(\d\d)(?::(\d\d))?Z?$")
EPOCH = datetime(1970, 1, 1)


def to_utc(value: datetime) -> datetime:
    """Without a zone, in UTC."""
    return value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value


def parse_time(value: Any) -> datetime:
    """A date-time, a date or a year; without a zone it is UTC."""
    if isinstance(value, datetime):
        return to_utc(value)
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    text = str(value).strip()
    if re.fullmatch(r"\d{4}", text):
        return datetime(int(text), 1, 1)
    try:
        return to_utc(datetime.fromisoformat(text.replace("Z", "+00:00")))
    except ValueError as e:
        raise ProcessParameterInvalid(f"{value!r} is no date") from e


def clock(value: Any) -> str | None:
    """``HH:MM:SS`` if the value is a time of day."""
    m = _CLOCK.match(value) if isinstance(value, str) else None
    return f"{m[1]}:{m[2]}:{m[3] or '00'}" if m else None


def within(extent: list, at: Column) -> Column:
    """``start <= t < end``; times of day may go round midnight; one end may be open."""
    if not isinstance(extent, (list, tuple)) or len(extent) != 2:
        raise ProcessParameterInvalid("an extent has a start and an end")
    start, end = extent
    if start is None and end is None:
        raise ProcessParameterInvalid("an extent has a start or an end")
    clocks = [clock(x) for x in extent]
    if any(clocks):
        day = F.date_format(at, "HH:mm:ss")
        low, high = clocks[0] or "00:00:00", clocks[1] or "24:00:00"
        if low == high:
            raise TemporalExtentEmpty("the end is not after the start")
        return (day >= low) & (day < high) if low < high else (day >= low) | (day < high)
    low, high = (None if x is None else parse_time(x) for x in extent)
    if low and high and high <= low:
        raise TemporalExtentEmpty("the end is not after the start")
    test = F.lit(True)
    if low:
        test = test & (at >= F.lit(low).cast("timestamp_ntz"))
    if high:
        test = test & (at < F.lit(high).cast("timestamp_ntz"))
    return test


def need_time(name: str | None) -> None:
    if name is not None and dimension(name) != "t":
        raise DimensionNotAvailable(f"{name!r} is no temporal dimension")


def filter_temporal(data: Cube, extent: list, dimension: str | None = None) -> Cube:
    """Keep the timestamps in an extent; none may be left."""
    need_time(dimension)
    return data.with_df(data.df.where(within(extent, F.col("t"))), times=known_within(data.times, extent))


def known_within(times: tuple[datetime, ...] | None, extent: list) -> tuple[datetime, ...] | None:
    """What is left of known timestamps; unknown for times of day, which Spark evaluates."""
    if times is None or any(clock(x) for x in extent):
        return None
    low, high = (None if x is None else parse_time(x) for x in extent)
    return tuple(t for t in times if (low is None or t >= low) and (high is None or t < high))


def filter_labels(data: Cube, keys: list) -> Cube:
    """Keep the named timestamps."""
    wanted = [parse_time(k) for k in keys]
    left = None if data.times is None else tuple(t for t in data.times if t in wanted)
    return data.with_df(data.df.where(F.col("t").isin([F.lit(k).cast("timestamp_ntz") for k in wanted])), times=left)


def series_of(data: Cube) -> list[Series]:
    return [Series(data.band(b), F.col("t")) for b in data.bands]


def reduced(result: Any) -> Column:
    if isinstance(result, dict):
        raise ProcessParameterInvalid("a reducer gives one value")
    return col(result)


def reduce_dimension(data: Cube, reducer: Callable, dimension: str, context: Any = None) -> Cube:
    """Along time: one aggregation per cell.  Along bands: an expression per pixel.

    A band reducer that gives several values leaves them as bands.
    """
    from rasterloom.cube import dimension as named

    if named(dimension) == "t":
        aggs = [reduced(reducer(s, context)).cast("double").alias(b) for b, s in zip(data.bands, series_of(data), strict=True)]
        df = data.df.groupBy("y", "x").agg(*aggs)
        return data.with_df(df.select(F.lit(REDUCED).cast("timestamp_ntz").alias("t"), "y", "x", *[data.band(b) for b in data.bands]), has_t=False, times=(REDUCED,))
    out = reducer(Bands([data.band(b) for b in data.bands], data.bands), context)
    if isinstance(out, list):
        names = out.names if isinstance(out, Bands) and len(out.names) == len(out) else [f"band{i + 1}" for i in range(len(out))]
        return data.select(dict(zip(names, map(col, out), strict=True)))
    return data.select({"band1": reduced(out)}, has_bands=False)


def interval_labels(intervals: list, labels: list | None) -> list[datetime]:
    """A timestamp per interval: its label, or its start.

    Labels that are no dates number days from 1970: texts by their place, numbers as they
    are; times of day are taken on 1970-01-01.
    """
    if labels:
        if len(labels) != len(intervals):
            raise LabelMismatch(f"{len(labels)} labels for {len(intervals)} intervals")
        out = []
        for i, label in enumerate(labels):
            if isinstance(label, (int, float)) and not isinstance(label, bool):
                out.append(EPOCH + timedelta(days=label))
            elif clock(label):
                h, m, s = map(int, clock(label).split(":"))
                out.append(EPOCH + timedelta(hours=h, minutes=m, seconds=s))
            else:
                try:
                    out.append(parse_time(label))
                except ProcessParameterInvalid:
                    out.append(EPOCH + timedelta(days=i))
    else:
        out = [parse_time(a) if a is not None and not clock(a) else datetime(1, 1, 1) if a is None else EPOCH + timedelta(seconds=sum(int(p) * f for p, f in zip(clock(a).split(":"), (3600, 60, 1), strict=True))) for a, _ in intervals]
    if len(set(out)) != len(out):
        raise DistinctDimensionLabelsRequired("the labels of the intervals are not distinct")
    return out


def aggregate_temporal(data: Cube, intervals: list, reducer: Callable, labels: list | None = None, dimension: str | None = None, context: Any = None) -> Cube:
    """A slice per interval ``[start, end)``; intervals may overlap.

    A pixel row is copied into the intervals that hold it (no join), then grouped.  Rows
    outside of all intervals are dropped at the scan.  An interval without rows gives a slice
    of missing values.
    """
    need_time(dimension)
    names = interval_labels(intervals, labels)
    tests = [within(list(i), F.col("t")) for i in intervals]
    any_of = tests[0]
    for t in tests[1:]:
        any_of = any_of | t
    bounds = [(parse_time(a) if a is not None else None, parse_time(b) if b is not None else None) for a, b in intervals if not clock(a) and not clock(b)]
    df = data.df
    if len(bounds) == len(intervals):
        low, high = [a for a, _ in bounds], [b for _, b in bounds]
        if None not in low:
            df = df.where(F.col("t") >= F.lit(min(low)).cast("timestamp_ntz"))
        if None not in high:
            df = df.where(F.col("t") < F.lit(max(high)).cast("timestamp_ntz"))
    held = F.filter(F.array(*[F.when(t, F.lit(n).cast("timestamp_ntz")) for t, n in zip(tests, names, strict=True)]), lambda v: v.isNotNull())
    rows = df.where(any_of).withColumn("_label", F.explode(held))
    aggs = [reduced(reducer(s, context)).cast("double").alias(b) for b, s in zip(data.bands, series_of(data), strict=True)]
    out = rows.groupBy(F.col("_label").alias("t"), "y", "x").agg(*aggs)
    marks = None if data.footprints is None else data.footprints.relabelled(held)
    return data.with_df(out.select(*KEYS, *[data.band(b) for b in data.bands]), has_t=True, footprints=marks).dense(names)


PIXEL_SELECTIONS = {"first", "highest", "lowest", "mean", "median", "stdev", "lastbandlow", "lastbandhight", "count"}


def apply_pixel_selection(data: Cube, pixel_selection: str = "first") -> Cube:
    """One slice out of all: per band and pixel, or the whole pixel whose last band is extreme.

    ``first`` is the first value that is not missing.  Ties go to the earliest slice.
    """
    v = {b: data.band(b) for b in data.bands}
    simple = {
        "first": lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("t"))), "highest": F.max, "lowest": F.min, "mean": F.avg, "median": F.median,
        "stdev": F.stddev_samp, "count": lambda c: F.count(c).cast("double"),
    }
    if pixel_selection in simple:
        df = data.df.groupBy("y", "x").agg(*[simple[pixel_selection](c).alias(b) for b, c in v.items()])
    elif pixel_selection in ("lastbandlow", "lastbandhight"):
        last = v[data.bands[-1]]
        order = F.when(last.isNotNull(), F.struct(last if pixel_selection == "lastbandlow" else -last, F.col("t")))
        df = data.df.groupBy("y", "x").agg(F.min_by(F.struct(*v.values()), order).alias("_p")).select("y", "x", "_p.*")
    else:
        raise ProcessParameterInvalid(f"no pixel selection is named {pixel_selection!r}")
    return data.with_df(df.select(F.lit(REDUCED).cast("timestamp_ntz").alias("t"), "y", "x", *v.values()), has_t=False)


def slice_reducer(method: str) -> Callable[[Cube], Cube]:
    """A reducer applied to a whole cube reduces time."""
    from rasterloom.functions.reducers import PROCESSES

    def run(data: Cube, **args: Any) -> Cube:
        if method in ("lastbandlow", "lastbandhight"):
            return apply_pixel_selection(data, method)
        return reduce_dimension(data, lambda s, _: PROCESSES[method](s, **args), "t")

    return run
