"""Reducers of three kinds of values.

``Series`` is a band along time inside an aggregation: a reducer gives an aggregate column,
combined before the shuffle.  ``Bands`` are the bands of a pixel, and ``Values`` an array
column: a reducer gives an expression.  Missing values are left out unless said otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.errors import ProcessParameterInvalid


@dataclass(frozen=True)
class Series:
    """A band over the rows of a group, in the order of ``at``."""

    value: Column
    at: Column

    def array(self) -> Column:
        """All values in order, missing ones too."""
        return F.transform(F.array_sort(F.collect_list(F.struct(self.at.alias("t"), self.value.alias("v")))), lambda s: s["v"])


class Bands(list):
    """Columns of one pixel, with their names."""

    def __init__(self, columns: list[Column], names: tuple[str, ...] = ()):
        super().__init__(columns)
        self.names = tuple(names)

    def array(self) -> Column:
        return F.array(*[c.cast("double") for c in self])


@dataclass(frozen=True)
class Values:
    """An array column."""

    value: Column

    def array(self) -> Column:
        return self.value


Data = Series | Bands | Values | list


def as_data(data) -> Data:
    if isinstance(data, (Series, Bands, Values)):
        return data
    if isinstance(data, list):
        return Bands([c if isinstance(c, Column) else F.lit(None if c is None else float(c)).cast("double") for c in data])
    if isinstance(data, Column):
        return Values(data)
    raise ProcessParameterInvalid(f"a reducer takes an array, not {type(data).__name__}")


def _flag(ignore_nodata) -> bool:
    if not isinstance(ignore_nodata, bool):
        raise ProcessParameterInvalid("ignore_nodata is true or false")
    return ignore_nodata


def _valid(array: Column) -> Column:
    return F.filter(array, lambda v: v.isNotNull())


def _reduce(data, aggregate, of_array, ignore_nodata=True) -> Column:
    keep = _flag(ignore_nodata)
    data = as_data(data)
    if isinstance(data, Series):
        out = aggregate(data)
        return out if keep else F.when(F.count(data.value) == F.count(F.lit(1)), out)
    array = data.array()
    out = of_array(_valid(array))
    return out if keep else F.when(F.size(_valid(array)) == F.size(array), out)


def max_(data, ignore_nodata=True) -> Column:
    return _reduce(data, lambda s: F.max(s.value), F.array_max, ignore_nodata)


def min_(data, ignore_nodata=True) -> Column:
    return _reduce(data, lambda s: F.min(s.value), F.array_min, ignore_nodata)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _mean(a: Column) -> Column:
    return F.try_divide(_total(a), F.size(a).cast("double"))


def mean(data, ignore_nodata=True) -> Column:
    return _reduce(data, lambda s: F.avg(s.value), _mean, ignore_nodata)


def _median(a: Column) -> Column:
    n, s = F.size(a), F.array_sort(a)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def median(data, ignore_nodata=True) -> Column:
    return _reduce(data, lambda s: F.median(s.value), _median, ignore_nodata)


def _variance(a: Column) -> Column:
    n, m = F.size(a), _mean(a)
    return F.when(n > 1, F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / (n - 1))


def variance(data, ignore_nodata=True) -> Column:
    """Of the sample (divided by n - 1)."""
    return _reduce(data, lambda s: F.var_samp(s.value), _variance, ignore_nodata)


def sd(data, ignore_nodata=True) -> Column:
    """Of the sample."""
    return _reduce(data, lambda s: F.stddev_samp(s.value), lambda a: F.sqrt(_variance(a)), ignore_nodata)


def count(data, condition=None) -> Column:
    """Of valid values, or of those that fulfil a condition: a function of a column, or true for all."""
    data = as_data(data)
    if callable(condition):
        test = condition
    elif condition is True:
        test = lambda v: F.lit(True)
    else:
        test = lambda v: v.isNotNull()
    if isinstance(data, Series):
        return F.count_if(F.coalesce(test(data.value).cast("boolean"), F.lit(False))).cast("double")
    return F.size(F.filter(data.array(), lambda v: F.coalesce(test(v).cast("boolean"), F.lit(False)))).cast("double")


def first(data, ignore_nodata=True) -> Column:
    """The earliest value, even if it is missing."""
    data = as_data(data)
    return F.min_by(data.value, data.at) if isinstance(data, Series) else F.get(data.array(), F.lit(0))


def last(data, ignore_nodata=True) -> Column:
    """The latest value, even if it is missing."""
    data = as_data(data)
    return F.max_by(data.value, data.at) if isinstance(data, Series) else F.get(data.array(), F.size(data.array()) - 1)


def firstpixel(data) -> Column:
    """The earliest value that is not missing."""
    data = as_data(data)
    if isinstance(data, Series):
        return F.min_by(data.value, F.when(data.value.isNotNull(), data.at))
    return F.get(_valid(data.array()), F.lit(0))


PROCESSES = {
    "max": max_, "min": min_, "mean": mean, "median": median, "sd": sd, "stdev": sd, "variance": variance, "count": count, "first": first, "last": last,
    "firstpixel": firstpixel, "highestpixel": max_, "lowestpixel": min_,
}
