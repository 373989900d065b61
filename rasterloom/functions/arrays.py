"""Arrays: bands of a pixel, values along time, array columns."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.errors import ProcessParameterInvalid
from rasterloom.functions.maths import col
from rasterloom.functions.reducers import Bands, Series, Values, as_data


def array_element(data: Any, index: int | None = None, label: str | None = None, return_nodata: bool = False) -> Column:
    """An element by its place from 0 or by its label."""
    if isinstance(data, Column) and index == 0 and label is None and not return_nodata:
        return F.get(data, F.lit(0))
    if index is None and label is None:
        raise ProcessParameterInvalid("array_element needs an index or a label")
    data = as_data(data)
    if label is not None:
        if not isinstance(data, Bands) or label not in data.names:
            if return_nodata:
                return F.lit(None).cast("double")
            raise IndexError(f"there is no element {label!r}")
        return data[data.names.index(label)]
    if index < 0:
        raise IndexError("an index is not negative")
    if isinstance(data, Bands):
        if index >= len(data):
            if return_nodata:
                return F.lit(None).cast("double")
            raise IndexError(f"there are {len(data)} elements only")
        return data[index]
    return F.get(data.array(), F.lit(index))


def array_create(data: list | None = None, repeat: int = 1) -> Bands:
    """A new array of given values, ``repeat`` times."""
    items = [] if data is None else list(data) if isinstance(data, list) else [data]
    return Bands([col(x) for x in items] * int(repeat))


def array_apply(data: Any, process: Callable, context: Any = None) -> Any:
    """``process(x, index)`` on every element."""
    data = as_data(data)
    if isinstance(data, Bands):
        return Bands([col(process(c, F.lit(i))) for i, c in enumerate(data)], data.names)
    return Values(F.transform(data.array(), lambda x, i: col(process(x, i)).cast("double")))


PROCESSES = {"array_element": array_element, "array_create": array_create}
__all__ = ["PROCESSES", "Bands", "Series", "Values", "array_apply", "array_create", "array_element"]
