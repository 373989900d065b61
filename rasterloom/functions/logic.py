"""Comparisons and choices."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.functions.maths import col


def truth(x: Any) -> Column:
    """A condition without NULL: missing is false, a number is true unless 0."""
    if isinstance(x, Column):
        return F.coalesce(x.cast("boolean"), F.lit(False))
    return F.lit(bool(x))


def if_(value: Any, accept: Any, reject: Any = None) -> Any:
    """Where the condition is missing, ``reject``; a missing ``reject`` of a column is 0."""
    if not isinstance(value, Column):
        return accept if value is True else reject
    return F.when(truth(value), col(accept)).otherwise(col(0.0 if reject is None else reject))


def and_(x: Any, y: Any) -> Any:
    return truth(x) & truth(y)


def or_(x: Any, y: Any) -> Any:
    return truth(x) | truth(y)


def _near(x: Any, y: Any, delta: float | None, case_sensitive: bool) -> Column:
    a, b = col(x), col(y)
    if delta is not None:
        return F.abs(a - b) <= float(delta)
    if not case_sensitive:
        return F.lower(a) == F.lower(b)
    return a == b


def eq(x: Any, y: Any, delta: float | None = None, case_sensitive: bool = True) -> Column:
    return _near(x, y, delta, case_sensitive)


def neq(x: Any, y: Any, delta: float | None = None, case_sensitive: bool = True) -> Column:
    return ~_near(x, y, delta, case_sensitive)


def lt(x: Any, y: Any) -> Column:
    return col(x) < col(y)


def lte(x: Any, y: Any) -> Column:
    return col(x) <= col(y)


def gt(x: Any, y: Any) -> Column:
    return col(x) > col(y)


def gte(x: Any, y: Any) -> Column:
    return col(x) >= col(y)


PROCESSES = {"if": if_, "and": and_, "or": or_, "eq": eq, "neq": neq, "lt": lt, "lte": lte, "gt": gt, "gte": gte}
