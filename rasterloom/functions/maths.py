"""Numbers: ``Column -> Column``.  A result outside a function's domain is NULL."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | float | int | None


def col(x: Value) -> Column:
    """A number as a DOUBLE column; columns as they are."""
    if isinstance(x, Column):
        return x
    return F.lit(None).cast("double") if x is None else F.lit(x if isinstance(x, (bool, str)) else float(x))


def add(x: Value, y: Value) -> Column:
    return col(x) + col(y)


def subtract(x: Value, y: Value) -> Column:
    return col(x) - col(y)


def multiply(x: Value, y: Value) -> Column:
    return col(x) * col(y)


def divide(x: Value, y: Value) -> Column:
    return F.try_divide(col(x), col(y))


def mod(x: Value, y: Value) -> Column:
    """The remainder with the sign of the divisor."""
    x, y = col(x), col(y)
    return F.when(y != 0, x - y * F.floor(x / y))


def power(base: Value, p: Value) -> Column:
    return F.pow(col(base), col(p))


def absolute(x: Value) -> Column:
    return F.abs(col(x))


def sgn(x: Value) -> Column:
    return F.signum(col(x))


def sqrt(x: Value) -> Column:
    return F.when(col(x) >= 0, F.sqrt(col(x)))


def exp(p: Value) -> Column:
    return F.exp(col(p))


def ln(x: Value) -> Column:
    return F.when(col(x) > 0, F.ln(col(x)))


def log(x: Value, base: Value) -> Column:
    return F.try_divide(ln(x), ln(base))


def _plain(name: str):
    f = getattr(F, name)

    def one(x: Value) -> Column:
        return f(col(x))

    return one


sin, cos, tan = _plain("sin"), _plain("cos"), _plain("tan")
sinh, cosh, tanh = _plain("sinh"), _plain("cosh"), _plain("tanh")
arctan, arsinh = _plain("atan"), _plain("asinh")


def arcsin(x: Value) -> Column:
    return F.when(F.abs(col(x)) <= 1, F.asin(col(x)))


def arccos(x: Value) -> Column:
    return F.when(F.abs(col(x)) <= 1, F.acos(col(x)))


def arcosh(x: Value) -> Column:
    return F.when(col(x) >= 1, F.acosh(col(x)))


def artanh(x: Value) -> Column:
    return F.when(F.abs(col(x)) < 1, F.atanh(col(x)))


def arctan2(y: Value, x: Value) -> Column:
    return F.atan2(col(y), col(x))


def floor(x: Value) -> Column:
    return F.floor(col(x)).cast("double")


def ceil(x: Value) -> Column:
    return F.ceil(col(x)).cast("double")


def trunc(x: Value) -> Column:
    """Toward zero, in a byte without sign: modulo 256."""
    whole = F.when(col(x) >= 0, F.floor(col(x))).otherwise(F.ceil(col(x)))
    return F.pmod(whole.cast("long"), F.lit(256)).cast("double")


def round_(x: Value, p: int = 0) -> Column:
    """Half to even."""
    return F.bround(col(x), int(p)).cast("double")


def clip(x: Value, min: Value, max: Value) -> Column:  # noqa: A002
    return F.when(col(x).isNotNull(), F.greatest(F.least(col(x), col(max)), col(min)))


def linear_scale_range(x: Value, inputMin: Value, inputMax: Value, outputMin: Value = 0.0, outputMax: Value = 1.0) -> Column:  # noqa: N803
    """Clamped to the input range, which may be given the wrong way round, then scaled."""
    a, b, c, d = col(inputMin), col(inputMax), col(outputMin), col(outputMax)
    v = clip(x, F.least(a, b), F.greatest(a, b))
    return F.try_divide(v - a, b - a) * (d - c) + c


def normalized_difference(x: Value, y: Value) -> Column:
    return F.try_divide(col(x) - col(y), col(x) + col(y))


def e() -> Column:
    return F.lit(math.e)


def pi() -> Column:
    return F.lit(math.pi)


def constant(x: Any) -> Any:
    return x


PROCESSES = {
    "add": add, "subtract": subtract, "multiply": multiply, "divide": divide, "mod": mod, "power": power, "absolute": absolute, "sgn": sgn, "sqrt": sqrt,
    "exp": exp, "ln": ln, "log": log, "sin": sin, "cos": cos, "tan": tan, "sinh": sinh, "cosh": cosh, "tanh": tanh, "arcsin": arcsin, "arccos": arccos,
    "arctan": arctan, "arctan2": arctan2, "arsinh": arsinh, "arcosh": arcosh, "artanh": artanh, "floor": floor, "ceil": ceil, "trunc": trunc, "clip": clip,
    "linear_scale_range": linear_scale_range, "normalized_difference": normalized_difference, "e": e, "pi": pi, "constant": constant,
}
