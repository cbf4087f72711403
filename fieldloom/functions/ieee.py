"""Scalar functions with IEEE and C semantics, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAN, _INF = float("nan"), float("inf")


def divide(a: Column, b: Column) -> Column:
    """a / b: 0/0 and NaN give NaN, x/0 an infinity with the signs of both."""
    a, b = a.cast("double"), b.cast("double")
    below = b.cast("string") == "-0.0"  # -0.0 = 0.0 in comparisons
    zero = F.when((a == 0) | F.isnan(a), F.lit(_NAN)).when((a > 0) == below, F.lit(-_INF)).otherwise(F.lit(_INF))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def fmod(a: Column, b: Column) -> Column:
    """Remainder with the sign of a; NaN for a zero b or an infinite a."""
    return F.when((b == 0) | (F.abs(a.cast("double")) == _INF), F.lit(_NAN)).when(F.abs(b.cast("double")) == _INF, a.cast("double")).otherwise(F.try_mod(a.cast("double"), b.cast("double")))


def log(a: Column) -> Column:
    """Natural logarithm: -inf at 0, NaN below."""
    return F.when(a == 0, F.lit(-_INF)).when(a < 0, F.lit(_NAN)).otherwise(F.log(a))


def trunc(a: Column) -> Column:
    return F.when(_whole(a), a.cast("double")).when(a < 0, F.ceil(a).cast("double")).otherwise(F.floor(a).cast("double"))


def ceil(a: Column) -> Column:
    return F.when(_whole(a), a.cast("double")).otherwise(F.ceil(a).cast("double"))


def floor(a: Column) -> Column:
    return F.when(_whole(a), a.cast("double")).otherwise(F.floor(a).cast("double"))


def _whole(a: Column) -> Column:
    """Beyond 2**52, or NaN: nothing to cut off."""
    return F.abs(a.cast("double")) >= float(1 << 52)


def _told(a: Column, b: Column) -> Column:
    return ~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double"))


def less(a: Column, b: Column) -> Column:
    return _told(a, b) & (a < b)


def less_equal(a: Column, b: Column) -> Column:
    return _told(a, b) & (a <= b)


def equal(a: Column, b: Column) -> Column:
    return _told(a, b) & (a == b)


def maximum(a: Column, b: Column) -> Column:
    """a > b ? a : b, and null if either is null."""
    return F.when(a.isNull() | b.isNull(), None).when(less(b, a), a).otherwise(b)


def minimum(a: Column, b: Column) -> Column:
    """a > b ? b : a, and null if either is null."""
    return F.when(a.isNull() | b.isNull(), None).when(less(b, a), b).otherwise(a)


def single(a: Column) -> Column:
    """Rounded to single precision, as after each operation on floats."""
    return a.cast("float")


def power(a: Column, n: int) -> Column:
    """Repeated multiplication a * (a * ...); the power 0 is 1."""
    out = F.lit(1.0) if n == 0 else a
    for _ in range(n - 1):
        out = a * out
    return out
