"""Expressions that an operator returns: built once, then turned into Columns or evaluated on numpy arrays."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions import ieee


class Expr:
    def __add__(self, o): return Op("+", (self, lift(o)))  # noqa: E704
    def __radd__(self, o): return Op("+", (lift(o), self))  # noqa: E704
    def __sub__(self, o): return Op("-", (self, lift(o)))  # noqa: E704
    def __rsub__(self, o): return Op("-", (lift(o), self))  # noqa: E704
    def __mul__(self, o): return Op("*", (self, lift(o)))  # noqa: E704
    def __rmul__(self, o): return Op("*", (lift(o), self))  # noqa: E704
    def __truediv__(self, o): return Op("/", (self, lift(o)))  # noqa: E704
    def __rtruediv__(self, o): return Op("/", (lift(o), self))  # noqa: E704
    def __mod__(self, o): return Op("fmod", (self, lift(o)))  # noqa: E704
    def __neg__(self): return Op("neg", (self,))  # noqa: E704
    def __pos__(self): return self  # noqa: E704
    def __lt__(self, o): return Op("<", (self, lift(o)))  # noqa: E704
    def __le__(self, o): return Op("<=", (self, lift(o)))  # noqa: E704
    def __gt__(self, o): return Op(">", (self, lift(o)))  # noqa: E704
    def __ge__(self, o): return Op(">=", (self, lift(o)))  # noqa: E704
    def __and__(self, o): return Op("and", (self, lift(o)))  # noqa: E704
    def __or__(self, o): return Op("or", (self, lift(o)))  # noqa: E704

    def __pow__(self, n: int) -> Expr:
        """Repeated multiplication; the power 0 is 1."""
        if not isinstance(n, int) or n < 0:
            raise ValueError("powers are whole numbers from 0; use power() for others")
        out: Expr = Const(1.0) if n == 0 else self
        for _ in range(n - 1):
            out = self * out
        return out

    def __getitem__(self, at: int | str) -> Expr:
        """An element of a tuple-valued field, by place (array) or name (struct)."""
        return Item(self, at)


@dataclass(frozen=True, eq=False)
class Const(Expr):
    value: float | int | bool


@dataclass(frozen=True, eq=False)
class Read(Expr):
    """A field at an offset."""

    field: str
    offset: tuple[int, int, int] = (0, 0, 0)


@dataclass(frozen=True, eq=False)
class ReadAt(Expr):
    """A field as many levels away as an expression says at the point; null beyond the column.  offset: how far away besides."""

    field: str
    offset: tuple[int, int, int]
    by: Expr

    @property
    def beside(self) -> tuple[int, int, int]:
        return (*self.offset[:2], 0)


@dataclass(frozen=True, eq=False)
class Index(Expr):
    """The point's own coordinate along a dimension."""

    dim: str


@dataclass(frozen=True, eq=False)
class Item(Expr):
    of: Expr
    at: int | str


@dataclass(frozen=True, eq=False)
class Op(Expr):
    kind: str
    args: tuple[Expr, ...]


def lift(value) -> Expr:
    return value if isinstance(value, Expr) else Const(value)


def where(condition, yes, no) -> Expr:
    return Op("where", (lift(condition), lift(yes), lift(no)))


def equal(a, b) -> Expr:
    return Op("==", (lift(a), lift(b)))


def _call(kind: str) -> Callable[..., Expr]:
    return lambda *args: Op(kind, tuple(map(lift, args)))


sqrt, exp, log, power, fabs, trunc, ceil, floor, sin, cos, struct, array = map(_call, ("sqrt", "exp", "log", "power", "abs", "trunc", "ceil", "floor", "sin", "cos", "struct", "array"))


def maximum(*args) -> Expr:
    """a > b ? a : b from the left: with a NaN, the later argument."""
    out = lift(args[0])
    for a in args[1:]:
        out = Op("max", (out, lift(a)))
    return out


def minimum(*args) -> Expr:
    """a > b ? b : a from the left: with a NaN, the earlier argument."""
    out = lift(args[0])
    for a in args[1:]:
        out = Op("min", (out, lift(a)))
    return out


#: kind: (on Columns, on numpy arrays)
_OPS: dict[str, tuple[Callable, Callable]] = {
    "+": (lambda a, b: a + b, np.add),
    "-": (lambda a, b: a - b, np.subtract),
    "*": (lambda a, b: a * b, np.multiply),
    "/": (ieee.divide, np.true_divide),
    "neg": (lambda a: -a, np.negative),
    "fmod": (lambda a, b: ieee.fmod(a, b), np.fmod),
    "<": (ieee.less, np.less),
    "<=": (ieee.less_equal, np.less_equal),
    ">": (lambda a, b: ieee.less(b, a), np.greater),
    ">=": (lambda a, b: ieee.less_equal(b, a), np.greater_equal),
    "==": (ieee.equal, np.equal),
    "and": (lambda a, b: a & b, np.logical_and),
    "or": (lambda a, b: a | b, np.logical_or),
    "where": (lambda c, a, b: F.when(c, a).otherwise(b), np.where),
    "sqrt": (F.sqrt, np.sqrt),
    "exp": (F.exp, np.exp),
    "log": (ieee.log, np.log),
    "power": (F.pow, np.power),
    "abs": (F.abs, np.abs),
    "trunc": (ieee.trunc, np.trunc),
    "ceil": (ieee.ceil, np.ceil),
    "floor": (ieee.floor, np.floor),
    "sin": (F.sin, np.sin),
    "cos": (F.cos, np.cos),
    "max": (ieee.maximum, lambda a, b: np.where(np.greater(a, b), a, b)),
    "min": (ieee.minimum, lambda a, b: np.where(np.greater(a, b), b, a)),
    "array": (lambda *a: F.array(*a), None),
    "struct": (lambda *a: F.struct(*(x.alias(f"_{n}") for n, x in enumerate(a))), None),
}


def reads(expr: Expr) -> set[tuple[str, tuple[int, int, int]]]:
    if isinstance(expr, Read):
        return {(expr.field, expr.offset)}
    if isinstance(expr, ReadAt):
        return {(expr.field, expr.beside)} | reads(expr.by)
    if isinstance(expr, Item):
        return reads(expr.of)
    return set().union(*map(reads, expr.args)) if isinstance(expr, Op) else set()


def indexed_reads(expr: Expr) -> dict[str, ReadAt]:
    """Reads whose offset is an expression, by what they are in words: equal ones have one entry."""
    if isinstance(expr, ReadAt):
        if indexed_reads(expr.by):
            raise ValueError("an offset cannot be read at an offset that is an expression itself")
        return {repr(expr): expr}
    if isinstance(expr, Item):
        return indexed_reads(expr.of)
    out: dict[str, ReadAt] = {}
    for a in expr.args if isinstance(expr, Op) else ():
        out |= indexed_reads(a)
    return out


def native_only(expr: Expr) -> bool:
    """Whether a part of it has no numpy form."""
    if isinstance(expr, Item):
        return True
    return isinstance(expr, Op) and (_OPS[expr.kind][1] is None or any(map(native_only, expr.args)))


#: Kinds whose results are truth values or tuples, not numbers.
_NO_NUMBER = {"<", "<=", ">", ">=", "==", "and", "or", "array", "struct"}


def in_single(expr: Expr, singles: frozenset[str]) -> bool:
    """Whether all that it reads are fields of floats, and so all its steps stay floats."""
    if isinstance(expr, Op):
        return any(reads(a) for a in expr.args) and all(isinstance(a, Const) or in_single(a, singles) for a in expr.args)
    return isinstance(expr, Read | ReadAt) and expr.field in singles


def to_column(expr: Expr, read: Callable[[str, tuple[int, int, int]], Column], singles: frozenset[str] = frozenset(), index: Callable[[str], Column] = F.col, missing: bool = False) -> Column:
    """singles: the fields of floats.  Steps on these alone are rounded to single precision one by one, as numpy's are.  index: a coordinate of the point.

    An indexed read is read(field, its words).  missing: reads may be null; then a choice whose condition is unknown is null too.
    """
    if isinstance(expr, Const):
        return F.lit(expr.value)
    if singles and isinstance(expr, Op) and in_single(expr, singles):
        args = [F.lit(a.value).cast("float") if isinstance(a, Const) and type(a.value) is not bool else to_column(a, read, singles, index, missing) for a in expr.args]
        out = _OPS[expr.kind][0](*args)
        return out if expr.kind in _NO_NUMBER else ieee.single(out)
    if isinstance(expr, Read):
        return read(expr.field, expr.offset)
    if isinstance(expr, ReadAt):
        return read(expr.field, repr(expr))
    if isinstance(expr, Index):
        return index(expr.dim)
    if isinstance(expr, Item):
        of = to_column(expr.of, read, singles, index, missing)
        return F.get(of, F.lit(expr.at)) if isinstance(expr.at, int) else of.getField(expr.at)
    if missing and expr.kind == "where":
        condition, yes, no = (to_column(a, read, singles, index, missing) for a in expr.args)
        return F.when(condition, yes).when(~condition, no)
    return _OPS[expr.kind][0](*(to_column(a, read, singles, index, missing) for a in expr.args))


def to_numpy(expr: Expr, read: Callable[[str, tuple[int, int, int]], np.ndarray], index: Callable[[str], np.ndarray]):
    if isinstance(expr, Const):
        return expr.value
    if isinstance(expr, Read):
        return read(expr.field, expr.offset)
    if isinstance(expr, ReadAt):
        return read(expr.field, (*expr.offset[:2], expr.offset[2] + np.asarray(to_numpy(expr.by, read, index))))
    if isinstance(expr, Index):
        return index(expr.dim)
    with np.errstate(all="ignore"):
        return _OPS[expr.kind][1](*(to_numpy(a, read, index) for a in expr.args))
