"""Operators, stages and multistages; their checks, and how far each stage must compute."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from fieldloom.plans.expr import Const, Expr, Index, Read, ReadAt, indexed_reads, lift, reads
from fieldloom.plans.grid import Extent, Grid, Interval


class SpecError(ValueError):
    """A computation that breaks a rule of the model."""


@dataclass(frozen=True)
class Accessor:
    """A parameter: read only or written too, with the greatest offsets that it may be read at."""

    writable: bool = False
    extent: Extent = field(default_factory=Extent)


def in_(i: tuple[int, int] = (0, 0), j: tuple[int, int] = (0, 0), k: tuple[int, int] = (0, 0)) -> Accessor:
    return Accessor(False, Extent(i, j, k))


def inout(k: tuple[int, int] = (0, 0)) -> Accessor:
    """Written accessors have no horizontal extent."""
    return Accessor(True, Extent(k=k))


@dataclass(frozen=True)
class Global:
    """A constant for all points, or a callable that makes one from its arguments."""

    value: object

    def __call__(self, *args):
        return lift(self.value(*args) if callable(self.value) else self.value)


class _Reader:
    """What an operator's function gets for a parameter: calling it reads the field at an offset."""

    def __init__(self, name: str, field_name: str, accessor: Accessor, base: tuple[int, int, int] = (0, 0, 0)):
        self.name, self.field, self.accessor, self.base = name, field_name, accessor, base

    def __call__(self, i: int = 0, j: int = 0, k: int | Expr = 0) -> Expr:
        """k: levels away, or an expression that says how many at each point."""
        if isinstance(k, Expr):
            at = self(i, j)
            return ReadAt(self.field, (*at.offset[:2], self.base[2]), k)
        own = tuple(a + b for a, b in zip(self.base, (i, j, k), strict=True))
        if not self.accessor.extent.holds(Extent.at(*own)):
            raise SpecError(f"{self.name} is read at {own}, beyond its extent")
        return Read(self.field, own)

    def at(self, i: int = 0, j: int = 0, k: int = 0) -> _Reader:
        """The same parameter seen from another point: offsets add up."""
        return _Reader(self.name, self.field, self.accessor, tuple(a + b for a, b in zip(self.base, (i, j, k), strict=True)))


Body = Callable[..., Mapping[str, object]]


class Operator:
    """Parameters and, for each vertical interval (None: all levels), a function from readers to {parameter: value}."""

    def __init__(self, bodies: Body | Mapping[Interval | None, Body], **params: Accessor | Global):
        self.bodies: dict[Interval | None, Body] = dict(bodies) if isinstance(bodies, Mapping) else {None: bodies}
        self.params = params
        for name, p in params.items():
            if isinstance(p, Accessor) and p.writable and p.extent.horizontal() != Extent():
                raise SpecError(f"{name} is written and so has no horizontal extent")

    def __call__(self, **args) -> Mapping[str, object]:
        """As a function within another operator, on readers (seen from anywhere) or values in place of fields."""
        if None not in self.bodies or len(self.bodies) > 1:
            raise SpecError("only an operator for all levels can be called")
        given = {n: a if isinstance(a, _Reader) or callable(a) else (lambda i=0, j=0, k=0, a=a: lift(a)) for n, a in args.items()}
        given = {n: p for n, p in self.params.items() if isinstance(p, Global)} | given
        return {n: lift(v) for n, v in self.bodies[None](**{n: given.get(n) for n in inspect.signature(self.bodies[None]).parameters}).items()}


def operator(**params: Accessor | Global) -> Callable[[Body], Operator]:
    return lambda body: Operator(body, **params)


@dataclass(frozen=True)
class Stage:
    operator: Operator
    args: Mapping[str, str]
    extent: Extent | None = None

    def bodies(self) -> list[tuple[Interval | None, dict[str, Expr]]]:
        """For each interval, {written field: expression}."""
        out = []
        for interval, body in self.operator.bodies.items():
            given = {n: _Reader(n, self.args[n], p) if isinstance(p, Accessor) else p for n, p in self.operator.params.items()}
            wanted = inspect.signature(body).parameters
            found = body(**{n: r for n, r in given.items() if n in wanted})
            for n in found:
                if n not in self.operator.params or not getattr(self.operator.params[n], "writable", False):
                    raise SpecError(f"{n} is not a writable parameter")
            out.append((interval, {self.args[n]: lift(v) for n, v in found.items()}))
        return out

    def read_extents(self) -> dict[str, Extent]:
        out: dict[str, Extent] = {}
        for _, body in self.bodies():
            for e in body.values():
                for name, offset in reads(e):
                    out[name] = out.get(name, Extent()).hull(Extent.at(*offset))
        return out

    def indexed(self) -> dict[str, ReadAt]:
        out: dict[str, ReadAt] = {}
        for _, body in self.bodies():
            for e in body.values():
                out |= indexed_reads(e)
        return out

    def written(self) -> set[str]:
        return {self.args[n] for n, p in self.operator.params.items() if isinstance(p, Accessor) and p.writable}


@dataclass(frozen=True)
class MultiStage:
    """Stages in one vertical order: parallel, forward or backward."""

    order: str
    stages: tuple[Stage, ...] = ()
    caches: tuple[tuple[str, str, tuple[str, ...]], ...] = ()

    def stage(self, op: Operator, *, extent: Extent | None = None, **args: str) -> MultiStage:
        """Append a stage; args name the field of each parameter.  extent: compute so far, whatever is inferred."""
        fields = {n for n, p in op.params.items() if isinstance(p, Accessor)}
        if set(args) != fields:
            raise SpecError(f"the operator takes {sorted(fields)}, not {sorted(args)}")
        return MultiStage(self.order, (*self.stages, Stage(op, args, extent)), self.caches)

    def ij_cached(self, *names: str) -> MultiStage:
        """Accepted for its checks; Spark has nothing to do."""
        return MultiStage(self.order, self.stages, (*self.caches, *(("ij", n, ()) for n in names)))

    def k_cached(self, *names: str, fill: bool = False, flush: bool = False) -> MultiStage:
        policies = ("fill",) * fill + ("flush",) * flush
        return MultiStage(self.order, self.stages, (*self.caches, *(("k", n, policies) for n in names)))


def execute_parallel() -> MultiStage:
    return MultiStage("parallel")


def execute_forward() -> MultiStage:
    return MultiStage("forward")


def execute_backward() -> MultiStage:
    return MultiStage("backward")


@dataclass(frozen=True)
class Spec:
    """Multistages one after the other; temps: the fields that only live within a run; kinds: types of temps other than double."""

    multistages: tuple[MultiStage, ...]
    temps: frozenset[str] = frozenset()
    kinds: Mapping[str, str] = field(default_factory=dict)

    def stages(self) -> list[Stage]:
        return [s for m in self.multistages for s in m.stages]

    def fields(self) -> set[str]:
        return {f for s in self.stages() for f in s.args.values()}

    def compute_extents(self) -> list[Extent]:
        """Of each stage, how far beyond the box it computes so that all later reads of what it writes find values.

        From the last stage back: the hull, over what the stage writes, of the later readers' own extents plus their read
        offsets.  Vertical offsets do not count.
        """
        needed: dict[str, Extent] = {}
        out = []
        for s in reversed(self.stages()):
            own = Extent()
            for name in s.written():
                own = own.hull(needed.get(name, Extent()))
            own = s.extent if s.extent is not None else own
            out.append(own.horizontal())
            for name, e in s.read_extents().items():
                needed[name] = needed.get(name, Extent()).hull(own.plus(e).horizontal())
        return out[::-1]

    def arg_extents(self) -> dict[str, Extent]:
        """How far each field is read beyond the box, k offsets included."""
        out: dict[str, Extent] = {}
        for s, own in zip(self.stages(), self.compute_extents(), strict=True):
            found = s.read_extents()
            for name in s.args.values():
                out[name] = out.get(name, Extent()).hull(own.plus(found.get(name, Extent())))
        return out

    def arg_intent(self, name: str) -> str:
        if name not in self.fields():
            raise SpecError(f"no stage uses {name}")
        return "inout" if any(name in s.written() for s in self.stages()) else "in"

    def validate(self, grid: Grid) -> None:
        writer: dict[str, int] = {}
        offset_read: set[str] = set()
        for n, s in enumerate(self.stages()):
            for name in s.written():
                if name in writer:
                    raise SpecError(f"{name} is written by stages {writer[name]} and {n}")
                if name in offset_read and name not in self.temps:
                    raise SpecError(f"{name} is written after it was read at an offset")
                writer[name] = n
            offset_read |= {name for name, e in s.read_extents().items() if e.horizontal() != Extent()}
            taken: set[int] = set()
            for interval in s.operator.bodies:
                levels = set(grid.levels(interval) if interval else range(grid.nk))
                if taken & levels:
                    raise SpecError("intervals of an operator overlap")
                taken |= levels
            for name, e in s.read_extents().items():
                if name in s.written() and e.horizontal() != Extent():
                    raise SpecError(f"{name} is written and read at a horizontal offset in one stage")
        for t in self.temps:
            if t in self.fields() and t not in writer:
                raise SpecError(f"temporary {t} is never written")
        for m in self.multistages:
            used = {f for s in m.stages for f in s.args.values()}
            for kind, name, policies in m.caches:
                if name not in used:
                    raise SpecError(f"cached {name} is not used in the multistage")
                if not policies and name not in self.temps:
                    raise SpecError(f"only temporaries can be cached without a policy, not {name}")
                if policies and kind == "ij":
                    raise SpecError("ij caches have no policy")

    def explain_json(self, grid: Grid) -> str:
        """The plan as JSON: multistages, their stages with extent, intervals, fields and expressions."""
        extents = iter(self.compute_extents())
        plan = {"temporaries": sorted(self.temps), "multistages": []}
        for m in self.multistages:
            stages = []
            for s in m.stages:
                e = next(extents)
                cells = [{"levels": [r.start, r.stop], "writes": {f: _told(x) for f, x in body.items()}} for interval, body in s.bodies() for r in [grid.levels(interval) if interval else range(grid.nk)]]
                stages.append({"fields": dict(s.args), "extent": {"i": e.i, "j": e.j}, "cells": cells})
            plan["multistages"].append({"execution": m.order, "caches": [list(c) for c in m.caches], "stages": stages})
        return json.dumps(plan)


def _told(e: Expr) -> object:
    if isinstance(e, Const):
        return e.value
    if isinstance(e, Read):
        return {"read": e.field, "offset": list(e.offset)}
    if isinstance(e, ReadAt):
        return {"read": e.field, "offset": list(e.offset), "levels": _told(e.by)}
    if isinstance(e, Index):
        return {"index": e.dim}
    return {"op": e.kind, "args": [_told(a) for a in e.args]} if hasattr(e, "kind") else {"item": e.at, "of": _told(e.of)}


def multi_pass(*multistages: MultiStage, temps: tuple[str, ...] | Mapping[str, str] = ()) -> Spec:
    """temps: names, or types by name (of doubles and other numbers in blocks, of any type in windows)."""
    return Spec(multistages, frozenset(temps), dict(temps) if isinstance(temps, Mapping) else {})
