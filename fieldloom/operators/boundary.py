"""Boundary conditions on the 26 directions around a box, and after a halo exchange."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.plans.grid import Halo

#: A direction's sign in each dimension; None in a pattern stands for any.
Direction = tuple[int, int, int]
Pattern = tuple[int | None, int | None, int | None]
Functor = Callable[[Mapping[str, Column]], Mapping[str, Column]]
DIRECTIONS: list[Direction] = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]


def sides(halos: tuple[Halo, Halo, Halo]) -> list[Column]:
    """The sign of a cell's side in each dimension: 0 within the box, null beyond the halo."""
    out = []
    for d, h in zip("ijk", halos, strict=True):
        x, rule = F.col(d), None
        for side in (-1, 0, 1):
            r = h.receive(side)
            if len(r):
                rule = (F if rule is None else rule).when(x.between(r.start, r.stop - 1), F.lit(side))
        out.append(rule if rule is not None else F.lit(None).cast("int"))
    return out


def always(direction: Direction) -> bool:
    return True


def at_edges(block: Direction, blocks: Direction, periodic: tuple[bool, bool, bool]) -> Callable[[Direction], bool]:
    """Only where a block of a grid of blocks has no neighbour."""

    def without_neighbour(direction: Direction) -> bool:
        return any(not p and not 0 <= b + s < n for b, n, s, p in zip(block, blocks, direction, periodic, strict=True))

    return without_neighbour


def apply_boundary(df: DataFrame, halos: tuple[Halo, Halo, Halo], rules: Mapping[Pattern, Functor], predicate: Callable[[Direction], bool] = always, edges: tuple[Direction, tuple[bool, bool, bool]] | None = None) -> DataFrame:
    """df with the halo cells of each direction that passes the predicate updated by its most specific rule.

    A rule gets {column: Column} and returns the new ones.  edges: of a table of blocks (bi, bj, bk), the number of blocks and
    the periodic dimensions; rules then only hold where a block has no neighbour.  No shuffle: one conditional for each column.
    """
    si, sj, sk = sides(halos)
    columns = {c: F.col(c) for c in df.columns}
    updates: dict[str, list[tuple[Column, Column]]] = {}
    for direction in DIRECTIONS:
        fitting = [p for p in rules if all(a is None or a == b for a, b in zip(p, direction, strict=True))]
        if not fitting or not predicate(direction):
            continue
        best = max(fitting, key=lambda p: sum(a is not None for a in p))
        here = (si == direction[0]) & (sj == direction[1]) & (sk == direction[2])
        if edges:
            blocks, periodic = edges
            outside = [~(F.col(f"b{d}") + s).between(0, n - 1) for d, s, n, p in zip("ijk", direction, blocks, periodic, strict=True) if s and not p]
            if not outside:
                continue
            here = here & reduce(lambda a, b: a | b, outside)
        for name, value in rules[best](columns).items():
            updates.setdefault(name, []).append((here, value))
    out = {}
    for name, cases in updates.items():
        rule = None
        for here, value in cases:
            rule = (rule if rule is not None else F).when(here, value)
        out[name] = rule.otherwise(F.col(name)).cast(df.schema[name].dataType)
    return df.withColumns(out) if out else df


ANY: Pattern = (None, None, None)


def copy_boundary(source: str, *targets: str) -> dict[Pattern, Functor]:
    return {ANY: lambda c: {t: c[source] for t in targets}}


def value_boundary(value: object, *targets: str) -> dict[Pattern, Functor]:
    return {ANY: lambda c: {t: F.lit(value) for t in targets}}


def zero_boundary(*targets: str) -> dict[Pattern, Functor]:
    return value_boundary(0, *targets)


@dataclass(frozen=True)
class BoundCondition:
    """Rules with the fields that are exchanged; associated fields are read by the rules only."""

    rules: Mapping[Pattern, Functor]
    fields: tuple[str, ...]
    associated: tuple[str, ...] = field(default=())

    def associate(self, *names: str) -> BoundCondition:
        return BoundCondition(self.rules, self.fields, self.associated + names)


def bind_bc(rules: Mapping[Pattern, Functor], *fields: str) -> BoundCondition:
    return BoundCondition(rules, fields)


class DistributedBoundaries:
    """Halo exchange, then boundary conditions, of a table of blocks."""

    def __init__(self, halos: tuple[Halo, Halo, Halo], blocks: Direction, periodic: tuple[bool, bool, bool], max_stores: int):
        self.halos, self.blocks, self.periodic, self.max_stores = halos, blocks, periodic, max_stores

    def exchange(self, df: DataFrame, *jobs: str | BoundCondition) -> DataFrame:
        from fieldloom.operators.halo import exchange

        names = list(dict.fromkeys(f for job in jobs for f in ((job,) if isinstance(job, str) else job.fields)))
        if len(names) > self.max_stores:
            raise ValueError(f"{len(names)} fields are more than max_stores {self.max_stores}")
        return self.boundary_only(exchange(df, names, self.halos, self.blocks, self.periodic), *jobs)

    def boundary_only(self, df: DataFrame, *jobs: str | BoundCondition) -> DataFrame:
        for job in jobs:
            if not isinstance(job, str):
                df = apply_boundary(df, self.halos, job.rules, edges=(self.blocks, self.periodic))
        return df
