"""The functional frontend: stencils are functions of iterators, which shift() moves and deref() reads.

A stencil returns an expression, or a tuple of them for as many outputs.  Stencils call each other on shifted iterators; the
moves add up in the iterator, so that a composed stencil is one gather of all that it reads.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import mesh, stencil
from fieldloom.plans.expr import Const, Expr, Item, Op, Read, ReadAt, indexed_reads, lift, reads, to_column
from fieldloom.plans.grid import Axis, Extent, Grid
from fieldloom.plans.spec import MultiStage, Operator, Spec, Stage, in_, inout
from fieldloom.sources.tables import written

DIMS = ("i", "j", "k")
_ACC = "__acc"


@dataclass(frozen=True)
class Iterator:
    """A field seen from a point: hops along connectivities, (name, place) each, and offsets along dimensions.

    levels: an expression that says how many levels away besides, at the point that the stencil is for.
    """

    field: str
    hops: tuple[tuple[str, int], ...] = ()
    offset: tuple[int, int, int] = (0, 0, 0)
    levels: Expr | None = None


def shift(it: Iterator, *moves: str | int | Expr) -> Iterator:
    """Moved by pairs: a dimension and a number of steps, or a connectivity's name and the neighbour's place.

    Along k the number may be an expression, as another field's value.
    """
    if len(moves) % 2:
        raise ValueError("moves come in pairs")
    for where, by in zip(moves[::2], moves[1::2], strict=True):
        if isinstance(by, Expr):
            if where != "k" or it.hops:
                raise ValueError("only levels of a cartesian domain can be shifted by an expression")
            it = replace(it, levels=by if it.levels is None else it.levels + by)
        elif where in DIMS:
            n = DIMS.index(where)
            it = replace(it, offset=tuple(o + by * (d == n) for d, o in enumerate(it.offset)))
        else:
            it = replace(it, hops=(*it.hops, (where, by)))
    return it


def deref(it: Iterator) -> Expr:
    """The field's value; null at a missing neighbour and beyond the table."""
    if it.levels is not None:
        return ReadAt(it.field, it.offset, it.levels)
    return Read(it.field, (it.hops, it.offset) if it.hops else it.offset)


def can_deref(it: Iterator) -> Expr:
    """False where a hop met a missing neighbour (from there is no way back); always true without hops."""
    return Read("", (it.hops, (0, 0, 0))) if it.hops else Const(True)


def _results(outs: tuple[str, ...], found) -> dict[str, Expr]:
    values = found if isinstance(found, tuple) else (found,)
    if len(values) != len(outs):
        raise ValueError(f"the stencil has {len(values)} results for {len(outs)} outputs")
    return {out: lift(v) for out, v in zip(outs, values, strict=True)}


def _names(out: str | tuple[str, ...]) -> tuple[str, ...]:
    return (out,) if isinstance(out, str) else tuple(out)


@dataclass(frozen=True)
class _Step:
    outs: tuple[str, ...]
    stencil: Callable
    inputs: tuple[str, ...]
    domain: mesh.Domain

    def bodies(self) -> dict[str, Expr]:
        return _results(self.outs, self.stencil(*map(Iterator, self.inputs)))


class CartesianExecutor:
    """Assignments that run in order on a dense table (i, j, k, fields), each on the executor's domain or its own.

    Consecutive assignments on the same levels run as stages of one parallel spec: one exchange for all, by windows.  Points
    outside an assignment's domain keep what they had (null in a new column).
    """

    def __init__(self, domain: mesh.Domain, fields: DataFrame, kind: str = "double"):
        self.domain, self.fields, self.kind = domain, fields, kind
        self.steps: list[_Step] = []

    def assign(self, out: str | tuple[str, ...], stencil: Callable, *inputs: str, domain: mesh.Domain | None = None) -> CartesianExecutor:
        self.steps.append(_Step(_names(out), stencil, inputs, domain or self.domain))
        return self

    def execute(self, **options) -> DataFrame:
        df = self.fields
        new = {out: F.lit(None).cast(self.kind) for s in self.steps for out in s.outs if out not in df.columns}
        df = df.withColumns(new) if new else df
        group: list[_Step] = []
        for s in self.steps:
            if group and not _together([*group, s]):
                df, group = _run(group, df, options), []
            group.append(s)
        return _run(group, df, options) if group else df


def _box(domain: mesh.Domain) -> tuple[tuple[int, int], ...]:
    """(first, after last) in each dimension."""
    if set(domain.sizes) != set(DIMS):
        raise ValueError("a cartesian domain here has the dimensions i, j and k")
    return tuple((domain.offsets.get(d, 0), domain.offsets.get(d, 0) + domain.sizes[d]) for d in DIMS)


def _together(steps: list[_Step]) -> bool:
    """Whether they fit in one spec: same levels, a common box, nothing written twice or after it was read at an offset."""
    boxes = [_box(s.domain) for s in steps]
    common = [(max(b[d][0] for b in boxes), min(b[d][1] for b in boxes)) for d in range(3)]
    if len({b[2] for b in boxes}) > 1 or any(a >= b for a, b in common):
        return False
    seen: set[str] = set()
    for s in steps:
        if seen & set(s.outs):
            return False
        seen |= set(s.outs) | {f for e in s.bodies().values() for f, _ in reads(e)}
    return True


def _run(steps: list[_Step], df: DataFrame, options: dict) -> DataFrame:
    boxes = [_box(s.domain) for s in steps]
    if any(a >= b for box in boxes for a, b in box):
        return df
    (i0, i1), (j0, j1), (k0, k1) = ((max(b[d][0] for b in boxes), min(b[d][1] for b in boxes)) for d in range(3))
    if k0 < 0:
        raise ValueError("levels begin at 0")
    axis = Axis(k0, k1 - k0)
    stages = []
    for s, box in zip(steps, boxes, strict=True):
        body = s.bodies()
        extent = Extent((box[0][0] - i0, box[0][1] - i1), (box[1][0] - j0, box[1][1] - j1))
        params = {}
        for f in {f for e in body.values() for f, _ in reads(e)}:
            if any(len(o) != 3 for e in body.values() for g, o in reads(e) if g == f):
                raise ValueError("connectivities need a MeshExecutor")
            hull = reduce(Extent.hull, (Extent.at(*o) for e in body.values() for g, o in reads(e) if g == f))
            params[f] = in_(hull.i, hull.j, hull.k)
        params |= {out: inout() for out in body}
        stages.append(Stage(Operator({axis.interval(1): _body(body)}, **params), {p: p for p in params}, extent))
    return stencil.run(Spec((MultiStage("parallel", tuple(stages)),)), Grid(i0, i1 - i0, j0, j1 - j0, axis), df, **options)


def _body(found: dict[str, Expr]) -> Callable:
    return lambda: found


# --- column passes


@dataclass(frozen=True)
class ScanPass:
    """step(acc, *iterators) gives the new accumulator, project(acc) what is written; acc is an expression, acc[n] of a tuple."""

    step: Callable
    project: Callable[[Expr], Expr] = lambda acc: acc


@dataclass(frozen=True)
class FoldPass:
    """As a scan's step; writes nothing."""

    step: Callable


def column_executor(fields: DataFrame, domain: mesh.Domain, seed: Column, inputs: tuple[str, ...], body: ScanPass | FoldPass, out: str, backward: bool = False, prologue: tuple = (), epilogue: tuple = (), kind: str = "double", width: int = 0, out_kind: str | None = None) -> DataFrame:
    """The domain's rows with `out` written by a pass over each column (i, j) whose step may read at offsets.

    Shifted inputs become columns first, by one parallel stage; then one exchange by column serves the pass.  width: the number of the
    accumulator's elements, if it is a tuple; it is written as struct<_0, _1, ...> unless the scans project it and out_kind says to what.
    """
    acc_kind = f"struct<{', '.join(f'_{n}: {kind}' for n in range(width))}>" if width else kind
    found = [_traced(p, inputs) for p in (body, *prologue, *epilogue)]
    wanted = sorted({r for step in found for r in reads(step) if r[0] != _ACC})
    moved = {(f, o): f"__at{n}" for n, (f, o) in enumerate(r for r in wanted if any(r[1]))}
    indexed = {key: r for step in found for key, r in indexed_reads(step).items()}
    if any(f == _ACC for r in indexed.values() for f, _ in reads(r.by)):
        raise ValueError("an offset cannot depend on the accumulator")
    if moved or indexed:
        copies = CartesianExecutor(domain, fields, kind)
        copied = [Read(f, o) for f, o in moved] + list(indexed.values())
        moved |= {(r.field, key): f"__by{n}" for n, (key, r) in enumerate(indexed.items())}
        copies.assign(tuple(moved.values()), lambda *its: tuple(copied))
        fields = copies.execute()
    passes = [_columns(p, step, moved) for p, step in zip((body, *prologue, *epilogue), found, strict=True)]
    df = fields.where(domain.holds())
    others = [c for c in df.columns if c not in DIMS]
    stage = mesh.ColumnStage(passes[0], out, seed, out_kind or acc_kind, acc_kind, backward, tuple(passes[1 : 1 + len(prologue)]), tuple(passes[1 + len(prologue) :]))
    return mesh.merged_columns(df, ["i", "j"], "k", others, [stage]).drop(*moved.values())


def _traced(p: ScanPass | FoldPass, inputs: tuple[str, ...]) -> Expr:
    found = p.step(_Acc(), *map(Iterator, inputs))
    return Op("struct", tuple(map(lift, found))) if isinstance(found, tuple) else lift(found)


class _Acc(Read):
    """The accumulator; its elements are named by place."""

    def __init__(self):
        super().__init__(_ACC)

    def __getitem__(self, at: int | str) -> Expr:
        return Item(self, f"_{at}" if isinstance(at, int) else at)


def _columns(p: ScanPass | FoldPass, step: Expr, moved: Mapping) -> mesh.Pass:
    run = lambda acc, x: to_column(step, lambda f, o: acc if f == _ACC else x[moved.get((f, o), f)])
    if isinstance(p, FoldPass):
        return mesh.Fold(run)
    return mesh.Scan(run, lambda acc: to_column(lift(p.project(_Acc())), lambda f, o: acc))


# --- meshes


def _way(domain: mesh.Domain, at: str, names: tuple[str, ...], hops: list[tuple[tuple[str, int], ...]]) -> DataFrame | None:
    """(at, place of each hop __n0..., __to): where the hops lead; None without hops."""
    way = None
    for d, name in enumerate(names):
        if name not in domain.connectivities:
            raise ValueError(f"the domain has no connectivity {name}")
        table = domain.connectivities[name].where(F.col("neighbor") != mesh.MISSING).where(F.col("n").isin(*{h[d][1] for h in hops}))
        if way is None:
            way = table.select(F.col("index").alias(at), F.col("n").alias("__n0"), F.col("neighbor").alias("__to"))
        else:
            table = table.select(F.col("index").alias("__to"), F.col("n").alias(f"__n{d}"), F.col("neighbor").alias("__next"))
            way = way.join(table, "__to").drop("__to").withColumnRenamed("__next", "__to")
    return way


def mesh_column_executor(domain: mesh.Domain, at: str, fields: Mapping[str, DataFrame], seed: Column, inputs: tuple[str, ...], body: ScanPass | FoldPass, out: str, backward: bool = False, prologue: tuple = (), epilogue: tuple = (), kind: str = "double", width: int = 0, out_kind: str | None = None, level: str = "k") -> DataFrame:
    """The location's rows within the domain with `out` written by a pass over each point's column; the step may read neighbours' columns, at level offsets too.

    Whole packed columns travel along the connectivities, once for all levels: an equi-join on the neighbour and an aggregate by point for each way.  Missing neighbours and levels
    read null.  width, out_kind: as in column_executor.
    """
    acc_kind = f"struct<{', '.join(f'_{n}: {kind}' for n in range(width))}>" if width else kind
    found = [_traced(p, inputs) for p in (body, *prologue, *epilogue)]
    if any(indexed_reads(step) for step in found):
        raise ValueError("a mesh is read at fixed level offsets")
    whole = MeshExecutor(domain, at, fields, level)
    own = fields[at].where(domain.holds())
    names = [c for c in own.columns if c not in (at, level)]
    packed = own.groupBy(at).agg(F.array_sort(F.collect_list(F.struct(F.col(level).alias("__k"), *names))).alias("__l"))
    moved: dict[tuple, str] = {}
    groups: dict[tuple, list[tuple[str, tuple]]] = {}
    for f, o in sorted({r for step in found for r in reads(step) if r[0] != _ACC}, key=repr):
        hops, offset = o if len(o) == 2 else ((), o)
        if any(offset[:2]):
            raise ValueError("a mesh has levels, but no i and j")
        if hops or offset[2]:
            moved[f, o] = f"__at{len(moved)}"
            groups.setdefault((whole._location(f) if f else None, tuple(h for h, _ in hops)), []).append((f, o))
    arrays: dict[tuple, str] = {}
    for n, ((location, way_names), wanted) in enumerate(groups.items()):
        if not way_names:
            continue
        way = _way(domain, at, way_names, [o[0] for _, o in wanted])
        if location is not None:
            values = sorted({f for f, _ in wanted})
            columns = fields[location].groupBy(F.col(location).alias("__to")).agg(F.array_sort(F.collect_list(F.struct(F.col(level).alias("__k"), *values))).alias("__column"))
            way = way.join(columns, "__to")
        got = []
        for m, hops in enumerate(sorted({o[0] for _, o in wanted})):
            here = reduce(lambda a, b: a & b, (F.col(f"__n{d}") == place for d, (_, place) in enumerate(hops)))
            arrays[location, hops] = f"__w{n}_{m}"
            got.append(F.first(F.when(here, F.col("__column") if location is not None else F.lit(True)), ignorenulls=True).alias(f"__w{n}_{m}"))
        packed = packed.join(way.groupBy(at).agg(*got), at, "left")

    def beside(x: Column, n: Column) -> Column:
        for (f, o), name in moved.items():
            hops, offset = o if len(o) == 2 else ((), o)
            if not f:
                x = x.withField(name, F.coalesce(F.col(arrays[None, hops]), F.lit(False)))
                continue
            column = F.col(arrays[whole._location(f), hops]) if hops else F.col("__l")
            # the level is where it is in dense columns of the same levels, else it is sought
            there = F.get(column, n + offset[2])
            level_there = F.when(there["__k"] == x["__k"] + offset[2], there).otherwise(F.get(F.filter(column, _at_level(x["__k"] + offset[2])), F.lit(0)))
            x = x.withField(name, level_there.getField(f))
        return x

    packed = packed.withColumn("__l", F.transform("__l", beside)) if moved else packed
    passes = [_columns(p, step, moved) for p, step in zip((body, *prologue, *epilogue), found, strict=True)]
    stage = mesh.ColumnStage(passes[0], out, seed, out_kind or acc_kind, acc_kind, backward, tuple(passes[1 : 1 + len(prologue)]), tuple(passes[1 + len(prologue) :]))
    return mesh.run_passes(packed, [at], level, names, [stage])


def _at_level(level: Column) -> Callable[[Column], Column]:
    return lambda y: y["__k"] == level


class MeshExecutor:
    """Assignments that run in order on one location of a mesh, from fields on any location.

    fields: for each location its table, with a column of that name for the point, the level where the domain has one, and
    values.  The domain's connectivities lead from point to point; what they lead to is the location of the field that is read.
    """

    def __init__(self, domain: mesh.Domain, at: str, fields: Mapping[str, DataFrame], level: str = "k"):
        self.domain, self.at, self.fields, self.level = domain, at, dict(fields), level
        self.steps: list[_Step] = []

    def assign(self, out: str | tuple[str, ...], stencil: Callable, *inputs: str) -> MeshExecutor:
        self.steps.append(_Step(_names(out), stencil, inputs, self.domain))
        return self

    def execute(self) -> DataFrame:
        """The location's table with the outputs.

        All fields that are reached by the same connectivities come by one equi-join on the neighbour and one aggregate by point,
        whatever the number of places; missing neighbours join nothing.
        """
        for s in self.steps:
            body = s.bodies()
            own = self.fields[self.at]
            groups: dict[tuple, list[tuple[str, tuple]]] = {}
            for f, o in sorted({r for e in body.values() for r in reads(e)}, key=repr):
                hops, offset = o if len(o) == 2 else ((), o)
                if any(offset[:2]):
                    raise ValueError("a mesh has levels, but no i and j")
                if hops or any(offset):
                    groups.setdefault((self._location(f), tuple(h for h, _ in hops), offset[2]), []).append((f, o))
            held: dict[tuple, str] = {}
            df = own
            for (location, names, up), wanted in groups.items():
                got, keys = self._gathered(location, names, up, wanted, held)
                df = df.join(got, keys, "left")
            exists = lambda f, o: F.coalesce(F.col(held[f, o]), F.lit(False)) if not f else F.col(held[f, o])
            read = lambda f, o: exists(f, o) if (f, o) in held else F.col(f)
            inside = self.domain.holds()
            new = {}
            for out, e in body.items():
                value = F.when(inside, to_column(e, read))
                new[out] = value.otherwise(F.col(out)) if out in own.columns else value
            self.fields[self.at] = df.withColumns(new).drop(*held.values())
        return self.fields[self.at]

    def needed(self, points: DataFrame) -> dict[str, DataFrame]:
        """For each field that is read, the points at which the outputs on `points` need it, all stages taken together: (id, and what points has besides).

        points: rows with an id, and more columns that tell parts of a mesh apart if there are any.  From the last assignment back, each is wanted on the
        points and wherever later ones read it; sets grow along the connectivities, a hop an equi-join.
        """
        need: dict[str, DataFrame] = {}
        for s in reversed(self.steps):
            own = points
            for out in s.outs:
                own = own.union(need.pop(out).select(*points.columns)) if out in need else own
            own = own.distinct()
            ways: dict[tuple, set[tuple]] = {}
            for f, o in {r for e in s.bodies().values() for r in reads(e) if r[0]}:
                hops = o[0] if len(o) == 2 else ()
                ways.setdefault((f, tuple(name for name, _ in hops)), set()).add(tuple(place for _, place in hops))
            for (f, names), places in sorted(ways.items()):
                reached = self._reached(own, names, sorted(places)) if names else own
                need[f] = need[f].union(reached).distinct() if f in need else reached
        return need

    def _reached(self, points: DataFrame, names: tuple[str, ...], places: list[tuple[int, ...]]) -> DataFrame:
        """Where the places along connectivities lead from the points, all by one way."""
        way = _way(self.domain, "id", names, [tuple(zip(names, p, strict=True)) for p in places])
        one = lambda p: reduce(lambda a, b: a & b, (F.col(f"__n{d}") == n for d, n in enumerate(p)))
        way = way.where(reduce(lambda a, b: a | b, map(one, places))).select("id", "__to")
        return points.join(way, "id").withColumn("id", F.col("__to")).select(*points.columns).distinct()

    def on_part(self, points: DataFrame) -> DataFrame:
        """What execute() gives on some points (id), from tables that hold only what these need: the part and its ghost points."""
        need = self.needed(points)
        own = points.select("id").distinct()
        for s in self.steps[:-1]:  # earlier outputs are computed where later assignments read them
            rest = MeshExecutor(self.domain, self.at, self.fields, self.level)
            rest.steps = self.steps[self.steps.index(s) + 1 :]
            later = rest.needed(points)
            for out in s.outs:
                own = own.union(later[out].select("id")).distinct() if out in later else own
        by_location: dict[str, DataFrame] = {self.at: own}
        for f, ids in need.items():
            at = self._location(f)
            by_location[at] = by_location[at].union(ids.select("id")) if at in by_location else ids.select("id")
        # the sets of points are written, so that the tables' plans do not hold the way to them
        fields = {at: self.fields[at].join(written(ids.distinct()).withColumnRenamed("id", at), at, "left_semi") for at, ids in by_location.items()}
        part = MeshExecutor(self.domain, self.at, fields, self.level)
        part.steps = list(self.steps)
        return part.execute().join(points.select(F.col("id").alias(self.at)), self.at, "left_semi")

    def _location(self, field: str) -> str | None:
        if not field:
            return None
        places = [at for at, df in self.fields.items() if field in df.columns]
        if len(places) != 1:
            raise ValueError(f"{field} is a field of {len(places)} locations")
        return places[0]

    def _gathered(self, location: str | None, names: tuple[str, ...], up: int, wanted: list, held: dict) -> tuple[DataFrame, list[str]]:
        places = [f"__n{d}" for d in range(len(names))]
        way = _way(self.domain, self.at, names, [o[0] for _, o in wanted])
        keys = [self.at]
        if location is not None:
            source = self.fields[location]
            levels = [self.level] if self.level in source.columns and self.level in self.fields[self.at].columns else []
            values = sorted({f for f, _ in wanted})
            source = source.select(F.col(location).alias("__to" if names else self.at), *((F.col(d) - up).cast(source.schema[d].dataType).alias(d) for d in levels), *(F.col(f).alias(f"__f_{f}") for f in values))
            if not names:
                if not levels:
                    raise ValueError("the field has no levels")
                out = {(f, o): f"__{len(held) + n}" for n, (f, o) in enumerate(wanted)}
                held |= out
                return source.select(self.at, *levels, *(F.col(f"__f_{f}").alias(c) for (f, _), c in out.items())), [self.at, *levels]
            way = way.join(source, "__to")
            keys += levels
        found = []
        for f, o in wanted:
            held[f, o] = f"__{len(held)}"
            here = reduce(lambda a, b: a & b, (F.col(p) == n for p, (_, n) in zip(places, o[0], strict=True)))
            found.append(F.max(F.when(here, F.col(f"__f_{f}") if f else F.lit(True))).alias(held[f, o]))
        return way.groupBy(*keys).agg(*found), keys
