"""Forward and backward multistages in the JVM: a point's column is packed into one array and folded level by level.

The stages of a multistage are compiled into one step.  Its accumulator is a ring of what the last levels wrote, as long as the greatest offset that is
read behind; what is read ahead, or is not written in the multistage, comes from the packed levels.  Horizontal reads of fields that
the multistage does not write are windows before the column is packed.  Parallel multistages in between are windows as ever.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.plans.expr import ReadAt, reads, to_column
from fieldloom.plans.grid import Extent, Grid
from fieldloom.plans.spec import MultiStage, Spec, Stage

#: Levels whose results are gathered at a time: an array that grows level by level is copied each time.
CHUNK = 32
KEYS = ["ti", "tj", "own", "i", "j"]


def has_column_form(spec: Spec) -> bool:
    """Whether no ordered multistage reads what it writes at a horizontal offset or at one that is an expression."""
    for m in spec.multistages:
        if m.order != "parallel":
            written = {f for s in m.stages for f in s.written()}
            if any(f in written and any(o[:2]) for s in m.stages for f, o in _reads(s)):
                return False
            if any(n.field in written or any(f in written for f, _ in reads(n.by)) for s in m.stages for n in s.indexed().values()):
                return False
    return True


def _reads(s: Stage) -> set[tuple[str, tuple[int, int, int]]]:
    return {r for _, body in s.bodies() for e in body.values() for r in reads(e)}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def run_columns(spec: Spec, grid: Grid, tiled: DataFrame, parallel_stage: Callable, shifted: Callable) -> DataFrame:
    """tiled (see stencil.deal) after all multistages.  parallel_stage and shifted: the window forms of a stage, and of reads at offsets."""
    singles = frozenset(f.name for f in tiled.schema if isinstance(f.dataType, T.FloatType))
    extents = iter(spec.compute_extents())
    flat, packed = tiled, None
    checked: set[str] = set()
    for m in spec.multistages:
        stages = [(s, next(extents)) for s in m.stages]
        beside = sorted({(f, (*o[:2], 0)) for s, _ in stages for f, o in _reads(s) if any(o[:2])})
        wanted = {key: n for s, _ in stages for key, n in s.indexed().items()}
        if packed is not None and (m.order == "parallel" or beside or wanted):
            flat, packed = _unpacked(packed), None
        if m.order == "parallel":
            for s, extent in stages:
                flat = parallel_stage(flat, s, extent, grid, singles, checked)
            continue
        held: dict[tuple, str] = {}
        if beside:
            flat, held = shifted(flat, beside, checked)
        if wanted:
            flat, more = read_indexed(flat, wanted, held, singles)
            held |= more
        if packed is None:
            packed = _packed(flat)
        packed = _folded(packed, m, stages, grid, held, singles)
        if held:
            packed = packed.withColumn("__l", F.transform("__l", _without(list(held.values()))))
    return _unpacked(packed) if packed is not None else flat


def _without(names: list[str]) -> Callable[[Column], Column]:
    return lambda x: x.dropFields(*names)


def _packed(flat: DataFrame) -> DataFrame:
    """One row for each column: its levels in order.  Tiles hold whole columns, so that this needs no exchange."""
    levels = F.struct("k", *(F.col(c) for c in flat.columns if c not in KEYS and c != "k"))
    return flat.groupBy(*KEYS).agg(F.array_sort(F.collect_list(levels)).alias("__l"))


def read_indexed(flat: DataFrame, wanted: dict[str, ReadAt], held: dict[tuple, str], singles: frozenset[str]) -> tuple[DataFrame, dict[tuple, str]]:
    """flat with a column for each read whose offset is an expression, and their names; null beyond the column and where the offset is null.

    All come by array access in the packed column, in one pass over it: no join, and no exchange beside that of the tiles.  Offsets are cut to whole levels.
    """
    at = lambda f, o: F.col(held[f, o] if any(o) else f)
    offsets = {f"__o{n}": (to_column(r.by, at, singles) + r.offset[2]).cast("int") for n, r in enumerate(wanted.values())}
    packed = _packed(flat.withColumns(offsets))
    dense = F.size("__l") == F.element_at("__l", -1)["k"] - F.element_at("__l", 1)["k"] + 1
    levels = F.when(dense, F.col("__l")).otherwise(F.raise_error(F.lit("the table has a hole or a repeated point along k")))

    def found(x: Column, n: Column) -> Column:
        for m, r in enumerate(wanted.values()):
            x = x.withField(f"__d{m}", F.get("__l", n + x[f"__o{m}"]).getField(held[r.field, r.beside] if any(r.beside) else r.field))
        return x.dropFields(*offsets)

    flat = _unpacked(packed.withColumn("__l", F.transform(levels, found)))
    return flat, {(r.field, key): f"__d{m}" for m, (key, r) in enumerate(wanted.items())}


def _unpacked(packed: DataFrame) -> DataFrame:
    # no column is empty; an inner explode would have its array computed once more, by a filter on its size
    return packed.select(*KEYS, F.explode_outer("__l").alias("__x")).select(*KEYS, "__x.*")


def _folded(packed: DataFrame, m: MultiStage, stages: list[tuple[Stage, Extent]], grid: Grid, held: dict[tuple, str], singles: frozenset[str]) -> DataFrame:
    backward = m.order == "backward"
    behind = 1 if backward else -1  # the sign of offsets to levels that are done
    kinds = {f.name: f.dataType for f in packed.schema["__l"].dataType.elementType}
    written = sorted({f for s, _ in stages for f in s.written()})
    every = {r for s, _ in stages for r in _reads(s)}
    ring = {f: max([1, *(abs(o[2]) for g, o in every if g == f and o[2] * behind > 0)]) for f in written}
    ahead = sorted((f, o) for f, o in every if o[2] and not (f in written and o[2] * behind > 0))
    copies = {r: f"__v{n}" for n, r in enumerate(ahead)}
    source = lambda f, o: held[f, (*o[:2], 0)] if any(o[:2]) else f

    # levels with what they read above and below, in the order of the fold
    levels = F.col("__l")
    if copies:
        def beside(x: Column, n: Column) -> Column:
            for (f, o), name in copies.items():
                x = x.withField(name, F.get("__l", n + o[2]).getField(source(f, o)))
            return x

        levels = F.transform("__l", beside)
    levels = F.reverse(levels) if backward else levels

    def stage(acc: Column, x: Column, now: Callable[[str], Column], s: Stage, extent: Extent) -> Column:
        """struct of all written fields after a stage at a level."""

        def read(f: str, o: tuple[int, int, int]) -> Column:
            if isinstance(o, str):
                return x.getField(held[f, o])
            if f in ring and not o[2]:
                return now(f)
            if f in ring and o[2] * behind > 0:
                return acc.getField(f"{f}__{abs(o[2]) - 1}")
            return x.getField(copies[f, o] if o[2] else source(f, o))

        inside = F.col("i").between(grid.i0 + extent.i[0], grid.i0 + grid.ni - 1 + extent.i[1]) & F.col("j").between(grid.j0 + extent.j[0], grid.j0 + grid.nj - 1 + extent.j[1])
        new: dict[str, Column] = {}
        for interval, body in s.bodies():
            at = grid.levels(interval) if interval else range(grid.nk)
            here = inside & x["k"].between(at.start, at.stop - 1)
            for f, e in body.items():
                value = to_column(e, read, singles, index=lambda d: x["k"] if d == "k" else F.col(d))
                value = value if isinstance(kinds[f], (T.StructType, T.ArrayType)) else value.cast(kinds[f])
                new[f] = new[f].when(here, value) if f in new else F.when(here, value)
        return F.struct(*((new[f].otherwise(now(f)) if f in new else now(f)).alias(f) for f in written))

    def step(state: Column, x: Column) -> Column:
        acc = state["acc"]

        def after(now: Callable[[str], Column], rest: list) -> Column:
            if rest:
                return bound(stage(acc, x, now, *rest[0]), lambda c: after(c.getField, rest[1:]))
            moved = [now(f).alias(f"{f}__0") for f in written] + [acc.getField(f"{f}__{n - 1}").alias(f"{f}__{n}") for f in written for n in range(1, ring[f])]
            return F.struct(F.struct(*moved).alias("acc"), F.concat(state["out"], F.array(F.struct(*(now(f).alias(f) for f in written)))).alias("out"))

        return after(x.getField, stages)

    one = T.StructType([T.StructField(f, kinds[f]) for f in written])
    ring_type = T.StructType([T.StructField(f"{f}__0", kinds[f]) for f in written] + [T.StructField(f"{f}__{n}", kinds[f]) for f in written for n in range(1, ring[f])])
    state_type = T.StructType([T.StructField("acc", ring_type), T.StructField("out", T.ArrayType(one))])
    some = lambda kind: F.array().cast(kind)

    def chunk(state: Column, part: Column) -> Column:
        fresh = F.struct(state["acc"].alias("acc"), some(T.ArrayType(one)).alias("out")).cast(state_type)
        done = F.aggregate(part, fresh, lambda s, x: step(s, x).cast(state_type))
        return bound(done, lambda d: F.struct(d["acc"].alias("acc"), F.concat(state["out"], F.array(d["out"])).alias("out")).cast(chunks_type))

    chunks_type = T.StructType([T.StructField("acc", ring_type), T.StructField("out", T.ArrayType(T.ArrayType(one)))])
    start = F.struct(F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in ring_type)).alias("acc"), some(T.ArrayType(T.ArrayType(one))).alias("out")).cast(chunks_type)
    packed = packed.withColumn("__in", levels)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("__in") - 1) / CHUNK).cast("int")), lambda c: F.slice("__in", c * CHUNK + 1, F.lit(CHUNK)))
    packed = packed.withColumn("__out", F.flatten(F.aggregate(parts, start, chunk).getField("out")))

    def put(x: Column, w: Column) -> Column:
        for f in written:
            x = x.withField(f, w.getField(f))
        return x

    return packed.withColumn("__l", F.zip_with("__l", F.reverse("__out") if backward else F.col("__out"), put)).drop("__in", "__out")
