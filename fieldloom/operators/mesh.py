"""Unstructured meshes: gathers over neighbour tables, scans and folds of columns, and the functional frontend.

A connectivity is a table (index, n, neighbor): the n-th neighbour of a point, -1 where there is none.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

MISSING = -1


def as_neighbor_table(df: DataFrame, index: str, place: str, neighbor: str) -> DataFrame:
    if index == place:
        raise ValueError("index and neighbour dimensions must differ")
    return df.select(F.col(index).alias("index"), F.col(place).alias("n"), F.col(neighbor).alias("neighbor"))


def neighbors_of(table: DataFrame, index: int) -> DataFrame:
    return table.where(F.col("index") == index).orderBy("n")


def hop(points: DataFrame, at: str, table: DataFrame, place: int | None = None, to: str | None = None, order: str = "n") -> DataFrame:
    """Move along a connectivity: to the place-th neighbour, or a row for each neighbour with its place in `order`.

    The new position is in `to` (at, if None).  -1 stays -1: from a missing point there is no way back.
    """
    to = to or at
    own = table if place is None else table.where(F.col("n") == place)
    own = own.select(F.col("index").alias("__index"), F.col("n").alias("__n"), F.col("neighbor").alias("__to"))
    out = points.join(own, F.col(at) == F.col("__index"), "left")
    out = out.withColumn(to, F.coalesce("__to", F.lit(MISSING)))
    return (out.withColumn(order, F.col("__n")) if place is None else out).drop("__index", "__n", "__to")


def deref(points: DataFrame, at: str, field: DataFrame, index: str, value: str, more: tuple[str, ...] = (), name: str | None = None) -> DataFrame:
    """The field's value at a position (null where it is -1); more: dimensions that both share, as k."""
    own = field.select(F.col(index).alias("__index"), *more, F.col(value).alias(name or value))
    return points.withColumnRenamed(at, "__index").join(own, ["__index", *more], "left").withColumnRenamed("__index", at)


def can_deref(at: str) -> Column:
    return F.col(at) != MISSING


def reduce_neighbors(field: DataFrame, value: str, table: DataFrame, index: str, target: str, fold: Callable[[Column, Column, Column], Column], init: Column, levels: Mapping[str, int] | None = None, name: str = "value") -> DataFrame:
    """(target, *levels, name): fold(acc, neighbour's value, place) over the neighbours that exist, in their order.

    levels: sizes of the dimensions that the field has besides (as k), in which it is dense.  Values are gathered by one equi-join on
    the neighbour, and folded in an array no longer than a point's neighbours.  Points without neighbours give init at every
    level; they are found from the table alone and join nothing, so that they make no hot key.
    """
    more = list(levels or {})
    there = table.where(F.col("neighbor") != MISSING).join(field.select(F.col(index).alias("neighbor"), *more, F.col(value).alias("__value")), "neighbor")
    there = there.select("index", *more, F.struct("n", "__value").alias("__x"))
    alone = table.groupBy("index").agg(F.max("neighbor").alias("__most")).where(F.col("__most") == MISSING).drop("__most")
    for d, n in (levels or {}).items():
        alone = alone.withColumn(d, F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast(ArrayType(field.schema[d].dataType))))
    alone = alone.withColumn("__x", F.lit(None).cast(there.schema["__x"].dataType))
    lists = there.unionByName(alone).groupBy("index", *more).agg(F.array_sort(F.collect_list("__x")).alias("__list"))
    folded = F.aggregate("__list", init, lambda acc, x: fold(acc, x["__value"], x["n"]))
    return lists.select(F.col("index").alias(target), *more, folded.alias(name))


def indirect(field: DataFrame, value: str, axis: str, offset: Column, keys: list[str], name: str = "value") -> DataFrame:
    """field with the value found `offset` places further along an axis, where offset is a field's own value."""
    own = field.select(*keys, F.col(axis).alias("__at"), F.col(value).alias(name))
    return field.withColumn("__at", (F.col(axis) + offset).cast(field.schema[axis].dataType)).join(own, [*keys, "__at"], "left").drop("__at")


# --- ordered columns


@dataclass(frozen=True)
class Scan:
    """acc = step(acc, inputs); writes project(acc) at each level.  step gets the accumulator and a level's struct."""

    step: Callable[[Column, Column], Column]
    project: Callable[[Column], Column] = lambda acc: acc


@dataclass(frozen=True)
class Fold:
    """acc = step(acc, inputs); writes nothing."""

    step: Callable[[Column, Column], Column]


Pass = Scan | Fold


@dataclass(frozen=True)
class ColumnStage:
    """A pass over each column, in order or backward; out: the field that its scans write, if any.

    seed None takes the accumulator that the stage before ended with.  prologue and epilogue take the first and last levels met.
    """

    body: Pass
    out: str | None = None
    seed: Column | None = None
    kind: str = "double"
    acc_kind: str | None = None
    backward: bool = False
    prologue: tuple[Pass, ...] = ()
    epilogue: tuple[Pass, ...] = ()


#: Levels whose results are gathered at a time: an array that grows level by level is copied each time.
CHUNK = 64


def merged_columns(df: DataFrame, keys: list[str], axis: str, inputs: list[str], stages: list[ColumnStage], last: str | None = None, beside: DataFrame | None = None) -> DataFrame:
    """(keys, axis, inputs and what the stages write, last): stages run one after the other on each column.

    A stage reads the inputs and what stages before it wrote.  Levels that a fold covers keep the old value, or null where `out` is
    no input.  last: a column for the accumulator at the end.  One exchange serves all stages: a point's column is one array,
    ordered and folded by JVM aggregates; it must be as long as a stage's prologue and epilogue.  beside: a row for each column by keys, whose other values
    the seeds and steps may use.
    """
    level = F.struct(F.col(axis).alias("__k"), *inputs)
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(level)).alias("__l"))
    if beside is not None:
        packed = packed.join(beside, keys, "left")
    return run_passes(packed, keys, axis, inputs, stages, last)


def run_passes(packed: DataFrame, keys: list[str], axis: str, inputs: list[str], stages: list[ColumnStage], last: str | None = None) -> DataFrame:
    """The stages on packed columns: a row for each, with its levels in __l, structs of __k and what the stages read; returns rows of inputs and results."""
    known = list(inputs)
    for n, s in enumerate(stages):
        if s.seed is None and n == 0:
            raise ValueError("the first stage needs a seed")
        packed = packed.withColumn(f"__s{n}", _pass(s, s.seed if s.seed is not None else F.col(f"__s{n - 1}.acc"), s.out in known))
        if s.out:
            written = F.col(f"__s{n}.out")
            written = F.flatten(F.reverse(F.transform(written, F.reverse)) if s.backward else written)
            packed = packed.withColumn("__l", F.zip_with("__l", written, _put(s.out)))
            known += [s.out] * (s.out not in known)
    # no column is empty; an inner explode would have its array computed once more, by a filter on its size
    flat = packed.select(*keys, F.explode_outer("__l").alias("__x"), F.col(f"__s{len(stages) - 1}.acc").alias("__acc"))
    return flat.select(*keys, F.col("__x.__k").alias(axis), *(F.col(f"__x.`{c}`").alias(c) for c in known), *([F.col("__acc").alias(last)] if last else []))


def _put(name: str) -> Callable[[Column, Column], Column]:
    return lambda x, v: x.withField(f"`{name}`", v)


def _pass(s: ColumnStage, seed: Column, old: bool) -> Column:
    """struct<acc, out, n> of a stage over __l: its accumulator at the end, and what it wrote in chunks in the order met."""
    n_pro, n_epi = len(s.prologue), len(s.epilogue)
    acc_kind = s.acc_kind or s.kind
    size = F.size("__l")
    levels = F.reverse("__l") if s.backward else F.col("__l")
    if n_pro + n_epi:
        levels = F.when(size >= n_pro + n_epi, levels).otherwise(F.raise_error(F.lit("a column is shorter than prologue and epilogue")))
    nothing = F.expr("array()").cast(f"array<{s.kind}>")

    def step(state: Column, x: Column) -> Column:
        acc = state["acc"]

        def done(p: Pass) -> tuple[Column, Column]:
            new = p.step(acc, x).cast(acc_kind)
            return new, (p.project(new) if isinstance(p, Scan) else x[s.out] if old else F.lit(None)).cast(s.kind)

        new, written = done(s.body)
        for at, p in [*((n, p) for n, p in enumerate(s.prologue)), *((size - n_epi + n, p) for n, p in enumerate(s.epilogue))]:
            a, w = done(p)
            here = state["n"] == at
            new, written = F.when(here, a).otherwise(new), F.when(here, w).otherwise(written)
        out = F.concat(state["out"], F.array(written)) if s.out else state["out"]
        return F.struct(new.alias("acc"), out.alias("out"), (state["n"] + 1).alias("n"))

    def chunk(state: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(state["acc"].alias("acc"), nothing.alias("out"), state["n"].alias("n")), step)
        joined = lambda x, d: F.struct(d["acc"].alias("acc"), F.concat(x["out"], F.array(d["out"])).alias("out"), d["n"].alias("n"))
        return F.aggregate(F.array(done), state, joined)  # names the chunk's result, which is used three times

    chunks = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / CHUNK).cast("int")), lambda c: F.slice(levels, c * CHUNK + 1, F.lit(CHUNK)))
    start = F.struct(seed.cast(acc_kind).alias("acc"), F.expr("array()").cast(f"array<array<{s.kind}>>").alias("out"), F.lit(0).alias("n"))
    return F.aggregate(chunks, start, chunk)


def column_stage(df: DataFrame, keys: list[str], axis: str, inputs: list[str], seed: Column, body: Pass, kind: str, out: str = "value", backward: bool = False, prologue: tuple[Pass, ...] = (), epilogue: tuple[Pass, ...] = (), acc_kind: str | None = None) -> DataFrame:
    """(keys, axis, out, out_last): one pass over each column in order; levels that a fold covers have null."""
    ran = merged_columns(df, keys, axis, [c for c in inputs if c != out], [ColumnStage(body, out, seed, kind, acc_kind, backward, prologue, epilogue)], f"{out}_last") if out not in inputs else None
    if ran is None:  # what it reads has the name of what it writes
        ran = merged_columns(df, keys, axis, inputs, [ColumnStage(body, "__out", seed, kind, acc_kind, backward, prologue, epilogue)], f"{out}_last").drop(out).withColumnRenamed("__out", out)
    return ran.select(*keys, axis, out, f"{out}_last")


def fold_columns(df: DataFrame, keys: list[str], axis: str, inputs: list[str], seed: Column, step: Callable[[Column, Column], Column], kind: str, backward: bool = False, out: str = "value") -> DataFrame:
    """One row for each column: its accumulator at the end, which seeds the next stage of a merged one."""
    level = F.struct(F.col(axis).alias("__k"), *inputs)
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(level)).alias("__l"))
    levels = F.reverse("__l") if backward else F.col("__l")
    return packed.select(*keys, F.aggregate(levels, seed.cast(kind), lambda a, x: step(a, x).cast(kind)).alias(out))


# --- the functional frontend


@dataclass(frozen=True)
class Domain:
    """Sizes and offsets of dimensions; any size 0 runs nothing, no dimension at all runs once."""

    sizes: Mapping[str, int]
    offsets: Mapping[str, int]
    connectivities: Mapping[str, DataFrame]

    def points(self, spark: SparkSession) -> DataFrame:
        out = spark.range(1 if all(n > 0 for n in self.sizes.values()) else 0)
        for d, n in self.sizes.items():
            low = self.offsets.get(d, 0)
            out = out.withColumn(d, F.explode(F.sequence(F.lit(low), F.lit(low + max(n, 1) - 1))))
        return out.drop("id")

    def holds(self) -> Column:
        inside = F.lit(True)
        for d, n in self.sizes.items():
            low = self.offsets.get(d, 0)
            inside = inside & F.col(d).between(low, low + n - 1)
        return inside


def cartesian_domain(sizes: Mapping[str, int], offsets: Mapping[str, int] | None = None) -> Domain:
    return Domain(sizes, offsets or {}, {})


def unstructured_domain(sizes: Mapping[str, int], offsets: Mapping[str, int] | None = None, **connectivities: DataFrame) -> Domain:
    return Domain(sizes, offsets or {}, connectivities)


class StencilExecutor:
    """Pointwise assignments that run in order on one table: .assign(out, stencil, *inputs), stencils from Columns to a Column.

    Stencils that read other points are in fieldloom.operators.fn.
    """

    def __init__(self, domain: Domain, fields: DataFrame):
        self.domain, self.fields = domain, fields
        self.steps: list[tuple[str, Callable[..., Column], tuple[str, ...]]] = []

    def assign(self, out: str, stencil: Callable[..., Column], *inputs: str) -> StencilExecutor:
        self.steps.append((out, stencil, inputs))
        return self

    def execute(self) -> DataFrame:
        df = self.fields
        for out, stencil, inputs in self.steps:
            old = F.col(out) if out in df.columns else F.lit(None)
            df = df.withColumn(out, F.when(self.domain.holds(), stencil(*map(F.col, inputs))).otherwise(old))
        return df


class VerticalExecutor:
    """Column passes that run in order on one table: .assign(out, pass, seed, *inputs), each from the columns before it.

    fields is dense along the axis within the domain; rows outside the domain are left aside.  One exchange serves all passes.
    """

    def __init__(self, domain: Domain, fields: DataFrame, keys: list[str], axis: str, kind: str = "double"):
        self.domain, self.fields, self.keys, self.axis, self.kind = domain, fields, keys, axis, kind
        self.steps: list[ColumnStage] = []

    def assign(self, out: str, body: Pass, seed: Column, *inputs: str, backward: bool = False, prologue: tuple[Pass, ...] = (), epilogue: tuple[Pass, ...] = (), kind: str | None = None, acc_kind: str | None = None) -> VerticalExecutor:
        self.steps.append(ColumnStage(body, out, seed, kind or self.kind, acc_kind, backward, prologue, epilogue))
        return self

    def execute(self) -> DataFrame:
        df = self.fields.where(self.domain.holds())
        others = [c for c in df.columns if c not in self.keys and c != self.axis]
        return merged_columns(df, self.keys, self.axis, others, self.steps)


def merged_stencil(*parts: tuple[str, Callable[..., Column], tuple[str, ...]]) -> Callable[[DataFrame], DataFrame]:
    """Several outputs for each point, all from the old values."""
    return lambda df: df.withColumns({out: f(*map(F.col, inputs)) for out, f, inputs in parts})
