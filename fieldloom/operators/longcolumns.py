"""Columns longer than a task should hold: scans by composable steps, and tridiagonal systems, in chunks that work apart.

A column is cut along its axis into chunks.  Each chunk is worked to a summary; the summaries are one column more, shorter by the length of a chunk, and are
worked in the same way until a chunk holds them; then every chunk finishes with what came from its neighbours.  A task never holds more than a chunk.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.mesh import ColumnStage, Scan, merged_columns
from fieldloom.sources.tables import written

CHUNK = 4096


@dataclass(frozen=True)
class Monoid:
    """An associative combine(earlier, later) with its identity, on values of a type."""

    kind: str
    identity: Column
    combine: Callable[[Column, Column], Column]


def affine() -> Monoid:
    """Maps x -> a x + b, as struct<a, b>, one after the other."""
    both = lambda f, g: F.struct((g["a"] * f["a"]).alias("a"), (g["a"] * f["b"] + g["b"]).alias("b"))
    return Monoid("struct<a: double, b: double>", F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")), both)


def blocked_scan(df: DataFrame, keys: list[str], axis: str, element: Column, monoid: Monoid, out: str, size: int = CHUNK) -> DataFrame:
    """df with the combination of each point's element with all those before it on its column.

    axis: whole numbers, distinct within a column, with or without gaps; a chunk covers `size` of them, so holds no more points.  Sums of floating-point numbers
    and the like differ from a scan from end to end in rounding, as they are combined in another order; the order depends on the axis and size alone, not on
    partitions.  An empty table stays empty.
    """
    if size < 2:
        raise ValueError("a chunk has two places or more")
    low, high = df.agg(F.min(axis), F.max(axis)).first()
    if low is None:
        return df.withColumn(out, F.lit(None).cast(monoid.kind))
    whole = df.withColumns({"__e": element.cast(monoid.kind), "__p": F.col(axis).cast("long")})
    return _scanned(whole, keys, monoid, out, size, int(low), int(high)).select(*df.columns, out)


def _scanned(df: DataFrame, keys: list[str], monoid: Monoid, out: str, size: int, low: int, high: int, exclusive: bool = False) -> DataFrame:
    """df, with elements __e at places __p from low to high, with `out`; exclusive: without the point's own element."""
    identity = monoid.identity.cast(monoid.kind)
    begun = None
    df = df.withColumn("__c", F.floor((F.col("__p") - low) / size).cast("long"))
    own = [*keys, "__c"]
    if high - low >= size:
        level = F.array_sort(F.collect_list(F.struct("__p", "__e")))
        total = F.aggregate("__l", identity, lambda acc, x: monoid.combine(acc, x["__e"]).cast(monoid.kind))
        sums = df.select(*own, "__p", "__e").groupBy(*own).agg(level.alias("__l")).select(*keys, F.col("__c").alias("__p"), total.alias("__e"))
        begun = _scanned(sums, keys, monoid, "__begin", size, 0, (high - low) // size, exclusive=True).select(*keys, F.col("__p").alias("__c"), "__begin")
    begin = identity if begun is None else F.coalesce("__begin", identity)
    step = Scan(lambda acc, x: F.struct(acc["now"].alias("before"), monoid.combine(acc["now"], x["__e"]).cast(monoid.kind).alias("now")), lambda acc: acc["before" if exclusive else "now"])
    stage = ColumnStage(step, out, F.struct(begin.alias("before"), begin.alias("now")), monoid.kind, f"struct<before: {monoid.kind}, now: {monoid.kind}>")
    inputs = [c for c in df.columns if c not in (*own, "__p")]
    return merged_columns(df, own, "__p", inputs, [stage], beside=begun)


def blocked_tridiagonal(df: DataFrame, keys: list[str], axis: str, inf: str, diag: str, sup: str, rhs: str, out: str, size: int = CHUNK) -> DataFrame:
    """df with the solution of each column's system inf[p] x[p-1] + diag[p] x[p] + sup[p] x[p+1] = rhs[p].

    The last place of each chunk is kept apart.  The others of a chunk are eliminated within it, which leaves their first and last as sums of a value and
    multiples of the places kept apart on both sides; put into the equations of these, that makes a tridiagonal system of them alone, which is solved in the same way.  Columns
    begin and end where they like, but have no gaps (an error tells); the first inf and the last sup of a column count nothing.  The systems should be such that
    elimination needs no pivots, as for Thomas.
    """
    if size < 2:
        raise ValueError("a chunk has two places or more")
    ends = df.groupBy(*keys).agg(F.min(axis).alias("low"), F.max(axis).alias("high"), F.count("*").alias("n"))
    low, high, holes = ends.agg(F.min("low"), F.max("high"), F.max(F.col("n") != F.col("high") - F.col("low") + 1)).first()
    if low is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    if holes:
        raise ValueError("a column has a gap or a repeated place")
    row = {"__p": F.col(axis).cast("long"), "__inf": F.col(inf).cast("double"), "__diag": F.col(diag).cast("double"), "__sup": F.col(sup).cast("double"), "__rhs": F.col(rhs).cast("double")}
    return _solved(df.withColumns(row), keys, size, int(low), int(high)).select(*df.columns, F.col("__x").alias(out))


def _sweeps(apart: bool) -> list[ColumnStage]:
    """Forward elimination and back substitution of a run of rows; apart: also for the multiples of what lies before (v) and after (w) it."""
    names = ("c", "d", "e") if apart else ("c", "d")
    kind = f"struct<{', '.join(f'{n}: double' for n in names)}>"

    def forward(acc: Column, x: Column) -> Column:
        below = x["__diag"] - x["__inf"] * acc["c"]
        new = {"c": x["__sup"] / below, "d": (x["__rhs"] - x["__inf"] * acc["d"]) / below, "e": -(x["__inf"] * acc["e"]) / below if apart else None}
        return F.struct(*(new[n].alias(n) for n in names))

    start = F.struct(*(F.lit({"c": 0.0, "d": 0.0, "e": -1.0}[n]).alias(n) for n in names))
    if not apart:
        return [ColumnStage(Scan(forward), "__f", start, kind), ColumnStage(Scan(lambda acc, x: x["__f"]["d"] - x["__f"]["c"] * acc), "__x", F.lit(0.0), "double", backward=True)]
    back = lambda acc, x: F.struct((x["__f"]["d"] - x["__f"]["c"] * acc["y"]).alias("y"), (x["__f"]["e"] - x["__f"]["c"] * acc["v"]).alias("v"), (-(x["__f"]["c"] * acc["w"])).alias("w"))
    last = F.struct(F.lit(0.0).alias("y"), F.lit(0.0).alias("v"), F.lit(-1.0).alias("w"))
    return [ColumnStage(Scan(forward), "__f", start, kind), ColumnStage(Scan(back), "__z", last, "struct<y: double, v: double, w: double>", backward=True)]


def _solved(df: DataFrame, keys: list[str], size: int, low: int, high: int) -> DataFrame:
    columns = df.columns
    df = df.withColumn("__c", F.floor((F.col("__p") - low) / size).cast("long"))
    own = [*keys, "__c"]
    inputs = [c for c in columns if c not in (*keys, "__p")]
    if high - low < size:
        return merged_columns(df, own, "__p", inputs, _sweeps(False)).select(*columns, "__x")
    apart = (F.col("__p") - low) % size == size - 1
    inner = merged_columns(df.where(~apart), own, "__p", inputs, _sweeps(True)).drop("__f")
    ends = inner.groupBy(*own).agg(F.min_by("__z", "__p").alias("first"), F.max_by("__z", "__p").alias("last"))
    kept = df.where(apart)
    # the first of the next chunk, and the last of this one, beside each place kept apart
    after = ends.select(*keys, (F.col("__c") - 1).alias("__c"), F.col("first").alias("__after"))
    before = ends.select(*own, F.col("last").alias("__before"))
    part = lambda side, n: F.coalesce(F.col(f"{side}.{n}"), F.lit(0.0))
    joined = kept.join(before, own, "left").join(after, own, "left")
    reduced = joined.select(
        *keys, F.col("__c").alias("__p"),
        (-(F.col("__inf") * part("__before", "v"))).alias("__inf"),
        (F.col("__diag") - F.col("__inf") * part("__before", "w") - F.col("__sup") * part("__after", "v")).alias("__diag"),
        (-(F.col("__sup") * part("__after", "w"))).alias("__sup"),
        (F.col("__rhs") - F.col("__inf") * part("__before", "y") - F.col("__sup") * part("__after", "y")).alias("__rhs"),
    )
    # a row for each chunk: written, so that what follows does not work the chunks again at each use
    found = written(_solved(written(reduced), keys, size, 0, (high - low) // size).select(*keys, F.col("__p").alias("__c"), "__x"))
    sides = found.select(*own, F.col("__x").alias("__right"), F.lit(None).cast("double").alias("__left")).union(found.select(*keys, F.col("__c") + 1, F.lit(None).cast("double"), "__x"))
    sides = sides.groupBy(*own).agg(F.max("__right").alias("__right"), F.max("__left").alias("__left"))
    x = F.col("__z.y") - F.col("__z.v") * F.coalesce("__left", F.lit(0.0)) - F.col("__z.w") * F.coalesce("__right", F.lit(0.0))
    solved = inner.join(sides, own, "left").select(*columns, x.alias("__x"))
    return solved.union(kept.join(found, own).select(*columns, "__x"))
