"""Sums of doubles that do not depend on the order: exact in whole numbers until the last rounding.

A double is cut into at most three whole numbers, each times a power of two from a fixed ladder of rungs 32 bits apart.  The cuts are exact, whole numbers add up exactly in
any order, and a sum is at most 66 rungs: native partial aggregates by rung, however many rows there are.  Only the rungs of each sum are put together and
rounded once, to the nearest double.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS, LOWEST = 32, -1074
_NAN, _UP, _DOWN = -1, -2, -3  # rungs of what is not finite


def rungs(x: Column) -> Column:
    """array<struct<rung, n>> of a double: the finite x is the sum of n * 2 ** (32 * rung - 1074).  Null has none."""
    part = T.ArrayType(T.StructType([T.StructField("rung", T.IntegerType()), T.StructField("n", T.LongType())]))
    unit = lambda rung: F.pow(F.lit(2.0), (rung * BITS + LOWEST).cast("double"))
    top = F.greatest(F.floor((F.log2(F.abs(x)) - LOWEST) / BITS).cast("int"), F.lit(0))

    def cut(state: Column, down: Column) -> Column:
        rung = state["top"] - down
        q = state["rest"] / unit(F.greatest(rung, F.lit(0)))
        q = F.when(rung >= 0, F.when(q < 0, F.ceil(q)).otherwise(F.floor(q))).otherwise(F.lit(0).cast("long"))
        rest = state["rest"] - q.cast("double") * unit(F.greatest(rung, F.lit(0)))
        return F.struct(state["top"].alias("top"), rest.alias("rest"), F.concat(state["out"], F.array(F.struct(rung.alias("rung"), q.alias("n")))).alias("out"))

    start = F.struct(top.alias("top"), x.alias("rest"), F.array().cast(part).alias("out"))
    finite = F.filter(F.aggregate(F.array(*map(F.lit, range(3))), start, cut)["out"], lambda p: p["n"] != 0)
    special = lambda rung: F.array(F.struct(F.lit(rung).alias("rung"), F.lit(1).cast("long").alias("n"))).cast(part)
    zero = F.array(F.struct(F.lit(0).alias("rung"), F.lit(0).cast("long").alias("n"))).cast(part)
    infinite = F.lit(float("inf"))
    return F.when(x.isNull(), F.array().cast(part)).when(F.isnan(x), special(_NAN)).when(x == infinite, special(_UP)).when(x == -infinite, special(_DOWN)).when(x == 0, zero).otherwise(finite)


def exact_sum(df: DataFrame, keys: list[str], value: str, name: str = "sum") -> DataFrame:
    """(keys, name): the sum of each group's values, rounded once: bit-equal whatever the order and partitions.

    Nulls add nothing; a group of nulls alone gives null, and without keys so does an empty table.  NaN, or both infinities, give NaN; a sum beyond the doubles is infinite.  Zeros
    of either sign add up to 0.0.
    """
    plain = [f"key{n}" for n in range(len(keys))]
    df = df.select(*(F.col(k).alias(p) for p, k in zip(plain, keys, strict=True)), F.col(value).cast("double").alias("x"))
    cut = df.select(*plain, F.explode(rungs(F.col("x"))).alias("r")).groupBy(*plain, "r.rung").agg(F.sum(F.col("r.n").cast("decimal(20,0)")).alias("n"))
    every = cut.groupBy(*plain).agg(F.collect_list(F.struct("rung", F.col("n").cast("string").alias("n"))).alias("parts"))
    if keys:  # groups of nulls alone have no rung
        groups = df.select(*plain).distinct()
        same = [F.col(f"g.{p}").eqNullSafe(F.col(f"e.{p}")) for p in plain]
        every = groups.alias("g").join(every.alias("e"), same, "left").select(*(F.col(f"g.{p}").alias(p) for p in plain), "e.parts")
    schema = T.StructType([*(T.StructField(p, every.schema[p].dataType) for p in plain), T.StructField("sum", T.DoubleType())])

    def rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [_rounded([(p["rung"], int(p["n"])) for p in parts]) if parts else None for parts in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.float64())], names=[*plain, "sum"])

    return every.mapInArrow(rounded, schema).toDF(*keys, name)


def _rounded(parts: list[tuple[int, int]]) -> float:
    there = {rung for rung, _ in parts}
    if _NAN in there or {_UP, _DOWN} <= there:
        return float("nan")
    if _UP in there or _DOWN in there:
        return float("inf") if _UP in there else float("-inf")
    total = sum(n << BITS * rung for rung, n in parts)
    try:
        return total / (1 << -LOWEST)  # of whole numbers, rounded to the nearest
    except OverflowError:
        return float("inf") if total > 0 else float("-inf")
