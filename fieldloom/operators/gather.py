"""Reads at offsets by sending rows to the places that read them, whatever points a table lacks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMS = ("i", "j", "k")


def sent_within(df: DataFrame, keys: list[str], wanted: Mapping[tuple[int, int, int], list[str]]) -> tuple[DataFrame, dict[tuple, str]]:
    """df with a column for each wanted field at each offset, null where there is no such point, and their names by (field, offset).

    df is dealt by keys (and may be by k too) with all that its rows read.  Each row is sent to itself and to the points that read it, and one aggregate by
    point puts them together: it needs no exchange, as the exchange by keys serves it.  Points are told by keys and place; they must not repeat.
    """
    offsets = [(0, 0, 0), *wanted]
    still = [d for n, d in enumerate(DIMS) if not any(o[n] for o in offsets)]  # stays the column that df may be dealt by
    own = [c for c in df.columns if c not in (*keys, *DIMS)]
    everything = F.struct(*own)
    held = {(f, o): f"__g{n}_{m}" for n, (o, names) in enumerate(wanted.items()) for m, f in enumerate(names)}
    sends = []
    for n, o in enumerate(offsets):
        place = [(F.col(d) - by).cast(df.schema[d].dataType).alias(d) for d, by in zip(DIMS, o, strict=True) if d not in still]
        sends.append(F.struct(F.lit(n).alias("n"), *place))
    sent = df.select(*keys, *still, F.explode(F.array(*sends)).alias("__to"), everything.alias("__x"))
    sent = sent.select(*keys, *still, *(F.col(f"__to.{d}").alias(d) for d in DIMS if d not in still), F.col("__to.n").alias("__n"), "__x")
    gathered = [F.first(F.when(F.col("__n") == n, F.col(f"__x.`{f}`")), ignorenulls=True).alias(held[f, o]) for n, (o, names) in enumerate(wanted.items(), 1) for f in names]
    points = sent.groupBy(*keys, *DIMS).agg(F.first(F.when(F.col("__n") == 0, F.col("__x")), ignorenulls=True).alias("__own"), *gathered)
    points = points.where(F.col("__own").isNotNull())
    return points.select(*keys, *DIMS, "__own.*", *held.values()), held
