"""Halo exchange between the blocks of a block-decomposed field, and other block movements.

A field of blocks has the columns bi, bj, bk (the block), i, j, k (the place within it, halo included) and values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.plans.grid import Halo

_KEYS = ["bi", "bj", "bk", "i", "j", "k"]


def neighbour(block: Column, step: Column, count: int, periodic: bool) -> Column:
    """A block's neighbour in a dimension, wrapped if it is periodic, else -1 beyond the edge."""
    at = block + step
    return F.pmod(at, F.lit(count)) if periodic else F.when(at.between(0, count - 1), at).otherwise(F.lit(-1))


def exchange(df: DataFrame, fields: list[str], halos: tuple[Halo, Halo, Halo] | dict[str, tuple[Halo, Halo, Halo]], blocks: tuple[int, int, int], periodic: tuple[bool, bool, bool]) -> DataFrame:
    """df with the fields' halo cells filled from the neighbours' boxes; halo cells without a neighbour keep their values.

    halos: for all fields, or for each.  Each box cell near a face, edge or corner is copied to the up to 7 neighbours that need
    it (only those rows are), and one aggregate by block and place brings the copies in.  Which rows are
    copied depends on the halo widths alone, so the keys are well spread.  Points must not repeat.  For many steps, see blocks: there only strips move.
    """
    groups: dict[tuple, list[str]] = {}
    for f in fields:
        groups.setdefault(tuple(halos[f] if isinstance(halos, dict) else halos), []).append(f)
    for own, names in groups.items():
        df = _exchanged(df, names, own, blocks, periodic)
    return df


def _exchanged(df: DataFrame, fields: list[str], halos: tuple, blocks: tuple, periodic: tuple) -> DataFrame:
    """Each row goes to its own place, and box cells to the places that need them too: the table is read once, so that plans of many exchanges grow by one each."""
    box = reduce(lambda a, b: a & b, (F.col(d).between(h.begin, h.end) for d, h in zip("ijk", halos, strict=True)))
    # all three dimensions at once: a cell goes to each combination of its sides; (0, 0, 0) is its own place
    sides = {
        d: F.when(box, F.array_compact(F.array(F.lit(0), *(F.when(F.col(d).between(r.start, r.stop - 1), F.lit(s)) for s in (-1, 1) if len(r := h.send(s)))))).otherwise(F.array(F.lit(0)))
        for d, h in zip("ijk", halos, strict=True)
    }
    sent = df.select(*_KEYS, F.struct(*df.columns).alias("__own"), *(s.alias(f"s{d}") for d, s in sides.items()))
    for d in "ijk":
        sent = sent.withColumn(f"s{d}", F.explode(f"s{d}"))
    own = (F.col("si") == 0) & (F.col("sj") == 0) & (F.col("sk") == 0)
    target = {}
    for d, h, n, p in zip("ijk", halos, blocks, periodic, strict=True):
        step, size = F.col(f"s{d}"), h.end + 1 - h.begin
        target[f"b{d}"] = F.when(step == 0, F.col(f"b{d}")).otherwise(neighbour(F.col(f"b{d}"), step, n, p))
        target[d] = F.col(d) - step * size
    sent = sent.select(*(x.cast(df.schema[n].dataType).alias(n) for n, x in target.items()), F.when(own, F.col("__own")).alias("__own"), F.when(~own, F.struct(*(F.col(f"__own.`{f}`").alias(f) for f in fields))).alias("__got"))
    sent = sent.where("__own is not null or (bi >= 0 and bj >= 0 and bk >= 0)")
    cells = sent.groupBy(*_KEYS).agg(F.first("__own", ignorenulls=True).alias("__own"), F.first("__got", ignorenulls=True).alias("__got")).where("__own is not null")
    return cells.select(*(F.when(F.col("__got").isNotNull(), F.col(f"__got.`{c}`")).otherwise(F.col(f"__own.`{c}`")).alias(c) if c in fields else F.col(c) if c in _KEYS else F.col(f"__own.`{c}`").alias(c) for c in df.columns))


def decompose(df: DataFrame, sizes: tuple[int, int, int], halos: tuple[tuple[int, int], ...], blocks: tuple[int, int, int]) -> DataFrame:
    """Blocks of a dense field: sizes cells of each, placed after the halo's minus cells; halo cells have null values."""
    values = [c for c in df.columns if c not in ("i", "j", "k")]
    inner = df.select(
        *(F.floor(F.col(d) / n).cast("int").alias(f"b{d}") for d, n in zip("ijk", sizes, strict=True)),
        *((F.col(d) % n + m).cast("int").alias(d) for d, n, (m, _) in zip("ijk", sizes, halos, strict=True)), *values,
    )
    spark = df.sparkSession
    cells = spark.range(1)
    for name, n in [*((f"b{d}", n) for d, n in zip("ijk", blocks, strict=True)), *((d, n + a + b) for d, n, (a, b) in zip("ijk", sizes, halos, strict=True))]:
        cells = cells.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return cells.drop("id").join(inner, _KEYS, "left")


def all_to_all(df: DataFrame, routes: DataFrame, fields: list[str]) -> DataFrame:
    """df updated by sub-blocks moved along routes.

    routes: rows of (from_bi, from_bj, from_bk, i0, i1, j0, j1, k0, k1, to_bi, to_bj, to_bk, di, dj, dk): cells i0..i1, j0..j1, k0..k1 of
    a block go to another, shifted by di, dj, dk.  Cells that nothing reaches keep their values;
    where several routes reach a cell, the one from the greatest block (then the greatest cell in it) holds.
    """
    inside = reduce(lambda a, b: a & b, (F.col(d).between(F.col(f"{d}0"), F.col(f"{d}1")) for d in "ijk"))
    same = reduce(lambda a, b: a & b, (F.col(f"b{d}") == F.col(f"from_b{d}") for d in "ijk"))
    moved = df.join(routes, same).where(inside).select(
        *(F.col(f"to_b{d}").alias(f"b{d}") for d in "ijk"), *((F.col(d) + F.col(f"d{d}")).cast(df.schema[d].dataType).alias(d) for d in "ijk"), F.struct(*fields).alias("__got"),
        F.struct(*(f"from_b{d}" for d in "ijk"), *(F.col(d).alias(f"from_{d}") for d in "ijk")).alias("__from"),
    )
    moved = moved.groupBy(*_KEYS).agg(F.max_by("__got", "__from").alias("__got"))
    joined = df.join(moved, _KEYS, "left")
    return joined.select(*(F.when(F.col("__got").isNotNull(), F.col(f"__got.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns))
