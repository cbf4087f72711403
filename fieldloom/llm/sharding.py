"""Shards along a Hilbert curve over quantised metadata, by DataFrame functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hilbert_indices(dims: int, bits: int) -> list[int]:
    """Place on the curve of each cell of a grid with 2**bits cells a side; a cell's number has the first dimension highest.

    A cell's bits are read from the coarsest level down.  At each level the corner within the present sub-cube is turned
    back by the sub-cube's entry corner and axis, and its Gray-code rank gives the next dims bits of the place.
    """
    gray = lambda k: k ^ k >> 1
    mask = (1 << dims) - 1
    turn = lambda x, by: (x >> by | x << dims - by) & mask if by else x
    rank = {gray(k): k for k in range(1 << dims)}
    ones = lambda k: (~k & k + 1).bit_length() - 1  # noqa: E731  trailing ones of k
    entry = [0] + [gray(2 * ((k - 1) // 2)) for k in range(1, 1 << dims)]
    axis = [0] + [(ones(k - 1) if k % 2 == 0 else ones(k)) % dims for k in range(1, 1 << dims)]
    out = []
    for cell in range(1 << dims * bits):
        place, corner, along = 0, 0, 0
        for level in range(bits - 1, -1, -1):
            at = 0
            for d in range(dims):
                at |= (cell >> bits * (dims - 1 - d) + level & 1) << d
            k = rank[turn(at ^ corner, (along + 1) % dims)]
            place = place << dims | k
            by = along + 1
            corner ^= turn(entry[k], (dims - by % dims) % dims)
            along = (along + axis[k] + 1) % dims
        out.append(place)
    return out


def log_bin(size: Column, bits: int) -> Column:
    """Bin of a non-negative number by its power of two, null as 0, the last bin open."""
    return F.least(F.greatest(F.length(F.bin(F.coalesce(size, F.lit(0)).cast("long"))) - 1, F.lit(0)), F.lit((1 << bits) - 1))


def hash_bin(value: Column, bits: int) -> Column:
    """Bin of a label by its CRC-32, null as 0."""
    return F.when(value.isNull(), F.lit(0)).otherwise(F.crc32(value.cast("binary")).bitwiseAND((1 << bits) - 1).cast("int"))


#: Multiplier of the spread of row keys over a cell's parts, and the bits of a part's number.
SPREAD, PART_BITS = 2654435761, 10


def hilbert_shards(rows: DataFrame, dims: list[Column], bits: int, key: Column, shards: int = 8) -> DataFrame:
    """rows with curve (long), shard (int) and slot (long): runs of the curve with counts at most one apart.

    dims: integer columns from 0 to 2**bits - 1, at most 12 bits in all.  Rows are numbered along the curve, those of a cell by
    a spread of the key, then by the key, then by all columns; equal rows share their places among them in any order.  A
    cell's rows are dealt over 2**PART_BITS parts, so that a cell with a third of all rows still sorts in many tasks.  Only
    counts are summed up in one task: one for each cell, so 2**(bits * dims) at most; a cell's part counts are summed in a
    task each.  The first place of a shard s of n is ceil(s * rows / n).  Null keys count as 0; an empty table stays empty.
    """
    if bits * len(dims) > 12:
        raise ValueError("at most 12 bits in all: a count for each cell is summed in one task")
    cell = reduce(lambda a, b: a * (1 << bits) + b, dims)
    spread = F.pmod(F.pmod(F.coalesce(key, F.lit(0)).cast("long"), F.lit(1 << 31)) * F.lit(SPREAD), F.lit(1 << 32))
    held = rows.withColumns({
        "curve": F.element_at(F.array([F.lit(x) for x in hilbert_indices(len(dims), bits)]), (cell + 1).cast("int")).cast("long"),
        "part": F.shiftright(spread, 32 - PART_BITS),
    })
    parts = held.groupBy("curve", "part").agg(F.count("*").alias("n"))
    cells = parts.groupBy("curve").agg(F.sum("n").alias("n"))
    cells = cells.select("curve", F.coalesce(F.sum("n").over(Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("curve", "part", within.alias("inside")).join(F.broadcast(cells), "curve").select("curve", "part", (F.col("before") + F.col("inside")).alias("offset"), "total")
    order = Window.partitionBy("curve", "part").orderBy(key, *[c for c in rows.columns])
    placed = held.withColumn("nth", F.row_number().over(order)).join(offsets, ["curve", "part"]).withColumn("place", F.col("offset") + F.col("nth") - 1)
    shard = F.expr(f"cast((place * {shards}) div total as int)")
    first = F.expr(f"(cast((place * {shards}) div total as long) * total + {shards - 1}) div {shards}")
    return placed.select(*rows.columns, "curve", shard.alias("shard"), (F.col("place") - first).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8, bits: int = 4) -> DataFrame:
    """Documents' doc_id, size, text_crc32, curve, shard, slot; the dimensions are source, language and size.

    size is the UTF-8 bytes of the text (null: none) plus 1, the CRC that of the text (null: of no bytes).  Texts are read
    once and never shuffled: the rows that move hold four numbers.  Null sources and languages are bin 0; repeated rows and
    null ids get places of their own; other columns are left aside.
    """
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
        (hash_bin(F.col("source"), bits) * (1 << bits) + hash_bin(F.col("lang"), bits)).alias("labels"),
    )
    dims = [F.floor(F.col("labels") / (1 << bits)).cast("int"), F.col("labels").bitwiseAND((1 << bits) - 1), log_bin(F.col("size") / 64, bits)]
    return hilbert_shards(rows, dims, bits, F.col("doc_id"), shards).drop("labels")


