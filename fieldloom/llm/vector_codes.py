"""Vectors as short codes: each of a few parts is replaced by the number of the nearest entry of that part's codebook.

All arithmetic is on whole numbers.  The nearest entry is sought by partial distances: dimensions are taken in descending variance of
the codebook, and an entry is dropped once its sum so far is strictly beyond the best complete distance known for the vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import dealt_anew, written

MOST = 1 << 40  # scaled components beyond it count as it
_LONG = (1 << 63) - 1
_BLOCK = 256  # vectors compared with a codebook at a time
_FLUSH = 1 << 20  # vectors whose sums a task holds at a time: 2**60 at most


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the entry of book next to each row of x, ties to the lower index; whole numbers of any size."""
    d = x.shape[1]
    out_at, out_far = np.zeros(len(x), np.int64), np.zeros(len(x), object)
    if not len(x) or not d:
        return out_at, out_far
    bound = d * (2 * int(max(abs(x).max(), abs(book).max()))) ** 2
    kind = np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object
    order = np.argsort(-book.astype(np.float64).var(0), kind="stable")
    x, book = x[:, order].astype(kind), book[:, order].astype(kind)
    for low in range(0, len(x), _BLOCK):
        b = x[low : low + _BLOCK]
        sums = np.zeros((len(b), len(book)), kind)
        best, k = None, 0
        while k < d:  # all entries at first, in steps of two dimensions
            for k in range(k, min(k + 2, d)):
                gap = b[:, k, None] - book[None, :, k]
                sums += gap * gap
            k += 1
            full = ((b - book[sums.argmin(1)]) ** 2).sum(1)
            best = full if best is None else np.minimum(best, full)
            alive = sums <= best[:, None]
            if np.count_nonzero(alive) * 4 < alive.size:
                break
        row, entry = np.nonzero(alive)
        part = sums[row, entry]
        for k in range(k, d):  # then those that are left
            gap = b[row, k] - book[entry, k]
            part += gap * gap
            left = part <= best[row]
            if not left.all():
                row, entry, part = row[left], entry[left], part[left]
        least = np.minimum.reduceat(part, np.flatnonzero(np.r_[True, row[1:] != row[:-1]]))  # the best entry itself is never dropped
        hit = np.flatnonzero(part == least[row])
        _, first = np.unique(row[hit], return_index=True)
        out_at[low : low + _BLOCK], out_far[low : low + _BLOCK] = entry[hit[first]], least
    return out_at, out_far


@dataclass(frozen=True)
class Codebooks:
    """entries[part]: a matrix of the part's entries; at most parts * 256 * width numbers in all."""

    entries: tuple[np.ndarray, ...]

    def digest(self) -> str:
        """SHA-256 of all components in decimal by part, entry and place, with commas."""
        return hashlib.sha256(",".join(str(v) for book in self.entries for v in book.ravel().tolist()).encode()).hexdigest()


def whole_vectors(df: DataFrame, vector: Column, scale: int, parts: int, keep: list[Column]) -> tuple[DataFrame, int]:
    """(kept columns and v, the vector as floor(scale * x), width): rows without null vectors and null or non-finite components.

    The width is the longest vector's, rounded up to whole parts; shorter vectors end in zeros.  Scaled components beyond 2**40 count as that.
    """
    low = F.lit(-float(MOST))
    good = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.coalesce(good, F.lit(False)))
    longest = rows.agg(F.max(F.size(vector))).first()[0] or 0
    width = -(-longest // parts) * parts
    whole = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), low)))
    return rows.select(*keep, F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(vector))).alias("v")), width


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def fit_codebooks(whole: DataFrame, width: int, parts: int = 4, entries: int = 256, rounds: int = 4, order: tuple[str, ...] = ("id",)) -> Codebooks:
    """Rounds of assigning all vectors and moving each entry to the floor of its parts' mean; unused entries stay.

    whole: a written table with v (see whole_vectors).  Codebooks start from the first vectors by `order`, nulls last, and then by v.  Each task sends the
    sums of its own vectors by part and entry; the driver gets one sum for each number of the codebooks.
    """
    first = whole.orderBy(*(F.col(c).asc_nulls_last() for c in order), "v").limit(entries).select("v").collect()
    start = np.array([r.v for r in first], np.int64).reshape(len(first), width)
    books = Codebooks(tuple(np.split(start, parts, axis=1)))
    if not len(first) or not width:
        return books
    for _ in range(rounds):
        books = _moved(whole, width, books)
    return books


def _moved(whole: DataFrame, width: int, books: Codebooks) -> Codebooks:
    size = width // len(books.entries)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[pa.RecordBatch]:
            for p, (total, n) in enumerate(held):
                used = np.flatnonzero(n)
                if len(used):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"]
                    )

        fresh = lambda: [(np.zeros(b.shape, np.int64), np.zeros(len(b), np.int64)) for b in books.entries]
        held, rows = fresh(), 0
        for batch in batches:
            if rows + batch.num_rows > _FLUSH:
                yield from told()
                held, rows = fresh(), 0
            rows += batch.num_rows
            for (total, n), x, book in zip(held, np.split(_matrix(batch.column(0), width), len(books.entries), axis=1), books.entries, strict=True):
                at, _ = nearest(x, book)
                np.add.at(total, at, x)
                n += np.bincount(at, minlength=len(n))
        yield from told()

    told = whole.select("v").mapInArrow(sums, "part int, entry int, n long, total array<long>")
    told = told.select("part", "entry", "n", F.posexplode("total").alias("place", "sum")).groupBy("part", "entry", "place").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"), F.sum("n").alias("n"))
    out = [book.copy() for book in books.entries]
    for r in told.toLocalIterator():  # one for each number of the codebooks
        out[r["part"]][r["entry"], r["place"]] = int(r["sum"]) // r["n"]
    assert all(b.shape[1] == size for b in out)
    return Codebooks(tuple(out))


def encode_vectors(whole: DataFrame, width: int, books: Codebooks, keep: list[str]) -> DataFrame:
    """The kept columns, code (two hex digits for each part's entry) and error: the squared distances, summed (at most the greatest long)."""
    held = whole.select(*keep, "v")
    plain = [f"c{n}" for n in range(len(keep))]
    schema = ", ".join([*(f"{p} {whole.schema[c].dataType.simpleString()}" for p, c in zip(plain, keep, strict=True)), "code string", "error long"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.full(batch.num_rows, "", object), np.zeros(batch.num_rows, object)
            for x, book in zip(np.split(_matrix(batch.column(batch.num_columns - 1), width), len(books.entries), axis=1), books.entries, strict=True):
                at, far = nearest(x, book)
                code = code + np.array([f"{a:02x}" for a in at.tolist()], object)
                error = error + far
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(code.tolist(), pa.string()), pa.array([min(int(e), _LONG) for e in error.tolist()], pa.int64())], names=[*plain, "code", "error"])

    return held.toDF(*plain, "v").mapInArrow(encode, schema).toDF(*keep, "code", "error")


def compress_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label", scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, Codebooks]:
    """(id, group, code, error, group_error) of every vector, and the codebooks that the codes refer to.

    Left out: null vectors and those with null or non-finite components; an empty table gives nothing.  Repeated rows stay; null ids come last
    in the order that codebooks start from; fewer vectors than entries make shorter codebooks.  group_error is the error summed over rows of an equal group, nulls
    together (at most the greatest long): partial sums, then a join whose hot groups the adaptive skew join can split.
    """
    if entries > 256:
        raise ValueError("an entry's number has two hex digits")
    whole, width = whole_vectors(df, F.col(vector_col), scale, parts, [F.col(id_col).alias("id"), F.col(group_col).alias("group")])
    whole = written(whole, "whole")
    books = fit_codebooks(whole, width, parts, entries, rounds)
    coded = written(encode_vectors(whole, width, books, ["id", "group"]), "coded")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    sums = dealt_anew(coded.groupBy(F.col("group").alias("__group")).agg(total.alias("group_error")), "__group")
    return coded.join(sums, F.col("group").eqNullSafe(F.col("__group"))).drop("__group"), books
