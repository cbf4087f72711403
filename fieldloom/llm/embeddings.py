"""Near-duplicate vectors by an exact metric range join over pivot cells.

On unit vectors, cosine >= c is Euclidean distance <= r = sqrt(2 - 2c).  Each distinct vector has its home in the cell of its
nearest pivot.  By the triangle inequality it can have neighbours only in cells whose least and greatest distances to
every pivot its own distances meet within r, and whose border lies within r.  Of two such cells, one is visited: its homes
meet the other's vectors there, and both sides count the links.  Every cell joins alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import connected_components, dealt_anew, written

_SLACK = 1e-6  # for rounding in the bounds; the links themselves are decided in double precision


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows in double precision of equally long vectors, however large or small."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _units(flat.reshape(len(column), -1))


def _units(x: np.ndarray) -> np.ndarray:
    # by a power of two first, which rounds nothing, so that squares neither overflow nor vanish
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))


class _Links:
    """Components of a cell's linked vectors."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        p = self.parent
        while (up := p.setdefault(x, x)) != x:
            p[x] = p.setdefault(up, up)
            x = p[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.95, cell_rows: int = 4096, most_pivots: int = 256, pivot_sample: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id) of each row: other rows with a cosine of at least `cosine`, and the smallest id links reach.

    Rows that are null, zero or hold a null or non-finite component, and rows of another length than those they are compared
    with, link with nothing and are their own component.  Equal vectors meet in one class first, by an aggregate with
    partial counts; all else works on classes.  There is a pivot for each cell_rows classes, most_pivots at most, far apart
    among the pivot_sample vectors of the smallest hash; a cell with more homes than cell_rows is cut into chunks that its visitors enter each, so
    that a task holds at most about 2 * cell_rows vectors and streams the rest.  Only that sample and two numbers for each two pivots
    go to the driver.  Repeated ids count as rows of their own; a null id never is a component's smallest; other columns are
    left aside; an empty table gives no row.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    valid = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    classes = written(
        rows.where(valid).groupBy("v").agg(F.count("*").alias("n"), F.min("id").alias("least"))
        .select(F.monotonically_increasing_id().alias("c"), "v", F.size("v").alias("dim"), "n", "least"), "classes",
    )
    sizes = {r[0]: r[1] for r in classes.groupBy("dim").count().collect()}
    parts = [_joined(classes.where(F.col("dim") == dim), count, math.sqrt(max(0.0, 2 - 2 * cosine)), cosine, cell_rows, most_pivots, pivot_sample) for dim, count in sorted(sizes.items())]
    links = written(_union(parts), "links") if parts else None
    if links is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    components = connected_components(links.where("u is not null").select("u", "v"))
    counts = links.where("u is null").groupBy("c").agg(F.sum("n_links").alias("n_links"))
    labelled = classes.select("c", "v", "n", "least").join(counts, "c", "left").join(components.withColumnRenamed("node", "c"), "c", "left")
    labelled = labelled.select("v", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "c").alias("component"), "least")
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    per_vector = labelled.join(dealt_anew(smallest, "component"), "component").select("v", "n_links", "component_id")
    good = rows.where(valid).join(dealt_anew(per_vector, "v"), "v").select("id", "n_links", "component_id")
    bad = rows.where(~F.coalesce(valid, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.union(bad).select(F.col("id").alias(id_col), "n_links", "component_id")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _joined(classes: DataFrame, count: int, radius: float, cosine: float, cell_rows: int, most_pivots: int, pivot_sample: int) -> DataFrame:
    """Rows (c, n_links, null, null) of linked classes, to be summed, and (null, null, u, v) of edges with the components of all links."""
    spark = classes.sparkSession
    k = max(1, min(most_pivots, math.ceil(count / cell_rows)))
    sample = classes.orderBy(F.xxhash64("v"), "c").limit(pivot_sample).select("v").collect() if k > 1 else classes.limit(1).select("v").collect()
    pivots = _far_apart(_units(np.array([r.v for r in sample], np.float64)), k)
    sent = spark.sparkContext.broadcast((pivots, _distances(pivots, pivots)))  # most_pivots vectors at most
    box = pa.schema([("cell", pa.int64()), ("pivot", pa.int64()), ("n", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, _ = sent.value
        n, low, high = np.zeros(len(p), np.int64), np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)
        for batch in batches:
            if batch.num_rows:
                d = _distances(_matrix(batch.column(0)), p)
                home = d.argmin(axis=1)
                n += np.bincount(home, minlength=len(p))
                order = np.argsort(home, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], np.diff(home[order]) > 0]))
                at = home[order][first]
                low[at] = np.minimum(low[at], np.minimum.reduceat(d[order], first))
                high[at] = np.maximum(high[at], np.maximum.reduceat(d[order], first))
        on = np.flatnonzero(n)
        cell, pivot = np.repeat(on, len(p)), np.tile(np.arange(len(p)), len(on))
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(pivot), pa.array(n[cell]), pa.array(low[cell, pivot]), pa.array(high[cell, pivot])], schema=box)

    found = classes.select("v").mapInArrow(boxes, "cell long, pivot long, n long, low double, high double").groupBy("cell", "pivot").agg(F.sum("n"), F.min("low"), F.max("high")).collect()
    chunks, low, high = np.zeros(k, np.int64), np.full((k, k), np.inf), np.full((k, k), -np.inf)
    for cell, pivot, n, a, b in found:
        chunks[cell], low[cell, pivot], high[cell, pivot] = math.ceil(n / cell_rows), a, b
    bounds = spark.sparkContext.broadcast((chunks, low, high))
    dealt = pa.schema([("cell", pa.int64()), ("visitor", pa.bool_()), ("c", pa.int64()), ("n", pa.int64()), ("v", pa.list_(pa.float64()))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, between = sent.value
        chunks, low, high = bounds.value
        first = np.cumsum(chunks) - chunks
        for whole in batches:
            for batch in (whole.slice(k, 2048) for k in range(0, whole.num_rows, 2048)):
                d = _distances(_matrix(batch.column(2)), p)
                at = np.arange(len(d))
                home = d.argmin(axis=1)
                own = d[at, home]
                apart = np.maximum(between[home], 1e-12)
                border = (d * d - (own * own)[:, None]) / (2 * apart)  # distance to the border of the two cells
                r = radius + _SLACK
                visits = (border <= r) & _turn(home[:, None], np.arange(len(p)))
                for pivot in range(len(p)):  # a cell whose distances to a pivot lie apart from the vector's holds no neighbour
                    visits &= (d[:, pivot, None] <= high[:, pivot] + r) & (d[:, pivot, None] >= low[:, pivot] - r)
                visits[at, home] = True
                c = batch.column(0).to_numpy()
                row, cell = np.nonzero(visits)
                many = chunks[cell]
                row, cell = np.repeat(row, many), np.repeat(cell, many)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                own_chunk = c[row] % np.maximum(chunks[cell], 1)
                visitor = (cell != home[row]) | (nth != own_chunk)
                keep = (cell != home[row]) | (nth == own_chunk) | _turn(own_chunk, nth)
                row, cell, nth, visitor = row[keep], cell[keep], nth[keep], visitor[keep]
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(first[cell] + nth), pa.array(visitor), taken.column(0), taken.column(1), taken.column(2)], schema=dealt)

    out = pa.schema([("c", pa.int64()), ("n_links", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])

    def cell_links(homes: tuple, others: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        """Compare a cell's homes with each other, then with its visitors as they come; both get their links counted."""
        c, n, x = homes
        links, counts = _Links(), np.zeros(len(c), np.int64)
        short = x.astype(np.float32)
        for oc, on, ox in _chain((c, n, x), others):
            inner = oc is c
            for k in range(0, len(oc), 1024):
                a, b = _near(x, short, ox[k : k + 1024], cosine)
                if inner:
                    a, b = a[a != b + k], b[a != b + k]
                if len(a):
                    met = on[k : k + 1024]
                    counts += np.bincount(a, weights=met[b], minlength=len(c)).astype(np.int64)
                    if not inner:
                        seen = np.bincount(b, weights=n[a], minlength=len(met)).astype(np.int64)
                        yield counted(oc[k : k + 1024], seen)
                    for u, v in _spanning(c[a], oc[k : k + 1024][b]):
                        links.join(u, v)
        yield counted(c, counts)
        edges = [(a, links.root(a)) for a in list(links.parent)]
        edges = np.array([e for e in edges if e[0] != e[1]], np.int64).reshape(-1, 2)
        if len(edges):
            none = pa.nulls(len(edges), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(edges[:, 0].copy()), pa.array(edges[:, 1].copy())], schema=out)

    def counted(c: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(counts)
        none = pa.nulls(len(some), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c[some]), pa.array(counts[some]), none, none], schema=out)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, homes, others in _cells(batches):
            if homes is not None:
                yield from cell_links(homes, others)
            for _ in others:
                pass

    rows = classes.select("c", "n", "v").mapInArrow(deal, "cell long, visitor boolean, c long, n long, v array<double>")
    return rows.repartition("cell").sortWithinPartitions("cell", "visitor").mapInArrow(join, "c long, n_links long, u long, v long")


def _turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two different numbers, whether the first visits the second: each visits about half of the others."""
    return np.where((a + b) % 2 == 0, a < b, a > b)


def _far_apart(x: np.ndarray, k: int) -> np.ndarray:
    """k of the rows, each the farthest from those before it."""
    taken = [0]
    least = _distances(x, x[:1])[:, 0]
    while len(taken) < min(k, len(x)):
        taken.append(int(least.argmax()))
        least = np.minimum(least, _distances(x, x[taken[-1:]])[:, 0])
    return x[taken]


def _near(x: np.ndarray, short: np.ndarray, other: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with at least that cosine: single precision finds who may be, double precision decides."""
    a, b = np.nonzero(short @ other.astype(np.float32).T >= np.float32(cosine - 1e-3))
    if len(a) * 8 > len(x) * len(other):
        return np.nonzero(x @ other.T >= cosine)
    keep = np.concatenate([np.einsum("ij,ij->i", x[a[k : k + 65536]], other[b[k : k + 65536]]) >= cosine for k in range(0, len(a), 65536)]) if len(a) else np.zeros(0, bool)
    return a[keep], b[keep]


def _chain(first, rest):
    yield first
    yield from rest


def _spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Few pairs with the components of all links (a[i], b[i]): a tree for each, found by spreading the smallest label."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[left], label[right])
        np.minimum.at(label, left, least)
        np.minimum.at(label, right, least)
        label = label[label]
        if (label == before).all():
            break
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return list(zip(nodes[own].tolist(), nodes[label[own]].tolist(), strict=True))


def _cells(batches: Iterator[pa.RecordBatch]):
    """(cell, homes, visitors in batches) from rows sorted by cell with homes first."""
    stream = ((int(cell), bool(visitor), part) for cell, visitor, part in _runs(batches))
    item = next(stream, None)
    while item is not None:
        cell, homes = item[0], []
        while item is not None and item[0] == cell and not item[1]:
            homes.append(item[2])
            item = next(stream, None)

        def visitors(cell=cell):
            nonlocal item
            while item is not None and item[0] == cell:
                yield item[2]
                item = next(stream, None)

        yield cell, tuple(np.concatenate(p) for p in zip(*homes, strict=True)) if homes else None, visitors()


def _runs(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column(0).to_numpy()
        visitor = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        c, n, x = batch.column(2).to_numpy(), batch.column(3).to_numpy(), _matrix(batch.column(4))
        cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (visitor[1:] != visitor[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)], strict=True):
            yield cell[a], visitor[a], (c[a:b], n[a:b], x[a:b])

