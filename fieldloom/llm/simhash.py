"""SimHash fingerprints and their near-duplicates by multi-index hashing.

Two fingerprints with at most `radius` differing bits have a segment in which few bits differ: with segment radii that
sum to radius - segments + 1, some segment differs by at most its own.  Each distinct fingerprint is entered under its own
segments, and probes all values within the radius of each segment's Hamming ball in which bits are only set: of two values
that differ in one bit, the one without it finds the other.  What meets under a segment value is compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import connected_components, dealt_anew, in_blocks, in_parts, utf8, written

_WORDS_AT_ONCE = 1 << 14


def fingerprint(data: bytes, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles; 0 without words, the whole sequence if it has fewer words."""
    words = data.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for low in range(0, n, _WORDS_AT_ONCE):
        part = words[low : min(n, low + _WORDS_AT_ONCE) + shingle - 1]
        joined = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part])
        starts = np.concatenate([[0], ends[:-1]]).tolist()
        ends = (ends - 1).tolist()[min(shingle, len(part)) - 1 :]
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends)], np.uint64)  # noqa: B905  as many as there are ends
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of each row; null and empty texts have fingerprint 0."""
    out = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], schema=out)

    return docs.select(F.col(id_col).cast("long").alias("id"), utf8(F.col(text_col)).alias("data")).mapInArrow(hashed, "id long, fp long")


def segment_plan(radius: int, segments: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, ball radius) of each segment."""
    each, more = divmod(max(0, radius - segments + 1), segments)
    bounds = [64 * k // segments for k in range(segments + 1)]
    return [(a, b - a, each + (k < more) if radius >= segments - 1 else 0) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]


def _probes(fps: np.ndarray, plan: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fingerprint, 1 if a probe) of the entries and probes of fingerprints; a key is the segment's number and value."""
    keys, owners, kinds = [], [], []
    for k, (first, bits, ball) in enumerate(plan):
        value = fps >> np.uint64(first) & np.uint64((1 << bits) - 1)
        mark = np.uint64(k << 56)
        keys.append(value | mark)
        owners.append(fps)
        kinds.append(np.zeros(len(fps), np.int8))
        for at, values in _targets(value, bits, ball):
            keys.append(values | mark)
            owners.append(fps[at])
            kinds.append(np.ones(len(values), np.int8))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(kinds)


def _targets(value: np.ndarray, bits: int, ball: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which values probe, what they probe) for each set of bits that a ball changes; of two values a bit apart one probe is enough."""
    for mask in _balls(bits, ball):
        at = np.flatnonzero(value & np.uint64(mask) == 0) if mask.bit_count() == 1 else np.arange(len(value))
        yield at, value[at] ^ np.uint64(mask)


def _balls(bits: int, ball: int) -> list[int]:
    from itertools import combinations

    return [sum(1 << b for b in c) for r in range(1, ball + 1) for c in combinations(range(bits), r)]


def links_in_bucket(entries: np.ndarray, probes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect the fingerprints of a bucket as all links between entries, and entries and probes, would.

    A search from one fingerprint to all not yet reached: each step compares one with those left, so that a bucket of n near
    copies costs about n steps over few, and holds n numbers.
    """
    nodes = np.concatenate([entries, probes])
    is_probe = np.arange(len(nodes)) >= len(entries)
    left = np.arange(len(nodes))
    edges = []
    while len(left):
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(nodes[left] ^ nodes[at]) <= radius
            if is_probe[at]:
                near &= ~is_probe[left]
            if near.any():
                found = left[near]
                left = left[~near]
                edges += [(int(nodes[at]), int(x)) for x in nodes[found]]
                frontier += found.tolist()
    return edges


def _bucket_sizes(distinct: DataFrame, plan: list[tuple[int, int, int]], most: int) -> DataFrame:
    """(key, n): a bound from above of the entries and probes of each bucket that may hold more than `most`.

    Counts of entries by segment value (never more than a segment has values) tell the probes too, as all entries of a value
    probe alike.  Counts too low to matter even if all that reach a bucket were such are left aside and allowed for.
    """
    values = [F.shiftrightunsigned("fp", first).bitwiseAND((1 << bits) - 1 if bits < 64 else -1).bitwiseOR(k << 56) for k, (first, bits, _) in enumerate(plan)]
    per = distinct.select(F.explode(F.array(*values)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    widest = 1 + max(len(_balls(bits, ball)) for _, bits, ball in plan)
    out = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.cast(out)
            key, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k, (_, bits, ball) in enumerate(plan):
                own = np.flatnonzero(key >> 56 == k)
                for at, values in _targets(key[own].view(np.uint64) & np.uint64((1 << 56) - 1), bits, ball):
                    yield pa.RecordBatch.from_arrays([pa.array((values | np.uint64(k << 56)).view(np.int64)), pa.array(n[own][at])], schema=out)

    large = per.where(F.col("n") > most // (2 * widest)).mapInArrow(reached, "key long, n long")
    return large.groupBy("key").agg((F.sum("n") + (most + 1) // 2).alias("n"))


def fingerprint_links(distinct: DataFrame, radius: int = 4, segments: int = 3, bucket_rows: int = 1 << 20) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) with the components of all pairs within the radius.

    A bucket of more than about `bucket_rows` entries and probes is compared as pairs of its blocks, each in a task's bounds.
    """
    plan = segment_plan(radius, segments)
    out = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("probe", pa.int8())])

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for low in range(0, len(fps), 4096):
                keys, owners, kinds = _probes(fps[low : low + 4096], plan)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(owners.view(np.int64)), pa.array(kinds)], schema=out)

    edge = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _and_end(batches):
            if batch is not None:
                key, fp, probe = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
                if rest is not None:
                    key, fp, probe = (np.concatenate([a, b]) for a, b in zip(rest, (key, fp, probe), strict=True))
                cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last bucket may go on
                rest = key[cut:], fp[cut:], probe[cut:]
                key, fp, probe = key[:cut], fp[:cut], probe[:cut]
            elif rest is not None:
                key, fp, probe = rest
            else:
                return
            found = _bucket_links(key, fp.view(np.uint64), probe, radius)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy().view(np.int64)), pa.array(found[:, 1].copy().view(np.int64))], schema=edge)

    entered = distinct.select("fp").mapInArrow(enter, "key long, fp long, probe byte")
    sorted_ = in_blocks(entered, _bucket_sizes(distinct, plan, bucket_rows), "fp", bucket_rows).repartition("key").sortWithinPartitions("key", "probe")
    return sorted_.mapInArrow(compare, "u long, v long").distinct()


def _and_end(batches):
    yield from batches
    yield None


def _bucket_links(key: np.ndarray, fp: np.ndarray, probe: np.ndarray, radius: int, small: int = 32) -> np.ndarray:
    """Links of sorted buckets: all pairs of small ones at once, the others one by one."""
    if not len(key):
        return np.zeros((0, 2), np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    entries = np.add.reduceat((probe == 0).astype(np.int64), starts)
    live = (entries > 0) & (sizes > 1)
    found = []
    for a, n, e in zip(starts[live & (sizes > small)], sizes[live & (sizes > small)], entries[live & (sizes > small)], strict=True):
        found += links_in_bucket(fp[a : a + e], fp[a + e : a + n], radius)
    out = [np.array(found, np.uint64).reshape(-1, 2)]
    a, n, e = (x[live & (sizes <= small)] for x in (starts, sizes, entries))
    for k in range(small - 1):  # the k-th entry of each bucket against all after it
        on = (k < e) & (k + 1 < n)
        if not on.any():
            break
        counts = n[on] - k - 1
        left = np.repeat(a[on] + k, counts)
        right = left + 1 + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        near = np.bitwise_count(fp[left] ^ fp[right]) <= radius
        out.append(np.column_stack([fp[left[near]], fp[right[near]]]))
    return np.concatenate(out)


def near_duplicates(docs: DataFrame, radius: int = 4, segments: int = 3, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, component): of each row its fingerprint and the smallest id that links of at most `radius` bits reach.

    Rows with the same fingerprint meet in one aggregate with partial minima, before anything is compared, so that copies cost
    nothing more.  Null texts count as empty; repeated rows stay; a row with a null id has its component's smallest id (null
    if all are); other columns are left aside; an empty table gives no row.
    """
    fps = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("id").alias("least"))
    linked = connected_components(fingerprint_links(classes, radius, segments))
    linked = linked.join(classes.withColumnRenamed("fp", "node"), "node")
    component = linked.groupBy("component").agg(F.min("least").alias("smallest"))
    members = linked.select("node", "component").join(component, "component").select(F.col("node").alias("fp"), "smallest")
    per_fp = classes.join(members, "fp", "left").select("fp", F.coalesce("smallest", "least").alias("component"))
    return fps.join(dealt_anew(per_fp, "fp"), "fp").select(F.col("id").alias(id_col), "fp", "component")
