"""Repeated passages: MinHash banding of paragraphs, exact Jaccard, and removals by components.

Paragraphs are cut by content, so that a passage set into another text is cut alike: where a capital or a small letter
shows a seam, after a third of the sentences and lines, and after a 64th of the words, both picked by their own hashes.
What cuts miss is found exactly: every run of 50 words that stands in more than one row, wherever it begins.  Winnowing
(the least hash of 16 words among every 35 in a row) picks the same places in all its copies; around picks that rows share,
all windows of 50 words are counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.llm.common import connected_components, dealt_anew, drop_written, in_blocks, utf8, written

SHINGLE = 5
_U = np.uint64
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1024)], _U)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ x >> _U(31)) * _U(0x7FB5D329728EA185)
    x = (x ^ x >> _U(27)) * _U(0x81DADEF4BC2DD44D)
    return x ^ x >> _U(33)


def _sums(flags: np.ndarray) -> np.ndarray:
    """How many are set before each place, the end included."""
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=out[1:])
    return out


def _lone(marks: np.ndarray, reach: int) -> np.ndarray:
    """Marks without another within reach on either side."""
    sums = _sums(marks)
    at = np.arange(len(marks))
    return marks & (sums[np.minimum(at + reach + 1, len(marks))] - sums[np.maximum(at - reach, 0)] == 1)


#: Stands between texts that are looked at together: words without marks, as many as a mark's neighbours count.
_BETWEEN = b"\n" + b"a " * 6 + b"\n"


def _worded(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(bytes, where texts begin, where words begin and end, their hashes, their texts, whether they lie in one) of joined texts."""
    data = _BETWEEN.join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    opens = np.cumsum(sizes + len(_BETWEEN)) - sizes - len(_BETWEEN)
    raw = np.frombuffer(data, np.uint8)
    text = _FOLD[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (text != 32).view(np.int8), [0]])))
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return raw, opens, first, last, np.array([], _U), first, np.array([], bool)
    place = np.zeros(len(text), np.int32)  # within the word, counted on through the space after it
    place[first] = np.diff(first, prepend=0)
    place = np.arange(len(text), dtype=np.int32) - np.cumsum(place, dtype=np.int32)
    weighed = np.where(text == 32, 0, text).astype(_U) * _POWERS[place % 1024]
    words = _mixed(np.add.reduceat(weighed, first) + (last - first).astype(_U))
    doc = np.searchsorted(opens, first, side="right") - 1
    return raw, opens, first, last, words, doc, first < opens[doc] + sizes[doc]


#: Words of a window and of a pick; a window holds REACH picks' places.
WINDOW, PICK = 50, 16
REACH = WINDOW - PICK + 1


def _extreme(x: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """The least or largest of every `size` numbers in a row."""
    have, out = 1, x
    while have * 2 <= size:
        out, have = best(out[:-have], out[have:]), have * 2
    return best(out[: len(out) - (size - have)], out[size - have :]) if size > have else out


class Windows:
    """Every WINDOW words of several texts: hash, the pick that its words decide, text, first word and places in code points."""

    def __init__(self, texts: list[bytes]):
        raw, opens, first, last, words, doc, inside = _worded(texts)
        n = len(first) - WINDOW + 1
        self.hash = np.array([], _U)
        if n < 1:
            return
        two = h = _mixed(words[:-1] * _U(3) + words[1:])
        for k in (2, 4, 8):
            h = _mixed(h[:-k] * _U(3) + h[k:])
        own = (doc[: n + REACH - 1] == doc[PICK - 1 :]) & inside[PICK - 1 :]
        least = _extreme(np.where(own, h, ~_U(0)), REACH, np.minimum)
        keep = (doc[:n] == doc[WINDOW - 1 :]) & inside[WINDOW - 1 :]
        self.pick = least[keep]
        self.hash = _mixed(h[:n] + h[16 : n + 16] * _POWERS[1] + h[32 : n + 32] * _POWERS[2] + two[48 : n + 48] * _POWERS[3])[keep]
        at = np.flatnonzero(keep)
        self.doc = doc[at]
        self.begin = at - np.searchsorted(first, opens[self.doc])
        chars = _sums((raw & 0xC0) != 0x80)
        base = chars[opens[self.doc]]
        self.start, self.stop = chars[first[at]] - base, chars[last[at + WINDOW - 1]] - base


class Paragraphs:
    """Arrays of the paragraphs of at least SHINGLE words of several texts, each as if it stood alone."""

    def __init__(self, texts: list[bytes]):
        self.begin = np.array([], np.int64)
        raw, opens, first, last, words, doc, inside = _worded(texts)
        n = len(first)
        if n < SHINGLE:
            return
        joint = inside[1:] & inside[:-1] & (doc[1:] == doc[:-1])
        marks = _sums((raw == 46) | (raw == 33) | (raw == 63))
        lines = _sums(raw == 10)
        ended = (marks[first[1:]] > marks[last[:-1]]) & joint
        second = np.minimum(first + 1, len(raw) - 1)
        capital = ((raw[first] >= 65) & (raw[first] <= 90) | (raw[first] == 0xC3) & (raw[second] >= 0x80) & (raw[second] <= 0x9E))[1:]
        loud = ((raw[last - 1] >= 65) & (raw[last - 1] <= 90))[1:]  # a word in capitals shows no seam
        seam = np.where(ended, ~capital, capital & ~loud) & joint
        ended |= (lines[first[1:]] > lines[last[:-1]]) & joint
        pair = _mixed(words[:-1] * _U(3) + words[1:])
        ended, seam = _lone(ended, 1), _lone(seam, 3)  # where marks stand after every word they tell nothing
        cut = seam | ended & (words[:-1] % _U(3) == 0) | (pair % _U(64) == 0) | ~joint
        begin = np.concatenate([[0], np.flatnonzero(cut) + 1])
        end = np.append(begin[1:], n)
        keep = (end - begin >= SHINGLE) & inside[begin]
        begin_kept, end_kept = begin[keep], end[keep]
        if not len(begin_kept):
            return
        self.doc = doc[begin_kept]
        base = np.searchsorted(first, opens[self.doc])  # a text's first word
        self.begin, self.end = begin_kept - base, end_kept - base  # words of the text
        start, stop = first[begin_kept], last[end_kept - 1]
        chars = _sums((raw & 0xC0) != 0x80)
        base = chars[opens[self.doc]]
        self.start, self.stop = chars[start] - base, chars[stop] - base  # code points
        owner = np.repeat(np.where(keep, np.arange(len(begin)), -1 - np.arange(len(begin))), end - begin)
        shingle = np.zeros(n - SHINGLE + 1, _U)
        for k in range(SHINGLE):
            shingle += words[k : n - SHINGLE + 1 + k] * _POWERS[k + 1]
        own = owner[: n - SHINGLE + 1]
        self.shingles = _mixed(shingle[(own == owner[SHINGLE - 1 :]) & (own >= 0)])  # within a kept paragraph
        counts = end_kept - begin_kept - SHINGLE + 1
        self.at = np.cumsum(counts) - counts
        rank = np.arange(len(self.shingles)) - np.repeat(self.at, counts)
        self.hash = _mixed(np.add.reduceat(self.shingles * _POWERS[rank % 1024], self.at) + counts.astype(_U))

    def __len__(self) -> int:
        return len(self.begin)

    def band_keys(self, bands: int, rows: int) -> np.ndarray:
        """A row of keys for each paragraph."""
        out = np.empty((len(self), bands), _U)
        for b in range(bands):
            key = np.full(len(self), b + 1, _U)
            for r in range(rows):
                k = b * rows + r
                key = _mixed(key + np.minimum.reduceat(_mixed(self.shingles ^ _POWERS[500 + k]), self.at))
            out[:, b] = key
        return out

    def sets(self, which: np.ndarray) -> list[np.ndarray]:
        ends = np.append(self.at[1:], len(self.shingles))
        return [np.unique(self.shingles[self.at[k] : ends[k]]) for k in which]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _groups(column: pa.Array, most: int = 1 << 17) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts) of runs of texts with at most about `most` bytes."""
    texts, held, low = [], 0, 0
    for n, data in enumerate(column):
        data = data.as_py()
        if texts and held + len(data) > most:
            yield low, texts
            texts, held, low = [], 0, n
        texts.append(data)
        held += len(data)
    if texts:
        yield low, texts


def tuned(similarity: float, recall: float, hashes: int = 10) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands take no more than so many hashes, and one row where none do.

    Pairs with the similarity meet in some band with probability 1 - (1 - similarity**rows)**bands, which is at least `recall`.
    """

    def bands(rows: int) -> int:
        meets = similarity**rows
        return 1 if meets >= 1 else math.ceil(math.log1p(-recall) / math.log1p(-meets) - 1e-12)

    return next(((bands(r), r) for r in range(hashes, 1, -1) if r * bands(r) <= hashes), (bands(1), 1))


def repeated_passages(docs: DataFrame, similarity: float = 0.8, recall: float = 0.99, least_words: int = 32, gap: int = 8, filter_bits: int = 26, crowd: int = 1000, band_sets: int = 1 << 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, n_words, run_words, cluster, n_paragraphs, removed): the paragraphs of repeated passages, places in code points.

    A paragraph (of 5 words or more) is repeated if its component, over links with a Jaccard similarity of 5-word shingles of
    at least `similarity`, stands in more than one row of docs.  Runs of repeated paragraphs with gaps of at most `gap` words
    are reported from least_words words on.  cluster is the component's smallest paragraph hash; all its paragraphs but the
    first (by id, row, place) are removed.  Besides, every run of WINDOW (50) words or more that stands word by word in more than
    one row of docs is reported to its exact ends, wherever it begins, also where paragraphs tell of the same words (so rows of
    the two kinds may overlap, and what goes is the union of the removed ones); its cluster joins the runs that share windows.  Pairs at the threshold meet in a
    band with a probability of at least `recall`, from which and the similarity bands and rows are tuned (5 of 2 at 0.8, which
    is 0.994); what meets is decided on the whole shingle sets.

    Equal paragraphs are one class by an aggregate with partial counts, and each batch sends a class's keys once, so copies do
    not gather.  The shingle sets of the few classes that share a key are computed again in a last pass: a bit field
    of 2**filter_bits (8 MB) passes over most others, and an equi-join decides.  A key that more than band_sets classes share
    is compared as pairs of blocks of them, each in a task's bounds.  Null and empty texts have none; a
    null id is carried along; other columns are left aside; an empty table gives no row.
    """
    bands, rows = tuned(similarity, recall)
    held = docs.select(F.col(id_col).cast("long").alias("id"), utf8(F.col(text_col)).alias("data"))
    numbered = held.select(F.monotonically_increasing_id().alias("row"), "id", "data")
    unit = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("begin", pa.int32()), ("stop_word", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("h", pa.int64())])

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, texts in _groups(batch.column(2)):
                p = Paragraphs(texts)
                if len(p):
                    own = batch.select(["row", "id"]).slice(low, len(texts)).take(pa.array(p.doc))
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(p.begin.astype(np.int32)), pa.array(p.end.astype(np.int32)), pa.array(p.start.astype(np.int64)), pa.array(p.stop.astype(np.int64)), _signed(p.hash)], schema=unit)

    key = pa.schema([("key", pa.int64()), ("h", pa.int64())])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, hashes = [], []
            for _, texts in _groups(batch.column(0)):
                p = Paragraphs(texts)
                if len(p):
                    parts.append(p.band_keys(bands, rows))
                    hashes.append(p.hash)
            if parts:
                h, at = np.unique(np.concatenate(hashes), return_index=True)
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(parts)[at].ravel()), _signed(np.repeat(h, bands))], schema=key)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, h, told = np.array([], np.int64), np.array([], np.int64), False
        for batch in batches:
            k, h = np.concatenate([k[-1:], batch.column(0).to_numpy()]), np.concatenate([h[-1:], batch.column(1).to_numpy()])
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])]) if len(k) else np.array([], bool)
            k, h = k[new], h[new]
            many = np.zeros(len(k), bool)
            many[1:] = k[1:] == k[:-1]
            many[:-1] |= many[1:]
            tell = many.copy()
            if told:  # the last one of the batch before
                tell[0], many[0] = False, True
            told = bool(len(k)) and bool(many[-1])
            if tell.any():
                yield pa.RecordBatch.from_arrays([pa.array(k[tell]), pa.array(h[tell])], schema=key)

    table = written(numbered.mapInArrow(units, "row long, id long, begin int, stop_word int, start long, end long, h long"), "paragraphs")
    met = held.select("data").mapInArrow(keys, "key long, h long").repartition("key").sortWithinPartitions("key", "h")
    met = written(met.mapInArrow(shared, "key long, h long"), "met")
    sent = docs.sparkSession.sparkContext.broadcast(_bit_field(met.select("h"), filter_bits))
    sets = pa.schema([("h", pa.int64()), ("shingles", pa.binary())])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            found: dict[int, bytes] = {}
            for _, texts in _groups(batch.column(0)):
                p = Paragraphs(texts)
                if len(p):
                    low = p.hash & _U((1 << filter_bits) - 1)
                    for k in np.flatnonzero(bits[(low >> _U(3)).astype(np.int64)] >> (low & _U(7)).astype(np.uint8) & 1):
                        if (h := int(p.hash[k])) not in found:
                            found[h] = p.sets([k])[0].tobytes()
            if found:
                yield pa.RecordBatch.from_arrays([_signed(np.array(list(found), _U)), pa.array(list(found.values()), pa.binary())], schema=sets)

    texts = held.select("data").mapInArrow(shingles, "h long, shingles binary").groupBy("h").agg(F.first("shingles").alias("shingles"))
    edge = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, own in _buckets(batches):
            found = linked(h, own, similarity)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], schema=edge)

    parted = in_blocks(met, met.groupBy("key").agg(F.count("*").alias("n")), "h", band_sets)
    pairs = parted.join(dealt_anew(texts, "h"), "h").select("key", "h", "shingles").repartition("key").sortWithinPartitions("key", "h").mapInArrow(verify, "u long, v long")
    components = connected_components(pairs)  # written, so the field is not needed any more
    sent.destroy()
    place = F.struct("id", "row", "begin")
    classes = table.groupBy("h").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.count("*").alias("n"), F.min(place).alias("first"))
    labelled = classes.join(components.withColumnRenamed("node", "h"), "h", "left").withColumn("cluster", F.coalesce("component", "h"))
    repeated = labelled.where("component is not null or low < high").select("h", "cluster", "low", "high", "n", "first")
    clusters = repeated.groupBy("cluster").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n_paragraphs"), F.min("first").alias("first")).where("low < high")
    member = repeated.select("h", "cluster").join(dealt_anew(clusters.select("cluster", "n_paragraphs", "first"), "cluster"), "cluster")
    found = table.join(dealt_anew(member, "h"), "h")
    order = Window.partitionBy("row").orderBy("begin")
    whole = Window.partitionBy("row", "run")
    found = found.withColumn("new", F.when(F.col("begin") - F.lag("stop_word").over(order) <= gap, 0).otherwise(1))
    found = found.withColumn("run", F.sum("new").over(order)).withColumn("run_words", F.max("stop_word").over(whole) - F.min("begin").over(whole))
    names = ["id", "start", "end", "n_words", "run_words", "cluster", "n_paragraphs", "removed"]
    found = found.where(F.col("run_words") >= least_words).select(
        "id", "start", "end", (F.col("stop_word") - F.col("begin")).cast("long").alias("n_words"), F.col("run_words").cast("long").alias("run_words"),
        "cluster", "n_paragraphs", (~place.eqNullSafe(F.col("first"))).alias("removed"),
    )
    found = written(found, "passages")
    drop_written(table)
    drop_written(met)
    return found.union(_exact_runs(numbered, filter_bits, crowd).select(*names)).withColumnRenamed("id", id_col)


def _packed(x: np.ndarray) -> bytes:
    """The steps between numbers that do not fall, in as few bytes each as the largest needs."""
    steps = np.diff(x)
    most = int(steps.max()) if len(steps) else 0
    return steps.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _unpacked(first: int, steps: bytes, n: int) -> np.ndarray:
    if n == 1:
        return np.array([first], np.int64)
    return first + np.concatenate([[0], np.cumsum(np.frombuffer(steps, f"<u{len(steps) // (n - 1)}"), dtype=np.int64)])


_CONTEXT = "row long, id long, pick long, hot boolean, begin int, start long, end long, hashes binary, starts binary, ends binary"
_MARKED = "row long, id long, pick long, begin int, start long, end long, marks binary, starts binary, ends binary"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in ddl.split(", "))])


def _rows_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _exact_runs(numbered: DataFrame, filter_bits: int, crowd: int) -> DataFrame:
    """(id, start, end, n_words, run_words, cluster, n_paragraphs, removed) of all runs of WINDOW words that several rows have.

    The windows around one place of a pick (35 at most) travel as one row, a context, under the pick that they share: equal
    windows have equal picks.  The contexts of one pick meet in a task; picks with more than `crowd` of them (a bit field
    tells, the same way for all contexts of a pick) are counted window by window instead, by aggregates with partial
    sums and an equi-join that the adaptive skew join can split.  A run is cut where its words begin or cease to be
    the first copy (by id, row, place) of some window; those stay.
    """
    pick = pa.schema([("h", pa.int64()), ("row", pa.int64())])

    def picks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, texts in _groups(batch.column(2)):
                w = Windows(texts)
                if len(w.hash):
                    new = np.concatenate([[True], (w.pick[1:] != w.pick[:-1]) | (w.doc[1:] != w.doc[:-1])])
                    yield pa.RecordBatch.from_arrays([_signed(w.pick[new]), batch.column(0).take(pa.array(w.doc[new] + low))], schema=pick)

    met = numbered.mapInArrow(picks, "h long, row long").groupBy("h").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.count("*").alias("n")).where("low < high")
    met = written(met.select("h", "n"), "picks")
    sent = numbered.sparkSession.sparkContext.broadcast((_bit_field(met.select("h"), filter_bits), _bit_field(met.where(F.col("n") > crowd).select("h"), filter_bits)))
    drop_written(met)
    context = _arrow(_CONTEXT)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, crowded = sent.value
        for batch in batches:
            for low, texts in _groups(batch.column(2)):
                w = Windows(texts)
                if not len(w.hash):
                    continue
                first = np.flatnonzero(np.concatenate([[True], (w.pick[1:] != w.pick[:-1]) | (w.doc[1:] != w.doc[:-1])]))
                last = np.append(first[1:], len(w.hash))
                at = w.pick[first] & _U((1 << filter_bits) - 1)
                byte, bit = (at >> _U(3)).astype(np.int64), (at & _U(7)).astype(np.uint8)
                on = np.flatnonzero(bits[byte] >> bit & 1)
                if not len(on):
                    continue
                own = batch.select(["row", "id"]).take(pa.array(w.doc[first[on]] + low))
                spans = list(zip(first[on].tolist(), last[on].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([
                    own.column(0), own.column(1), _signed(w.pick[first[on]]), pa.array((crowded[byte] >> bit & 1)[on].astype(bool)), pa.array(w.begin[first[on]].astype(np.int32)),
                    pa.array(w.start[first[on]].astype(np.int64)), pa.array(w.stop[first[on]].astype(np.int64)), pa.array([w.hash[a:b].tobytes() for a, b in spans], pa.binary()),
                    pa.array([_packed(w.start[a:b]) for a, b in spans], pa.binary()), pa.array([_packed(w.stop[a:b]) for a, b in spans], pa.binary()),
                ], schema=context)

    table = written(numbered.mapInArrow(contexts, _CONTEXT), "contexts")
    sent.destroy()
    marked = _arrow(_MARKED)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_keys(batches, 2):
            yield from _marked(part, marked)

    quiet = table.where(~F.col("hot")).drop("hot").repartition("pick").sortWithinPartitions("pick").mapInArrow(mark, _MARKED)
    one = "row long, id long, pick long, begin int, start long, end long, h long"

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 1000) for k in range(0, whole.num_rows, 1000)):
                n = np.array([len(x.as_py()) // 8 for x in batch.column("hashes")])
                at = np.repeat(np.arange(len(n)), n)
                nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                own = batch.select(["row", "id", "pick"]).take(pa.array(at))
                begin = batch.column("begin").to_numpy()[at] + nth
                start, end = (np.concatenate([_unpacked(f, d, k) for f, d, k in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist(), n.tolist(), strict=True)]) for a, b in (("start", "starts"), ("end", "ends")))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(begin.astype(np.int32)), pa.array(start), pa.array(end), pa.array(np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.int64))], schema=_arrow(one))

    crowds = table.where("hot").mapInArrow(apart, one)
    place = F.struct("id", "row", "begin")
    classes = crowds.groupBy("pick", "h").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.min(place).alias("first")).where("low < high").select("pick", "h", "first")
    kept = F.when(place.eqNullSafe(F.col("first")), F.lit(b"\x02")).otherwise(F.lit(b"\x01")).alias("marks")
    loud = crowds.join(dealt_anew(classes, "h"), ["pick", "h"]).select("row", "id", "pick", "begin", "start", "end", kept, F.lit(b"").alias("starts"), F.lit(b"").alias("ends"))
    hit = quiet.union(loud).select("row", "id", F.struct("begin", "pick", "start", "end", "marks", "starts", "ends").alias("w"))
    kinds = "id long, start long, end long, n_words long, run_words long, removed boolean, pick long, picks array<long>"
    piece = _arrow(kinds)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            every, cuts = _windows_of(batch.column(1))
            for own, low, high in zip(batch.column(0).to_pylist(), cuts, cuts[1:], strict=False):
                begin, start, end, picks, stays = (x[low:high] for x in every)
                bounds = [0, *(np.flatnonzero(np.diff(begin) >= WINDOW) + 1), len(begin)]
                for a, b in zip(bounds, bounds[1:], strict=False):
                    among = np.unique(picks[a:b])
                    words = int(begin[b - 1]) + WINDOW - int(begin[a])
                    for k, (x, y, p, q, removed) in enumerate(_cut(begin[a:b], start[a:b], end[a:b], stays[a:b])):
                        rows.append((own, p, q, y - x, words, removed, int(among[0]), [] if k else among.tolist()))
            yield _rows_batch(rows, piece)

    cut = hit.groupBy("row").agg(F.first("id").alias("id"), F.sort_array(F.collect_list("w")).alias("w")).select("id", "w")
    cut = written(cut.mapInArrow(pieces, kinds), "pieces")
    drop_written(table)
    components = connected_components(cut.select(F.col("pick").alias("u"), F.explode("picks").alias("v")))
    cut = cut.join(dealt_anew(components.withColumnRenamed("node", "pick"), "pick"), "pick", "left").withColumn("cluster", F.coalesce("component", "pick"))
    return cut.join(dealt_anew(cut.groupBy("cluster").agg(F.count("*").alias("n_paragraphs")), "cluster"), "cluster")


def _whole_keys(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by a column in which none of its values goes on in the next."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(column).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut or (rest and rest[-1].column(column)[0].as_py() != key[0]):
            yield pa.concat_batches([*rest, batch.slice(0, cut)])
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.concat_batches(rest)


def _marked(part: pa.RecordBatch, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The contexts with a shared window; marks has a byte for each window: 0 its row's alone, 1 a later copy, 2 the first copy."""
    if not part.num_rows:
        return
    raw = [x.as_py() for x in part.column("hashes")]
    n = np.array([len(x) // 8 for x in raw])
    hashes = np.frombuffer(b"".join(raw), _U)
    row, begin = part.column("row").to_numpy(), part.column("begin").to_numpy()
    ids, null = part.column("id").fill_null(0).to_numpy(), part.column("id").is_null().to_numpy(zero_copy_only=False)
    order = np.empty(len(n), np.int64)
    order[np.lexsort((begin, row, ids, ~null))] = np.arange(len(n))
    owner = np.repeat(np.arange(len(n)), n)
    by = np.lexsort((order[owner], hashes))  # equal windows together, the first copy first
    starts = np.flatnonzero(np.concatenate([[True], hashes[by][1:] != hashes[by][:-1]]))
    rows = row[owner[by]]
    shared = np.minimum.reduceat(rows, starts) < np.maximum.reduceat(rows, starts)
    marks = np.zeros(len(hashes), np.uint8)
    marks[by] = np.repeat(shared, np.diff(np.append(starts, len(hashes))))
    marks[by[starts[shared]]] = 2
    ends = np.cumsum(n)
    on = np.flatnonzero(np.maximum.reduceat(marks, ends - n))
    if len(on):
        own = part.take(pa.array(on))
        told = pa.array([marks[b - k : b].tobytes() for b, k in zip(ends[on].tolist(), n[on].tolist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([told if f.name == "marks" else own.column(f.name) for f in schema], schema=schema)


def _windows_of(contexts: pa.ListArray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """(begin, start, end, pick, whether it stays) of the shared windows of all rows' contexts, which come in order, and where each row's begin."""
    flat = contexts.flatten()
    told = {f.name: flat.field(k) for k, f in enumerate(flat.type)}
    marks = told["marks"].to_pylist()
    n = np.array([len(x) for x in marks], np.int64)
    marks = np.frombuffer(b"".join(marks), np.uint8)
    on = np.flatnonzero(marks)
    opens = np.cumsum(n) - n  # each context's first window
    owner = np.repeat(np.arange(len(n)), n)
    start, end = (_all_unpacked(told[first].to_numpy(zero_copy_only=False), told[steps].to_pylist(), n, opens, owner)[on] for first, steps in (("start", "starts"), ("end", "ends")))
    begin = told["begin"].to_numpy(zero_copy_only=False).astype(np.int64)[owner[on]] + on - opens[owner[on]]
    rows = np.concatenate([[0], np.cumsum(contexts.value_lengths().to_numpy(zero_copy_only=False))])
    cuts = np.searchsorted(on, np.append(opens, len(marks))[rows])
    return (begin, start, end, told["pick"].to_numpy(zero_copy_only=False)[owner[on]], marks[on] == 2), cuts


def _all_unpacked(first: np.ndarray, steps: list[bytes], n: np.ndarray, opens: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """_unpacked() of many at once."""
    out = np.zeros(len(owner), np.int64)
    width = np.array([len(x) for x in steps], np.int64) // np.maximum(n - 1, 1)
    later = np.arange(len(owner)) != opens[owner]
    for w in (1, 2, 4):
        out[later & (width == w)[owner]] = np.frombuffer(b"".join(x for x, k in zip(steps, width.tolist(), strict=True) if k == w), f"<u{w}")
    out = np.cumsum(out)
    return out - (out[opens] - first)[owner]


def _cut(begin: np.ndarray, start: np.ndarray, end: np.ndarray, stays: np.ndarray) -> list[tuple[int, int, int, int, bool]]:
    """(first word, end word, start, end, removed) of the pieces of a run of windows."""
    out = []
    word, char = int(begin[0]), int(start[0])
    kept = np.flatnonzero(stays)
    firsts = kept[np.concatenate([[True], np.diff(begin[kept]) > WINDOW])] if len(kept) else kept
    lasts = kept[np.concatenate([np.diff(begin[kept]) > WINDOW, [True]])] if len(kept) else kept
    for a, b in zip(firsts, lasts, strict=True):
        if begin[a] > word:
            out.append((word, int(begin[a]), char, int(start[a]), True))
        word, char = int(begin[b]) + WINDOW, int(end[b])
        out.append((int(begin[a]), word, int(start[a]), char, False))
    if begin[-1] + WINDOW > word:
        out.append((word, int(begin[-1]) + WINDOW, char, int(end[-1]), True))
    return out


def _bit_field(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bytes with a bit set for each hash: at most 2**(bits - 6) words of it come to the driver, however many hashes there are.

    They come as Arrow batches of 16 bytes a word; as rows, each would be objects in the JVM and in Python.
    """
    place = F.col("h").bitwiseAND((1 << bits) - 1)
    words = hashes.select(F.shiftright(place, 6).alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    field = np.zeros(1 << bits - 6, np.int64)
    for batch in words.to_batches():
        field[batch.column("w").to_numpy()] = batch.column("b").to_numpy()
    return field.view(np.uint8)


def _buckets(batches: Iterator[pa.RecordBatch]):
    """(hashes, shingle sets) of each key of sorted rows."""
    now, h, own = None, [], []
    for batch in batches:
        for k, x, s in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
            if k != now:
                if len(h) > 1:
                    yield h, own
                now, h, own = k, [], []
            h.append(x)
            own.append(np.frombuffer(s, _U))
    if len(h) > 1:
        yield h, own


def linked(h: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges with the components of all pairs of sets with that similarity: a search from each to those not yet reached."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    left = np.ones(len(sets), bool)
    out = []
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed] = False
        frontier = [seed]
        while frontier:
            at = frontier.pop()
            open_ = left[owner]
            flat, owner = flat[open_], owner[open_]
            if not len(flat):
                return out
            common = np.bincount(owner[np.isin(flat, sets[at])], minlength=len(sets))
            near = left & (common >= similarity * (sizes + sizes[at] - common) - 1e-9) & (common > 0)
            for k in np.flatnonzero(near):
                out.append((h[at], h[k]))
                frontier.append(int(k))
            left &= ~near
    return out
