"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of order 0 to ORDER holds counts.  A byte's probability in a context is
count / (total + distinct); the escape to the next shorter context takes distinct / (total + distinct), and below order 0
all byte values share what is left evenly.  The statistics are frozen after learning, so that a byte's code length in
bits depends on the last ORDER bytes alone.  A text's language is the one with the shortest exact code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import columns_of, in_parts, utf8

ORDER = 3
_SLAB = 1 << 18  # bytes that are looked up at a time


def _grams(data: bytes, letters: np.ndarray) -> np.ndarray:
    """Letters of the text after ORDER start letters (0)."""
    return np.concatenate([np.zeros(ORDER, np.int64), letters[np.frombuffer(data, np.uint8)]])


def gram_counts(docs: DataFrame, label: str, text: str) -> DataFrame:
    """(label, gram, n): how often each run of ORDER + 1 bytes occurs, bytes counted from 1 with 0 before the start.

    Counted in each task first: a task's rows are bounded by its distinct runs.
    """
    letters = np.arange(1, 257, dtype=np.int64)
    out = pa.schema([("label", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in in_parts(batches):
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = _grams(data, letters)
                if len(x) > ORDER:
                    code = sum(x[k : len(x) - ORDER + k] << 9 * (ORDER - k) for k in range(ORDER + 1))
                    held.setdefault(name, []).append(np.unique(code, return_counts=True))
            for name, parts in held.items():
                if len(parts) > 200:
                    held[name] = [_summed(parts)]
        for name, parts in held.items():
            gram, n = _summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram), pa.array(n)], schema=out)

    rows = docs.select(F.col(label).alias("label"), utf8(F.col(text)).alias("data"))
    return rows.mapInArrow(count, "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return gram, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


class Costs:
    """Code lengths in bits by context, letter and language.

    Only what a language has met in a context is kept, beside its escape from there: the size grows with each language's own
    grams, not with contexts times letters times languages.
    """

    def __init__(self, size: int, parent: np.ndarray, order: np.ndarray, met: list[tuple[np.ndarray, np.ndarray]], escapes: list[tuple[np.ndarray, np.ndarray]]):
        """met: of each language, keys (context * size + letter) and bits; escapes: contexts and bits."""
        self.size, self.parent, self.order, self.languages = size, parent, order, len(met)
        self.met, self.escapes = _by_key(met), _by_key(escapes)

    def of(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """A row of bits, one for each language, for each pair of a context and the letter after it."""
        chain = [nodes]
        for _ in range(ORDER):
            chain.append(np.where(self.order[chain[-1]] > 0, self.parent[chain[-1]], -1))
            chain[-1][chain[-2] < 0] = -1
        out = np.full((len(nodes), self.languages), 8.0)  # order -1: each byte value alike
        for at in reversed(chain):  # from the shortest context to the longest
            rows = np.flatnonzero(at >= 0)
            _gathered(self.escapes, at[rows], rows, out, add=True)
            _gathered(self.met, at[rows] * np.int64(self.size) + letters[rows], rows, out, add=False)
        return out

    def __getitem__(self, key: tuple) -> np.ndarray:
        nodes, letters, language = key
        code, pairs = pd.factorize(np.asarray(nodes, np.int64) * self.size + letters)
        return self.of(pairs // self.size, pairs % self.size)[code, language]


def _by_key(each: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """(distinct keys, bounds of their entries, languages, values), entries sorted by key."""
    if not each:
        return np.array([], np.int64), np.zeros(1, np.int64), np.array([], np.int16), np.array([], np.float32)
    key = np.concatenate([k for k, _ in each])
    by = np.argsort(key, kind="stable")
    keys, first = np.unique(key[by], return_index=True)
    language = np.repeat(np.arange(len(each), dtype=np.int16), [len(k) for k, _ in each])
    return keys, np.append(first, len(key)), language[by], np.concatenate([v for _, v in each]).astype(np.float32)[by]


def _gathered(table: tuple, wanted: np.ndarray, rows: np.ndarray, out: np.ndarray, add: bool) -> None:
    keys, bounds, language, value = table
    if not len(keys):
        return
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    on = np.flatnonzero(keys[at] == wanted)
    low, n = bounds[at[on]], bounds[at[on] + 1] - bounds[at[on]]
    entry = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
    row = np.repeat(rows[on], n)
    if add:
        out[row, language[entry]] += value[entry]
    else:
        out[row, language[entry]] = value[entry]


class Model:
    """Code lengths of all languages: node[code of the last ORDER letters] is the context that cost knows."""

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]], least: int = 2):
        """counts: of each language, the sorted grams of ORDER + 1 letters and how often each occurs.

        least: a context of order 2 or more is kept where some language has met it so often.
        """
        self.languages = languages
        grams = np.unique(np.concatenate([g for g, _ in counts])) if counts else np.array([], np.int64)
        used = np.unique(np.concatenate([grams >> 9 * k & 511 for k in range(ORDER + 1)])) if len(grams) else np.array([0])
        used = np.unique(np.concatenate([[0], used]))
        self.size = size = len(used) + 1  # the last letter stands for all bytes that were never met
        of = np.full(512, size - 1, np.int64)
        of[used] = np.arange(len(used))
        self.letters = of[1:257]
        split = [[of[g >> 9 * (ORDER - k) & 511] for k in range(ORDER + 1)] for g, _ in counts]
        contexts = [np.array([0])]
        for order in range(1, ORDER + 1):
            codes = [sum(s[ORDER - order + k] * size ** (order - 1 - k) for k in range(order)) for s in split]
            code = np.unique(np.concatenate(codes)) if codes else np.array([], np.int64)
            if order > 1 and len(code):
                most = np.zeros(len(code))
                for own, (_, n) in zip(codes, counts, strict=True):
                    most = np.maximum(most, np.bincount(np.searchsorted(code, own), weights=n, minlength=len(code)))
                code = code[most >= least]
            contexts.append(code)
        first = np.cumsum([0, *map(len, contexts)])
        orders = np.repeat(np.arange(ORDER + 1), [len(c) for c in contexts])
        parent = np.full(int(first[-1]), -1)
        for order in range(1, ORDER + 1):
            shorter = np.searchsorted(contexts[order - 1], contexts[order] % size ** (order - 1))
            assert (contexts[order - 1][np.minimum(shorter, len(contexts[order - 1]) - 1)] == contexts[order] % size ** (order - 1)).all()  # a context is met no more often than its suffix
            parent[first[order] : first[order + 1]] = first[order - 1] + shorter
        met, escapes = [], []
        for (_, n), s in zip(counts, split, strict=True):
            keys, bits, gone, lost = [], [], [], []
            before_key, before_p = np.array([], np.int64), np.array([])
            for order in range(ORDER + 1):
                code = contexts[order]
                own = sum((s[ORDER - order + j] * size ** (order - 1 - j) for j in range(order)), np.zeros(len(n), np.int64))
                at = np.minimum(np.searchsorted(code, own), max(len(code) - 1, 0))
                inside = code[at] == own if len(code) else np.zeros(len(n), bool)
                key, which = np.unique((first[order] + at[inside]) * size + s[ORDER][inside], return_inverse=True)
                times = np.bincount(which, weights=n[inside], minlength=len(key))
                context, where = np.unique(key // size, return_inverse=True)
                total, distinct = np.bincount(where, weights=times), np.bincount(where)
                # what is met here is met after the shorter context too
                before = before_p[np.searchsorted(before_key, parent[key // size] * size + key % size)] if order else np.full(len(key), 1 / 256)
                left = np.where(distinct < 256, np.maximum(1 - np.bincount(where, weights=before), 1e-12), 0)  # escapes code only what the context has not met
                escape = np.where(left > 0, distinct, 0)
                p = times / (total + escape)[where]
                keys.append(key)
                bits.append(-np.log2(p))
                gone.append(context)
                lost.append(np.where(left > 0, -np.log2(np.maximum(escape, 1) / np.maximum(left, 1e-12) / (total + escape)), 100.0))
                before_key, before_p = key, p
            met.append((np.concatenate(keys), np.concatenate(bits)))
            escapes.append((np.concatenate(gone), np.concatenate(lost)))
        self.cost = Costs(size, parent, orders, met, escapes)
        # the longest kept context of every run of ORDER letters
        node = np.zeros(1, np.int64)
        for order in range(1, ORDER + 1):
            node = np.tile(node, size)  # an unmet context falls back to the one without its oldest letter
            node[contexts[order]] = first[order] + np.arange(len(contexts[order]))
        self.node = node.astype(np.int32)  # at most 257**3

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language, whole texts."""
        out = np.zeros((len(texts), len(self.languages)))
        parts, owners, held = [], [], 0
        for k, data in enumerate(texts):
            for low in range(0, len(data), _SLAB):  # a slab begins with the letters before it
                x = self.letters[np.frombuffer(data, np.uint8, min(len(data), low + _SLAB) - max(0, low - ORDER), max(0, low - ORDER))]
                parts.append(x if low else np.concatenate([np.zeros(ORDER, np.int64), x]))
                owners.append(k)
                held += len(parts[-1])
                if held >= _SLAB:
                    self._add(out, parts, owners)
                    parts, owners, held = [], [], 0
        if parts:
            self._add(out, parts, owners)
        return out

    def _add(self, out: np.ndarray, parts: list[np.ndarray], owners: list[int]) -> None:
        x = np.concatenate(parts)
        code = np.zeros(len(x) - ORDER, np.int64)
        for k in range(ORDER):
            code = code * self.size + x[k : len(x) - ORDER + k]
        at, pairs = pd.factorize(self.node[code] * np.int64(self.size) + x[ORDER:])
        cost = self.cost.of(pairs // self.size, pairs % self.size)[at]
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(sizes) - ORDER  # in cost; the ORDER entries from there on would mix two texts
        starts = np.concatenate([[0], ends[:-1] + ORDER])
        edges = np.column_stack([starts, ends]).ravel()
        sums = np.add.reduceat(np.concatenate([cost, np.zeros((1, cost.shape[1]))]), edges, axis=0)[::2]
        np.add.at(out, owners, sums)


def learn(docs: DataFrame, text: str, label: str, key: Column, most_rows: int = 2_000) -> Model:
    """Fit on at most about most_rows labelled rows of each label (the documented bound of the sample), whole texts.

    Labels with more rows are sampled by a hash of the key and the text at the rate most_rows / rows, so that rows
    with a null or repeated key are drawn apart.  Rows with a null label are left
    out; null and empty texts add nothing.  The driver gets a count for each label and each label's distinct runs of bytes, which
    the sample bounds.
    """
    rows = docs.where(F.col(label).isNotNull())
    rate = {r[0]: min(1.0, most_rows / r[1]) for r in rows.groupBy(F.col(label)).count().collect()}
    if not rate:
        return Model([], [])
    place = F.pmod(F.xxhash64(key, F.col(text)), F.lit(1 << 20)) / (1 << 20)
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in rate.items() for x in pair]), F.col(label))
    counts = gram_counts(rows.where(place < limit), label, text).orderBy("label", "gram").toPandas()
    languages = sorted(rate)
    each = {name: (g["gram"].to_numpy(np.int64), g["n"].to_numpy(np.int64)) for name, g in counts.groupby("label")}
    none = np.array([], np.int64)
    return Model(languages, [each.get(name, (none, none)) for name in languages])


_MODELS: dict = {}
UNKNOWN = "und"


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[Column] | None = None, whole: str | None = None) -> DataFrame:
    """The kept columns (if None all but those named like the new ones) and lang_pred, score (posterior under an even prior), bits_per_byte of each row.

    A null text, or one without a letter, is `und` with score 0; so is every text if no language was learned.  Repeated rows
    stay; only the text is read for the prediction.  Where whole is given, a struct of all columns of that name is kept, and goes
    to Python alone: the text is read in it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample
    out = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])
    if whole is None:
        held = docs.select(*(keep if keep is not None else columns_of(docs, without=tuple(out.names))), F.col(text).cast("binary").alias("the text"))
        schema = held.schema.fields[:-1]
    else:
        held = docs.select(F.struct(*columns_of(docs)).alias(whole))
        schema, place = held.schema.fields, docs.columns.index(text)
    plain = [f"c{k}" for k in range(len(schema))]  # names that the way to Python and back can take
    kinds = T.StructType([T.StructField(name, f.dataType) for name, f in zip(plain, schema, strict=True)] + [T.StructField(name, kind) for name, kind in zip(out.names, (T.StringType(), T.DoubleType(), T.DoubleType()), strict=True)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in in_parts(batches):
            data = batch.column(batch.num_columns - 1) if whole is None else batch.column(0).field(place).cast(pa.binary())
            texts = [x if x is not None and m.languages and _lettered(x) else b"" for x in data.to_pylist()]
            bits = m.code_lengths(texts)
            rows = []
            for data, b in zip(texts, bits, strict=True):
                if not data:
                    rows.append((UNKNOWN, 0.0, None))
                    continue
                best = int(b.argmin())
                rows.append((m.languages[best], float(1 / np.exp2(np.maximum(b[best] - b, -1000)).sum()), float(b[best] / len(data))))
            extra = [pa.array([r[k] for r in rows], out.field(k).type) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(schema)], *extra], names=[f.name for f in kinds])

    return held.toDF(*plain, *(["text"] if whole is None else [])).mapInArrow(score, kinds).toDF(*(f.name for f in schema), *out.names)


def _lettered(data: bytes) -> bool:
    if data.translate(None, _NOT_ASCII_LETTERS):
        return True
    return not data.isascii() and any(c.isalpha() for c in data.decode("utf-8", "replace"))


_NOT_ASCII_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))
