"""Document likelihood under a subword lattice.

The pieces are those of an existing public vocabulary.  A word's probability is the sum over all its segmentations into
pieces (byte pieces cover what no other does), by forward recursion in log space; no piece reaches over a word's start, so
the marginal probability of a text is the product over its words and end mark.  The vocabulary's stored scores are merge
ranks, not probabilities, so the weights are fitted: they start from the vocabulary's own segmentation of the training
words and then follow the expected use of each piece over all segmentations (forward-backward), smoothed and normalised over
the pieces that may stand at a word's start or, with the word's stop, within it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import drop_written, utf8, written

_START = "▁"
_LOG10 = math.log(10)
_LONG = 1 << 14  # bytes from which on a word passes the recursion alone, a slab of letters at a time


def words(data: bytes) -> list[bytes]:
    return data.lower().split()


class Pieces:
    """Natural logarithms of the pieces' probabilities at a word's start and within it, from their counts by id."""

    def __init__(self, path: str, counts: dict[int, float], n_words: float, smoothing: float = 0.05):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = {k: model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k))}
        begin = [k for k, t in texts.items() if t[0] == _START and _START not in t[1:]]
        inner = [k for k, t in texts.items() if _START not in t]

        def weigh(ks: list[int], more: float) -> dict[int, float]:
            total = math.log(sum(counts.get(k, 0) + smoothing for k in ks) + more)
            return {k: math.log(counts.get(k, 0) + smoothing) - total for k in ks}

        first = weigh(begin, 0)
        self.begin = {texts[k]: p for k, p in first.items()}
        within = weigh(inner, n_words + smoothing)
        self.inner = {texts[k]: p for k, p in within.items() if not model.is_byte(k)}
        self.byte_ids = np.zeros(256, np.int64)
        for k in inner:
            if model.is_byte(k):
                self.byte_ids[int(texts[k][3:5], 16)] = k
        self.bytes = [within[int(k)] for k in self.byte_ids]
        self.stop = math.log(n_words + smoothing) - math.log(sum(counts.get(x, 0) + smoothing for x in inner) + n_words + smoothing)
        self.longest = max(map(len, texts.values()))
        self.size = model.get_piece_size()
        self._index([(0, texts[k], k, p) for k, p in first.items()] + [(1, texts[k], k, p) for k, p in within.items() if not model.is_byte(k)])

    def _index(self, pieces: list[tuple[int, str, int, float]]) -> None:
        """Two trees of letters, of what may begin a word (root 0) and go on with it (root 1), as sorted steps."""
        steps: dict[tuple[int, int], int] = {}
        ends: dict[int, tuple[int, float]] = {}
        for state, text, k, p in pieces:
            for c in text:
                state = steps.setdefault((state, ord(c)), len(steps) + 2)
            ends[state] = (k, p)
        keys = np.array([state << 21 | c for state, c in steps], np.int64)
        by = np.argsort(keys)
        self.keys, self.to = keys[by], np.array(list(steps.values()), np.int64)[by]
        self.piece, self.weight = np.full(len(steps) + 2, -1), np.full(len(steps) + 2, -np.inf)
        for state, (k, p) in ends.items():
            self.piece[state], self.weight[state] = k, p

    def word(self, data: bytes) -> float:
        """log P(word), summed over all segmentations."""
        return float(self.words([data])[0])

    def words(self, words: list[bytes]) -> np.ndarray:
        """log P of each word."""
        out = np.empty(len(words))
        short, long = self._by_length(words)
        for at, lattice in self._lattices([words[k] for k in short]):
            out[short[at]] = lattice.total + self.stop
        for k in long:
            out[k] = _LongWord(self, words[k]).total + self.stop
        return out

    def expected(self, words: list[bytes], times: np.ndarray) -> np.ndarray:
        """How often each piece is used in expectation over all segmentations of words that occur so many times."""
        out = np.zeros(self.size)
        short, long = self._by_length(words)
        for at, lattice in self._lattices([words[k] for k in short]):
            lattice.add_expected(out, times[short[at]])
        for k in long:
            _LongWord(self, words[k]).add_expected(out, times[k])
        return out

    @staticmethod
    def _by_length(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        long = np.array([len(w) > _LONG for w in words], bool)
        return np.flatnonzero(~long), np.flatnonzero(long)

    def _lattices(self, words: list[bytes], cells: int = 1 << 17) -> Iterator[tuple[np.ndarray, _Lattice]]:
        """Words of like lengths together, about `cells` places of arcs at a time (a word alone may be more)."""
        texts = [_START + w.decode("utf-8", "replace") for w in words]
        order = np.argsort([len(t) for t in texts], kind="stable")
        at: list[int] = []
        for k in order.tolist():
            if at and (len(at) + 1) * (len(texts[k]) + 1) * self.longest > cells:
                yield np.array(at), _Lattice(self, [texts[j] for j in at])
                at = []
            at.append(k)
        if at:
            yield np.array(at), _Lattice(self, [texts[j] for j in at])


class _Lattice:
    """The segmentations of some words, which all recursions pass together, place by place."""

    def __init__(self, pieces: Pieces, texts: list[str]):
        self.pieces = pieces
        sizes = np.array([len(t) for t in texts])
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
        first = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(chars)) - first[word]
        self.n, self.width, reach = len(texts), int(sizes.max(initial=0)), min(pieces.longest, int(sizes.max(initial=1)))
        # arcs[j, k, word]: the weight of the piece of k + 1 letters that ends before letter j
        arcs = np.full((self.width + 1, reach, self.n), -np.inf)
        state, at = np.minimum(place, 1), np.arange(len(chars))
        used = []
        for k in range(reach):
            on = place[at] + k < sizes[word[at]]
            at, state = at[on], state[on]
            key = state << 21 | chars[at + k]
            step = np.minimum(np.searchsorted(pieces.keys, key), len(pieces.keys) - 1)
            on = pieces.keys[step] == key
            at, state = at[on], pieces.to[step[on]]
            if not len(at):
                break
            done = pieces.piece[state] >= 0
            begin, end = at[done], place[at[done]] + k + 1
            arcs[end, k, word[begin]] = pieces.weight[state[done]]
            used.append((word[begin], place[begin], end, pieces.piece[state[done]], pieces.weight[state[done]]))
        self.used = [np.concatenate(x) for x in zip(*used, strict=True)] if used else [np.array([], np.int64)] * 4 + [np.array([])]
        # letters within a word by their bytes
        inside = np.flatnonzero(place > 0)
        self.letters, which = np.unique(chars[inside], return_inverse=True)
        self.raw = [chr(c).encode() for c in self.letters]
        weight = np.array([sum(pieces.bytes[b] for b in raw) for raw in self.raw])[which]
        self.by_bytes = word[inside], place[inside], place[inside] + 1, which, weight
        end = place[inside] + 1
        arcs[end, 0, word[inside]] = np.logaddexp(arcs[end, 0, word[inside]], weight)
        self.arcs, self.sizes, self.reach = arcs, sizes, reach
        self.alpha = np.full((self.width + 1 + reach, self.n), -np.inf)  # after `reach` places that no arc begins at
        self.alpha[reach] = 0.0
        for j in range(1, self.width + 1):
            self.alpha[reach + j] = _log_sum(self.alpha[j : reach + j][::-1] + arcs[j])
        self.total = self.alpha[reach + sizes, np.arange(self.n)]

    def add_expected(self, out: np.ndarray, times: np.ndarray) -> None:
        reach = self.reach
        beta = np.full((self.width + 1 + reach, self.n), -np.inf)
        beta[self.sizes, np.arange(self.n)] = 0.0
        steps = np.arange(reach)
        for i in range(self.width - 1, -1, -1):
            ends = np.minimum(i + 1 + steps, self.width)
            ahead = self.arcs[ends, steps] + beta[i + 1 : i + 1 + reach]
            beta[i] = np.logaddexp(beta[i], _log_sum(ahead))

        def shares(arcs: list) -> np.ndarray:
            word, begin, end, _, weight = arcs
            return times[word] * np.exp(self.alpha[reach + begin, word] + weight + beta[end, word] - self.total[word])

        out += np.bincount(self.used[3], weights=shares(self.used), minlength=len(out))
        for raw, n in zip(self.raw, np.bincount(self.by_bytes[3], weights=shares(self.by_bytes), minlength=len(self.raw)), strict=True):
            np.add.at(out, self.pieces.byte_ids[list(raw)], n)


class _LongWord:
    """The segmentations of one long word: 8 bytes a letter and the arcs of a slab of letters are all that is held."""

    def __init__(self, pieces: Pieces, word: bytes, slab: int = 1 << 13):
        self.pieces, self.slab = pieces, slab
        self.chars = np.frombuffer((_START + word.decode("utf-8", "replace")).encode("utf-32-le"), "<u4")
        n, reach = len(self.chars), pieces.longest
        self.alpha = np.full(n + 1 + reach, -np.inf)
        self.alpha[0] = 0.0
        for low in range(0, n, slab):
            arcs = self._arcs(low)[0]
            for i, own in enumerate(arcs, low):
                ahead = self.alpha[i + 1 : i + 1 + reach]
                np.logaddexp(ahead, own + self.alpha[i], out=ahead)
        self.total = float(self.alpha[n])

    def _arcs(self, low: int) -> tuple:
        """(weights by letter that they begin at and length less 1, pieces, letters by their bytes) of a slab."""
        pieces, n = self.pieces, len(self.chars)
        begin = np.arange(low, min(low + self.slab, n))
        weights = np.full((len(begin), pieces.longest), -np.inf)
        at, state, used = begin, np.minimum(begin, 1), []
        for k in range(pieces.longest):
            on = at + k < n
            at, state = at[on], state[on]
            key = state << 21 | self.chars[at + k].astype(np.int64)
            step = np.minimum(np.searchsorted(pieces.keys, key), len(pieces.keys) - 1)
            on = pieces.keys[step] == key
            at, state = at[on], pieces.to[step[on]]
            if not len(at):
                break
            done = pieces.piece[state] >= 0
            weights[at[done] - low, k] = pieces.weight[state[done]]
            used.append((at[done], at[done] + k + 1, pieces.piece[state[done]], pieces.weight[state[done]]))
        inside = begin[begin > 0]
        letters, which = np.unique(self.chars[inside], return_inverse=True)
        raw = [chr(c).encode() for c in letters]
        by_bytes = np.array([sum(pieces.bytes[b] for b in r) for r in raw])[which] if raw else np.array([])
        weights[inside - low, 0] = np.logaddexp(weights[inside - low, 0], by_bytes)
        return weights, used, (inside, which, raw, by_bytes)

    def add_expected(self, out: np.ndarray, times: float) -> None:
        n, reach = len(self.chars), self.pieces.longest
        beta = np.full(n + 1 + reach, -np.inf)
        beta[n] = 0.0
        for low in range((n - 1) // self.slab * self.slab, -1, -self.slab):
            weights, used, (inside, which, raw, by_bytes) = self._arcs(low)
            for i in range(low + len(weights) - 1, low - 1, -1):
                beta[i] = np.logaddexp.reduce(weights[i - low] + beta[i + 1 : i + 1 + reach])
            for begin, end, piece, weight in used:
                out += np.bincount(piece, weights=times * np.exp(self.alpha[begin] + weight + beta[end] - self.total), minlength=len(out))
            shares = times * np.exp(self.alpha[inside] + by_bytes + beta[inside + 1] - self.total)
            for r, x in zip(raw, np.bincount(which, weights=shares, minlength=len(raw)), strict=True):
                np.add.at(out, self.pieces.byte_ids[list(r)], x)


def _log_sum(x: np.ndarray) -> np.ndarray:
    """log of the sum of exponentials along the first axis, where all may be -inf."""
    most = x.max(axis=0)
    safe = np.where(np.isfinite(most), most, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - safe).sum(axis=0)) + safe


def _counted(docs: DataFrame, most_held: int = 300_000, most_bytes: int = 16 << 20) -> DataFrame:
    """(word binary, n, trained) of all words; each task sums what it holds before it sends it on."""
    out = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("trained", pa.int64())])

    def flushed(every: Counter, trained: Counter) -> Iterator[pa.RecordBatch]:
        keys = list(every)
        for k in range(0, len(keys), 50_000):
            part = keys[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([every[w] for w in part], pa.int64()), pa.array([trained[w] for w in part], pa.int64())], schema=out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, trained, held = Counter(), Counter(), 0
        for batch in batches:
            for data, held_out in zip(batch.column(2), batch.column(1).to_pylist(), strict=True):
                data = data.as_py()
                own = words(data)
                every.update(own)
                if not held_out:
                    trained.update(own)
                held += len(data)  # no less than the bytes of the words that are new
                if len(every) >= most_held or held >= most_bytes and sum(map(len, every)) >= most_bytes:
                    yield from flushed(every, trained)
                    every, trained, held = Counter(), Counter(), 0
                elif held >= most_bytes:
                    held = sum(map(len, every))
        yield from flushed(every, trained)

    return docs.mapInArrow(count, "word binary, n long, trained long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("trained").alias("trained"))


def _piece_counts(counts: DataFrame, path: str) -> dict[int, float]:
    """How often the vocabulary's own segmentation uses each piece; at most a row for each piece comes to the driver."""
    out = pa.schema([("piece", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        total = np.zeros(model.get_piece_size(), np.int64)
        for batch in batches:
            texts = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            n = batch.column(1).to_numpy()
            for low in range(0, len(texts), 2_000):
                ids = model.encode(texts[low : low + 2_000], num_threads=1)
                sizes = [len(x) for x in ids]
                if sum(sizes):
                    np.add.at(total, np.concatenate([np.array(x, np.int64) for x in ids]), np.repeat(n[low : low + len(ids)], sizes))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], schema=out)

    rows = counts.where("trained > 0").select("word", "trained").mapInArrow(count, "piece long, n long")
    return {r[0]: r[1] for r in rows.groupBy("piece").agg(F.sum("n").alias("n")).collect()}


def _expected(counts: DataFrame, weights: Pieces) -> dict[int, float]:
    """The expected use of each piece in all training words; a row for each piece comes to the driver."""
    out = pa.schema([("piece", pa.int64()), ("n", pa.float64())])
    sent = counts.sparkSession.sparkContext.broadcast(weights)  # bounded by the vocabulary

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sent.value.size)
        for batch in batches:
            total += sent.value.expected(batch.column(0).to_pylist(), batch.column(1).to_numpy())
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], schema=out)

    rows = counts.where("trained > 0").select("word", "trained").mapInArrow(expect, "piece long, n double")
    found = {r[0]: r[1] for r in rows.groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    sent.unpersist()
    return found


def _scored(rows: DataFrame, weights: Pieces) -> DataFrame:
    """rows with lp, the natural logarithm of the word's probability."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)  # bounded by the vocabulary

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.words(batch.column(0).to_pylist()), pa.float64())], names=["word", "n", "trained", "lp"])

    return rows.select("word", "n", "trained").mapInArrow(score, "word binary, n long, trained long, lp double")


def lattice_scores(docs: DataFrame, held_out: Column, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", hot_words: int = 1 << 16, hot_bytes: int = 64, discount: float = 0.75, rounds: int = 2) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, word_score) of each row; learns from rows not held out.

    base_score is the add-one unigram log10 probability of words and end mark; score is the marginal log10 probability under
    the lattice, its weights fitted by `rounds` passes of expectation over all training words.  word_score is that of the
    lattice with each training word as one more arc of its own: the word's count, discounted by `discount` (at most 1),
    stands beside the lattice, which takes what the discounts leave.  The word table is
    summed and scored once, in the shared folder.  The hot_words most frequent words (of at most hot_bytes bytes each, which bounds
    what is broadcast) are looked up where the text is read; only the others, once for each text, move to the word table
    and back, so no word's rows gather in one task.  A null held_out counts as not held out; null and empty
    texts are the end mark alone; repeated rows and null ids keep rows of their own; without any training text the word
    counts are all 0.  Other columns are left aside.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), utf8(F.col(f"`{text_col}`")).alias("data"))
    counts = written(_counted(docs), "words")
    ends = docs.where(~F.col("held_out")).count()
    row = counts.agg(F.coalesce(F.sum("trained"), F.lit(0)), F.count(F.when(F.col("trained") > 0, 1))).first()
    total, distinct = row[0] + ends, row[1] + (ends > 0)
    weights = Pieces(vocabulary, _piece_counts(counts, vocabulary), row[0])
    for _ in range(rounds):
        weights = Pieces(vocabulary, _expected(counts, weights), row[0])
    # what the discounts leave, and one more, goes to the end mark and the lattice
    rest, end_share = math.log((discount * distinct + 1) / (total + 1)), (ends + 0.5) / (total + 1)
    word_share = math.log1p(-end_share)
    floor = math.log10(total + distinct + 1)
    trained, lattice = F.col("trained"), F.col("lp") + word_share
    arcs = F.when(trained > 0, F.log((trained - discount) / (total + 1.0) + F.exp(lattice + rest))).otherwise(lattice + rest)
    table = written(_scored(counts, weights).select("word", "n", (trained > 0).alias("known"), (F.log10(trained + 1.0) - floor).alias("base1"), lattice.alias("lattice1"), arcs.alias("arcs1")), "scored")
    drop_written(counts)
    top = table.where(F.octet_length("word") <= hot_bytes).orderBy(F.desc("n"), "word").limit(hot_words).select("word", "base1", "lattice1", "arcs1", "known")
    hot = {bytes(r[0]): (r[1], r[2], r[3], r[4]) for r in top.toLocalIterator()}
    end_lattice = math.log(end_share)
    end = (math.log10(ends + 1) - floor, end_lattice, math.log(max(0.0, ends - discount) / (total + 1) + math.exp(rest + end_lattice)) if ends else rest + end_lattice, ends > 0)
    sent = docs.sparkSession.sparkContext.broadcast(hot)
    kinds = "row long, id long, held_out boolean, word binary, n long, n_tokens long, n_known long, base double, lattice double, arcs double"
    out = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("held_out", pa.bool_()), ("word", pa.binary()), ("n", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("lattice", pa.float64()), ("arcs", pa.float64())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, under a word that no text has, and one for each of its words that are not hot."""
        table = sent.value
        for batch in batches:
            rows: list[tuple] = []
            for number, doc, held, data in zip(*(batch.column(k) for k in range(4)), strict=True):
                number, doc, held = number.as_py(), doc.as_py(), held.as_py()
                own = words(data.as_py())
                base, lattice, arcs, known = end
                known = int(known)
                for word, n in Counter(own).items():
                    found = table.get(word)
                    if found is None:
                        rows.append((number, None, None, word, n, 0, 0, 0.0, 0.0, 0.0))
                    else:
                        base += n * found[0]
                        lattice += n * found[1]
                        arcs += n * found[2]
                        known += n * found[3]
                rows.append((number, doc, held, b" %d" % number, 0, len(own) + 1, known, base, lattice, arcs))
                if len(rows) >= 50_000:
                    yield _batch(rows, out)
                    rows = []
            if rows:
                yield _batch(rows, out)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "data")
    each = numbered.mapInArrow(split, kinds).join(table.drop("n"), "word", "left")
    n = F.col("n").cast("double")

    def summed(own: str, of_word: str) -> Column:
        return F.sum(F.col(own) + F.when(F.col("n") > 0, n * F.col(of_word)).otherwise(0.0))

    sums = each.groupBy("row").agg(
        F.max("id").alias("id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when((F.col("n") > 0) & F.col("known"), F.col("n")).otherwise(0)).alias("n_known"),
        summed("base", "base1").alias("base_score"), (summed("lattice", "lattice1") / _LOG10).alias("score"), (summed("arcs", "arcs1") / _LOG10).alias("word_score"),
    )
    return sums.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "word_score")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
