"""A convolutional text classifier over hashed words, trained in numpy on shards whose steps Spark averages, with a threshold for each language.

A word's vector is the sum of the vectors of its hashes: of the whole word, its beginnings and its end.  Filters of several widths slide over a
text's word vectors; the greatest answer of each filter over the whole text, cut at zero, feeds one logistic unit.  Filters are linear, so a word's
share in each place of each filter is computed once for a distinct word and looked up for its occurrences.
"""

from __future__ import annotations

import collections
import copy
import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import columns_of, dealt_anew, drop_written, utf8, written
from fieldloom.llm.language import UNKNOWN

WIDTHS = (1, 2, 3)
STARTS, END = (3, 4, 5, 6, 7), 4  # bytes of a word's beginnings and of its end that are hashed
_PAD = max(WIDTHS) - 1
_SLAB = 1 << 20  # bytes of a text that are cut into words at a time
_HELD = 1 << 18  # word places that are looked up at a time, and distinct words that a task remembers
#: Rounds of averaging and passes in each where there are several shards; passes where there is one.
ROUNDS, PASSES, EPOCHS = 2, 2, 8
_SCALE = 1 << 24  # a step's whole numbers
#: ASCII letters, digits and all other bytes stay; the rest separates words.
_TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def hashes(word: bytes) -> list[int]:
    out = [zlib.crc32(b"w" + word)]
    out += [zlib.crc32(b"%d" % n + word[:n]) for n in STARTS if n < len(word)]
    if len(word) > END:
        out.append(zlib.crc32(b"e" + word[-END:]))
    return out


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()
#: zlib's state after the letter that stands before a whole word or an end, and by n the difference that such a start makes to n bytes.
_WHOLE, _ENDING = zlib.crc32(b"w"), zlib.crc32(b"e")
_BEGUN = {n: zlib.crc32(bytes(n), zlib.crc32(b"%d" % n)) ^ zlib.crc32(bytes(n)) for n in STARTS}


def hashes_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes() of each word, one after the other, how many each has); words have no zero byte."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    most = max(STARTS)
    columns = np.zeros((len(words), 2 + len(STARTS)), np.int64)
    columns[:, 0] = np.fromiter(map(zlib.crc32, words, itertools.repeat(_WHOLE)), np.int64, len(words))
    letters = np.array(words, f"S{most}").view(np.uint8).reshape(len(words), most)
    state = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for n in range(1, most + 1):  # all words at once, a letter at a time; one state serves all lengths, as the hash is linear
        state = _CRC[(state ^ letters[:, n - 1]) & 255] ^ state >> 8
        if n in _BEGUN:
            columns[:, 1 + STARTS.index(n)] = ~state ^ np.uint32(_BEGUN[n])
    columns[:, -1] = np.fromiter(map(zlib.crc32, [w[-END:] for w in words], itertools.repeat(_ENDING)), np.int64, len(words))
    has = np.column_stack([np.ones(len(words), bool), *(sizes > n for n in STARTS), sizes > END])
    return columns[has], has.sum(1)


def slabs(data: bytes) -> Iterator[list[bytes]]:
    """A lower-case text's words, about _SLAB bytes of it at a time; words are never cut."""
    low = 0
    while low < len(data):
        high = low + _SLAB
        if high < len(data):
            part = data[low:high].translate(_TABLE)
            cut = part.rfind(b" ")
            while cut <= 0 and high < len(data):  # one word that long
                high = min(high * 2 - low, len(data))
                part = data[low:high].translate(_TABLE)
                cut = part.rfind(b" ") if high < len(data) else len(part)
            part = part[:cut] if high < len(data) else part
            high = low + len(part)
        else:
            part = data[low:].translate(_TABLE)
        yield part.split()
        low = high


def _with_last(parts: Iterator[list[bytes]]) -> Iterator[tuple[list[bytes], bool]]:
    """Each part and whether it is the last; without any, an empty one."""
    before = next(parts, [])
    for part in parts:
        yield before, False
        before = part
    yield before, True


@dataclass
class Network:
    """known: sorted hashes that have a vector; vectors: a row for each; filters[n]: (width * size of a vector, number) of WIDTHS[n]."""

    known: np.ndarray
    vectors: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    offset: float
    thresholds: dict[str, float] = field(default_factory=dict)
    usual: float = 0.0
    languages: list[str] = field(default_factory=list)
    odds: np.ndarray | None = None  # of each hash by language, logarithms less their mean

    def tell_nothing(self, toxic: int, others: int) -> None:
        """Every text scores the base rate."""
        self.out[:] = 0
        self.offset = float(np.log((toxic + 0.5) / (others + 0.5))) if toxic + others else -1.0

    def dense(self) -> np.ndarray:
        """All but the vectors, in rows as long as those."""
        flat = np.concatenate([*(f.ravel() for f in self.filters), *self.bias, self.out, [self.offset]]).astype(np.float64)
        return np.append(flat, np.zeros(-len(flat) % self.vectors.shape[1])).reshape(-1, self.vectors.shape[1])

    def set_dense(self, rows: np.ndarray) -> None:
        flat, low = rows.ravel(), 0
        for value in (*self.filters, *self.bias, self.out):
            value[...] = flat[low : low + value.size].reshape(value.shape)
            low += value.size
        self.offset = float(flat[low])

    def features(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(owners, rows of vectors) of the words' known hashes."""
        if not len(self.known) or not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code, n = hashes_of(words)
        owner = np.repeat(np.arange(len(words)), n)
        at = np.minimum(np.searchsorted(self.known, code), len(self.known) - 1)
        hit = self.known[at] == code
        return owner[hit], at[hit]

    def shares(self, words: list[bytes]) -> list[np.ndarray]:
        """What each word adds to the filters of each width in each of their places, an array for each place, and last to each language's odds."""
        owner, row = self.features(words)
        x = np.zeros((len(words), self.vectors.shape[1]), np.float32)
        spoken = np.zeros((len(words), len(self.languages)), np.float32)
        if len(owner):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            x[owner[first]] = np.add.reduceat(self.vectors[row], first)
            if self.languages:
                spoken[owner[first]] = np.add.reduceat(self.odds[row], first)
        return [*self.placed(x), spoken]

    def placed(self, x: np.ndarray) -> list[np.ndarray]:
        return [x @ part for f, w in zip(self.filters, WIDTHS, strict=True) for part in np.split(f, w)]

    def greatest(self, shares: list[np.ndarray], words: np.ndarray, starts: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each filter's greatest answer in each run of words (from starts on; each ends in _PAD empty words), and its place if asked for."""
        out, places, first = [], [], 0
        ends = np.append(starts[1:], len(words)) - _PAD
        for f, w in zip(self.filters, WIDTHS, strict=True):
            answers = np.full((len(words) - _PAD + 1, f.shape[1]), -np.inf, np.float32)  # the last row is no window's
            np.take(shares[first], words[: len(words) - _PAD], axis=0, out=answers[:-1], mode="clip")
            for j in range(1, w):
                answers[:-1] += shares[first + j].take(words[j : len(words) - _PAD + j], axis=0)
            first += w
            bounds = np.column_stack([starts, ends]).ravel()
            out.append(np.maximum.reduceat(answers, bounds, axis=0)[::2])
            if where:
                places.append(np.array([a + answers[a:b].argmax(0) for a, b in zip(starts, ends, strict=True)]))
        return np.concatenate(out, axis=1), np.concatenate(places, axis=1) if where else None

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + np.concatenate(self.bias), 0) @ self.out + self.offset

    def scores(self, logits: np.ndarray, languages: list[str]) -> np.ndarray:
        """0 to 1, and 0.5 at the language's threshold."""
        over = logits - np.array([self.thresholds.get(name, self.usual) for name in languages])
        return 1 / (1 + np.exp(-np.clip(over, -30, 30)))


class Reader:
    """Texts to the network's pooled answers; remembers the shares of words that it met."""

    def __init__(self, network: Network):
        self.network = network
        self.empty = [x * 0 for x in network.shares([b""])]
        self._forget()

    def _forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.rows = self.empty
        self.fresh: list[list[np.ndarray]] = []  # of words met since the rows were joined

    def places(self, words: list[bytes]) -> np.ndarray | None:
        """Rows of the words' shares; None if there is no room to remember them beside the others."""
        ids = np.fromiter(map(self.at.get, words, itertools.repeat(-1)), np.int64, len(words))
        unmet = np.flatnonzero(ids < 0).tolist()
        if unmet:
            fresh = list({words[k] for k in unmet})
            if len(self.at) + len(fresh) > _HELD and self.at:
                return None
            self.at.update(zip(fresh, range(len(self.at) + 1, len(self.at) + 1 + len(fresh)), strict=True))
            self.fresh.append(self.network.shares(fresh))
            ids[unmet] = [self.at[words[k]] for k in unmet]
        return ids

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """A row for each lower-case text, of each filter's greatest answer over all of it; windows at its end go on in empty words."""
        return self._read(texts)[0]

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, list[str]]:
        """pooled() and each text's language, `und` where it has no known hash or no language was learned."""
        out, odds = self._read(texts)
        names = self.network.languages
        return out, [names[b] if some else UNKNOWN for b, some in zip(odds.argmax(1), odds.any(1), strict=True)] if names else [UNKNOWN] * len(texts)

    def _read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        total = sum(f.shape[1] for f in self.network.filters)
        out = np.full((len(texts), total), -np.inf, np.float32)
        odds = np.zeros((len(texts), len(self.network.languages)))
        runs: list[np.ndarray] = []
        fresh: list[int] = []  # where each run's words begin that the one before it does not hold
        owners: list[int] = []
        held, pad, empty = 0, np.zeros(_PAD, np.int64), np.zeros(1 + _PAD, np.int64)

        def flush() -> None:
            nonlocal held
            if runs:
                lengths = np.array([len(r) for r in runs])
                if self.fresh:
                    self.rows, self.fresh = [np.concatenate(x) for x in zip(self.rows, *self.fresh, strict=True)], []
                words = np.concatenate(runs)
                got, _ = self.network.greatest(self.rows[:-1], words, np.cumsum(lengths) - lengths)
                np.maximum.at(out, owners, got)
                if odds.shape[1]:
                    ends = np.cumsum(lengths)
                    bounds = np.column_stack([ends - lengths + fresh, ends]).ravel()
                    spoken = np.concatenate([self.rows[-1].take(words, axis=0), np.zeros((1, odds.shape[1]), np.float32)])
                    np.add.at(odds, owners, np.add.reduceat(spoken, bounds, axis=0)[::2])
            runs.clear()
            fresh.clear()
            owners.clear()
            held = 0

        waiting: list[tuple[int, list[bytes], bool, int]] = []  # owner, words, whether the text ends, how many of them were told
        words_waiting = 0

        def place() -> None:
            nonlocal held, words_waiting
            joined = list(itertools.chain.from_iterable(words for _, words, _, _ in waiting))
            ids = self.places(joined)
            if ids is None:
                flush()
                self._forget()
                ids = self.places(joined)
            low = 0
            for k, words, last, told in waiting:
                own = ids[low : low + len(words)]
                low += len(words)
                runs.append((np.concatenate([own, pad]) if len(own) else empty) if last else own)
                fresh.append(told)
                owners.append(k)
                held += len(runs[-1])
                if held >= _HELD:
                    flush()
            waiting.clear()
            words_waiting = 0

        for k, data in enumerate(texts):
            before: list[bytes] = []
            told = 0
            for words, last in _with_last(slabs(data)):
                words = before + words  # a slab's last words begin windows together with the next one's
                before = words[-_PAD:]
                if not last and len(words) <= _PAD:
                    continue
                waiting.append((k, words, last, told))
                words_waiting += len(words)
                told = len(before)
                if words_waiting >= _HELD >> 4:
                    place()
        place()
        flush()
        return out, odds


def started(known: np.ndarray, size: int, number: int, rng: np.random.Generator) -> Network:
    """A network before it has learned, with a vector for each of the sorted hashes."""
    return Network(
        known, rng.normal(0, 0.1, (len(known), size)).astype(np.float32), [rng.normal(0, 1 / np.sqrt(w * size), (w * size, number)).astype(np.float32) for w in WIDTHS],
        [np.zeros(number, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, len(WIDTHS) * number).astype(np.float32), 0.0,
    )


def train(texts: list[bytes], toxic: np.ndarray, size: int = 16, number: int = 8, least: int = 3, most_hashes: int = 1 << 17, epochs: int = 8, batch: int = 32, rate: float = 0.1, seed: int = 7) -> Network:
    """Fit a network to whole lower-case texts and their labels in one place (see fit).

    least: texts that must hold a hash for it to have a vector; most_hashes: how many have one, the commonest first.
    """
    rng = np.random.default_rng(seed)
    codes, held = _hash_texts(texts)
    kept = np.flatnonzero(held >= least)
    if len(kept) > most_hashes:
        kept = np.sort(kept[np.argsort(-held[kept], kind="stable")[:most_hashes]])
    net = started(codes[kept], size, number, rng)
    counts = int(toxic.sum()), len(texts) - int(toxic.sum())
    if not all(counts):
        net.tell_nothing(*counts)
    else:
        fit(net, *encoded(net, texts), toxic, counts, rng, epochs, batch, rate)
    return net


def _numbered_words(texts: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """The texts' distinct words, the empty one first, and of each text their numbers with _PAD empty words at the end."""
    number_of: dict[bytes, int] = {b"": 0}
    runs = []
    for t in texts:
        parts = [np.array([number_of.setdefault(w, len(number_of)) for w in part], np.int32) for part in slabs(t)]
        parts = [x for x in parts if len(x)] or [np.zeros(1, np.int32)]
        runs.append(np.concatenate([*parts, np.zeros(_PAD, np.int32)]))
    return list(number_of), runs


def _hash_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, how many of the texts hold each)."""
    words, runs = _numbered_words(texts)
    each, sizes = hashes_of(words[1:])
    codes, feature = np.unique(each, return_inverse=True)
    bounds = np.concatenate([[0, 0], np.cumsum(sizes)])  # the empty word has none
    held, seen = np.zeros(len(codes), np.int64), np.zeros(len(words), bool)
    for r in runs:
        seen[r] = True
        ws = np.flatnonzero(seen)
        seen[ws] = False
        held[feature[_ranges(bounds[ws], bounds[ws + 1])[1]]] += 1  # a hash that several of the text's words have counts once
    return codes, held


def _best(net: Network, shares: list[np.ndarray], runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's greatest answer in each text and the words of that window, a long text a piece at a time."""
    total = len(net.out)
    pooled, words = np.full((len(runs), total), -np.inf, np.float32), np.zeros((len(runs), total, _PAD + 1), np.int64)
    pieces = [(k, r[a : a + _HELD + _PAD]) for k, r in enumerate(runs) for a in range(0, len(r) - _PAD, _HELD)]
    while pieces:
        n = max(1, int(np.searchsorted(np.cumsum([len(r) for _, r in pieces]), 2 * _HELD)))
        some, pieces = pieces[:n], pieces[n:]
        joined = np.concatenate([r for _, r in some])
        lengths = np.array([len(r) for _, r in some])
        got, places = net.greatest(shares, joined, np.cumsum(lengths) - lengths, where=True)
        for (k, _), g, p in zip(some, got, places, strict=True):
            over = g > pooled[k]
            pooled[k, over] = g[over]
            words[k, over] = joined[p[over, None] + np.arange(_PAD + 1)]
    return pooled, words


def encoded(net: Network, texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of each text its words' numbers, and the rows of vectors of each word, from one bound to the next."""
    words, runs = _numbered_words(texts)
    owner, feature = net.features(words[1:])
    return runs, np.searchsorted(owner, np.arange(-1, len(words))), feature  # the empty word has no hash


def fit(net: Network, runs: list[np.ndarray], bounds: np.ndarray, feature: np.ndarray, toxic: np.ndarray, counts: tuple[int, int], rng: np.random.Generator, epochs: int = 8, batch: int = 32, rate: float = 0.1) -> None:
    """Fit the network further to encoded texts and their labels by Adagrad on the logistic loss; counts: toxic texts and others of the whole task, which weigh alike."""
    weight = np.where(toxic, sum(counts) / 2 / counts[0], sum(counts) / 2 / counts[1])
    size, number = net.vectors.shape[1], len(net.bias[0])
    past = {"v": np.full(net.vectors.shape, 1e-2, np.float32), "f": [np.full(f.shape, 1e-2, np.float32) for f in net.filters], "b": [np.full(b.shape, 1e-2, np.float32) for b in net.bias], "o": np.full(net.out.shape, 1e-2, np.float32), "c": 1e-2}

    def step(value: np.ndarray, seen: np.ndarray, grad: np.ndarray, rows=slice(None)) -> None:
        seen[rows] += grad * grad
        value[rows] -= rate * grad / np.sqrt(seen[rows])

    met, place = np.zeros(len(bounds) - 1, bool), np.zeros(len(bounds) - 1, np.int64)
    for _ in range(epochs):
        deal = rng.permutation(len(runs))
        for low in range(0, len(deal), batch):
            own = deal[low : low + batch]
            for k in own:
                met[runs[k]] = True
            ws = np.flatnonzero(met)
            met[ws], place[ws] = False, np.arange(len(ws))
            owners, at = _ranges(bounds[ws], bounds[ws + 1])
            rows = feature[at]
            x = np.zeros((len(ws), size), np.float32)
            if len(owners):
                first = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
                x[owners[first]] = np.add.reduceat(net.vectors[rows], first)
            pooled, windows = _best(net, net.placed(x), [place[runs[k]] for k in own])
            active = pooled + np.concatenate(net.bias)
            hidden = np.maximum(active, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.offset, -30, 30)))
            gap = ((p - toxic[own]) * weight[own] / len(own)).astype(np.float32)
            back = gap[:, None] * net.out[None, :] * (active > 0)
            gx = np.zeros_like(x)
            for n, (f, w) in enumerate(zip(net.filters, WIDTHS, strict=True)):
                own_back, own_windows = back[:, n * number : (n + 1) * number], windows[:, n * number : (n + 1) * number]
                gf = np.zeros_like(f)
                for j in range(w):
                    word = own_windows[:, :, j]  # (texts, filters)
                    gf[j * size : (j + 1) * size] = np.einsum("tfs,tf->sf", x[word], own_back)
                    np.add.at(gx, word.ravel(), (own_back[:, :, None] * f[j * size : (j + 1) * size].T[None]).reshape(-1, size))
                step(f, past["f"][n], gf + 1e-4 * f)
                step(net.bias[n], past["b"][n], own_back.sum(0))
            touched = np.flatnonzero(np.abs(gx).sum(1)[owners])
            used, back_at = np.unique(rows[touched], return_inverse=True)
            gv = np.zeros((len(used), size), np.float32)
            np.add.at(gv, back_at, gx[owners[touched]])
            step(net.vectors, past["v"], gv, used)
            step(net.out, past["o"], hidden.T @ gap + 1e-4 * net.out)
            past["c"] += float(gap.sum()) ** 2
            net.offset -= rate * float(gap.sum()) / np.sqrt(past["c"])


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place) of all places in ranges."""
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def threshold(logits: np.ndarray, toxic: np.ndarray, n: np.ndarray | int = 1) -> float:
    """The middle of the cuts that put the fewest rows on the wrong side; n: rows that each entry stands for."""
    by = np.argsort(logits, kind="stable")
    x, t = logits[by], toxic[by]
    n = np.broadcast_to(n, len(logits))[by]
    missed = np.concatenate([[0], np.cumsum(t * n)]) + (~t * n).sum() - np.concatenate([[0], np.cumsum(~t * n)])
    usable = np.concatenate([[True], x[1:] > x[:-1], [True]])
    best = np.flatnonzero(usable & (missed == missed[usable].min()))
    cut = best[len(best) // 2]
    return float(x[0] - 1 if cut == 0 else x[-1] + 1 if cut == len(x) else (x[cut - 1] + x[cut]) / 2)


def learn_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", mark: str = "toxic", least_rows: int = 10, shard_rows: int = 4096, rounds: int = ROUNDS, size: int = 16, number: int = 8, least: int = 3, most_hashes: int = 1 << 17, seed: int = 7) -> Network:
    """Fit on every labelled row, whole texts of any length.

    A key's label is the greatest of its rows in labels, a text's that of its keys; null ones and null keys are left out.  Repeated texts count once, so the model is
    the same whatever the order and partitions, and however often a text is repeated.  By the texts' hash, three quarters of them fit the network and all others set the
    thresholds: a language with fewer than least_rows of either label takes that of all, and where all have fewer every text fits, and the threshold is where both labels, weighed
    alike, are as likely.  Where no label is given at all, every score is the same.

    The texts lie in shards of about shard_rows by their hash.  In each round a task fits its shards from the common network, and their steps are averaged
    over the shards that made them, by an aggregate of whole numbers.  The network's size is fixed: least texts must hold a hash for it to have a vector, and the most_hashes commonest of all texts have one.
    Languages are told by the odds of the hashes, counted over all rows that have a lang.
    """
    rng = np.random.default_rng(seed)
    known = labels.where(F.col(key).isNotNull() & F.col(mark).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max(F.col(mark)).alias("mark"))
    whole = docs.select(F.col(key).alias("__key"), F.col(lang).alias("lang"), utf8(F.lower(F.col(text))).alias("data"))
    # numbers first: only labelled texts are shuffled, once for each copy's hash
    rows = whole.select("__key", F.xxhash64("data").alias("h")).join(dealt_anew(known, "__key"), "__key")
    marked = written(rows.groupBy("h").agg((F.max("mark") == 1).alias("mark")), "labelled")
    apart = F.pmod("h", F.lit(4)) == 0
    found = {(r["apart"], r["mark"]): r["n"] for r in marked.groupBy(apart.alias("apart"), "mark").agg(F.count("*").alias("n")).collect()}
    aside = min(found.get((True, True), 0), found.get((True, False), 0)) >= least_rows
    counts = tuple(found.get((False, m), 0) + (0 if aside else found.get((True, m), 0)) for m in (True, False))
    if not aside:
        apart = F.lit(False)
    if not all(counts):
        drop_written(marked)
        net = started(np.array([], np.int64), size, number, rng)
        net.tell_nothing(*counts)
        return net
    shards = max(1, -(-sum(counts) // shard_rows))
    shard = F.pmod(F.xxhash64("h", F.lit("shard")), F.lit(shards))
    texts = _maybe_in(whole.select("data", F.xxhash64("data").alias("h")), marked).groupBy("h").agg(F.first("data").alias("data")).join(marked, "h")
    texts = texts.withColumn("shard", F.when(apart, -1 - shard).otherwise(shard)).repartition(2 * shards, "shard").sortWithinPartitions("shard", "h")
    texts = written(texts.select("shard", "mark", "data"), "texts")
    drop_written(marked)
    ours = texts.where("shard >= 0")
    hashed = _hash_counts(ours.select("data")).where(F.col("n") >= least).orderBy(F.desc("n"), "code").limit(most_hashes).select("code").toPandas()
    net = started(np.sort(hashed["code"].to_numpy(np.int64)), size, number, rng)
    ready = written(_encoded_shards(ours, net), "encoded")
    for k in range(rounds if shards > 1 else 1):
        _fit_shards(ready, net, counts, seed + k, PASSES if shards > 1 else EPOCHS)
    drop_written(ready)
    _learn_languages(whole.where("lang is not null").select("lang", "data"), net)
    if aside:
        _set_thresholds(texts.where("shard < 0"), net, least_rows)
    drop_written(texts)
    return net


def _maybe_in(rows: DataFrame, wanted: DataFrame, bits: int = 24) -> DataFrame:
    """rows without most of those whose h is not in wanted's, so that hardly any other texts are shuffled for a join that tells exactly.

    Every row of wanted's stays.  The bits of all wanted hashes, 64 in a row, are broadcast: at most 2**(bits - 6) rows, however many hashes there are.
    """
    word, bit = F.col("h").bitwiseAND((1 << bits) - 64), F.col("h").bitwiseAND(63).cast("int")
    field = wanted.select(word.alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("field"))
    return rows.join(F.broadcast(field), (word == F.col("word")) & (F.bit_get("field", bit) == 1), "left_semi")


def _hash_counts(texts: DataFrame) -> DataFrame:
    """(code, n): how many texts hold each hash, counted in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bytes_held = [], 0
        for batch in batches:
            for data in batch.column(0):
                held.append(data.as_py())
                bytes_held += len(held[-1])
                if bytes_held > 1 << 24:
                    yield told(held)
                    held, bytes_held = [], 0
        if held:
            yield told(held)

    def told(held: list[bytes]) -> pa.RecordBatch:
        codes, n = _hash_texts(held)
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["code", "n"])

    return texts.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _encoded_shards(texts: DataFrame, net: Network) -> DataFrame:
    """(shard, mark, data), sorted by shard in each file, as a row of arrays for each shard."""
    sent = texts.sparkSession.sparkContext.broadcast(net)
    names = ["shard", "marks", "words", "lengths", "bounds", "feature"]

    def told(shard: int, data: list[bytes], marks: list[bool]) -> pa.RecordBatch:
        runs, bounds, feature = encoded(sent.value, data)
        parts = np.array(marks, bool), np.concatenate(runs), np.array([len(r) for r in runs], np.int64), bounds.astype(np.int64), feature.astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, data, marks = None, [], []
        for batch in batches:
            for s, m, d in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if s != now and data:
                    yield told(now, data, marks)
                    data, marks = [], []
                now = s
                data.append(d)
                marks.append(m)
        if data:
            yield told(now, data, marks)

    return texts.mapInArrow(work, "shard long, marks binary, words binary, lengths binary, bounds binary, feature binary")


def _fit_shards(shards: DataFrame, net: Network, counts: tuple[int, int], seed: int, epochs: int) -> None:
    """A round: every encoded shard fits a copy of the network; the steps, as whole numbers, are averaged over the shards that made them."""
    size = net.vectors.shape[1]
    sent = shards.sparkSession.sparkContext.broadcast(net)  # its size is bounded by most_hashes
    names = [f"v{k}" for k in range(size)]
    schema = pa.schema([("place", pa.int64()), *((name, pa.int64()) for name in names)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, marks, words, lengths, bounds, feature = (x[0].as_py() for x in batch.slice(row, 1).columns)
                runs = np.split(np.frombuffer(words, np.int32), np.cumsum(np.frombuffer(lengths, np.int64))[:-1])
                own = copy.deepcopy(sent.value)
                fit(own, runs, np.frombuffer(bounds, np.int64), np.frombuffer(feature, np.int32), np.frombuffer(marks, bool), counts, np.random.default_rng([seed, shard]), epochs)
                moved = np.flatnonzero((own.vectors != sent.value.vectors).any(1))
                dense = own.dense() - sent.value.dense()
                step = np.concatenate([own.vectors[moved].astype(np.float64) - sent.value.vectors[moved], dense])
                step = np.rint(step * _SCALE).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([moved, -1 - np.arange(len(dense))])), *(pa.array(np.ascontiguousarray(step[:, k])) for k in range(size))], schema=schema)

    made = shards.mapInArrow(work, ", ".join(f"{name} long" for name in schema.names)).groupBy("place").agg(F.count("*").alias("n"), *(F.sum(name).alias(name) for name in names)).toPandas()
    place = made["place"].to_numpy(np.int64)
    step = made[names].to_numpy(np.float64) / made["n"].to_numpy(np.float64)[:, None] / _SCALE
    own = place >= 0
    net.vectors[place[own]] += step[own].astype(np.float32)
    dense = net.dense()
    dense[-1 - place[~own]] += step[~own]
    net.set_dense(dense)
    sent.destroy()


def _learn_languages(docs: DataFrame, net: Network) -> None:
    """Count the network's hashes in all words of (lang, data), by language."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    out = pa.schema([("lang", pa.string()), ("place", pa.int64()), ("n", pa.int64())])

    def told(held: dict[str, collections.Counter]) -> Iterator[pa.RecordBatch]:
        for name, words in held.items():
            owner, row = sent.value.features(list(words))
            n = np.bincount(row, weights=np.fromiter(words.values(), np.int64, len(words))[owner]).astype(np.int64)
            on = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(on), pa.string()), pa.array(on), pa.array(n[on])], schema=out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, collections.Counter] = {}
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = held.setdefault(name, collections.Counter())
                for words in slabs(data.as_py()):
                    own.update(words)
            if sum(map(len, held.values())) > _HELD:
                yield from told(held)
                held = {}
        yield from told(held)

    found = docs.mapInArrow(count, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()
    net.languages = sorted(found["lang"].unique())
    n = np.full((len(net.known), len(net.languages)), 0.5)
    n[found["place"].to_numpy(np.int64), np.searchsorted(net.languages, found["lang"].to_numpy(str)) if len(found) else []] += found["n"].to_numpy(np.float64)
    odds = np.log(n / n.sum(0)) if len(n) else n
    net.odds = (odds - odds.mean(1, keepdims=True)).astype(np.float32) if len(net.languages) else odds.astype(np.float32)
    sent.destroy()


def _set_thresholds(texts: DataFrame, net: Network, least_rows: int) -> None:
    """Thresholds by all of (shard, mark, data), from the numbers of rows by language, label and logit, the last in steps of 1/1024."""
    sent = texts.sparkSession.sparkContext.broadcast(net)
    out = pa.schema([("lang", pa.string()), ("mark", pa.bool_()), ("step", pa.int64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value)
        for batch in batches:
            pooled, names = reader.read(batch.column(2).to_pylist())
            step = np.rint(np.clip(sent.value.logits(pooled).astype(np.float64), -500, 500) * 1024).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), batch.column(1), pa.array(step)], schema=out)

    found = texts.mapInArrow(score, "lang string, mark boolean, step long").groupBy("lang", "mark", "step").agg(F.count("*").alias("n")).toPandas()
    sent.destroy()
    names, marks, logits, n = found["lang"].to_numpy(), found["mark"].to_numpy(bool), found["step"].to_numpy(np.float64) / 1024, found["n"].to_numpy(np.int64)
    net.usual = threshold(logits, marks, n)
    for name in sorted(set(names) - {UNKNOWN}):
        own = names == name
        if n[own & marks].sum() >= least_rows and n[own & ~marks].sum() >= least_rows:
            net.thresholds[name] = threshold(logits[own], marks[own], n[own])


def score_toxicity(docs: DataFrame, model: Network, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """The kept columns (if None all but those named like the new ones) and score: 0 to 1, from 0.5 on toxic by the threshold of the text's language.

    Only the text is read, whole; null is as empty, and scores as a text without words.  Repeated rows stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by most_hashes
    held = docs.select(*(keep if keep is not None else columns_of(docs, without=("score",))), utf8(F.lower(F.col(text))).alias("the text"))
    schema = held.schema.fields[:-1]
    plain = [f"c{k}" for k in range(len(schema))]
    kinds = T.StructType([*(T.StructField(name, f.dataType) for name, f in zip(plain, schema, strict=True)), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        reader = Reader(m)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            pooled, names = reader.read(texts)
            found = m.scores(m.logits(pooled).astype(np.float64), names)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], names=[f.name for f in kinds])

    return held.toDF(*plain, "text").mapInArrow(score, kinds).toDF(*(f.name for f in schema), "score")
