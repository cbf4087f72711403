"""Benchmark decontamination: one Aho-Corasick automaton over normalised items, each text scanned once."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import columns_of, in_parts, kept_by_worker, utf8

#: A-Z become lower case; what is left of ASCII besides digits and letters separates words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


class Items:
    """The Aho-Corasick automaton of a block of items, as Latin-1 strings, a character for each byte.

    A window of n words holds a whole one of the item's blocks of (n + 1) // 2 words that begin at multiples of that, so
    those blocks are the automaton's words, about a state for each byte of text; what is met is extended in the item's own
    words.  An item of fewer than n words is a word of the automaton itself.  Places of a block with the same words around
    them, as far as a window reaches, are one place of all their items, so that repetitive items add little to a match.
    """

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.n = n
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        kept: dict[bytes, bytes] = {}
        self.words: list[list[bytes]] = []
        size = (n + 1) // 2
        places: dict[bytes, dict[tuple, tuple[int, int, set[int]]]] = {}
        sizes: dict[bytes, int] = {}
        for name, data in items:
            w = [kept.setdefault(x, x) for x in words(data)]
            step = size if len(w) >= n else len(w)
            for at in range(0, len(w) - step + 1, step) if w else ():
                key = b" " + b" ".join(w[at : at + step]) + b" "
                sizes[key] = step
                more = n - step if len(w) >= n else 0
                around = len(w) >= n, tuple(w[max(0, at - more) : at]), tuple(w[at + step : at + step + more])
                places.setdefault(key, {}).setdefault(around, (len(self.words), at, set()))[2].add(number[name])
            self.words.append(w)
        self.sets: list[tuple[int, ...]] = []
        known: dict[tuple[int, ...], int] = {}

        def set_number(own: set[int]) -> int:
            k = known.setdefault(tuple(sorted(own)), len(known))
            if k == len(self.sets):
                self.sets.append(tuple(sorted(own)))
            return k

        self.found = ahocorasick.Automaton()
        for key, of in places.items():
            self.found.add_word(key.decode("latin-1"), (sizes[key], tuple((k, at, set_number(own)) for k, at, own in of.values())))
        if places:
            self.found.make_automaton()
        self.empty = not places

    def scan(self, w: list[bytes], text: str, spaces: np.ndarray | None) -> tuple[set[tuple[int, int]], set[str]]:
        """Ranges of the document's words that windows cover, and the items of those windows."""
        ranges: set[tuple[int, int]] = set()
        sets: set[int] = set()
        if self.empty:
            return ranges, set()
        for end, (size, of) in self.found.iter(text):
            stop = int(np.searchsorted(spaces, end))  # the spaces before a match's last one are as many as the words up to it
            start = stop - size
            for k, at, of_items in of:
                own = self.words[k]
                left = right = 0
                if len(own) >= self.n:
                    more = self.n - size
                    while left < more and left < at and left < start and own[at - left - 1] == w[start - left - 1]:
                        left += 1
                    while right < more and at + size + right < len(own) and stop + right < len(w) and own[at + size + right] == w[stop + right]:
                        right += 1
                    if left + size + right < self.n:
                        continue
                ranges.add((start - left, stop + right))
                sets.add(of_items)
        return ranges, {self.names[k] for own in sets for k in self.sets[own]}


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = 4 << 20, whole: bool = False) -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, items array<string> (those with occurring windows), hits array<struct<start,end>>.

    hits are the merged ranges of hit words in the original text, as UTF-8 byte offsets with exclusive ends, n_hit their
    number of words.  All items are in one automaton that each Python worker builds once (about 60 bytes for each byte of
    item text), and a text is scanned once.  Items with more than block_bytes of text in all (a larger item apart) are several
    automata, which a task builds one after the other for every 64 MB of its texts, so that what it holds is bounded however large
    the benchmark is; the plan is the same one pass without a shuffle.  The items' own text is broadcast, in blocks.  Null
    and empty texts and items have no words; items with the same id count as one; items with a null id are ignored;
    repeated rows stay apart; other columns are left aside.  If whole, a struct of all
    columns takes the id's place, as kept, and goes to Python alone: the text is read in it.
    """
    sc = docs.sparkSession.sparkContext
    items = benchmark.where(F.col(f"`{item_col}`").isNotNull()).select(F.col(f"`{item_col}`").cast("string").alias("item"), utf8(F.col(f"`{item_text}`")).alias("data"))
    sent, block, held = [], [], 0
    for item in items.toLocalIterator():  # a block at a time on the driver
        if block and held + len(item.data) > block_bytes:
            sent.append(sc.broadcast(block))
            block, held = [], 0
        block.append((item.item, bytes(item.data)))
        held += len(item.data)
    sent.append(sc.broadcast(block))
    key = uuid.uuid4().hex

    def texts(batch: pa.RecordBatch) -> Iterator[bytes]:
        return (x.as_py() or b"" for x in (batch.column(0).field(place).cast(pa.binary()) if whole else batch.column(1)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = in_parts(batches, "automata")
        for some in _some(batches, 64 << 20) if len(sent) > 1 else ([batch] for batch in batches):
            found: list[list[tuple[set, set]]] = [[] for batch in some for _ in range(batch.num_rows)]
            for k in range(len(sent)):
                at = _automaton(key, k, sent[k], n)
                for own, data in zip(found, (x for batch in some for x in texts(batch)), strict=True):
                    w = words(data)
                    if w and not at.empty:
                        text = b" ".join([b"", *w, b""])
                        ranges, names = at.scan(w, text.decode("latin-1"), np.flatnonzero(np.frombuffer(text, np.uint8) == 32))
                        if ranges:
                            own.append((ranges, names))
            place = 0
            for batch in some:
                rows = [_told(data, own) for data, own in zip(texts(batch), found[place : place + batch.num_rows], strict=True)]
                place += batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], _OUT.field(k).type) for k in range(4))], names=["id", *_OUT.names])

    name = "kept" if whole else id_col
    if whole:
        ids, place = docs.select(F.struct(*columns_of(docs)).alias("id")), docs.columns.index(text_col)
    else:
        ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), utf8(F.col(f"`{text_col}`")).alias("data"))
    kinds = T.StructType([ids.schema["id"], *_KINDS])
    return ids.mapInArrow(scan, kinds).withColumnRenamed("id", name)


#: The last automaton that a Python worker built, by its key.
_BUILT = kept_by_worker("automata")
_OUT = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

_HIT = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_KINDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("hits", T.ArrayType(_HIT))]


def _automaton(key: str, k: int, block: Broadcast, n: int) -> Items:
    if (key, k) not in _BUILT:
        _BUILT.clear()
        _BUILT[key, k] = Items(block.value, n)
    return _BUILT[key, k]


def _some(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Lists of batches of about `most` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            yield held
            held = []
    if held:
        yield held


def _told(data: bytes, found: list[tuple[set, set]]) -> tuple[int, int, list[str], list[dict]]:
    """n_words, n_hit, items and hits of a text from what the automata found."""
    if not found:
        return len(words(data)), 0, [], []
    merged = _union(set().union(*(ranges for ranges, _ in found)))
    raw = np.frombuffer(data.translate(_FOLD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], raw, [False]]).astype(np.int8)))
    hits = [{"start": int(edges[2 * a]), "end": int(edges[2 * b - 1])} for a, b in merged]
    return len(edges) // 2, sum(b - a for a, b in merged), sorted(set().union(*(names for _, names in found))), hits


def _union(ranges: set[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
