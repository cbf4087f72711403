"""Order-preserving packing by dynamic programming with a monotone queue.

Documents of a partition, in their order, form one stream of tokens.  Windows of at most `size` tokens are cut at
document ends (free), at sentence ends (a small penalty) or, where neither comes soon, inside sentences (a larger one).
The cut list with the least sum of padding and penalties comes from one forward pass: the best predecessor of a cut is
the least of cost + position over the cuts at most `size` tokens before it, which a monotone queue keeps at its head.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import in_parts, kept_by_worker

#: A space between white space, or at the end after white space: only there may a token cross from one chunk to the next.
_JOINED = re.compile(r"\s (?:\s|\Z)")
#: The pieces in which a byte-level vocabulary of this pattern is applied, for chunks of the letters below only.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: \x1c to \x1f are white space to Python's pattern but not to the tokenizer's.
_PLAIN = re.compile("[\x00-\x1b\x20-\x7f\xc0-\xd6\xd8-\xf6\xf8-ɏ]*")
_MOST_CACHED = 32 << 20  # characters and id bytes that a cache holds, _EACH more for each entry
_EACH = 40


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes, the same as the tokenizer's own.

    A text is split before each space; chunks, and the pieces within new chunks, are encoded once and kept.  That is exact
    because the tokenizer's pattern never joins what stands before such a space to what follows; texts where it could
    (a space within a longer run of white space) are encoded in one go.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        self.first: dict[str, bytes] = {}
        self.later = _Later(self)
        self.pieces: dict[str, bytes] = {}
        self.held = 0
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
        vocabulary = self.whole.get_vocab()
        back = {ord(c): b for b, c in self.letters.items()}
        self.sentence_end = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        for token, k in vocabulary.items():
            raw = bytes(back.get(ord(c), 32) for c in token)
            self.sentence_end[k] = raw[-1:] in (b".", b"!", b"?") or b"\n" in raw

    def encode_whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def chunk(self, text: str) -> bytes:
        if not _PLAIN.fullmatch(text):
            return self.encode_whole(text)
        out = []
        for piece in _PIECES.findall(text):
            ids = self.pieces.get(piece)
            if ids is None:
                raw = piece.encode().decode("latin-1").translate(self.letters)
                ids = self.pieces[piece] = np.array([t.id for t in self.model.tokenize(raw)], dtype="<u4").tobytes()
                self.held += len(piece) + len(ids) + _EACH
                if self.held > _MOST_CACHED:
                    self.pieces, self.held = {}, 0
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if _JOINED.search(text):
            return self.encode_whole(text)
        first, *rest = text.split(" ")
        return b"".join([self.chunk(first), *map(self.later.__getitem__, rest)])


class _Later(dict):
    """Ids of chunks that follow a space, by the chunk without it."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.held = encoder, 0

    def __missing__(self, text: str) -> bytes:
        ids = self.encoder.chunk(" " + text)
        self.held += len(text) + len(ids) + _EACH
        if self.held > _MOST_CACHED:
            self.clear()
            self.held = 0
        self[text] = ids
        return ids


_ENCODERS: dict[str, Encoder] = kept_by_worker("encoders")


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def best_cuts(at: np.ndarray, penalty: np.ndarray, size: int, open_end: bool = False) -> list[int]:
    """Window ends: from the candidates at[1:] (at[0] is the start, at[-1] the end), neighbours at most `size` apart.

    Minimises the sum over windows of size - length and the penalty of its end.  open_end: what follows the last cut, less
    than size, is left and costs nothing.
    """
    pos, pen = at.tolist(), penalty.tolist()
    cost, before = [pos[0]], [0]  # cost of the best cuts up to here, plus the position
    queue = deque([0])
    for j in range(1, len(pos)):
        low = pos[j] - size
        while pos[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        c = cost[i] + size + pen[j]
        cost.append(c)
        before.append(i)
        while queue and cost[queue[-1]] > c:
            queue.pop()
        queue.append(j)
    out, j = [], len(pos) - 1
    if open_end:
        j = min(range(bisect_right(pos, pos[-1] - size), len(pos)), key=lambda i: cost[i] - pos[i])
    while j:
        out.append(pos[j])
        j = before[j]
    return out[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, penalties: tuple[int, int], step: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, and their penalties: documents' ends 0, sentences' penalties[0], others penalties[1]."""
    ends = np.union1d(doc_ends, np.flatnonzero(sentence_end[ids]) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    inner = np.maximum((ends - starts - 1) // step, 0)  # cuts within a sentence, step tokens apart
    if inner.any():
        nth = np.arange(inner.sum()) - np.repeat(np.cumsum(inner) - inner, inner) + 1
        at = np.union1d(ends, np.repeat(starts, inner) + nth * step)
    else:
        at = ends
    penalty = np.where(np.isin(at, doc_ends), 0, np.where(np.isin(at, ends), penalties[0], penalties[1]))
    return np.concatenate([[0], at]), np.concatenate([[0], penalty])


class _Packer:
    def __init__(self, first_sequence: int, size: int, end_id: int, penalties: tuple[int, int], step: int):
        self.sequence, self.size, self.end_id, self.penalties, self.step = first_sequence, size, np.array([end_id], "<u4").tobytes(), penalties, step
        self.docs: list[tuple[object, int, int, bytes]] = []  # id, tokens of it that are packed, all tokens, the rest of them
        self.held = 0

    def add(self, doc_id, ids: bytes) -> None:
        ids += self.end_id
        self.docs.append((doc_id, 0, len(ids) // 4, ids))
        self.held += len(ids) // 4

    def pack(self, sentence_end: np.ndarray, last: bool) -> Iterator[tuple]:
        """Pieces of what is held; unless it is the last time, less than a window stays."""
        if not self.docs:
            return
        raw = b"".join(d[3] for d in self.docs)
        ids = np.frombuffer(raw, "<u4")
        doc_ends = np.cumsum([len(d[3]) // 4 for d in self.docs])
        cuts = best_cuts(*candidates(ids, doc_ends, sentence_end, self.penalties, self.step), self.size, open_end=not last)
        if last:
            cuts = sorted({*cuts, *self._tail(cuts)})
        done = cuts[-1] if cuts else 0
        doc_starts = np.concatenate([[0], doc_ends[:-1]])
        bounds = np.union1d(np.concatenate([[0], cuts]), doc_starts[doc_starts < done]).astype(np.int64) if done else np.array([0])
        if done and bounds[-1] != done:
            bounds = np.append(bounds, done)
        doc_of = np.searchsorted(doc_ends, bounds[:-1], side="right")
        window_of = np.searchsorted(np.array(cuts, dtype=np.int64), bounds[:-1], side="right")
        window_start = np.concatenate([[0], cuts]).astype(np.int64)
        for a, b, d, w in zip(bounds[:-1].tolist(), bounds[1:].tolist(), doc_of.tolist(), window_of.tolist(), strict=True):
            doc_id, packed, total, _ = self.docs[d]
            yield doc_id, packed + a - int(doc_starts[d]), b - a, total, self.sequence + w, a - int(window_start[w]), raw[4 * a : 4 * b]
        self.sequence += len(cuts)
        first = int(np.searchsorted(doc_ends, done, side="right"))
        rest = self.docs[first:]
        if rest:
            doc_id, packed, total, own = rest[0]
            skip = done - int(doc_starts[first])
            rest[0] = (doc_id, packed + skip, total, own[4 * skip :])
        self.docs, self.held = rest, len(ids) - done

    def _tail(self, cuts: list[int]) -> list[int]:
        """More cuts of the last window into powers of two, which need no padding, if that costs less than its padding."""
        start, end = (cuts[-2] if len(cuts) > 1 else 0), cuts[-1]
        length = end - start
        if self.size - length <= self.penalties[1] * (length.bit_count() - 1):
            return []
        out = []
        for k in range(length.bit_length() - 1, -1, -1):
            if length >> k & 1:
                start += 1 << k
                out.append(start)
        return out


_OUT = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
_ROWS = "id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 0, penalties: tuple[int, int] = (2, 8), step: int = 16, block_tokens: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences: id, start, length, doc_tokens, sequence_id, offset, ids (little-endian 32-bit).

    Each partition packs its own rows in their order, a block of block_tokens at a time; what follows a block's last
    cut opens the next, so that only a partition's last sequence can be much shorter than size.  There is no shuffle.  step is
    at most size.  Null and empty texts are their end token alone; repeated rows and null ids are packed like others; other
    columns are left aside; an empty table gives no row.  A sequence id is the partition's number times 2**33 plus a count.
    """
    if not 0 < step <= size:
        raise ValueError("step must be from 1 to size")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        packer = _Packer(TaskContext.get().partitionId() << 33, size, end_id, penalties, step)
        for batch in in_parts(batches, "encoders"):
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                packer.add(doc_id.as_py(), enc.encode(text.as_py() or ""))
                if packer.held >= block_tokens:
                    yield from _batches(packer.pack(enc.sentence_end, last=False))
        yield from _batches(packer.pack(enc.sentence_end, last=True))

    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return ids.mapInArrow(pack, _ROWS).withColumnRenamed("id", id_col)


def _batches(pieces: Iterator[tuple], most: int = 10_000) -> Iterator[pa.RecordBatch]:
    rows = list(pieces)
    for k in range(0, len(rows), most):
        columns = zip(*rows[k : k + most], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _OUT, strict=True)], schema=_OUT)
