"""Secret scanning with one combined deterministic automaton.

All rules are compiled together (subset construction, then minimisation) into one transition array of the mirrored
patterns.  One pass from the last byte to the first marks every byte where a match of some rule starts; from the
leftmost mark of a rule its own small automaton then reads the longest match, and the next mark at or after that end
is taken.  This gives each rule's leftmost-longest, non-overlapping matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.automaton import Dfa, compile_rules
from fieldloom.llm.common import in_parts, kept_by_worker, utf8


@dataclass(frozen=True)
class Rule:
    """pattern: what a match takes; keep: what it must be in full to be reported (all matches, if None); tail: what more it takes, or nothing."""

    kind: str
    pattern: str
    keep: str | None = None
    fold: bool = False
    tail: str = ""


_VALUE = "[A-Za-z0-9+/_.=-]"
_ASSIGN = "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
#: A run of hexadecimal digits passes from 24 on, so the count can stand in the pattern; likewise for access keys.
BASE_RULES = (
    Rule("assign", f"{_ASSIGN}{_VALUE}+", f"{_ASSIGN}{_VALUE}{{6,}}", fold=True),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
RULES = (
    *BASE_RULES,
    Rule("forge", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("webtoken", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
#: What is redacted: a private key to its END line or, where that is missing, over its lines of base64.
REDACTED = (*RULES[:-1], Rule("pem", RULES[-1].pattern, tail="((([^-]|-[^-])*-----END [A-Z ]*PRIVATE KEY-----)|([\\x09\\x0A\\x0D\\x20]*[A-Za-z0-9+/=]{16,})*)"))
_CONTINUATION = bytes(range(0x80, 0xC0))


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.starts = compile_rules([(r.pattern, r.fold) for r in rules], reverse=True)
        self.each = [compile_rules([(r.pattern + r.tail, r.fold)], anchored=True) for r in rules]
        self.keep: list[Dfa | None] = [compile_rules([(r.keep, r.fold)], anchored=True) if r.keep else None for r in rules]

    def marks(self, data: bytes) -> list[tuple[int, int, int]]:
        """(first byte, last byte, mask) of runs where matches start, from the end of the text to its beginning."""
        step, masks, first, state = self.starts.step, self.starts.masks, self.starts.first_hit, self.starts.start
        found: list[tuple[int, int, int]] = []
        for back, byte in enumerate(reversed(data), 1):
            state = step[state + byte]
            if state >= first:
                at, mask = len(data) - back, masks[state >> 8]
                if found and found[-1][0] == at + 1 and found[-1][2] == mask:
                    found[-1] = (at, found[-1][1], mask)
                else:
                    found.append((at, at, mask))
        return found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start byte, rule number, end byte) of all matches, sorted."""
        found = []
        marks = self.marks(data)
        for r in range(len(self.rules)) if marks else ():
            after = 0
            for low, high, mask in reversed(marks):
                at = max(low, after)
                while mask >> r & 1 and at <= high:
                    after = self.each[r].longest(data, at)
                    keep = self.keep[r]
                    if keep is None or keep.longest(data, at) == after:
                        found.append((at, r, after))
                    at = after
        return sorted(found)


_SCANNERS: dict[tuple[Rule, ...], Scanner] = kept_by_worker("scanners")


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """Compiled once in each Python worker."""
    if rules not in _SCANNERS:
        _SCANNERS[rules] = Scanner(rules)
    return _SCANNERS[rules]


def _chars(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, rule, end) in code points."""
    if data.isascii():
        return spans
    count, last, at = {}, 0, 0
    for b in sorted({x for s, _, e in spans for x in (s, e)}):
        at += len(data[last:b].translate(None, _CONTINUATION))
        count[b], last = at, b
    return [(count[s], r, count[e]) for s, r, e in spans]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, spans array<struct<kind,start,end>>) for each row of docs; ends are exclusive, in code points.

    Spans are sorted by start, then by the order of the rules.  Null and empty texts give an empty array; repeated rows
    and null ids are kept; other columns are left aside, whatever their names; an empty table gives an empty one.
    """
    out = pa.schema([("id", pa.int64()), ("spans", pa.list_(SPAN))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = scanner(rules)
        for batch in batches:
            rows = []
            for data in batch.column(1):
                data = data.as_py()
                rows.append([{"kind": rules[r].kind, "start": s, "end": e} for s, r, e in _chars(data, found.spans(data))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, out.field(1).type)], schema=out)

    ids = docs.select(F.col(id_col).cast("long").alias("id"), utf8(F.col(text_col)).alias("data"))
    return ids.mapInArrow(scan, "id long, spans array<struct<kind:string,start:long,end:long>>").withColumnRenamed("id", id_col)


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = REDACTED, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with every found span replaced by [kind], where spans that overlap count as one, of the first's kind.

    Keeps all rows, columns and their order; the column length_col, where there is one, follows the new text.  Texts
    without a finding, null ones too, stay as they are.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = scanner(rules)
        for batch in in_parts(batches, "scanners"):
            at = place
            texts = [None if x is None else _redacted(x, found) for x in batch.column(at).cast(pa.binary()).to_pylist()]
            columns = batch.columns
            columns[at] = pa.array(texts, pa.binary()).cast(batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    place = docs.columns.index(text_col)
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # names that the way to Python and back can take
    out = plain.mapInArrow(scan, plain.schema).toDF(*docs.columns)
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(kind))
    return out


def _redacted(data: bytes, found: Scanner) -> bytes:
    parts, last = [], 0
    for s, r, e in found.spans(data):
        if s >= last:
            parts += [data[last:s], b"[", found.rules[r].kind.encode(), b"]"]
        last = max(last, e)
    return b"".join([*parts, data[last:]]) if parts else data


def reference_spans(text: str, rules: tuple[tuple[str, str, int, int], ...]) -> list[tuple[int, int, str]]:
    """The same by Python's re, for tests: rules of (kind, pattern, group, least length of the group)."""
    found = sorted(((m.start(), k, m.end(), kind) for k, (kind, p, g, least) in enumerate(rules) for m in re.finditer(p, text) if len(m[g]) >= least))
    return [(start, end, kind) for start, _, end, kind in found]
