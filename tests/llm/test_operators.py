"""Each operator against a plain version on small tables, and on awkward ones."""

import collections
import functools
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldloom.llm import queries
from fieldloom.llm.automaton import compile_rules
from fieldloom.llm.common import connected_components
from fieldloom.llm.decontamination import contaminated
from fieldloom.llm.embeddings import near_duplicate_vectors
from fieldloom.llm.language import Model, learn, predict
from fieldloom.llm.lattice_lm import Pieces, lattice_scores
from fieldloom.llm.licenses import license_scan
from fieldloom.llm.packing import Encoder, best_cuts, pack_documents
from fieldloom.llm.secret_scan import BASE_RULES, Scanner, find_secrets, redact_secrets, reference_spans
from fieldloom.llm.sharding import hilbert_indices, shard_documents
from fieldloom.llm.simhash import fingerprint, links_in_bucket, near_duplicates, segment_plan
from fieldloom.llm.substrings import repeated_passages

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, shard int, row long, id string, key double"
LONG = "a word and another one. " * 40_000


def _rows():
    """Nulls, empty and very long texts, ties, repeated rows, other columns with names the operators use."""
    texts = [None, "", "  \n\t ", "!!! ???", "one", "The quick brown fox jumps over the lazy dog near the river bank.", "The quick brown fox jumps over the lazy dog near the river bank.", LONG, "é" * 30, "token = abcdefgh"]
    rows = [(n, t, None if n % 3 else "en", None if n % 2 else "src0", None if t is None else len(t), "x", 1, 2, "y", 0.5) for n, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, "no id at all", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").collect()]


BY_ROW = {
    "secrets": lambda d, s: find_secrets(d),
    "redaction": lambda d, s: redact_secrets(d),
    "shards": lambda d, s: shard_documents(d),
    "language": lambda d, s: predict(d, learn(d, "text", "lang", F.col("doc_id"))),
    "licenses": lambda d, s: license_scan(d, F.col("source")),
    "simhash": lambda d, s: near_duplicates(d),
    "lattice": lambda d, s: lattice_scores(d, F.lit(False), PIECES),
    "decontamination": lambda d, s: contaminated(d, s.createDataFrame([("a", "quick brown fox"), (None, "one"), ("b", None), ("c", "")], "item_id string, text string")),
}


@pytest.mark.parametrize("name", BY_ROW)
def test_awkward_tables(spark, odd, none, name):
    """A row for each row, whatever it holds; nothing for an empty table."""
    assert BY_ROW[name](none, spark).count() == 0
    got = BY_ROW[name](odd, spark).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in _rows())


def test_awkward_results(spark, odd, none):
    hits = {r.doc_id: r for r in BY_ROW["decontamination"](odd, spark).collect()}
    assert hits[5].n_hit == 3 and hits[5].items == ["a"] and hits[0].n_words == 0 and hits[3].n_words == 0 and hits[8].n_words == 1
    language = {r.doc_id: r for r in BY_ROW["language"](odd, spark).collect()}
    assert [language[n].lang_pred for n in (0, 1, 2, 3)] == ["und"] * 4 and language[5].lang_pred == "en"
    sim = {r.doc_id: r for r in near_duplicates(odd).collect()}
    assert sim[0].fp == sim[1].fp == sim[2].fp == 0 and sim[2].component == 0 and sim[6].component == 5
    packed = pack_documents(odd, BPE).collect()
    assert sorted(r.length for r in packed if r.doc_id in (0, 1)) == [1, 1] and pack_documents(none, BPE).count() == 0
    shards = [r.shard for r in shard_documents(odd).collect()]
    counts = collections.Counter(shards)
    assert max(counts.values()) - min(counts.values()) <= 1
    scored = {r.doc_id: r for r in lattice_scores(odd, F.lit(True), PIECES).collect()}
    assert scored[0].n_tokens == 1 and scored[0].train_tokens == 0 and scored[0].n_known == 0 and math.isfinite(scored[7].score)
    assert repeated_passages(none).count() == 0


def test_unlearned_languages(spark, odd):
    model = learn(odd.where("lang is null"), "text", "lang", F.col("doc_id"))
    assert {r.lang_pred for r in predict(odd, model).collect()} == {"und"}


# --- 1


def _random_secret(rnd):
    parts = ["token", "secret", "=", ":", " ", '"', "abcdef", "a", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "ab01", "é", "password", "api_key", "apikey", "TOKEN", "x", "\n", "--"]
    return "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14)))


def test_secret_spans_equal_regular_expressions(spark):
    rules = (("assign", r"(?ia)(password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))
    rnd = random.Random(1)
    texts = [_random_secret(rnd) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in find_secrets(df, BASE_RULES).collect():
        assert [(s.start, s.end, s.kind) for s in r.spans] == reference_spans(texts[r.doc_id], rules), texts[r.doc_id]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "my password=abcdefgh ok", 5), (2, None, 3)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r for r in redact_secrets(df).collect()}
    assert got[1].text == "my [assign] ok" and got[1].n_chars == 14 and got[2].text is None and got[2].n_chars == 3


def test_automaton_is_minimal_and_right():
    patterns = ["ab*c", "[a-c]{2,3}", "(ab|ba)+c?"]
    rnd = random.Random(3)
    for p in patterns:
        d = compile_rules([(p, False)], anchored=True)
        for _ in range(300):
            text = "".join(rnd.choice("abc") for _ in range(6))
            longest = max((n for n in range(7) if re.fullmatch(p, text[:n])), default=-1)
            assert d.longest(text.encode(), 0) == longest
    assert len(compile_rules([("(a|b)c|(b|a)c", False)], anchored=True).masks) == 4  # dead, start, middle, end
    assert Scanner(BASE_RULES).spans(b"") == []


# --- 2


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    df = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string").coalesce(1)
    got = pack_documents(df, BPE, block_tokens=20_000).collect()
    whole = collections.defaultdict(bytes)
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == len(whole[r.doc_id]) // 4 and len(r.ids) == 4 * r.length
        whole[r.doc_id] += bytes(r.ids)
    for i, t, _ in docs:
        want = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        assert np.frombuffer(whole[i], "<u4").tolist() == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    used = padded = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
        used += at
        padded += at if at & (at - 1) == 0 else 1024
    assert used / padded > 0.98


def test_encoder_on_white_space():
    enc = Encoder(BPE)
    rnd = random.Random(5)
    for _ in range(2000):
        text = "".join(rnd.choice([" ", "  ", "\n", "a", "it's", "12", "é", "日本", ".", "!", " ", "<|endoftext|>", "²", "_x"]) for _ in range(rnd.randint(0, 9)))
        assert enc.encode(text) == enc.encode_whole(text), repr(text)


def test_best_cuts_are_optimal():
    rnd = random.Random(7)
    for _ in range(100):
        at = np.cumsum([0, *(rnd.randint(1, 6) for _ in range(9))])
        pen = np.array([0, *(rnd.choice([0, 2, 5]) for _ in range(9))])
        cost = {0: 0}
        for j in range(1, 10):
            cost[j] = min(cost[i] + 10 - (at[j] - at[i]) + pen[j] for i in range(j) if at[j] - at[i] <= 10)
        place, total = 0, 0
        for c in best_cuts(at, pen, 10):
            assert c - place <= 10
            total += 10 - (c - place) + pen[at.tolist().index(c)]
            place = c
        assert place == at[-1] and total == cost[9]


# --- 3


def test_hilbert_neighbours():
    for dims, bits in ((2, 3), (3, 4), (4, 3)):
        places = hilbert_indices(dims, bits)
        cells = sorted(range(len(places)), key=places.__getitem__)
        split = [[c >> bits * d & (1 << bits) - 1 for d in range(dims)] for c in cells]
        assert sorted(places) == list(range(len(places)))
        assert all(sum(abs(a - b) for a, b in zip(x, y, strict=True)) == 1 for x, y in zip(split, split[1:], strict=False))


def test_shards_stay_native(spark, small):
    df = queries.op3_sharding(spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    rows = df.collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sorted(slots) == list(range(8))
    assert [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))] == sorted(r.curve for r in rows)


# --- 4


@pytest.mark.parametrize("cell_rows", [8, 4096])
def test_vector_links(spark, cell_rows):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 8))
    x = np.concatenate([base, base[:20] + 0.05 * rng.normal(size=(20, 8)), base[:5], 3 * base[:5]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(100, None), (101, [0.0] * 8), (102, [math.nan] + [1.0] * 7), (103, [1.0, None] + [1.0] * 6), (104, [math.inf] + [0.0] * 7), (105, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"n": F.lit(1), "cell": F.lit("x"), "v": F.lit(0)})
    got = {r.vec_id: r for r in near_duplicate_vectors(df, cell_rows=cell_rows).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([min([label[i], *label[near[i]]]) for i in range(len(x))])
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id) == (near[i].sum(), label[i])
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in range(100, 106))
    assert near_duplicate_vectors(df.where("false")).count() == 0


# --- 5


def test_passages_are_found_and_clean_texts_are_not(spark):
    rnd = random.Random(2)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(4000)]

    def sentence():
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(4, 13))]
        return " ".join(words).capitalize() + "."

    def text(n):
        return " ".join(sentence() for _ in range(n))

    passages = [text(9) for _ in range(5)]
    rows = []
    for i in range(40):
        own = text(20).split(" ")
        if i < 15:
            at = rnd.randint(1, len(own) - 1)
            own[at:at] = passages[i % 5].split(" ")
        rows.append((i, " ".join(own)))
    rows.append((40, rows[30][1].replace(vocabulary[0], vocabulary[1])))  # a copy
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {*range(15), 30, 40}
    texts = dict(rows)
    kept = collections.Counter((r.cluster, r.removed) for r in got)
    assert all(n == 1 for (_, removed), n in kept.items() if not removed)
    for r in got:
        assert r.n_words == len(re.findall(r"\w+", texts[r.doc_id][r.start : r.end]))


def test_passages_are_found_wherever_they_begin(spark):
    """51 to 60 words at sentence ends, amid a sentence and without any mark or capital; every one, to its exact ends."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(7))
    words = lambda n: [word() for _ in range(n)]
    sentence = lambda n: [*(w := words(n))[:-1], w[-1] + "."]
    rows, passages = [], []
    for kind in range(3):
        for size in range(51, 61):
            passage = words(size) if kind else [w for n in (17, 17, size - 34) for w in sentence(n)]
            passages.append(" ".join(passage))
            for _ in range(2):
                host = words(200) if kind == 2 else [w for _ in range(14) for w in sentence(14)]
                at = rnd.randint(1, 195) if kind else 14 * rnd.randint(1, 13)
                rows.append((len(rows), " ".join([*host[:at], *passage, *host[at:]])))
    rows.append((len(rows), " ".join(words(300))))
    texts = dict(rows)
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = collections.defaultdict(list)
    for r in got:
        spans[r.doc_id].append((r.start, r.end, r.n_words, r.removed))
    for k, passage in enumerate(passages):
        for i, removed in ((2 * k, False), (2 * k + 1, True)):
            at = texts[i].index(passage)
            end = at + len(passage.rstrip("."))
            assert (at, end, len(passage.split()), removed) in spans[i]
    assert len(rows) - 1 not in spans


# --- 6


def test_contamination_in_blocks(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    one = {r.doc_id: r for r in contaminated(docs, items).collect()}
    many = {r.doc_id: r for r in contaminated(docs, items, block_bytes=1000).collect()}
    assert one == many and any(r.n_hit for r in one.values())
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    windows = set()
    fold = lambda b: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", b.lower())
    for r in items.collect():
        w = fold(r.text.encode())
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))}
    for i, r in one.items():
        w = fold(texts[i])
        hit = {k + n for k in range(len(w)) for size in {len(x) for x in windows} if tuple(w[k : k + size]) in windows for n in range(size)}
        assert (r.n_words, r.n_hit) == (len(w), len(hit))
        assert sum(len(fold(texts[i][h.start : h.end])) for h in r.hits) == r.n_hit


# --- 7


def test_language_accuracy_and_code_lengths(spark, small, docs):
    got = {r.doc_id: r for r in queries.op7_language_id(spark, small).collect()}
    held = [(i, lang) for i, _, lang in docs if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i, _ in held) and sum(got[i].lang_pred == lang for i, lang in held) >= 0.98 * len(held)
    # a byte's probabilities after any context sum to 1
    text = b"abracadabra"
    letters = np.concatenate([np.zeros(3, np.int64), np.frombuffer(text, np.uint8).astype(np.int64) + 1])
    grams = sum(letters[k : len(letters) - 3 + k] << 9 * (3 - k) for k in range(4))
    model = Model(["x"], [np.unique(grams, return_counts=True)], least=1)
    for context in (b"", b"a", b"abr", b"zzz", b"cad"):
        base = model.code_lengths([context])[0, 0] if context else 0.0
        p = sum(2.0 ** -(model.code_lengths([context + bytes([b])])[0, 0] - base) for b in range(256))
        assert abs(p - 1) < 1e-4
    long = text * 60_000  # over several slabs
    assert abs(model.code_lengths([long])[0, 0] - _ppm(model, long)) < 1e-3
    assert (model.code_lengths([text, b"", text])[:, 0] == [_ppm(model, text), 0, _ppm(model, text)]).all()


def _ppm(model, data):
    x = np.concatenate([np.zeros(3, np.int64), model.letters[np.frombuffer(data, np.uint8)]])
    code = (x[:-3] * model.size + x[1:-2]) * model.size + x[2:-1]
    return float(model.cost[model.node[code], x[3:], 0].astype(np.float64).sum())


# --- 8


def test_licenses_are_inherited(spark):
    rows = [
        (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (2, "a/b/c.txt", "nothing here"),
        (3, "a/b/own.txt", "some words first. Released under the MIT License. and " + "more " * 30),
        (4, "z.txt", "nothing"),
        (5, "a/b/d/LICENSE", "This work is licensed under the GNU General Public License, version 3."),
        (6, "a/b/d/e/f.txt", None),
        (7, None, "a licence to talk"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: (r.licenses, r.origin, r.from_dir) for r in license_scan(df, F.col("path")).collect()}
    assert got[1] == (["Apache-2.0"], "own", None) and got[2] == (["Apache-2.0"], "inherited", "a")
    assert got[3] == (["MIT"], "own", None) and got[4] == ([], "none", None)
    assert got[5] == (["GPL-3.0"], "own", None) and got[6] == (["GPL-3.0"], "inherited", "a/b/d") and got[7] == ([], "none", None)


def test_whole_licence_files_are_inherited(spark):
    from fieldloom.llm.license_texts import TEXTS

    deep = "/".join("abcdefghijklmnopqrst")
    rows = []
    for n, (name, text) in enumerate(sorted(TEXTS.items())):
        rows += [(2 * n, f"{name}/LICENSE", f"Copyright (c) 2020 Some Holder\n\n{text}"), (2 * n + 1, f"{name}/{deep}/x.c", "int x;")]
    got = {r.doc_id: (r.licenses, r.origin, r.from_dir) for r in license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), F.col("path")).collect()}
    for n, name in enumerate(sorted(TEXTS)):
        assert got[2 * n] == ([name], "own", None) and got[2 * n + 1] == ([name], "inherited", name)


def test_wrapped_and_edited_notices_are_found(spark):
    rows = [
        (1, "# Permission is\n# hereby granted, free of charge, to any person\n# obtaining a copy of this software and\n# associated documentation files\n x = 1"),
        (2, " * Redistribution\n * and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:\n int x;"),
        (3, "Permission hereby is granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ] + [(n, "some plain words of another text") for n in range(10, 30)]
    got = {r.doc_id: r.licenses for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string"), F.concat(F.col("doc_id").cast("string"), F.lit("/f"))).collect()}
    assert got[1] == ["MIT"] and got[2] == ["BSD-3-Clause"] and got[3] == ["MIT"] and not any(got[n] for n in range(10, 30))


# --- 9


def _fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, small, docs):
    got = {r.doc_id: r for r in queries.op9_simhash(spark, small).collect()}
    fps = {i: _fingerprint(t) for i, t, _ in docs}
    label = {i: i for i in fps}
    for _ in range(8):
        for i in fps:
            for j in fps:
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    label[i] = min(label[i], label[j])
    for i, _, _ in docs:
        assert got[i].fingerprint == f"{fps[i]:016x}" and got[i].component_id == label[i]


def test_links_of_near_fingerprints(spark):
    """Every pair within 4 bits is tied, in any segment, and large buckets like small ones."""
    rnd = random.Random(4)
    values = []
    for _ in range(60):
        base = rnd.getrandbits(64)
        values.append(base)
        for k in range(rnd.randint(0, 3)):
            values.append(base ^ sum(1 << b for b in rnd.sample(range(64), k + 2)))
    values += [rnd.getrandbits(6) << 40 for _ in range(100)]  # one bucket
    values = sorted(set(values))
    from fieldloom.llm.simhash import fingerprint_links

    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    parts = {r.node % (1 << 64): r.component for r in connected_components(fingerprint_links(df)).collect()}
    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= 4:
                assert parts[a] == parts[b]
    roots = collections.defaultdict(list)
    for v, c in parts.items():
        roots[c].append(v)
    for group in roots.values():  # and nothing else is
        reached, todo = {group[0]}, [group[0]]
        while todo:
            at = todo.pop()
            new = [x for x in group if x not in reached and (x ^ at).bit_count() <= 4]
            reached.update(new)
            todo += new
        assert reached == set(group)
    assert segment_plan(4, 3) == [(0, 21, 1), (21, 21, 1), (42, 22, 0)]
    assert links_in_bucket(np.array([], np.uint64), np.array([1, 1], np.uint64), 4) == []
    assert fingerprint(b"") == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (10, 11), (20, 21), (21, 22), (22, 23), (23, 24), (24, 20), (2, 1), (None, 5)] + [(k, k + 1) for k in range(100, 140)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, **{k: 20 for k in range(20, 25)}, **{k: 100 for k in range(100, 141)}}


# --- 10


def test_lattice_scores(spark, small, docs):
    got = {r.doc_id: r for r in queries.op10_lattice_lm(spark, small).collect()}
    words = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), None]
    counts = collections.Counter(w for i, t, _ in docs if zlib.crc32(str(i).encode()) % 7 != 2 for w in words(t))
    n, v = sum(counts.values()), len(counts)
    for i, t, _ in docs:
        own = words(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert abs(r.base_score - base) < 1e-8 * abs(base) and r.score < 0


def test_lattice_sums_over_all_segmentations():
    p = Pieces(PIECES, {}, 10.0)

    def slow(text, first=True):
        if not text:
            return math.exp(p.stop)
        table = p.begin if first else p.inner
        total = sum(math.exp(table[text[:k]]) * slow(text[k:], False) for k in range(1, len(text) + 1) if text[:k] in table)
        return total + (0 if first else math.exp(sum(p.bytes[b] for b in text[0].encode())) * slow(text[1:], False))

    for word in ("the", "thé", "日"):
        assert abs(p.word(word.encode()) - math.log(slow("▁" + word))) < 1e-9
    assert abs(sum(map(math.exp, p.begin.values())) - 1) < 1e-9
    assert abs(sum(map(math.exp, p.inner.values())) + sum(map(math.exp, p.bytes)) + math.exp(p.stop) - 1) < 1e-9


# --- the pipeline


def test_pipeline(spark, small):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    kept = [docs]
    for _, stage in pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], small))
        assert kept[-1].columns == docs.columns
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert ids[1] == ids[0]  # all have a language
    fps = {r.doc_id: _fingerprint(r.text) for r in docs.collect()}
    near = lambda i: [j for j in fps if (fps[i] ^ fps[j]).bit_count() <= 4]
    label = {i: i for i in fps}
    links = {i: near(i) for i in fps}
    for _ in range(8):
        label = {i: min(label[j] for j in links[i]) for i in fps}
    assert ids[2] == set(label.values())
    hit = {r.doc_id for r in queries.op6_decontamination(spark, small).where("contaminated").collect()}
    assert ids[3] == ids[2] - hit and ids[4] == ids[3]
    assert not any(find_secrets(kept[4]).where("size(spans) > 0").collect())
    rows = pipeline.run(spark, small).collect()
    assert {r.doc_id for r in rows} == ids[4] and names[0] == "language_id"
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())


PLAIN = "doc_id long, text string, lang string, n_chars long"


def _texts(rows):
    return sorted(r.text for r in rows.collect())


def test_stages_decide_by_row(spark, tmp_path):
    import corpus_pipeline as pipeline

    rnd = random.Random(6)
    text = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(40))
    a, b, c, d, e = (text() for _ in range(5))
    df = spark.createDataFrame([(None, a, "en", 1), (None, b, "en", 1), (1, c, "en", 1), (1, d, "en", 1), (0, d, "en", 1), (None, d, "en", 1), (None, e, "en", 1), (None, e, "en", 1)], PLAIN)
    got = pipeline.simhash_dedup(spark, df, "")
    assert _texts(got) == sorted([a, b, c, d, e]) and [r.doc_id for r in got.collect() if r.text == d] == [0]


def test_language_stage_decides_by_model(spark, docs):
    import corpus_pipeline as pipeline

    rnd = random.Random(8)
    junk = "".join(rnd.choice("qxzvkjwQXZVKJW") for _ in range(300))
    foreign = "Это предложение написано на языке, который не был изучен. " * 4
    rows = [(i, t, lang, len(t)) for i, t, lang in docs] + [(-1, junk, None, 1), (-2, foreign, None, 1), (-3, "123 ...", None, 1)]
    got = {r.doc_id for r in pipeline.language_id(spark, spark.createDataFrame(rows, PLAIN), "").collect()}
    assert got == {i for i, _, _ in docs}
    unlabelled = spark.createDataFrame([(i, t, None, n) for i, t, _, n in rows], PLAIN)
    assert {r.doc_id for r in pipeline.language_id(spark, unlabelled, "").collect()} == {i for i, _, _ in docs} | {-1, -2}


def test_decontamination_decides_by_row(spark, tmp_path):
    import corpus_pipeline as pipeline

    rnd = random.Random(7)
    text = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(40))
    leak, other, clean = text(), text(), text()
    spark.createDataFrame([("x", leak), (None, other)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([(None, leak, "en", 1), (1, leak, "en", 1), (1, clean, "en", 1), (2, other, "en", 1)], PLAIN)
    assert _texts(pipeline.decontamination(spark, df, str(tmp_path))) == [clean]


def test_private_keys_are_redacted_whole(spark):
    body = "\n".join("MIIEpAIBAAKCAQEA7bq+/x" * 3 for _ in range(3)) + "\nab=="
    key = f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"
    locked = key.replace("KEY-----\nM", "KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A\n\nM", 1)
    cut = key[: key.index("\nab==")]
    rows = [(1, f"a {key} b {key} c", 1), (2, f"a {locked} b", 1), (3, f"a {cut} then plain words", 1), (4, "-----BEGIN PRIVATE KEY----- is a line", 1)]
    got = {r.doc_id: r.text for r in redact_secrets(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert got == {1: "a [pem] b [pem] c", 2: "a [pem] b", 3: "a [pem] then plain words", 4: "[pem] is a line"}


def test_registered(spark):
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 14))
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]


# --- further cases


def _folded(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


@pytest.mark.parametrize("crowd", [2, 1000])
def test_exact_runs_equal_brute_force(spark, crowd):
    """Words that lie in a window of 50 words which several rows have, and those of first copies, by tables of all windows."""
    from fieldloom.llm.substrings import _exact_runs

    rnd = random.Random(11)
    words = lambda n: ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(3, 9))) for _ in range(n)]
    shared = [words(n) for n in (50, 51, 80, 200)]
    texts = [None, "", "a b c"]
    for k in range(24):
        parts = [words(rnd.randint(0, 60)), shared[k % 4], words(rnd.randint(0, 30)), shared[rnd.randint(0, 3)][rnd.randint(0, 40) :], words(rnd.randint(0, 9))]
        texts.append(rnd.choice([" ", ", ", "\n"]).join(w for p in parts for w in p))
    texts += [texts[-1], texts[-1], " ".join(shared[3] * 3)]
    ids = [None if n % 7 == 6 else n // 2 for n in range(len(texts))]
    df = spark.createDataFrame([(n, i, (t or "").encode()) for n, (i, t) in enumerate(zip(ids, texts, strict=True))], "row long, id long, data binary").repartition(3)
    first, rows = {}, collections.defaultdict(set)
    for n, (i, t) in enumerate(zip(ids, texts, strict=True)):
        w = _folded(t)
        for at in range(len(w) - 49):
            key = tuple(w[at : at + 50])
            rows[key].add(n)
            place = (i is not None, i or 0, n, at)
            first[key] = min(first.get(key, place), place)
    want = collections.Counter()
    for n, t in enumerate(texts):
        w = _folded(t)
        of = [set() for _ in w]
        for at in range(len(w) - 49):
            key = tuple(w[at : at + 50])
            if len(rows[key]) > 1:
                for k in range(at, at + 50):
                    of[k].add(first[key][2:] == (n, at))
        for marks in of:
            if marks:
                want[ids[n], not any(marks)] += 1
    got = collections.Counter()
    clusters = {}
    for r in _exact_runs(df, 26, crowd).collect():
        got[r.id, r.removed] += r.n_words
        clusters.setdefault(r.cluster, set()).add(r.id)
        own = [t for i, t in zip(ids, texts, strict=True) if i == r.id and len(_folded((t or "")[r.start : r.end])) == r.n_words]
        assert own
    assert got == want and got and clusters


def test_paragraph_components_equal_brute_force(spark, small):
    """Clusters of cut paragraphs by exact Jaccard similarity of their words' shingles over all pairs."""
    from fieldloom.llm.substrings import Paragraphs

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    sets, where = {}, collections.defaultdict(set)
    for r in docs.collect():
        p = Paragraphs([r.text.encode()])
        for k in range(len(p)):
            w = _folded(r.text[p.start[k] : p.stop[k]])
            key = tuple(w)
            sets[key] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
            where[key].add(r.doc_id)
    keys = list(sets)
    holders = collections.defaultdict(list)
    for n, key in enumerate(keys):
        for s in sets[key]:
            holders[s].append(n)
    label = list(range(len(keys)))

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, key in enumerate(keys):
        common = collections.Counter(b for s in sets[key] for b in holders[s] if b < a)
        for b, n in common.items():
            if n >= 0.8 * (len(sets[key]) + len(sets[keys[b]]) - n) - 1e-9:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    rows = collections.defaultdict(set)
    for n, key in enumerate(keys):
        rows[root(n)] |= where[key]
    want = {key for n, key in enumerate(keys) if len(rows[root(n)]) > 1 and len(key) >= 32}
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {tuple(_folded(texts[r.doc_id][r.start : r.end])) for r in repeated_passages(docs).collect()}
    assert len(want - got) <= 0.01 * len(want) and want


def test_passages_of_awkward_rows(spark, odd):
    clash = odd.withColumnsRenamed({"lang": "h", "source": "cluster", "n_chars": "pick", "spans": "removed"})
    got = repeated_passages(clash).collect()
    assert {r.doc_id for r in got} <= {5, 6, 7} and not any(r.removed is None for r in got)


def test_encoder_on_control_characters():
    enc = Encoder(BPE)
    rnd = random.Random(9)
    alphabet = [*map(chr, range(128)), "\x85", "\xa0", "é", "'s", "'ll", "  ", "日"]
    for _ in range(20_000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 8)))
        assert enc.encode(text) == enc.encode_whole(text), repr(text)


def test_encoder_with_a_full_cache(monkeypatch):
    from fieldloom.llm import packing

    monkeypatch.setattr(packing, "_MOST_CACHED", 300)
    enc = Encoder(BPE)
    for k in range(300):
        text = f"word{k} and{k % 7} {k}-x the end"
        assert enc.encode(text) == enc.encode_whole(text)
        assert enc.held <= 300 and enc.later.held <= 300


def test_extreme_null_and_repeated_vectors(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1e200]), (3, [1e-200, 1e-200]), (4, [1.0, 1.0]), (4, [1.0, 1.01]), (None, [5e-324, 5e-324]), (6, [-1.0, 1.0]), (7, [0.0, 0.0]), (None, None)]
    got = collections.Counter((r.vec_id, r.n_links, r.component_id) for r in near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == collections.Counter([(1, 5, 1), (2, 5, 1), (3, 5, 1), (4, 5, 1), (4, 5, 1), (None, 5, 1), (6, 0, 6), (7, 0, 7), (None, 0, None)])


@pytest.mark.parametrize("pivots", [3, 40])
def test_clustered_vectors(spark, pivots):
    """Pivots, chunks and turns lose and repeat no link."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 6))
    x = np.concatenate([centres[rng.integers(0, 30, 500)] + 0.15 * rng.normal(size=(500, 6)), rng.normal(size=(200, 6))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in near_duplicate_vectors(df, cell_rows=20, most_pivots=pivots).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert [got[i] for i in range(len(x))] == ((u @ u.T >= 0.95).sum(axis=1) - 1).tolist()


def test_one_pass_over_a_large_benchmark(spark, small):
    """The plan is one Python stage without a shuffle, whatever the items' size; overlapping, short and repeated items count alike."""
    rnd = random.Random(12)
    words = [f"w{k}" for k in range(40)]
    items = [(f"i{k % 50}" if k % 9 else None, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 9, 10, 11, 40])))) for k in range(120)]
    texts = [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(30)] + [f"x {t} y" for _, t in items[:60]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    windows = collections.defaultdict(set)
    for name, t in items:
        w = t.split()
        if w and name:
            for k in range(max(1, len(w) - 9)):
                windows[tuple(w[k : k + 10])].add(name)
    for block in (1 << 20, 500):
        out = contaminated(df, bench, block_bytes=block)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "Union" not in plan
        for r in out.collect():
            w = texts[r.doc_id].split()
            hit, names = set(), set()
            for size in {len(x) for x in windows}:
                for k in range(len(w) - size + 1):
                    if found := windows.get(tuple(w[k : k + size])):
                        hit.update(range(k, k + size))
                        names |= found
            assert (r.n_words, r.n_hit, r.items) == (len(w), len(hit), sorted(names))


def test_hot_keys_are_split(spark):
    """The adaptive skew join splits one fingerprint that most rows have."""
    from fieldloom.llm.common import dealt_anew

    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 300_000, 1, 8).select(F.col("id"), F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(-1).alias("fp"))
        per = rows.groupBy("fp").agg(F.min("id").alias("least"))
        out = rows.join(dealt_anew(per, "fp"), "fp")
        out.write.format("noop").mode("overwrite").save()
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class _Ppm:
    """Prediction by partial matching from its definition: dictionaries of contexts, a recursion, exclusion at escapes."""

    def __init__(self, texts, least):
        self.counts = collections.defaultdict(collections.Counter)
        for data in texts:
            x = [0] * 3 + [b + 1 for b in data]
            for k in range(3, len(x)):
                for order in range(4):
                    self.counts[tuple(x[k - order : k])][x[k]] += 1
        self.kept = {c for c, of in self.counts.items() if len(c) < 2 or sum(of.values()) >= least}

    @functools.cache  # noqa: B019
    def p(self, context, symbol):
        if context is None:
            return 1 / 256
        shorter = context[1:] if context else None
        if context not in self.kept:
            return self.p(shorter, symbol)
        of = self.counts[context]
        total, distinct = sum(of.values()), len(of)
        if distinct == 256:
            return of[symbol] / total
        if symbol in of:
            return of[symbol] / (total + distinct)
        left = sum(self.p(shorter, b) for b in range(1, 257) if b not in of)
        return distinct / (total + distinct) * self.p(shorter, symbol) / left

    def bits(self, data):
        x = [0] * 3 + [b + 1 for b in data]
        return -sum(math.log2(self.p(tuple(x[k - 3 : k]), x[k])) for k in range(3, len(x)))


def test_code_lengths_equal_an_independent_model(spark):
    own = {"a": ["the cat sat on the mat", "a cat and a hat", ""], "b": ["der hund und die katze", "die maus"]}
    rows = [(n, t, lang) for n, (lang, t) in enumerate((lang, t) for lang, texts in own.items() for t in texts)]
    model = learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", F.col("doc_id"))
    tests = [b"the hat", b"die katze sat", "zé!".encode(), b"\x00\xff", b"a"]
    got = model.code_lengths(tests)
    # a context of order 2 or 3 is kept where either language has met it twice
    both = [_Ppm([t.encode() for t in own[lang]], 2) for lang in ("a", "b")]
    for ppm in both:
        ppm.kept = both[0].kept | both[1].kept
        ppm.kept = {c for c in ppm.kept if c in ppm.counts}
    for k, ppm in enumerate(both):
        for n, data in enumerate(tests):
            assert abs(got[n, k] - ppm.bits(data)) < 1e-3 * max(1, ppm.bits(data)), (k, data)


def test_stages_take_any_columns(spark, tmp_path):
    """Clashing and dotted names, nulls everywhere, repeated rows, an empty table."""
    import corpus_pipeline as pipeline

    spark.createDataFrame([("x", "one two three")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kinds = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, bits_per_byte string, __data binary, __row int, row long, `a.b` string, component long, doc string, fp long, `x y.z` int"
    words = "the cat sat on the mat and looked at the dog in the house"
    other = "a bird sang to the people in the garden while a man read of the weather"
    rows = [(1, words, "en", "s", 1), (1, words, "en", "s", 1), (None, other, "en", None, None), (2, None, None, None, None), (3, "one two three", "en", "s", 3), (4, "", "en", "s", 0), (5, "123", None, "s", 3)]
    df = spark.createDataFrame([(*r, 0.5, "q", "z", b"d", 7, 8, "dot", 9, "doc", 3, 1) for r in rows], kinds)
    empty = df.where("false")
    kept = df
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == df.columns, name
    got = kept.collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, other), (1, words)]
    assert all(r["a.b"] == "dot" and r["__row"] == 7 and bytes(r["__data"]) == b"d" and r["x y.z"] == 1 for r in got)
    assert pipeline.packing(spark, kept, "").count() == 2 and pipeline.packing(spark, empty, "").count() == 0
    assert pipeline.simhash_dedup(spark, df, "").count() == 5 and pipeline.decontamination(spark, df, str(tmp_path)).count() == 6
    predicted = predict(df, learn(df, "text", "lang", F.col("doc_id")))
    assert predicted.columns == [c for c in df.columns if c not in ("lang_pred", "score", "bits_per_byte")] + ["lang_pred", "score", "bits_per_byte"]
    assert predicted.count() == len(rows)


def _segmentations(p, text, first=True):
    """(log probability, pieces) of every segmentation, byte pieces as (byte,)."""
    if not text:
        yield 0.0, []
        return
    table = p.begin if first else p.inner
    for k in range(1, len(text) + 1):
        if text[:k] in table:
            for lp, rest in _segmentations(p, text[k:], False):
                yield table[text[:k]] + lp, [text[:k], *rest]
    if not first:
        for lp, rest in _segmentations(p, text[1:], False):
            yield sum(p.bytes[b] for b in text[0].encode()) + lp, [*((b,) for b in text[0].encode()), *rest]


def test_expected_pieces_equal_all_segmentations():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    p = Pieces(PIECES, {k: k % 7 for k in range(32_000)}, 10.0)
    words, times = ["there", "é日x", "a", "", "Übermut"], np.array([3, 2, 1, 4, 5])
    got = p.expected([w.encode() for w in words], times)
    want = np.zeros(p.size)
    for w, n in zip(words, times, strict=True):
        every = list(_segmentations(p, "▁" + w))
        total = math.log(sum(math.exp(lp) for lp, _ in every))
        assert abs(p.word(w.encode()) - total - p.stop) < 1e-9
        for lp, pieces in every:
            for piece in pieces:
                k = int(p.byte_ids[piece[0]]) if isinstance(piece, tuple) else model.piece_to_id(piece)
                want[k] += n * math.exp(lp - total)
    assert np.abs(got - want).max() < 1e-9
    assert np.isfinite(p.words([b"x" * 100_000, b"", b"ab"])).all()


def test_scores_equal_brute_force(spark):
    """Lattice and word scores of whole texts by sums over every segmentation, with weights fitted by the same counts in plain Python."""
    texts = ["the cat sat", "the dog", None, "a cat the cat zq", ""]
    held = [False, False, False, True, False]
    df = spark.createDataFrame([(n, t, h) for n, (t, h) in enumerate(zip(texts, held, strict=True))], "doc_id long, text string, h boolean")
    got = {r.doc_id: r for r in lattice_scores(df, F.col("h"), PIECES, hot_words=2, rounds=2).collect()}
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    train = collections.Counter(w for t, h in zip(texts, held, strict=True) if not h for w in (t or "").split())
    n_words = sum(train.values())
    counts = collections.Counter()
    for w, n in train.items():
        for k in model.encode(w):
            counts[k] += n
    p = Pieces(PIECES, counts, n_words)
    for _ in range(2):
        counts = collections.Counter()
        for w, n in train.items():
            every = list(_segmentations(p, "▁" + w))
            total = sum(math.exp(lp) for lp, _ in every)
            for lp, pieces in every:
                for piece in pieces:
                    counts[int(p.byte_ids[piece[0]]) if isinstance(piece, tuple) else model.piece_to_id(piece)] += n * math.exp(lp) / total
        p = Pieces(PIECES, counts, n_words)
    ends, distinct = 4, len(train) + 1
    total = n_words + ends
    end = (ends + 0.5) / (total + 1)
    left = (0.75 * distinct + 1) / (total + 1)
    for n, t in enumerate(texts):
        lattice = [sum(math.exp(lp) for lp, _ in _segmentations(p, "▁" + w)) * math.exp(p.stop) * (1 - end) for w in (t or "").split()] + [end]
        own = [max(0, train[w] - 0.75) / (total + 1) for w in (t or "").split()] + [(ends - 0.75) / (total + 1)]
        assert abs(got[n].score - sum(map(math.log10, lattice))) < 1e-6
        assert abs(got[n].word_score - sum(math.log10(a + left * b) for a, b in zip(own, lattice, strict=True))) < 1e-6


def test_findings_equal_brute_force_cosines(spark):
    """Cosines with real document frequencies of all words over every passage, and the nearest directory by walking up."""
    from fieldloom.llm.licenses import TEMPLATES
    from fieldloom.llm.licenses import words as fold

    few = {name: TEMPLATES[name] for name in ("MIT", "Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0")}
    rnd = random.Random(21)
    plain = ["rare%d" % k for k in range(60)] + ["common"] * 30 + ["the", "of", "license", "version"]
    notices = [t for texts in few.values() for t in texts]
    rows = []
    for n in range(120):
        ws = rnd.choice(notices).split()
        for _ in range(rnd.randint(0, 6)):  # near the threshold from both sides
            ws[rnd.randrange(len(ws))] = rnd.choice(plain)
        text = " ".join([*rnd.choices(plain, k=rnd.randint(0, 5)), *ws, *rnd.choices(plain, k=rnd.randint(0, 5))])
        path = "/".join(rnd.choice("ab") for _ in range(rnd.randint(0, 6))) + f"/f{n}"
        rows.append((n, path, text if n % 3 else " ".join(rnd.choices(plain, k=9))))
    n_docs = len(rows)
    df_of = collections.Counter(w for _, _, t in rows for w in set(fold(t.encode())))
    idf = lambda w: math.log((1 + n_docs) / (1 + df_of[w])) + 1

    def vector(ws):
        out = collections.Counter()
        for w in ws:
            out[w] += idf(w)
        for a, b in itertools.pairwise(ws):
            out[a, b] += (idf(a) + idf(b)) / 2
        return out

    own = [(name, fold(t.encode())) for name, texts in few.items() for t in texts]
    vectors = [(name, len(ws), vector(ws)) for name, ws in own]
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    from fieldloom.llm.licenses import find_licenses

    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: r for r in find_licenses(df, [F.col("doc_id")], few).collect()}
    some = clear = 0
    whole = {}
    for n, path, text in rows:
        ws = fold(text.encode())
        found = []
        for low in range(len(ws)):
            for size in {s for _, s, _ in vectors}:
                if low + size <= len(ws):
                    v = vector(ws[low : low + size])
                    scores = [sum(x * t.get(k, 0) for k, x in v.items()) / length(v) / length(t) for _, _, t in vectors]
                    best = max(range(len(scores)), key=lambda k: (scores[k], -k))
                    if scores[best] >= 0.8 and vectors[best][1] == size:
                        found.append((-scores[best], low, low + size, vectors[best][0]))
        kept = []
        for score, a, b, name in sorted(found):
            if all(b <= x or y <= a for x, y, _, _ in kept):
                kept.append((a, b, name, -score))
        kept.sort()
        assert [(f.license, round(f.cosine, 9)) for f in got[n].findings] == [(name, round(s, 9)) for _, _, name, s in kept], text
        some += bool(kept)
        clear += not kept
        if kept and 2 * sum(b - a for a, b, _, _ in kept) >= len(ws):
            whole.setdefault(path.rpartition("/")[0], set()).update(name for _, _, name, _ in kept)
    assert some > 20 and clear > 20
    for r in license_scan(df, F.col("path"), templates=few).collect():
        if not got[r.doc_id].findings:
            at = r.path.rpartition("/")[0]
            while at not in whole and at:
                at = at.rpartition("/")[0]
            want = (sorted(whole[at]), "inherited", at) if at in whole else ([], "none", None)
            assert (r.licenses, r.origin, r.from_dir) == want


def test_licences_of_many_families(spark):
    from fieldloom.llm.licenses import TEMPLATES, find_licenses

    rows = [(n, name, f"// some code\n# {t}\n int x = {n};") for n, (name, t) in enumerate((name, t) for name, texts in TEMPLATES.items() for t in texts)]
    got = {r.doc_id: [f.license for f in r.findings] for r in find_licenses(spark.createDataFrame(rows, "doc_id long, name string, text string"), [F.col("doc_id")]).collect()}
    assert len(TEMPLATES) >= 20 and all(got[n] == [name] for n, name, _ in rows)


def test_large_buckets_meet_in_blocks(spark):
    """Any two members of a large bucket share a key, keys hold about the most rows, and small buckets stay as they are."""
    from fieldloom.llm.common import in_blocks

    rows = spark.range(1000).select(F.when(F.col("id") < 900, 7).otherwise(F.col("id")).alias("key"), F.col("id").alias("m"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    members = collections.defaultdict(set)
    for r in in_blocks(rows, sizes, "m", 300).collect():
        members[r.key].add(r.m)
    large = [x for k, x in members.items() if k < 900 or k >= 1000]
    assert {k for k in members if 900 <= k < 1000} == set(range(900, 1000)) and len(large) > 1
    assert max(map(len, large)) < 1.5 * 300 and len(set().union(*large)) == 900
    met = {(a, b) for x in large for a in x for b in x if a < b}
    assert len(met) == 900 * 899 // 2


@pytest.mark.parametrize("radius", [4, 6])
def test_links_of_parted_buckets(spark, radius):
    from fieldloom.llm.simhash import fingerprint_links

    rnd = random.Random(9)
    values = {rnd.getrandbits(21) for _ in range(200)} | {rnd.getrandbits(64) for _ in range(50)}  # most in one bucket of two segments
    values |= {v ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, radius))) for v in list(values)[:80]}
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    whole, parted = (
        {(r.node, r.component) for r in connected_components(fingerprint_links(df, radius, bucket_rows=n)).collect()} for n in (1 << 20, 24)
    )
    assert whole == parted and len({c for _, c in whole}) > 1


def test_paragraphs_of_parted_bands(spark):
    rnd = random.Random(12)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(40):
        words = list(base)
        words[59 - rnd.randrange(2)] = f"x{rnd.randrange(1000)}"
        texts.append("\n".join([" ".join(rnd.choices(base, k=30)).capitalize() + ".", " ".join(words).capitalize() + "."]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    one, more = (sorted(map(str, repeated_passages(docs, band_sets=n).collect())) for n in (1 << 13, 6))
    assert one == more and len(one) >= 40
