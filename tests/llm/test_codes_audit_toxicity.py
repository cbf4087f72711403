"""Vector codes, the filter audit and the toxicity classifier against plain versions on small tables, and on awkward ones."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import toxicity
from fieldloom.llm.filter_audit import audit_documents, audit_filters
from fieldloom.llm.toxicity import learn_toxicity, score_toxicity
from fieldloom.llm.vector_codes import compress_vectors, nearest


@pytest.mark.parametrize("most", [3, 1 << 20, 1 << 40])
def test_nearest_equals_brute_force(most):
    """Ties to the lower index; whole numbers beyond 32 and 64 bits."""
    rng = np.random.default_rng(most)
    x, book = rng.integers(-most, most + 1, (600, 7)), rng.integers(-most, most + 1, (50, 7))
    book[30] = book[3]
    at, far = nearest(x, book)
    for row, a, f in zip(x.tolist(), at.tolist(), far.tolist(), strict=True):
        all_far = [sum((p - q) ** 2 for p, q in zip(row, b, strict=True)) for b in book.tolist()]
        assert f == min(all_far) and a == all_far.index(min(all_far))


def _codes(rows, entries, rounds=4, parts=4):
    """Plain version: rows of (id, vector, label)."""
    fine = [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in fine), default=0) // parts) * parts
    whole = [(i, [max(-(2**40), min(2**40, math.floor(1024 * x))) for x in v] + [0] * (width - len(v)), g) for i, v, g in fine]
    size = width // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, v, _ in whole]
    first = sorted(range(len(whole)), key=lambda n: (whole[n][0] is None, whole[n][0] or 0, whole[n][1]))[:entries]
    books = [[list(cut[n][p]) for n in first] for p in range(parts)]

    def near(x, book):
        far = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            mine = collections.defaultdict(list)
            for c in cut:
                mine[near(c[p], books[p])[0]].append(c[p])
            for e, xs in mine.items():
                books[p][e] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    out = []
    for (i, _, g), c in zip(whole, cut, strict=True):
        found = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, g, "".join(f"{a:02x}" for a, _ in found), min(sum(f for _, f in found), 2**63 - 1)))
    total = collections.Counter()
    for _, g, _, e in out:
        total[g] += e
    return sorted(((i, g, c, e, min(total[g], 2**63 - 1)) for i, g, c, e in out), key=repr), books


@pytest.mark.parametrize("extreme", [False, True])
def test_codes_equal_brute_force(spark, extreme):
    """Nulls, non-finite components, repeated rows and ids, shorter vectors, null ids and labels, extreme components."""
    rnd = random.Random(5)
    rows = [(n, [rnd.gauss(0, 1) for _ in range(10)], n % 3 if n % 4 else None) for n in range(60)]
    rows += [rows[4], (4, [0.5] * 10, 1), (70, None, 1), (71, [1.0, None] * 5, 1), (72, [float("nan")] * 10, 2), (73, [float("inf")] * 10, 2), (74, [0.25, -0.25], 0), (75, [], None), (None, [0.1] * 10, 9), (None, [0.0] * 10, 9)]
    if extreme:
        rows += [(80, [1e300, -1e300] * 5, 7), (81, [1e9] * 10, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got, books = compress_vectors(df, entries=8)
    want, wanted_books = _codes(rows, 8)
    assert [b.tolist() for b in books.entries] == wanted_books
    assert sorted(map(tuple, got.select("id", "group", "code", "error", "group_error").collect()), key=repr) == want


def test_codes_of_few_and_of_none(spark):
    schema = "vec_id long, embedding array<float>, label int, extra string"
    got, _ = compress_vectors(spark.createDataFrame([(1, [0.5, 0.25, 0.0, 1.0], None, "x")], schema))
    assert [tuple(r) for r in got.select("id", "code", "error", "group_error").collect()] == [(1, "00000000", 0, 0)]
    got, books = compress_vectors(spark.createDataFrame([], schema))
    assert got.count() == 0 and books.digest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _audit(docs, labels):
    """Plain version over (doc_id, text, source), applying each order step by step."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    first = {}
    for i, t, _ in docs:
        first[t or ""] = min(first.get(t or "", math.inf), math.inf if i is None else i)
    rows = []
    for i, t, s in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": (math.inf if i is None else i) != first[t]}
        rows.append((s or "", fails, i is not None and i in good, i is not None and i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                redundant = sum(r[1][f] for r in own) - len(gone)
                left = [r for r in left if not r[1][f]]
                alone = sum(r[1][f] and sum(r[1].values()) == 1 for r in own)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, alone, sum(r[2] for r in gone), sum(r[3] for r in gone)]
    shapley = collections.Counter()
    for (part, order, step), v in out.items():
        shapley[part, order[step - 1]] += v[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_brute_force(spark):
    """Null and empty texts and sources, null and repeated ids, copies across parts, labels of none and of many rows, other columns."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(3))
    docs = []
    for n in range(80):
        text = " ".join(word() for _ in range(rnd.choice([5, 49, 50, 80])))
        text = rnd.choice([text, text.upper(), "# " + text, " ".join([text[:40]] * 20), "x" * 200, "\t" + text + " é"])
        docs.append((n, text, rnd.choice(["s0", "s1", "s2"])))
    docs += [(200 + n, docs[n % 7][1], rnd.choice(["s0", None])) for n in range(40)]
    docs += [(300, None, None), (301, "", "s0"), (302, "", ""), (None, "", "s1"), (None, docs[3][1], "s1"), (None, "only without an id", "s1"), (None, "only without an id", "s1"), docs[5], docs[5], (5, "the same id", "s2"), (303, "long " * 60_000, "s3")]
    labels = [(n, n % 2, int(n % 5 == 0)) for n in range(0, 60)] + [(4, 0, 1), (None, 1, 1), (61, None, None), (201, 1, 1)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, source string, failed int, n int").repartition(5)
    got = audit_documents(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got.collect()}
    want = _audit(docs, labels)
    assert len(want) == 600 * len({d[2] or "" for d in docs}) and found == want


def test_audit_of_nothing_and_of_any_filters(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_documents(none, labels).count() == 0
    got = audit_filters(spark.createDataFrame([("p", True, True), ("p", False, True), ("p", False, False)], "part string, X boolean, Y boolean"), "part", ["X", "Y"], [])
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in got.collect()} == {
        ("XY", 1): (2, 1, 0, 0, 1), ("XY", 2): (1, 1, 1, 1, 3), ("YX", 1): (1, 2, 0, 1, 3), ("YX", 2): (1, 0, 1, 0, 1),
    }


CURSES = {"en": ["scumbag", "moronic"], "de": ["blödling", "lumperei"]}
PLAIN = {"en": ["river", "house", "green", "walking", "the", "and", "over", "stone"], "de": ["fluß", "haus", "grün", "gehen", "der", "und", "über", "stein"]}


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    out = []
    for n in range(600):
        lang = rnd.choice(["en", "de"])
        words = [rnd.choice(PLAIN[lang]) + (rnd.choice("abcdefgh") if rnd.random() < 0.3 else "") for _ in range(rnd.randint(3, 60))]
        toxic = n % 5 == 0
        if toxic:
            words.insert(rnd.randrange(len(words)), rnd.choice(CURSES[lang]) + rnd.choice(["", "s", "en", "x"]))
        out.append((n, " ".join(words).capitalize(), lang, int(toxic)))
    return out


def test_toxic_texts_are_caught(spark, texts):
    """Held-out accuracy; the score depends on the text alone, and copies score alike."""
    docs = spark.createDataFrame([(n, t, g, "s", 0.5) for n, t, g, _ in texts], "doc_id long, text string, lang string, source string, score double")
    labels = spark.createDataFrame([(n, x) for n, _, _, x in texts if n % 10 not in (0, 3)] + [(n, x) for n, _, _, x in texts if n % 20 == 0], "doc_id long, toxic int")
    model = learn_toxicity(docs, labels)
    got = {r.doc_id: r.score for r in score_toxicity(docs, model).collect()}
    held = [(n, x) for n, _, _, x in texts if n % 10 == 3 or n % 20 == 10]
    assert all(0 <= s <= 1 for s in got.values())
    assert sum((got[n] >= 0.5) == bool(x) for n, x in held) >= 0.97 * len(held) and sum(got[n] >= 0.5 for n, x in held if x) >= 0.9 * sum(x for _, x in held)
    others = spark.createDataFrame([(7, t, None) for _, t, _, _ in texts], "doc_id long, text string, lang string")
    assert collections.Counter(round(r.score, 9) for r in score_toxicity(others, model).collect()) == collections.Counter(round(s, 9) for s in got.values())


def test_toxicity_of_awkward_rows(spark, texts):
    """Null and empty texts score alike; repeated rows stay; one label, no label, no row; very long texts and words."""
    schema = "doc_id long, text string, lang string, source string, score int"
    rows = [(1, None, None, None, 1), (2, "", "en", "s", 2), (2, "", "en", "s", 2), (3, "  \n\t!!", None, None, 3), (4, "a moronic word " * 60_000, "en", "s", 4), (5, "x" * 3_000_000, "en", "s", 5), (None, "Scumbag", None, None, 6)]
    docs = spark.createDataFrame(rows, schema)
    for given in ([], [(2, 1)], [(2, 0), (3, 0)], [(None, 1), (4, None)], [(2, 0), (2, 1), (4, 1), (3, 0)]):
        model = learn_toxicity(docs, spark.createDataFrame(given, "doc_id long, toxic int"))
        got = score_toxicity(docs, model).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    none = spark.createDataFrame([], schema)
    assert score_toxicity(none, learn_toxicity(none, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


def test_pooling_equals_brute_force(texts, monkeypatch):
    """Whole texts, wherever slabs and batches cut them and however few words are remembered."""
    data = [t.lower().encode() for _, t, _, _ in texts[:200]] + [b"", " ".join(t.lower() for _, t, _, _ in texts).encode(), b"y" * 500]
    net = toxicity.train(data, np.array([x == 1 for _, _, _, x in texts[:200]] + [False] * 3), epochs=1, least=1)
    plain = toxicity.Reader(net).pooled(data)
    for k in (0, 5, 200, 201, 202):
        words = [w for w in data[k].translate(toxicity._TABLE).split()] or [b""]
        x = [sum((net.vectors[np.searchsorted(net.known, h)] for h in toxicity.hashes(w) if w and h in net.known), np.zeros(16)) for w in words] + [np.zeros(16)] * 2
        at = 0
        for f, width in zip(net.filters, toxicity.WIDTHS, strict=True):
            best = np.max([np.concatenate(x[p : p + width]) @ f for p in range(len(words))], axis=0)
            assert np.allclose(best, plain[k, at : at + f.shape[1]], atol=1e-5)
            at += f.shape[1]
    monkeypatch.setattr(toxicity, "_SLAB", 64)
    monkeypatch.setattr(toxicity, "_HELD", 300)
    assert np.allclose(toxicity.Reader(net).pooled(data), plain, atol=1e-5)
    assert b" ".join(w for part in toxicity.slabs(data[201]) for w in part) == b" ".join(data[201].translate(toxicity._TABLE).split())
