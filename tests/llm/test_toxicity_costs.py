"""What the toxicity classifier shuffles, and that its hashes and lookups of many words at once are those of single ones."""

import random

import numpy as np
from pyspark.sql import functions as F

from fieldloom.llm import toxicity


def test_hashes_of_many_words_are_those_of_each():
    rnd = random.Random(1)
    words = [bytes(rnd.randint(1, 255) for _ in range(rnd.randint(1, 14))) for _ in range(2000)] + [b"", b"x" * 5000]
    codes, n = toxicity.hashes_of(words)
    assert codes.tolist() == [h for w in words for h in toxicity.hashes(w)] and n.tolist() == [len(toxicity.hashes(w)) for w in words]
    assert [len(x) for x in toxicity.hashes_of([])] == [0, 0]


def test_only_rows_that_may_be_wanted_are_shuffled(spark):
    rows = spark.range(4000).select(F.xxhash64("id").alias("h"), "id")
    wanted = rows.where("id % 40 = 7").select("h")
    for bits in (6, 8, 24):  # a full field lets all pass
        got = [r.id for r in toxicity._maybe_in(rows, wanted, bits).collect()]
        assert len(got) == len(set(got)) and {k for k in range(4000) if k % 40 == 7} <= set(got)
    assert len(got) < 110
    assert toxicity._maybe_in(rows, wanted.limit(0)).count() == 0


def test_texts_without_a_label_are_not_shuffled(spark, monkeypatch):
    """The table of the labelled texts comes from an exchange that the others do not reach, in small tables as in large ones."""
    docs = spark.createDataFrame([(n, f"plain words number {n} " + "vile" * (n % 2), "en") for n in range(400)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(0, 40)], "doc_id long, toxic int")
    seen = {}
    write = toxicity.written
    monkeypatch.setattr(toxicity, "written", lambda df, label: seen.setdefault(label, df) and write(df, label))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        toxicity.learn_toxicity(docs, labels)
        plan = seen["texts"]._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftSemi" in plan and "strategy=broadcast" in plan and plan.index("Aggregate [h") < plan.index("LeftSemi")


def test_lookups_are_the_same_however_many_texts_wait(monkeypatch):
    rnd = random.Random(2)
    texts = [" ".join(f"w{rnd.randrange(500)}" for _ in range(rnd.randrange(0, 90))).encode() for _ in range(300)]
    net = toxicity.train(texts, np.arange(300) % 3 == 0, epochs=1, least=1)
    all_at_once = toxicity.Reader(net).pooled(texts)
    one_by_one = np.concatenate([toxicity.Reader(net).pooled([t]) for t in texts])
    monkeypatch.setattr(toxicity, "_HELD", 300)
    assert np.allclose(all_at_once, one_by_one, atol=1e-5) and np.allclose(all_at_once, toxicity.Reader(net).pooled(texts), atol=1e-5)
