"""The toxicity classifier learns from every labelled row."""

import numpy as np
from pyspark.sql import functions as F

from fieldloom.llm import toxicity


def _labelled(spark, rows, parts):
    docs = spark.createDataFrame([(n, text, "en") for n, text, _ in rows], "doc_id long, text string, lang string").repartition(parts)
    return docs, spark.createDataFrame([(n, mark) for n, _, mark in rows], "doc_id long, toxic int")


def test_toxicity_learns_from_labelled_texts_of_any_length(spark):
    rows = [(n, f"plain words number {n} of a row", n % 2) for n in range(40)]
    rows += [(100 + n, "filler " * 160_000 + f"rareword {n}", 1) for n in range(3)]  # beyond 1 MB
    model = toxicity.learn_toxicity(*_labelled(spark, rows, 3))
    network = getattr(model, "network", model)
    assert {toxicity.hashes(b"filler")[0], toxicity.hashes(b"rareword")[0]} <= set(network.known.tolist())


def test_toxicity_learns_from_all_shards_whatever_the_partitions(spark):
    rows = [(n, f"w{n % 13} w{n % 17} w{n % 19} {'vile' if n % 3 == 0 else 'mild'} w{n % 23}", int(n % 3 == 0)) for n in range(900)]
    one, other = (toxicity.learn_toxicity(*_labelled(spark, own, parts), shard_rows=200, rounds=6) for own, parts in ((rows, 2), (rows[::-1], 5)))
    assert np.array_equal(one.vectors, other.vectors) and one.usual == other.usual and one.thresholds == other.thresholds
    docs = spark.createDataFrame([(0, "w1 vile w2"), (1, "w1 mild w2")], "doc_id long, text string")
    low, high = (r.score for r in toxicity.score_toxicity(docs, one).orderBy(F.desc("doc_id")).collect())
    assert low < 0.5 <= high
