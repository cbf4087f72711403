"""What the driver holds of the tables that operators look at."""

import tracemalloc

import numpy as np
from pyspark import Broadcast
from pyspark.sql import functions as F

from fieldloom.llm.substrings import _bit_field, repeated_passages


def test_a_bit_field_comes_without_an_object_for_each_word(spark):
    n = 1 << 17
    hashes = spark.range(2 * n).select(((F.col("id") % n - n // 2) * 129).alias("h"))
    _bit_field(hashes.limit(10), 24)
    tracemalloc.start()
    got = _bit_field(hashes, 24)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.zeros(1 << 24, np.uint8)
    want[(np.arange(-n // 2, n // 2) * 129) % (1 << 24)] = 1
    assert (got == np.packbits(want, bitorder="little")).all()
    assert peak < got.nbytes + (4 << 20)


def test_a_bit_field_of_no_hashes_is_empty(spark):
    assert not _bit_field(spark.range(0).select(F.col("id").alias("h")), 12).any()


def test_fields_go_once_the_tables_that_need_them_are_written(spark, monkeypatch):
    gone = []
    destroy = Broadcast.destroy
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: (gone.append(self), destroy(self, *a))[1])
    words = " ".join(f"word{k}" for k in range(120))
    near = words.replace("word60", "other")
    rows = [(1, words), (2, f"before {words} after"), (3, near), (None, None), (4, "alone " * 3)]
    found = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(gone) == 2
    assert {r.doc_id for r in found.collect()} == {1, 2, 3}
