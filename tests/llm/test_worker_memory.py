"""What a Python worker holds, within a task and after it."""

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from fieldloom.llm import common, decontamination, packing


def test_parts_hold_all_rows_and_bounded_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["x" * 5000] * 1000)], names=["id", "text"])
    parts = list(common.in_parts(iter([batch, batch.slice(0, 0), batch.slice(990)]), most=1 << 16))
    assert [k for p in parts for k in p.column(0).to_pylist()] == [*range(1000), *range(990, 1000)]
    assert max(p.nbytes for p in parts) <= 1 << 16


def test_a_row_beyond_the_bound_is_a_part():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 5000] * 3)], names=["text"])
    assert [p.num_rows for p in common.in_parts(iter([batch]), most=100)] == [1, 1, 1]


def test_a_task_lets_go_of_other_operators_caches():
    packing._ENCODERS["path"] = object()
    decontamination._BUILT["key", 0] = object()
    assert list(common.in_parts(iter([]), "encoders")) == [] and "path" in packing._ENCODERS and not decontamination._BUILT
    assert list(common.in_parts(iter([]))) == [] and not packing._ENCODERS


def test_an_encoder_stays_while_its_operator_runs(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")

    def pack(batches):
        packing.encoder(path)
        n = sum(b.num_rows for b in common.in_parts(batches, "encoders"))
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([path in common._KEPT["encoders"]])], names=["n", "held"])

    assert [tuple(r) for r in spark.range(20).coalesce(1).mapInArrow(pack, "n long, held boolean").collect()] == [(20, True)]


def test_texts_go_to_python_once(spark, tmp_path):
    spark.createDataFrame([("a", "x " * 12)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, "a clean text", "en"), (None, None, None), (2, "", "en"), (3, "x " * 12, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `odd.name` string")
    out = pipeline.decontamination(spark, docs, str(tmp_path))
    node = next(x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Project [struct(" in x)
    assert node.count("text#") == 1
    assert sorted(map(repr, out.collect())) == sorted(map(repr, docs.where(F.coalesce("doc_id", F.lit(0)) != 3).collect()))
