"""What the pipeline's stages leave on disk."""

import corpus_pipeline as pipeline


def test_decontamination_neither_copies_nor_shuffles_the_documents(spark, tmp_path):
    item = "one two three four five six seven eight nine ten"
    spark.createDataFrame([("a", item), (None, "x " * 12)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, "clean", [1.5]), (1, "clean", [1.5]), (None, f"So {item.upper()} it is", None), (2, None, None), (None, "", [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `odd.name` array<double>")
    out = pipeline.decontamination(spark, docs, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "FileScan" not in plan
    assert out.schema == docs.schema and sorted(map(repr, out.collect())) == sorted(map(repr, docs.where("text is null or length(text) < 9").collect()))
