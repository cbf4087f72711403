"""A corpus from documents to packed sequences, a stage at a time, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import columns_of, drop_written, table, written
from fieldloom.llm.decontamination import contaminated
from fieldloom.llm.language import UNKNOWN, learn, predict
from fieldloom.llm.packing import pack_documents
from fieldloom.llm.secret_scan import redact_secrets
from fieldloom.llm.simhash import near_duplicates


#: A text is in no learned language beyond so many times the labelled rows' 99th hundredth of bits a byte, and so many bits for its beginning.
FAR, START_BITS = 1.5, 64


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop null and letterless texts, and those whose code under every language, learned from the labelled ones, is too long.

    Where no language can be learned, every text with a letter stays.
    """
    model = learn(docs, "text", "lang", F.col("doc_id"))
    if not model.languages:
        return docs.where(F.col("text").rlike("\\p{L}"))
    # in one column, no name clashes with the model's
    found = written(predict(docs, model, whole="doc"), "predicted").where(F.col("lang_pred") != UNKNOWN)
    usual = found.where(F.col("doc.lang").isNotNull()).agg(F.percentile_approx("bits_per_byte", 0.99)).first()[0]
    if usual is not None:
        found = found.where(F.col("bits_per_byte") <= FAR * usual + START_BITS / F.octet_length("doc.text"))
    return found.select("doc.*")


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, in a column that they lack, written so that every scan numbers them alike."""
    row = "row"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each near-duplicate group one row: that with the smallest doc_id, null ones last, and of ties the first row.

    Null and empty texts are one group; repeated rows and rows that share an id are told apart; an empty table stays empty.
    """
    rows, row = _numbered(docs)
    found = near_duplicates(rows, id_col=row).select(row, "component").join(rows.select(row, "doc_id"), row)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))
    kept = found.groupBy("component").agg(first.alias("first")).select(F.col(f"first.{row}").alias(row))
    return rows.join(kept, row, "left_semi").select(*columns_of(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that hold a window of 10 words of a benchmark item, whatever their ids and the item's.

    Null and empty texts hold none and stay, as do repeated rows without a window; an empty table stays empty.
    """
    items = table(spark, sf_dir, "benchmark").withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit("")))
    # the rows pass through the scan: neither a copy of the table nor a join
    return contaminated(docs, items, whole=True).where("n_hit = 0").select("kept.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in the place of every secret; keeps all rows, null and empty texts as they are."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens; a null or empty text is its end token alone."""
    pieces = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Language models, 64-bit fingerprints of all shingles and tokens are beyond SQL; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir; between stages the documents are a table in the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
