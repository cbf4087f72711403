"""Shared pieces: tables in the shared folder, connected components, text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one in local mode where it is unset."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='fieldloom-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors.

    The table goes when the driver ends, or earlier by drop_written().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared one when the driver ends; it is made if it is not there yet."""
    fs, place = _file_system(spark, path)
    fs.mkdirs(place)
    fs.deleteOnExit(place)


def drop_written(df: DataFrame) -> None:
    """Delete a table made by written(), once nothing reads it any more."""
    fs, place = _file_system(df.sparkSession, df._written_at)
    fs.delete(place, True)


def dealt_anew(side: DataFrame, key: str) -> DataFrame:
    """The side of a join that has a row or few for each key, dealt by another hash first.

    The adaptive skew join splits a hot key only where both sides come from an exchange of their own; the result of an
    aggregate by the join's key would come without.
    """
    return side.repartition(F.xxhash64(F.lit("dealt anew"), key))


def in_blocks(rows: DataFrame, sizes: DataFrame, member: str, most: int) -> DataFrame:
    """rows with a column key (long), where that of a bucket of more than `most` rows, by sizes (key, n), is parted.

    Such a bucket's members fall into blocks by their hash, and each goes to the keys of all pairs of blocks with its own: any
    two members still meet under some key, which holds about `most` rows.  The sizes of large buckets are a written table, so
    that Spark broadcasts it only if it is small.  Two keys that happen to be equal only make a bucket of two.
    """
    hot = written(sizes.where(F.col("n") > most).select("key", F.ceil(F.col("n") * 2 / most).cast("long").alias("blocks")), "hot")
    own = F.pmod(F.xxhash64(member), F.col("blocks"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: b != own)
    keys = F.when(F.col("blocks").isNull(), F.array("key")).otherwise(F.transform(others, lambda b: F.xxhash64("key", F.least(own, b), F.greatest(own, b))))
    rest = [c for c in rows.columns if c != "key"]
    return rows.join(hot, "key", "left").select(F.explode(keys).alias("key"), *rest)


#: What operators keep in a Python worker from task to task, by their names.
_KEPT: dict[str, dict] = {}


def kept_by_worker(name: str) -> dict:
    """A cache that lasts from task to task of an operator, until the worker runs another's (see in_parts)."""
    return _KEPT.setdefault(name, {})


def in_parts(batches: Iterator[pa.RecordBatch], own: str = "", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A task's rows in parts of about `most` bytes (a larger row alone), so that what is made of them is never that of a whole batch.

    Spark reuses Python workers: all caches but that of the name own go first, and at the end freed Arrow memory goes back to the system.
    """
    for name, cache in _KEPT.items():
        if name != own:
            cache.clear()
    try:
        for batch in batches:
            rows = max(1, batch.num_rows * most // max(1, batch.nbytes))
            for low in range(0, batch.num_rows, rows):
                yield batch.slice(low, rows)
            del batch
    finally:
        pa.default_memory_pool().release_unused()


def columns_of(df: DataFrame, without: tuple[str, ...] = ()) -> list[Column]:
    """All columns, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in without]


def utf8(text: Column) -> Column:
    """The UTF-8 bytes of a string column, null as empty."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of an undirected graph: edges (u long, v long) -> (node, component).

    Alternates two star operations until the edges no longer change: each node's larger neighbours are hung
    under its smallest neighbour, then its smaller ones are.  Every round is two aggregations with partial sums
    and two equi-joins, in which both sides have an exchange so that the adaptive skew join can split hot nodes; the rounds grow with the logarithm of
    the nodes.  Each round's edges are written to the shared folder.  Loops, repeated edges and nulls are ignored;
    without edges the result is empty.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(dealt_anew(least, "u"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(dealt_anew(least, "u"), "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        after = written(small, "edges")
        drop_written(now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _state(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge table."""
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())
