"""Tables that outlive a plan: written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder in local mode where it is unset."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='fieldloom-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Table:
    """A Parquet table of its own, bucketed by a column so that joins and groups by it read it without an exchange."""

    def __init__(self, df: DataFrame, by: str, buckets: int):
        self.spark = df.sparkSession
        self.name = f"fieldloom_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(self.spark)}/{self.name}"
        df.write.format("parquet").bucketBy(buckets, by).option("path", self.path).saveAsTable(self.name)
        self._place().deleteOnExit(self.spark._jvm.org.apache.hadoop.fs.Path(self.path))

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Delete it, once nothing reads it any more."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self._place().delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path), True)

    def _place(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())


def written(df: DataFrame) -> DataFrame:
    """df written and read back: cuts the plan, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/fieldloom_{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
