"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset (a local test), a temporary folder that is then set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="scholia-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Stored:
    """Tables written once and read back, so that a lost executor costs one stage and not the whole lineage.

    ``keep`` writes a DataFrame as Parquet and returns the reread one; ``drop`` deletes what is no longer read.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scholia-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._stored_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            at = jvm.org.apache.hadoop.fs.Path(t._stored_path)
            at.getFileSystem(conf).delete(at, True)
