"""Reading and writing the corpus: licence partitions, seeds, snapshots, reports, vectors."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that only assessment chunks fill; a legacy partition lacks them.
ASSESSMENT = T.StructType([
    T.StructField("item_type", T.StringType()), T.StructField("dok_level", T.IntegerType()), T.StructField("answer_key", T.StringType()), T.StructField("exam_series", T.StringType()),
    T.StructField("exam_year", T.IntegerType()), T.StructField("difficulty", T.DoubleType()), T.StructField("item_generation", T.StringType()),
])


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder of spark.checkpoint.dir, which all executors share; where that is unset (a local test), in a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
    return f"{(at or 'file://' + tempfile.mkdtemp(prefix='scholia-')).rstrip('/')}/corpus-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The table written as Parquet in a new folder of `shared_folder` and read back: computed once, however often it is read,
    and not again from its inputs if executors are lost."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_parts(spark: SparkSession, core: str, addons: dict[str, str] | None = None) -> DataFrame:
    """The core partition, and the optional ones that exist, as one table with `part`; a missing core raises."""
    if not exists(spark, core):
        raise FileNotFoundError(core)
    out = spark.read.parquet(core).withColumn("part", F.lit("core"))
    for part, path in (addons or {}).items():
        if exists(spark, path):
            out = out.unionByName(spark.read.parquet(path).withColumn("part", F.lit(part)), allowMissingColumns=True)
    return out


def heal(chunks: DataFrame) -> tuple[DataFrame, list[str]]:
    """The chunks with the assessment columns they lack as typed nulls, and the names of those."""
    lacking = [f for f in ASSESSMENT.fields if f.name not in chunks.columns]
    return chunks.withColumns({f.name: F.lit(None).cast(f.dataType) for f in lacking}), [f.name for f in lacking]


def snapshot_key(key: Column) -> Column:
    """A key as part of a path."""
    return F.replace(F.replace(key, F.lit(":"), F.lit("__")), F.lit("/"), F.lit("_"))


def snapshot_paths(raw: DataFrame, *, ext: str = "txt") -> DataFrame:
    """(source_id, key, path) of raw records (source_id, key, fetched_at)."""
    return raw.select("source_id", "key", F.concat(F.col("source_id"), F.lit("/"), F.substring("fetched_at", 1, 10), F.lit("/"), snapshot_key(F.col("key")), F.lit(f".{ext}")).alias("path"))


def write_snapshots(raw: DataFrame, root: str) -> None:
    """Raw records by source and day; what was there of a source's day is replaced, so a rerun changes nothing."""
    by_day = raw.withColumn("fetch_date", F.substring("fetched_at", 1, 10)).write.partitionBy("source_id", "fetch_date")
    by_day.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(root)


def without_line_comments(text: Column) -> Column:
    """A text without the lines that are comments; // inside a line stays."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.ltrim(x).startswith("//")), "\n")


def read_seed(texts: DataFrame, item: str, wrapper: str) -> DataFrame:
    """Rows of JSON seeds (column value: whole files, whole-line // comments allowed): a bare list of items, or an object that
    has the list under `wrapper`. `item` is the DDL of an item."""
    clean = F.trim(without_line_comments(F.col("value")))
    rows = F.when(clean.startswith("["), F.from_json(clean, f"array<struct<{item}>>")).otherwise(F.from_json(clean, f"{wrapper} array<struct<{item}>>")[wrapper])
    return texts.select(F.explode(rows).alias("r")).select("r.*")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def write_report(df: DataFrame, path: str) -> None:
    """A report as CSV with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_result(df: DataFrame, path: str) -> None:
    """An evaluation result as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_table(spark: SparkSession, table: str, *, jdbc: dict[str, str] | None = None, exported: str | None = None) -> DataFrame:
    """An external table: by JDBC where a driver is there, else from its Parquet export."""
    if jdbc:
        return spark.read.format("jdbc").options(dbtable=table, **jdbc).load()
    return spark.read.parquet(f"{exported}/{table}.parquet")


def decode_vectors(blobs: Column) -> Column:
    """Little-endian float32 bytes as array<float>; bytes of another length are null."""

    @F.arrow_udf("array<float>")
    def decode(x: pa.Array) -> pa.Array:
        # whole batches: the values are the bytes as they lie there
        lengths = pc.fill_null(pc.binary_length(x), 0).to_numpy()
        good = (lengths % 4 == 0) & pc.is_valid(x).to_numpy(zero_copy_only=False)
        kept = pc.if_else(pa.array(good), x, pa.scalar(b"", x.type))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept), pa.scalar(b"", x.type))[0].as_py()
        ends = np.cumsum(np.where(good, lengths // 4, 0))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(np.frombuffer(joined, "<f4")), mask=pa.array(~good))

    return decode(blobs)


def encode_vectors(vectors: Column) -> Column:
    @F.arrow_udf("binary")
    def encode(x: pa.Array) -> pa.Array:
        values = x.flatten().cast(pa.float32())
        lengths = pc.fill_null(pc.list_value_length(x), 0).to_numpy()
        ends = np.concatenate(([0], np.cumsum(lengths))) * 4
        data = pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False).astype("<f4").tobytes()
        valid = pc.is_valid(x)
        null = None if valid.true_count == len(x) else pa.array(valid.to_numpy(zero_copy_only=False)).buffers()[1]
        return pa.Array.from_buffers(pa.binary(), len(x), [null, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data)])

    return encode(vectors)

