"""Corpus tables laid out in folders, so that a load or a re-split rewrites only what it changes.

Chunks lie in hash buckets of their id. A load joins narrow rows (id, hash of the row) first; texts are read for changed ids
and for the buckets that hold them, and those buckets alone are replaced. When a row was last verified stands in a table of
its own, to which a load appends (id, time), so an unchanged row costs no rewrite.

Tables of licence partitions lie in one folder for each part; a re-split replaces the folders that books leave or enter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.sources.corpus import exists, stored

BUCKETS = 64
#: Columns that are no part of a row's identity: set by the load itself.
SET_BY_LOAD = ("created_at", "last_verified", "stale")


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _row_hash(df: DataFrame, key: str) -> Column:
    cols = sorted(c for c in df.columns if c not in (*SET_BY_LOAD, key, "row_hash", "bucket"))
    # null and absent differ, and a column's name counts
    named = [F.struct(F.lit(c).alias("n"), F.col(c).alias("v")) for c in cols]
    return F.concat_ws("-", F.hex(F.xxhash64(*named)), F.hex(F.xxhash64(F.lit(7), *named)))


def _replace(df: DataFrame, path: str, by: str) -> None:
    """Writes the values of `by` that `df` holds and leaves all other folders as they are."""
    df.repartition(F.col(by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def lay_out_chunks(chunks: DataFrame, path: str, *, buckets: int = BUCKETS) -> None:
    """A new snapshot of chunks (chunk_id, content, ..., created_at, last_verified, stale) at `path`."""
    rows = chunks.drop("content_hash").withColumn("content_hash", F.sha2(F.coalesce("content", F.lit("")), 256)).drop("last_verified")
    rows = rows.withColumn("row_hash", _row_hash(rows, "chunk_id")).withColumn("bucket", bucket_of(F.col("chunk_id"), buckets))
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/chunks")
    chunks.where("last_verified is not null").select("chunk_id", "last_verified").write.parquet(f"{path}/verified")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot's chunks, each with the last time that a load saw it."""
    seen = spark.read.parquet(f"{path}/verified").groupBy("chunk_id").agg(F.max("last_verified").alias("last_verified"))
    return spark.read.parquet(f"{path}/chunks").drop("row_hash", "bucket").join(seen, "chunk_id", "left")


def load_changes(spark: SparkSession, path: str, arrivals: DataFrame, *, now: str, buckets: int = BUCKETS) -> DataFrame:
    """Upserts `arrivals` (the snapshot's columns but those that a load sets) and returns (chunk_id, change): added, updated or same.

    Of arrivals with one id the one with the largest hash counts; those without an id are left out. created_at stays, stale is 0 again, new nulls win. The
    numbers of touched buckets (at most `buckets`) come to the driver, nothing else does.
    """
    new = arrivals.where("chunk_id is not null").drop(*SET_BY_LOAD, "content_hash").withColumn("content_hash", F.sha2(F.coalesce("content", F.lit("")), 256))
    new = new.withColumn("row_hash", _row_hash(new, "chunk_id"))
    old = spark.read.parquet(f"{path}/chunks")
    keys = new.groupBy("chunk_id").agg(F.max("row_hash").alias("row_hash"))  # texts stay where they are
    known = old.select("chunk_id", F.col("row_hash").alias("was"), F.col("stale").alias("was_stale"))
    change = F.when(F.col("was").isNull(), "added").when((F.col("was") != F.col("row_hash")) | (F.col("was_stale") != 0), "updated").otherwise("same")
    delta = stored(keys.join(known, "chunk_id", "left").select("chunk_id", "row_hash", change.alias("change"), bucket_of(F.col("chunk_id"), buckets).alias("bucket")))
    some = delta.where("change <> 'same'")
    touched = sorted(r["bucket"] for r in some.select("bucket").distinct().collect())
    if touched:
        before = old.where(F.col("bucket").isin(touched))  # other folders are not read
        ids = some.select("chunk_id", "row_hash", "bucket")
        rows = new.join(ids, ["chunk_id", "row_hash"]).dropDuplicates(["chunk_id"])
        made = before.select("chunk_id", F.col("created_at").alias("made"))
        rows = rows.join(made, "chunk_id", "left").withColumn("created_at", F.coalesce("made", F.lit(now))).withColumn("stale", F.lit(0))
        merged = before.join(ids.select("chunk_id"), "chunk_id", "left_anti").select(*old.columns).unionByName(rows.select(*old.columns))
        _replace(stored(merged), f"{path}/chunks", "bucket")  # what is read is not what is replaced
    delta.select("chunk_id", F.lit(now).alias("last_verified")).write.mode("append").parquet(f"{path}/verified")
    return delta.select("chunk_id", "change")


# ---- licence partitions ----

TABLES = ("books", "chunks", "embeddings", "alignments")


def lay_out_parts(tables: dict[str, DataFrame], root: str) -> None:
    """Writes each table (with a column part) under root/name, a folder for each part."""
    for name, df in tables.items():
        df.repartition("part").write.partitionBy("part").parquet(f"{root}/{name}")


def read_part_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A laid-out table; a filter on part reads only its folders."""
    path = f"{root}/{name}"
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def part_counts(spark: SparkSession, root: str) -> DataFrame:
    """(table, part, n) of all laid-out tables."""
    out = None
    for name in TABLES:
        n = read_part_table(spark, root, name).groupBy("part").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "part", "n")
        out = n if out is None else out.unionByName(n)
    return out


def resplit(spark: SparkSession, root: str, *, source: str = "core", target: str = "ncsa", licence: str = "%NC%") -> DataFrame:
    """Moves the books of `source` whose licence is like `licence`, with their chunks, embeddings and alignments, to `target`.

    Folders of other parts are not read or written. Returns (table, part, before, moved, after, orphans, ok): orphans are chunks
    without their book in the part, embeddings and alignments without their chunk; ok if the counts differ by what moved and
    there are no orphans. A second run moves nothing and replaces nothing.
    """
    before = stored(part_counts(spark, root))
    here = {name: read_part_table(spark, root, name).where(F.col("part").isin(source, target)) for name in TABLES}
    books = stored(here["books"].where((F.col("part") == source) & F.col("license").like(licence)).select("book_id").distinct())
    chunks = stored(here["chunks"].where(F.col("part") == source).join(books, "book_id", "left_semi").select("chunk_id").distinct())
    moved = dict.fromkeys(TABLES, 0)
    for name in TABLES if not books.isEmpty() else ():
        key, ids = ("book_id", books) if name == "books" else ("chunk_id", chunks)
        df = here[name].join(ids.withColumn("_goes", F.lit(True)), key, "left").withColumn("_goes", F.coalesce("_goes", F.lit(False)) & (F.col("part") == source))
        df = stored(df.withColumn("part", F.when(F.col("_goes"), target).otherwise(F.col("part"))))
        moved[name] = df.where("_goes").count()
        if moved[name]:
            _replace(df.select(*here[name].columns), f"{root}/{name}", "part")
            if df.where(F.col("part") == source).isEmpty():  # nothing is left to replace the folder with
                _delete(spark, f"{root}/{name}/part={source}")
    moved = spark.createDataFrame(list(moved.items()), "table string, moved long")
    after = part_counts(spark, root).withColumnRenamed("n", "after")
    report = before.withColumnRenamed("n", "before").join(after, ["table", "part"], "full_outer").join(moved, "table").join(part_orphans(spark, root), ["table", "part"], "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    gain = F.when(F.col("part") == source, -F.col("moved")).when(F.col("part") == target, F.col("moved")).otherwise(0)
    report = report.select("table", "part", n("before").alias("before"), gain.cast("long").alias("moved"), n("after").alias("after"), n("orphans").alias("orphans"))
    return stored(report.withColumn("ok", (F.col("before") + F.col("moved") == F.col("after")) & (F.col("orphans") == 0)))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def part_orphans(spark: SparkSession, root: str) -> DataFrame:
    """(table, part, orphans): rows whose book or chunk is not in their part."""
    books, chunks, embeddings, alignments = (read_part_table(spark, root, name) for name in TABLES)
    lost = chunks.join(books.select("book_id", "part"), ["book_id", "part"], "left_anti").select(F.lit("chunks").alias("table"), "part")
    for name, df in (("embeddings", embeddings), ("alignments", alignments)):
        lost = lost.unionByName(df.select("chunk_id", "part").join(chunks.select("chunk_id", "part"), ["chunk_id", "part"], "left_anti").select(F.lit(name).alias("table"), "part"))
    return lost.groupBy("table", "part").agg(F.count("*").alias("orphans"))
