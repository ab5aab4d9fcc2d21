"""The embedding of pending chunks against its SQL on texts whose words cancel out, blank ones and rows without an id."""

import duckdb

import __spark_entry__ as entry


def test_every_text_that_is_not_blank_is_embedded(spark, tmp_path):
    pairs = [f"w{i} x{i}" for i in range(600)]  # the signed counts of about one in 128 of these are all zero
    odd = ["", " \t\n", " " * 2500 + "late", " ", "\x0b", None, "one"]
    texts = [t for t in [*pairs, *odd] for _ in range(3)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)] + [(None, "no id", "en", "web", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("e1_pending_inputs", "e3_embed_pending"):
        got = sorted(tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect())
        assert got == sorted(con.sql(entry.oracle_sql()[name]).fetchall())
