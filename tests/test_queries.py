"""Every registered query with SQL against DuckDB at the smallest size."""

import os

import duckdb
import pandas as pd
import pytest

from scholia.plans import queries, source_queries  # noqa: F401  both register
from scholia.plans import registry as Q
from scholia.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canon(df: pd.DataFrame) -> pd.DataFrame:
    cols = sorted(df.columns)

    def one(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "~"
        return repr(round(float(v), 9)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    return df[cols].map(one).sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, db, name):
    got = Q.queries()[name](spark, SF).toPandas()
    if name in Q.oracle_sql():
        assert canon(got).equals(canon(db.sql(Q.oracle_sql()[name]).df()))
