"""Every query that has SQL, against DuckDB on the smallest tables."""

import math
from pathlib import Path

import pytest

from lectern.plans import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    def plain(v):
        if hasattr(v, "item"):
            v = v.item()
        if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>"):
            return "-"
        return f"{v:.6f}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(plain(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test tables here")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_oracle(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, str(DATA)).toPandas()) == rows(duck.execute(catalog.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_other_queries_run(spark, duck, name):
    assert catalog.QUERIES[name](spark, str(DATA)).count() > 0


def test_entry_and_names():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
