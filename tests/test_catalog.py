import os

import duckdb
import pandas as pd
import pytest

from perilmap.plans import catalog, charts, files, reports  # noqa: F401 - all register their queries with the catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shape(df: pd.DataFrame) -> list:
    cell = lambda x: None if pd.isna(x) else round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(repr([cell(x.item() if hasattr(x, "item") else x) for x in row]) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def test_every_query_has_sql():
    assert catalog.QUERIES.keys() == catalog.ORACLE_SQL.keys()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), con.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and shape(got) == shape(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 63
