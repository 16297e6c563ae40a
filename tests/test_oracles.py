"""Every registered query of the corpus operators against its DuckDB SQL."""

import duckdb
import pytest

from lodestone.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations region nation customer supplier part orders lineitem events".split()


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, DIR).toPandas()
    assert len(found)
    if name in registry.SQL:
        assert rows(found) == rows(duck.execute(registry.SQL[name]).df())
