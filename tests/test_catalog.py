import duckdb
import pytest

import __spark_entry__
from corvane import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    return round(x, 6) + 0.0 if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    rel = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in order) for r in df.collect()]
    want = [tuple(plain(r[rel.columns.index(c)]) for c in order) for r in rel.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "rank", "doc_id", "score", "included"] and df.count() > 0


def test_every_query_has_a_name_of_its_own():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
