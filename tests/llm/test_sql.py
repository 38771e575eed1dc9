import duckdb
import pytest

from corvane.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, rel = queries.QUERIES[name](spark, sf_dir), c.sql(queries.ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(rel.columns)
    assert sorted(tuple(r[x] for x in order) for r in df.collect()) == sorted(tuple(r[rel.columns.index(x)] for x in order) for r in rel.fetchall())
