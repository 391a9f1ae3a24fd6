"""Every query of the subpackage that has SQL equals it in DuckDB on the given tables."""

import os

import duckdb
import pytest

from tidewatch.llm import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=key) == sorted(cur.fetchall(), key=key)
