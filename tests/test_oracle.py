"""Every registered query of the library equals its SQL in DuckDB on the given tables."""

import math
import os

import duckdb
import pytest

from tidewatch.plans import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return (1, "")
    if isinstance(x, bool):
        return (0, str(x))
    if isinstance(x, (int, float)):
        return (0, f"{float(x):.5f}".replace("-0.00000", "0.00000"))
    return (0, str(x))


def table(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    got = table(df.collect(), df.columns)
    if name not in registry.ORACLE_SQL:
        assert got
        return
    cur = db.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = table(cur.fetchall(), names)
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    assert not bad, bad[:3]
