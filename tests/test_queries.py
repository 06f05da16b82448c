"""Every registered query with SQL, side by side with DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    try:
        return round(float(v), 5)
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & set(entry.queries())))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rel = duck.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    key = lambda r: tuple(str(x) for x in r)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-5) if all(isinstance(x, float) for x in a) else all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5) for x, y in zip(a, b, strict=True))


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
