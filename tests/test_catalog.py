"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from cairn.plans.catalog import ORACLE_SQL, QUERIES

SF = os.environ.get("CAIRN_SF", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _key(v):
    return (v is None, round(v, 5) + 0.0 if isinstance(v, float) else v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: [str(_key(v)) for v in r])


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and abs(float(a) - float(b)) <= 2e-6 * max(1.0, abs(float(b)))
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLE_SQL[name])
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert got_names == want_names
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want, strict=True) if not all(same(x, y) for x, y in zip(g, w, strict=True))]
    assert not bad, bad[:3]
