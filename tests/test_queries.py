"""Every registered query against its SQL on the smallest tables, the way the driver compares them."""

import math

import duckdb
import pytest

from kestrix import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows):
    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6) + 0.0
        return float(v) if type(v).__name__ == "Decimal" else v

    return sorted((tuple(cell(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    mine = [tuple(r[c] for c in names) for r in df.collect()]
    got = duck.execute(ORACLE[name])
    at = {d[0]: i for i, d in enumerate(got.description)}
    assert sorted(at) == names
    theirs = [tuple(r[at[c]] for c in names) for r in got.fetchall()]
    a, b = plain(mine), plain(theirs)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert len(x) == len(y)
        for u, v in zip(x, y):
            assert u == v or isinstance(u, (int, float)) and isinstance(v, (int, float)) and math.isclose(u, v, rel_tol=1e-6, abs_tol=2e-6), (x, y)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).limit(5).collect() is not None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("value, at_7", [("35", "c0 v"), ("-35", "c0 v"), ("15", "c0 m"), ("60", "v c0"), ("'NaN'", "v c0"), ("NULL", "c0 m")])
def test_explained_parts_rank_as_in_sql(value, at_7, spark, tmp_path):
    """With each remainder: 35 * 0.04 and 7 * 0.2 tie in floats only, NaN is largest, a missing part is last."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT event_id, {value}::DOUBLE AS value FROM range(13) t(event_id)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    mine = [tuple(r) for r in QUERIES["explain_topk"](spark, str(tmp_path)).collect()]
    assert plain(mine) == plain(con.execute(ORACLE["explain_topk"]).fetchall())
    assert " ".join(r[2] for r in sorted(mine) if r[0] == 7) == at_7
