"""Every query of the catalogue against its SQL, and plans of the SQL-only ones."""

import duckdb
import pytest

from weftline import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return "None"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, sf, sql, name):
    df = queries.QUERIES[name](spark, sf)
    cur = sql.execute(queries.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(map(plain, r)) for r in cur.fetchall())
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_does_not_sort_all(spark, sf):
    assert "TakeOrderedAndProject" in plan(queries.QUERIES["keep_top"](spark, sf))


def test_filters_reach_the_scan(spark, sf):
    assert "EqualTo(o_orderstatus,F)" in plan(queries.QUERIES["filter_exact"](spark, sf))


def test_no_python_in_sql_queries(spark, sf):
    for name in ("segment_rows", "top_chunks", "word_count", "majority_vote", "prompt_truncate", "page_text"):
        assert "Python" not in plan(queries.QUERIES[name](spark, sf)) and "Pandas" not in plan(queries.QUERIES[name](spark, sf))
