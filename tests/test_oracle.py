"""Every query that has SQL gives the same rows in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return repr(v)


def rows(found, names):
    return sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    want = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), names)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["segment_id", "doc_id", "bm25_score"] and df.count() == 10


def test_merge_plan(spark, sf):
    got = entry.queries()["merge_plan"](spark, sf).collect()
    assert got and len({r.segment_id for r in got}) == len(got)


def test_stream_equals_batch(spark, sf):
    q = entry.queries()
    stream = q["stream_ingest_search"](spark, sf).collect()
    batch = q["search_top10"](spark, sf).collect()
    assert sorted(r.bm25_score for r in stream) == sorted(r.bm25_score for r in batch)
