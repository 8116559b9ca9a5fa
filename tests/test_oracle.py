"""Registered queries against their SQL on the smallest tables.

Set EVIDAR_ALL_QUERIES=1 to run every registered query.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"
QUICK = [
    "tokenize", "infer_title", "expand_queries", "bm25_topk", "phrase_bonus", "evenly_spaced", "expand_neighbours", "segment_runs", "chunk_sections",
    "assemble_lines", "subset_cover", "parse_structured", "session_counters", "pair_source_views", "finalize_sessions", "valid_citations", "triage_jobs",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return connection


def names():
    every = sorted(entry.oracle_sql()) if os.environ.get("EVIDAR_ALL_QUERIES") else QUICK
    return every


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, db, name):
    got = entry.queries()[name](spark, SF).toArrow()
    want = db.execute(entry.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows_of(got) == rows_of(want)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["query_id", "mode", "chunk_id", "rank", "score", "adjacent", "strategy"] and out.count() > 0
