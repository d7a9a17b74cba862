"""The registered queries against their SQL, on the smallest tables where they are there."""

import math
import os

import pytest

import __spark_entry__ as entry

SMALL = os.environ.get("TRACEMILL_SMALL", "/root/testdata/sf0.001")
TABLES = "events documents embeddings passages qa_examples transitions episode_traces rollouts_for_grpo raw_records eval_items level_labels".split()
FEW = ("lexical_topk", "retrieval_eval", "preference_pairs", "env_summary", "p5_corpus", "p5_found", "p7_found", "validate_rows", "qa_ingest_examples", "log_metrics", "candidate_pool", "parse_agent_action")


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
@pytest.mark.parametrize("name", FEW)
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    cell = lambda x: "-" if x is None or (isinstance(x, float) and math.isnan(x)) else repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x)
    made = entry.queries()[name](spark, SMALL)
    wanted = con.sql(entry.oracle_sql()[name])
    columns = sorted(made.columns)
    assert columns == sorted(wanted.columns)
    got = sorted("|".join(cell(r[c]) for c in columns) for r in made.collect())
    want = sorted("|".join(cell(dict(zip(wanted.columns, r))[c]) for c in columns) for r in wanted.fetchall())
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
