"""Driver queries against their SQL at the smallest scale. PARCHMENT_ALL=1 runs every one of them."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"
QUICK = [
    "paginate", "combine_documents", "upsert_delete", "chunks", "section_carry", "query_coverage", "vector_topk",
    "pii_hits", "pii_redacted", "figure_candidates", "verified_items", "citation_check", "previous_question", "history_plan",
    "prompt_table", "feedback_state", "metric_summary", "quota_decisions", "rate_limited", "entitlements",
    "subscription_state", "live_links", "intent_features", "routed_messages", "stream_metric_summary",
]
NAMES = list(oracle_sql()) if os.environ.get("PARCHMENT_ALL") else QUICK
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    cur = con.execute(oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cur.fetchall())


def test_entry(spark):
    assert entry(spark).columns == ["query_id", "doc_id", "chunk_idx", "score", "lexical_rank"]


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_works_without_the_training_data_operators():
    """The subpackage and the pipeline are optional: without them every other query is still there."""
    import subprocess
    import sys

    code = (
        "import sys; sys.modules['parchment.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; names = e.queries(); assert 'bm25_topk' in names and set(e.oracle_sql()) <= set(names)\n"
        "assert not any(n.startswith('op1') or n == 'pipeline' for n in names)"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)
