"""A sample of registered queries against their SQL; ``python tests/oracle.py`` runs all of them."""

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

SF = "/root/testdata/sf0.001"
SAMPLE = ["hidden_gems", "analyze_corpus", "snapshot_deltas", "agent_counters", "evaluation_report", "theme_labels", "ingest_audit",
          "build_sessions", "caption_boost", "pair_rerank", "retrieve_context", "stream_agent_metrics", "stream_velocity",
          "stream_job_transitions", "stream_ewma", "upsert_analysis_stored", "embed_pending_stored", "replace_partition_stored",
          "latency_status", "score_distribution", "job_transitions", "score_velocity"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, con, name):
    problem, rows = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert problem is None and rows > 0


def test_every_family_is_registered():
    names = entry.queries()
    assert len(names) > 130 and set(entry.oracle_sql()) <= set(names)


def test_entry(spark):
    assert {"query_id", "context", "citations"} == set(entry.entry(spark).columns)
