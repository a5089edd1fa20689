"""Metadata of search hits: only rows that were found leave the metadata, with the rows of a plain left join."""

import pytest

from corpusradar.operators import vectors as V


@pytest.mark.parametrize("named", [10_000, 1])
def test_only_found_texts_are_exchanged(spark, monkeypatch, named):
    monkeypatch.setattr(V, "NAMED_IDS", named)
    hits = spark.createDataFrame([(1, 5, 1), (1, 7, 2), (2, 5, 1), (2, None, 2), (3, 99, 1)], "query_id long, paper_id long, rank int")
    papers = [(i, f"t{i}") for i in range(20)] + [(7, "twice"), (None, "nobody")]
    papers = spark.createDataFrame(papers, "paper_id long, title string")
    joined = papers.join(spark.createDataFrame([(5, 1.5)], "paper_id long, overall_score double"), "paper_id", "left")
    rows = V.with_metadata(hits, joined)
    got = sorted((r["query_id"], -1 if r["paper_id"] is None else r["paper_id"], r["title"], r["overall_score"]) for r in rows.collect())
    assert got == [(1, 5, "t5", 1.5), (1, 7, "t7", 0.0), (1, 7, "twice", 0.0), (2, -1, "Unknown", 0.0), (2, 5, "t5", 1.5), (3, 99, "Unknown", 0.0)]
    if named > 1:  # the filter stands below the join of the metadata, on either side
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(" IN (") + plan.count(" INSET ") >= 2
