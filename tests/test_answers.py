"""Limits of dense search, texts where nothing is found, clamped answers."""

import json

from test_search import distances, frame, vectors

from corpusradar import constants as C
from corpusradar.functions import guards as G
from corpusradar.operators import fusion as X
from corpusradar.operators.vectors import dense_retrieve
from pyspark.sql import functions as F


def test_dense_search_of_some_papers(spark):
    m = vectors(120)
    d = distances(m)
    df = frame(spark, m).withColumnRenamed("vec_id", "paper_id")
    queries = df.where("paper_id < 4").withColumnRenamed("paper_id", "query_id")
    papers = spark.createDataFrame([(0, 50), (0, 60), (0, 7), (1, 90), (2, 9999)], "query_id long, paper_id long")
    meta = spark.createDataFrame([(7, "seven")], "paper_id long, title string")
    got = {}
    for r in dense_retrieve(queries, df, meta, 2, 3.0, papers).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["paper_id"], r["distance"], r["title"])
    near = sorted((50, 60, 7), key=lambda i: (d[0, i], i))[:2]
    assert [got[0][k][0] for k in (1, 2)] == near and got[1] == {1: (90, d[1, 90] + 0.0, "Unknown")}
    assert 2 not in got  # its papers have no vectors
    assert [got[3][k][0] for k in (1, 2)] == sorted(range(120), key=lambda i: (d[3, i], i))[:2]


def test_questions_without_papers_get_a_text(spark):
    kind = ("query_id long, intent string, place int, source string, title string, paper_url string, overall_score double, action string, "
            "sources array<string>, abstract string, summary string, stack_fit string, score_reasoning string")
    papers = spark.createDataFrame([(1, "factual", 1, "dense", "T", "u", 7.0, "adopt", ["dense"], "x" * 500, None, None, None)], kind)
    got = {r["query_id"]: r["context"] for r in X.paper_context(papers, spark.createDataFrame([(1,), (2,)], "query_id long"), abstract_chars=5).collect()}
    assert got[2] == C.NO_PAPERS_TEXT and "Abstract: xxxxx\n" in got[1] and X.paper_context(papers).count() == 1


def test_answers_come_out_clamped(spark):
    raw = [('{"score": 12.5, "other": {"a": [1, "x"]}, "text": "q\\"q", "low": -3}',), ('{"score": 4, "low": "n/a", "other": null}',), ("broken",), (None,)]
    df = spark.createDataFrame(raw, "raw string")
    checked = G.run_guardrails(F.col("raw"), ["score"], {"score": (0, 10), "low": (1, 5)})
    out = [r[0] for r in df.select(checked["output"]).collect()]
    assert json.loads(out[0]) == {"score": 10, "other": {"a": [1, "x"]}, "text": 'q"q', "low": 1}
    assert json.loads(out[1])["score"] == 4 and json.loads(out[1])["low"] == "n/a" and out[2] is None
