"""The stored index gives what scoring all postings gives, and reads less."""

import random

from pyspark.sql import functions as F

from corpusradar.operators import inverted
from corpusradar.operators.inverted import build_index, candidates, needed_blocks, search
from corpusradar.operators.lexical import bm25_topk


def corpus(n, seed=3):
    draw = random.Random(seed)
    common = ["data", "model", "paper"]
    rare = [f"term{i}" for i in range(300)]
    texts = []
    for _ in range(n):
        words = draw.choices(common, k=draw.randint(3, 30)) + [draw.choice(rare) for _ in range(draw.randint(0, 6))]
        draw.shuffle(words)
        texts.append(" ".join(words))
    return texts + ["", "one"] + ["data data data model"] * 40


def test_searches_equal_full_scoring(spark, tmp_path):
    texts = corpus(900)
    docs = spark.createDataFrame([(f"d{i:04d}", t) for i, t in enumerate(texts)] + [("null", None)], "paper_id string, text string")
    index = build_index(docs, str(tmp_path / "index"), block_rows=16, buckets=8)
    asked = [(1, "data term7 term8"), (2, "term42 term42 paper model"), (3, "unknown"), (4, "one data"), (5, ""), (6, "data")]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    for k in (1, 5, 40):
        want = bm25_topk(queries, docs, k)
        assert sorted(map(tuple, search(index, queries, k).select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    two = queries.where("query_id = 2")  # texts that only have the common words cannot be among the best
    matching = bm25_topk(two, docs, 10_000).count()
    assert matching > 900 and candidates(needed_blocks(index, two, 2)).count() < 50
    one = queries.where("query_id = 6")  # and of a common word alone only its best blocks are needed
    assert needed_blocks(index, one, 1).count() < index.read("blocks").where("term = 'data'").count() / 2


def test_blocks_are_bounded_and_only_asked_buckets_are_read(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus(600))], "paper_id long, text string")
    index = build_index(docs, str(tmp_path / "index"), block_rows=16, buckets=8)
    sizes = index.read("blocks").selectExpr("max(size(rows))", "count(*)").first()
    assert sizes[0] <= 48 and sizes[1] > 100
    plan = needed_blocks(index, spark.createDataFrame([(1, "term5")], "query_id int, query string"), 3)._jdf.queryExecution().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "rows" in line]
    assert scans and all("bucket" in line and "IN" in line.upper() or "PartitionFilters" in line for line in scans)


def test_an_empty_corpus_finds_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, "")], "paper_id long, text string")
    index = build_index(docs, str(tmp_path / "index"))
    assert search(index, spark.createDataFrame([(1, "term5")], "query_id int, query string"), 3).count() == 0


def test_questions_together_and_one_by_one_agree(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus(500))], "paper_id long, text string")
    index = build_index(docs, str(tmp_path / "index"), block_rows=16, buckets=8)
    queries = spark.createDataFrame([("a", "data term7"), ("b", "term42 paper model model"), ("c", "")], "query_id string, query string")
    together = search(index, queries, 7)
    plan = together._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Exchange hashpartitioning(id") == 1  # a posting crosses once, without a row per question
    monkeypatch.setattr(inverted, "MOST_QUERIES", 0)
    apart = search(index, queries, 7)
    assert together.schema.names == apart.schema.names == ["query_id", "paper_id", "score", "rank"]
    assert sorted(map(tuple, together.collect())) == sorted(map(tuple, apart.collect()))


def test_blocks_are_cut_across_batches(spark, tmp_path):
    """Blocks hold each posting once whatever the Arrow batches, and their maxima are those of their rows."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus(200))], "paper_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        index = build_index(docs, str(tmp_path / "index"), block_rows=16, buckets=8)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    blocks, post = index.read("blocks"), index.read("postings")
    assert blocks.count() == blocks.select("term", "level", "part").distinct().count()
    flat = blocks.selectExpr("term", "level", "explode(rows) AS r").selectExpr("term", "level", "r.id", "r.dl", "r.tf")
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, post.select("term", "level", "paper_id", "dl", "tf").collect()))
    tops = {(r["term"], r["level"]): r["m"] for r in post.groupBy("term", "level").agg(F.max("impact").alias("m")).collect()}
    assert tops == {(r["term"], r["level"]): r["m"] for r in blocks.groupBy("term", "level").agg(F.max("top").alias("m")).collect()}
