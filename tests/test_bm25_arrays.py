"""BM25 summed as arrays agrees with the join by term, whatever ids repeat or are null; token counts meet by id."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusradar.operators import lexical as L
from corpusradar.operators.vectors import hashing_encoder

TEXTS = [(1, "a", "graph neural graph model"), (2, "a", "neural model"), (2, "a", "graph data"), (2, "b", "graph graph graph data of many words"),
         (None, "b", "neural data"), (None, None, "graph"), (3, None, "graph neural"), (4, "b", None), (5, "a", ""), (6, "b", "data data model"),
         (7, "a", "graph neural graph model"), (8, "a", "graph neural graph model")]
ASKED = [(10, "a", "graph model graph"), (11, "b", "data neural"), (None, "a", "neural"), (12, "a", "unknown words"), (13, None, "graph")]


def both(spark):
    corpus = spark.createDataFrame(TEXTS, "paper_id long, source string, text string").repartition(3)
    return spark.createDataFrame(ASKED, "query_id long, source string, query string"), corpus


@pytest.mark.parametrize("scope", [None, "source"])
@pytest.mark.parametrize("grid", [1, L.GRID])
def test_arrays_agree_with_the_join(spark, monkeypatch, scope, grid):
    queries, corpus = both(spark)
    monkeypatch.setattr(L, "MOST_QUERIES", 0)
    joined = L.bm25_score(queries, corpus, scope=scope)
    assert "MapInArrow" not in joined._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(map(repr, (tuple(r) for r in joined.select("query_id", "paper_id", "score").collect())))
    top = sorted(map(repr, (tuple(r) for r in L.bm25_topk(queries, corpus, 2, scope=scope).select("query_id", "paper_id", "score", "rank").collect())))
    monkeypatch.setattr(L, "MOST_QUERIES", 100)
    monkeypatch.setattr(L, "GRID", grid)
    arrays = L.bm25_score(queries, corpus, scope=scope)
    assert "MapInArrow" in arrays._jdf.queryExecution().optimizedPlan().toString()
    assert want and sorted(map(repr, (tuple(r) for r in arrays.select("query_id", "paper_id", "score").collect()))) == want
    assert sorted(map(repr, (tuple(r) for r in L.bm25_topk(queries, corpus, 2, scope=scope).select("query_id", "paper_id", "score", "rank").collect()))) == top


def test_texts_are_cut_once(spark):
    """The frequencies start from the stored postings, not from the texts again."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    queries, corpus = both(spark)
    corpus = corpus.mapInArrow(counted, corpus.schema)
    L.bm25_score(queries, corpus).collect()
    assert seen.value <= 3 * len(TEXTS)  # postings, and the number and length of texts


def test_no_question_finds_anything(spark):
    _, corpus = both(spark)
    none = spark.createDataFrame([(1, "zzz")], "query_id long, query string")
    assert L.bm25_topk(none, corpus, 3).count() == 0 == L.bm25_score(none, corpus).count()


def test_tokens_are_counted_before_any_exchange(spark):
    rows = [(1, "aa bb aa"), (1, "bb cc"), (2, ""), (None, "dd dd"), (3, None), (None, "aa")]
    vectors = hashing_encoder(spark.createDataFrame(rows, "id long, t string").repartition(4), "id", "t", 16)
    plan = vectors._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate explode" not in plan  # no row per token
    got = {r["id"]: [round(x, 9) for x in r["embedding"]] for r in vectors.collect()}
    bucket = F.conv(F.substring(F.md5("t"), 1, 4), 16, 10).cast("int") % 16
    at = {r["t"]: r["b"] for r in spark.createDataFrame([(t,) for t in ("aa", "bb", "cc", "dd")], "t string").select("t", bucket.alias("b")).collect()}
    for key, tokens in ((1, "aa bb aa bb cc"), (2, ""), (3, ""), (None, "dd dd aa")):
        want = [0] * 16
        for t in tokens.split():
            want[at[t]] += 1
        norm = sum(n * n for n in want) ** 0.5 or 1.0
        assert got[key] == [round(n / norm, 9) for n in want]
    assert len(got) == 4


def test_postings_cross_the_network_packed(spark):
    """One row per text and exchange, of a few bytes per asked term, also where every source is asked by every question."""
    words = [f"word{i}" for i in range(400)]
    texts = [(i, f"s{i % 3}", " ".join(words[(i * 7 + j * j) % 400] for j in range(300))) for i in range(60)]
    corpus = spark.createDataFrame(texts, "paper_id long, source string, text string").repartition(3)
    queries = spark.createDataFrame([(f"{q}/s{s}", f"s{s}", " ".join(words[q::5])) for q in range(5) for s in range(3)], "query_id string, source string, query string")
    asked = L._Asked(queries.select("query_id", "source", F.explode(F.split("query", " ")).alias("term"), F.lit(1).cast("bigint").alias("qtf")).toArrow(), "source")
    shared = spark.sparkContext.broadcast(asked)
    cut = corpus.select("paper_id", "source", F.split("text", " ").alias("t"))
    rows = cut.mapInArrow(L._pack_postings(shared), "paper_id bigint, source string, dl int, _post binary").collect()
    assert len(rows) == 60
    for r in rows:
        pair, tf = L._unpack([bytes(r["_post"])])
        want = {}
        for t in texts[r["paper_id"]][2].split():
            want[t] = want.get(t, 0) + 1
        place = len(asked.terms) * asked.scopes.to_pylist().index(r["source"])
        names = asked.terms.to_pylist()
        assert {names[asked.key[p] - place]: n for p, n in zip(pair, tf.tolist())} == want and r["dl"] == 300 and len(r["_post"]) < 3 * len(want) + 30
    pair, tf = L._unpack([L._pack(np.array([3, 70_000]), np.array([1, 300])), L._pack(np.array([0, 3]), np.array([2, 5]))])
    assert pair.tolist() == [0, 3, 70_000] and tf.tolist() == [2, 6, 300]


@pytest.mark.parametrize("grid", [1, L.GRID])
def test_many_questions_of_small_scopes_are_summed_without_a_join(spark, monkeypatch, grid):
    """What limits the arrays is the number of questions of a scope, not of all scopes together."""
    corpus = spark.createDataFrame([(t[0], f"s{s}", t[2]) for t in TEXTS for s in range(4)], "paper_id long, source string, text string").repartition(3)
    queries = spark.createDataFrame([(q[0], f"s{s}", q[2]) for q in ASKED for s in range(5)] + [(f"x{s}", f"s{s}", "graph data") for s in range(4)],
                                    "query_id string, source string, query string")
    got = {}
    for most in (0, 6):  # 6 questions of a scope, 8 in all
        monkeypatch.setattr(L, "MOST_QUERIES", most)
        monkeypatch.setattr(L, "GRID", grid)
        scored = L.bm25_score(queries, corpus, scope="source")
        assert ("MapInArrow" in scored._jdf.queryExecution().optimizedPlan().toString()) == (most > 0)
        best = L.bm25_topk(queries, corpus, 2, scope="source").select("query_id", "paper_id", "score", "rank")
        got[most] = [sorted(map(repr, (tuple(r) for r in df.collect()))) for df in (scored.select("query_id", "paper_id", "score"), best)]
    assert got[0] == got[6] and len(got[0][1]) > 8
