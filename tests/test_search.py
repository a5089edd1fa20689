import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from corpusradar.operators import fusion as X
from corpusradar.operators.clusters import density_clusters
from corpusradar.operators.lexical import bm25_score, expand_query, named_entities
from corpusradar.operators.vectors import nearest, similarity_pairs


def vectors(n=160, dims=6, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dims))
    out = base[rng.integers(0, 12, n)] + rng.normal(scale=0.12, size=(n, dims))
    out /= np.linalg.norm(out, axis=1, keepdims=True)
    out[5], out[9], out[77] = out[3], out[3], out[3]
    return out


def frame(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")


def distances(m):
    return np.round(1 - m @ m.T, 6)


def test_nearest_equals_brute_force(spark):
    m = vectors()
    d = distances(m)
    df = frame(spark, m)
    got = {}
    for r in nearest(df.withColumnRenamed("vec_id", "query_id"), df, 7, "cosine", "vec_id").collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for q in range(len(m)):
        want = sorted(range(len(m)), key=lambda i: (d[q, i], i))[:7]
        assert [got[q][k] for k in range(1, 8)] == want


def test_pairs_are_complete_and_copies_linear(spark):
    m = vectors()
    d = distances(m)
    got = {(r["id_a"], r["id_b"]) for r in similarity_pairs(frame(spark, m), 0.05, pivots=5).collect()}
    copies = {5, 9, 77}
    want = {(a, b) for a in range(len(m)) for b in range(a + 1, len(m)) if d[a, b] <= 0.05 and not {a, b} & copies}
    assert got == want | {(3, 5), (3, 9), (3, 77)}


def brute_clusters(d, eps, min_samples, min_size):
    n = len(d)
    near = [[j for j in range(n) if j != i and d[i, j] <= eps] for i in range(n)]
    core = [len(x) >= min_samples for x in near]
    label = {}
    for s in range(n):
        if core[s] and s not in label:
            stack = [s]
            while stack:
                x = stack.pop()
                if x not in label:
                    label[x] = s
                    stack += [y for y in near[x] if core[y]]
    for i in range(n):
        links = [j for j in near[i] if core[j]]
        if not core[i] and links:
            label[i] = label[min(links, key=lambda j: (d[i, j], j))]
    groups = {}
    for i, root in label.items():
        groups.setdefault(root, []).append(i)
    big = sorted((min(g), g) for g in groups.values() if len(g) >= min_size)
    out = [-1] * n
    for k, (_, g) in enumerate(big):
        for i in g:
            out[i] = k
    return out


def test_density_clusters_equal_brute_force(spark):
    m = vectors()
    for eps in (0.01, 0.03):
        got = {r["vec_id"]: r["cluster"] for r in density_clusters(frame(spark, m), eps, pivots=4).collect()}
        assert [got[i] for i in range(len(m))] == brute_clusters(distances(m), eps, 2, 3)


def test_too_few_rows_are_noise(spark):
    rows = density_clusters(frame(spark, vectors()[:5]), 0.5).collect()
    assert {r["cluster"] for r in rows} == {-1} and len(rows) == 5


def test_bm25_equals_plain_python(spark):
    rng = random.Random(1)
    docs = [" ".join(rng.choice(["alpha", "beta", "gamma", "x-y", "a", "Delta", "."]) for _ in range(rng.randint(3, 20))) for _ in range(25)]
    query = "Alpha alpha x-y delta unknown"
    tok = lambda s: re.findall("[a-z0-9_-]{2,}", s.lower())
    avgdl = sum(len(d.split()) for d in docs) / len(docs)
    df = {}
    for d in docs:
        for w in set(tok(d)):
            df[w] = df.get(w, 0) + 1
    want = {}
    for i, d in enumerate(docs):
        words, s = tok(d), 0.0
        for w in tok(query):
            if w in words:
                tf = words.count(w)
                s += math.log((25 - df[w] + .5) / (df[w] + .5) + 1) * tf * 2.5 / (tf + 1.5 * (.25 + .75 * len(words) / avgdl))
        if any(w in words for w in tok(query)):
            want[i] = round(s, 6)
    corpus = spark.createDataFrame(list(enumerate(docs)), "paper_id long, text string")
    queries = spark.createDataFrame([(1, query)], "query_id long, query string")
    got = {r["paper_id"]: r["score"] for r in bm25_score(queries, corpus).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got)


def ranks(spark, ids):
    return spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(ids)], "query_id long, doc string, rank int")


def test_rrf_is_symmetric_and_boosts_multiply(spark):
    a, b = ranks(spark, "abc"), ranks(spark, "cd")
    left = {r["doc"]: r["score"] for r in X.rrf_fuse(a, b, "doc").collect()}
    assert left == {r["doc"]: r["score"] for r in X.rrf_fuse(b, a, "doc").collect()}
    assert left["c"] == round(1 / 63 + 1 / 61, 9)
    flags = spark.createDataFrame([("a", True, True), ("b", False, False), ("c", False, False), ("d", False, False)],
                                  "doc string, has_list boolean, is_caption boolean")
    q = spark.createDataFrame([(1, "what are the main plots in the figure by BERT")], "query_id long, query string")
    got = {r["doc"]: r["score"] for r in X.fuse_with_boosts(q, a, b, flags, "doc").collect()}
    assert got["a"] == round(round(1 / 61, 9) * 1.5 * 1.6, 9) and got["d"] == round(1.4 / 62, 9)


def test_entities_and_expansion(spark):
    df = spark.createDataFrame([("Does FlashMix beat BERT, LoRA or laDeCo in ÉCOLE?",)], "q string")
    assert df.select(named_entities(F.col("q"))).first()[0] == ["BERT", "FlashMix"]
    q = spark.createDataFrame([("How is the method?",), ("nothing",)], "q string")
    assert [r[0] for r in q.select(expand_query(F.col("q"))).collect()] == [
        "How is the method? approach algorithm technique methodology procedure mechanism process steps procedure implementation", "nothing"]


def test_neighbors_stop_after_the_pair_that_reaches_the_cap(spark):
    pool = spark.createDataFrame([(1, f"c{i}", i, "S" if i < 20 else "T") for i in range(30)], "query_id long, chunk_id string, position int, section string")
    chosen = spark.createDataFrame([(1, f"c{p}", r) for r, p in enumerate([3, 10, 15, 19], 1)], "query_id long, chunk_id string, rank int")
    got = [r["chunk_id"] for r in X.neighbor_expand(chosen, pool, "chunk_id").orderBy("rank").collect()]
    assert got == ["c2", "c4", "c9", "c11"]
    edge = [r["chunk_id"] for r in X.neighbor_expand(chosen.where("rank = 4"), pool, "chunk_id").collect()]
    assert edge == ["c18"]


def test_context_announces_a_section_once(spark):
    hits = spark.createDataFrame([(1, 1, "A", 1, "x", 0.5), (1, 2, "A", 2, "y", 1.9), (1, 3, "B", 2, "z", 1.0), (1, 4, "A", 1, "w", 0.1)],
                                 "query_id long, position int, section string, page int, context_text string, distance double")
    assert X.assemble_context(hits).first()["context"] == "── A ──\nx\n\n── B ──\nz\n\nw"
    got = [(r["type"], r["value"]) for r in X.context_citations(hits).orderBy("citation_no").collect()]
    assert got == [("page", "1"), ("section", "A"), ("page", "2"), ("section", "B")]


def test_empty_rerank_keeps_order_for_short_lists(spark):
    c = spark.createDataFrame([(1, "a", "q words", "nothing", 1), (1, "b", "q words", "words", 2)], "query_id long, doc string, query string, text string, rank int")
    assert [r["doc"] for r in X.pair_rerank(c, "doc", F.lit(2)).orderBy("rank").collect()] == ["a", "b"]
    assert [r["doc"] for r in X.pair_rerank(c, "doc", F.lit(1)).orderBy("rank").collect()] == ["b"]
