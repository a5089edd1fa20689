"""Hard negatives and ranked search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusradar.llm import hard_negatives, ranked_search
from corpusradar.llm.hard_negatives import Settings
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, uid string, tile string, score string"


def brute_negatives(rows, is_anchor, rule):
    taken = []
    for vec_id, vec, label, *_ in rows:
        if label is not None and vec is not None and all(x is not None and math.isfinite(x) for x in vec):
            taken.append((vec_id, label, [math.floor(rule.scale * float(np.float32(x))) for x in vec]))
    key = lambda s, row: (-s, row[0] is None, row[0] or 0)
    out = []
    for i, (anchor, label, vec) in enumerate(taken):
        if not is_anchor(anchor):
            continue
        scored = [(sum(a * b for a, b in zip(vec, r[2])), r) for j, r in enumerate(taken) if j != i and len(r[2]) == len(vec)]
        positives = sorted(((s, r) for s, r in scored if r[1] == label), key=lambda x: key(*x))[:rule.positives]
        for ps, p in positives:
            fit = [(s, r) for s, r in scored if r[1] != label and rule.low * ps <= 100 * s <= rule.high * ps]
            for rank, (s, r) in enumerate(sorted(fit, key=lambda x: key(*x))[:rule.negatives], 1):
                out.append((anchor, p[0], rank, r[0], ps, s))
    return Counter(out)


def vectors(seed, n, dims, labels, step):
    draw = random.Random(seed)
    rows = [(i, [draw.randint(-4, 4) * step for _ in range(dims)], draw.randrange(labels), "x", "y", "z") for i in range(n)]
    rows += [(500 + i, [1.0] * dims, i % 2, None, None, None) for i in range(n // 3)]  # many equal rows
    return rows


ODD = [(None, [1.0, 1.0, 0.5], 1, None, None, None), (7, None, 1, None, None, None), (8, [1.0, None, 2.0], 1, None, None, None),
       (9, [1.0, float("nan"), 2.0], 1, None, None, None), (10, [1.0, float("inf"), 2.0], 1, None, None, None), (11, [1.0, 1.0, 2.0], None, "a", "b", "c"),
       (12, [], 1, None, None, None), (13, [], 0, None, None, None), (14, [2.0, 1.0], 1, None, None, None), (15, [1.0, 2.0], 0, None, None, None),
       (0, [1.0, 1.0, 1.0], 0, None, None, None), (0, [1.0, 1.0, 1.0], 0, None, None, None)]


@pytest.mark.parametrize("case", [dict(dims=3, labels=2, step=0.5), dict(dims=2, labels=40, step=1.0)])
def test_hard_negatives_equal_brute_force(spark, case):
    rows = vectors(case["dims"], 150, case["dims"], case["labels"], case["step"]) + ODD
    rule = Settings(tile_rows=32, leaf_rows=4, fanout=3, round_anchors=40, positives=3, negatives=4)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = hard_negatives.hard_negatives(df, anchors=F.col("vec_id") % 5 == 0, rule=rule)
    assert Counter(map(tuple, got.collect())) == brute_negatives(rows, lambda i: i is not None and i % 5 == 0, rule)


def test_null_id_anchors_large_components_and_nothing(spark):
    rows = [*ODD, (20, [3e6, -2e6, 1e6], 0, None, None, None), (21, [3e6, -2e6, 1e6], 0, None, None, None), (22, [2.9e6, -2e6, 1e6], 1, None, None, None)]
    df = spark.createDataFrame(rows, VECTORS)
    got = hard_negatives.hard_negatives(df)
    assert Counter(map(tuple, got.collect())) == brute_negatives(rows, lambda i: True, Settings())
    assert hard_negatives.hard_negatives(df.where("false")).count() == 0
    assert hard_negatives.hard_negatives(df, anchors=F.lit(None).cast("boolean")).count() == 0


def test_hard_negatives_agree_with_sql(spark):
    from oracle import compare, duck

    problem, rows = compare(hard_negatives.query(spark, SF), duck(SF), hard_negatives.SQL)
    assert problem is None and rows > 0


def test_boxes_shut_most_rows_out_where_vectors_cluster():
    """A tight window opens few leaves: the queue skips boxes, it does not scan."""
    draw = np.random.default_rng(5)
    vec = np.round(draw.normal(size=(4096, 2)) * 3000).astype(np.int64)
    import pyarrow as pa

    n = len(vec)
    table = pa.table({"uid": np.arange(n), "id": np.arange(n), "label": np.arange(n) % 2, "vec": pa.array(list(vec), pa.list_(pa.int64())),
                      "anchor": np.zeros(n, bool)})
    tile = hard_negatives._Tile(hard_negatives._pack(table, Settings(leaf_rows=32)).to_pylist()[0])
    opened = []

    class Counting(hard_negatives._Best):
        def offer(self, score, ids, uid):
            opened.append(len(score))
            super().offer(score, ids, uid)

    q = np.array([1000.0, 500.0])
    best = Counting(-(1 << 62), 1 << 62, 5)
    hard_negatives._walk([tile], np.array([math.inf]), np.array([-math.inf]), q, 0, 0, False, [best])
    scores = vec @ q.astype(np.int64)
    want = sorted(((-s, i) for i, s in enumerate(scores.tolist()) if i % 2 != 0))[:5]
    assert [(-s, i) for s, i in zip(best.score.tolist(), best.id.tolist())] == want
    assert sum(opened) < n // 8


TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(FOLD))


def brute_ranks(items, docs, k):
    counts = [(doc_id, Counter(terms_of(text))) for doc_id, text, *_ in docs]
    counts = [(doc_id, c) for doc_id, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text, *_ in items:
        asked.setdefault(item, Counter()).update(terms_of(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc_id, c in counts:
            m = 100 - 25 + 25 * c.total() * n_docs // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t, q in wanted.items() if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item, rank, doc_id, -s) for rank, (s, _, doc_id) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return Counter(out)


ITEMS = [(1, "Alpha beta beta gamma"), (2, ""), (3, None), (4, "\u00e9t\u00e9 na\u00efve x1"), (None, "alpha delta"), (5, "unknownword"), (1, "beta omega"),
         (6, "the " * 500 + "cat"), (6, "the cat"), (7, "--- !!!")]


def corpus(n):
    draw = random.Random(11)
    known = ["alpha", "Beta", "gamma", "delta", "omega", "the", "cat", "\u00e9t\u00e9", "na\u00efve", "x1", "other", "words", "\u00c9T\u00c9"]
    docs = [(i, " ".join(draw.choices(known, k=draw.randint(0, 30)))) for i in range(n)]
    docs += [(3, "alpha,beta;gamma"), (None, "alpha-beta gamma"), (901, None), (902, ""), (903, "..."), (904, "alpha " * 40_000 + "beta")]
    return docs + [(1000 + i, "same copy of the cat alpha") for i in range(60)]


@pytest.mark.parametrize("rule", [ranked_search.Settings(k=7, block_postings=6, grid=64), ranked_search.Settings()])
def test_ranked_search_equals_brute_force(spark, rule):
    docs = corpus(120)
    items = spark.createDataFrame([(*i, "x", "y") for i in ITEMS], "item_id int, text string, score string, rank string")
    table = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, n string, id string").repartition(5)
    got = ranked_search.ranked(items, table, rule=rule)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute_ranks(ITEMS, docs, rule.k)


def test_ranked_search_of_nothing_and_string_ids(spark):
    items = spark.createDataFrame([("a", "x y"), ("b", "z")], "item_id string, text string")
    docs = spark.createDataFrame([("p", "x"), ("o", "x"), (None, "x"), ("q", "y z z")], "doc_id string, text string")
    got = [tuple(r)[:3] for r in ranked_search.ranked(items, docs).orderBy("item_id", "rank").collect()]
    assert got[-1] == ("b", 1, "q") and [x[2] for x in got if x[2] != "q"] == ["o", "p", None]
    assert ranked_search.ranked(items, docs.where("false")).count() == 0
    assert ranked_search.ranked(items.where("false"), docs).count() == 0
    assert ranked_search.ranked(items, docs.select("doc_id", F.lit("...").alias("text"))).count() == 0


def test_terms_that_share_a_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(ranked_search, "span_hashes", lambda octets, starts, ends: np.zeros(len(starts), np.uint64))
    known = ranked_search.Vocabulary([b"one", b"two", b"three"])
    text = np.frombuffer(b"two one twos threx three", np.uint8)
    starts, ends, _ = ranked_search.words(text, np.array([0, len(text)]), ranked_search.GAP)
    assert len(known.tables) == 3 and known.find(text, starts, ends).tolist() == [1, 0, -1, -1, 2]


def test_large_scores_and_lengths_stay_exact():
    tf, n = np.array([1, 7, 2_000_000_000]), np.array([1, 10**9, 4 * 10**9])
    docs, terms = 10**10, 3 * 10**19
    want = [10**9 * int(t) // (1000 * int(t) + 12 * (75 + 25 * int(x) * docs // terms)) for t, x in zip(tf, n, strict=True)]
    assert ranked_search.parts(tf, n, docs, terms).tolist() == want


def test_ranked_search_agrees_with_sql(spark):
    from oracle import compare, duck

    problem, rows = compare(ranked_search.query(spark, SF), duck(SF), ranked_search.SQL)
    assert problem is None and rows > 0
