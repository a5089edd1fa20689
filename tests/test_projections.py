"""Hash tables of random projections: recall, work that grows with the rows, ids of any type."""

import numpy as np
import pytest
from test_search import brute_clusters, distances, frame, vectors

from corpusradar.operators import clusters as K
from corpusradar.operators import vectors as V
from corpusradar.operators.projections import Projections, hashed, plan_tables
from pyspark.sql import functions as F


def test_tables_are_planned_for_the_recall():
    for rows in (10, 10_000, 10_000_000, 10**12):
        plan = plan_tables(rows, 0.03)
        assert plan.recall(0.03) >= 0.999 and plan.tables <= 48 and plan.recall(0.01) > 0.9999
    assert plan_tables(10**6, 0.03).bits > plan_tables(10**4, 0.03).bits
    assert plan_tables(10**9, 1.9).bits == 1 and plan_tables(10**6, 0.0).tables == 1
    assert 0.2 < Projections(16, 1).recall(0.03) < 0.35


@pytest.mark.parametrize("recall", [0.9, 0.999])
def test_pairs_of_random_projections(spark, recall):
    m = vectors(700)
    d = distances(m)
    df = frame(spark, m)
    want = {(r["id_a"], r["id_b"]) for r in V.similarity_pairs(df, 0.05).collect()}
    rows = V.similarity_pairs(df, 0.05, method="projections", recall=recall).collect()
    got = [(r["id_a"], r["id_b"]) for r in rows]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= recall * len(want) and len(want) > 1000
    assert all(r["distance"] == d[r["id_a"], r["id_b"]] + 0.0 for r in rows)


def test_clusters_of_random_projections_over_string_ids(spark):
    m = vectors()
    df = frame(spark, m).withColumn("vec_id", F.format_string("2401.%05d", "vec_id"))
    want = brute_clusters(distances(m), 0.03, 2, 3)
    for method in ("exact", "projections"):
        got = {r["vec_id"]: r["cluster"] for r in K.density_clusters(df, 0.03, method=method, recall=0.99999).collect()}
        assert [got[f"2401.{i:05d}"] for i in range(len(m))] == want
    pairs = V.similarity_pairs(df, 0.03).collect()
    assert pairs and all(isinstance(r["id_a"], str) and r["id_a"] < r["id_b"] for r in pairs)


def test_work_grows_with_the_rows(spark):
    def compared(n):
        draw = F.array(*[F.randn(seed=i) for i in range(16)])
        rows = spark.range(n).select(F.col("id").alias("node"), draw.alias("embedding"))
        sizes = hashed(rows, plan_tables(n, 0.02)).groupBy("cell").count()
        return sizes.agg(F.sum(F.col("count") * F.col("count")), F.max("count")).first()

    small, large = compared(10_000), compared(100_000)
    assert large[0] < 10 ** 1.3 * small[0] and large[0] < 100_000 ** 2 / 20 and large[1] < 5_000, (small, large)


def test_a_hot_bucket_is_spread_and_bad_rows_do_not_matter(spark):
    m = vectors(300)
    rows = [(f"a{i}", [float(x) for x in v]) for i, v in enumerate(m)] + [("z", [1.0, 2.0]), ("n", None), ("o", [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    got = K.density_clusters(df.where("embedding IS NOT NULL AND size(embedding) = 6"), 0.03, method="projections").collect()
    assert len(got) == 301
    with pytest.raises(ValueError, match="no method"):
        V.similarity_pairs(df, 0.03, method="other")


def test_papers_with_string_ids_become_labelled_clusters(spark):
    """Feed rows to papers, vectors, clusters, themes and back to papers, with ids as a feed has them."""
    topics = ["graph neural network layers", "speech audio recognition models", "protein folding structure search"]
    feed = [(f"2401.{t * 40 + i:05d}", f"{topics[t]} part", f"{topics[t]} " * 6 + f"note {i % 4}", None, "2024-01-01") for t in range(3) for i in range(12)]
    papers = spark.createDataFrame(feed, "paper_id string, title string, abstract string, code string, published_at string").withColumn(
        "is_embedded", F.lit(False))
    found = V.embed_pending(papers)
    clusters = K.density_clusters(found, 0.05, id_col="paper_id", method="projections")
    themes = K.theme_labels(papers, clusters)
    labelled = K.assign_clusters(papers, clusters, themes).collect()
    assert len(labelled) == 36
    for t in range(3):
        mine = {(r["cluster_id"], r["cluster_theme"]) for r in labelled if topics[t] in r["title"]}
        assert len(mine) == 1 and mine.copy().pop()[0] == t and topics[t].split()[0].title() in mine.pop()[1]


def test_a_bucket_of_many_blocks_gives_every_pair_once(spark):
    """One bucket cut into blocks and rows in several tables: the pairs, counts and links of brute force, each pair once."""
    from corpusradar.operators import paired
    from corpusradar.operators.projections import bucket_pairs, crowded

    m = vectors(300)
    d = distances(m)
    rows = frame(spark, m).select(F.col("vec_id").alias("node"), F.format_string("a%03d", "vec_id").alias("rep"), "embedding")
    want = {(f"a{a:03d}", f"a{b:03d}") for a in range(300) for b in range(a + 1, 300) if d[a, b] <= 0.05}
    plan = Projections(1, 6)
    for block_rows in (7, 40, 4096):
        many = crowded(rows, plan, block_rows)
        got = [(r["id_a"], r["id_b"]) for r in bucket_pairs(rows, plan, many, 0.05, *paired.pair_rows("rep", "string")).collect()]
        assert len(got) == len(set(got)) and set(got) <= want and len(got) > 0.99 * len(want) and (many.count() == 0) == (block_rows == 4096)


def test_a_row_of_a_table_is_small(spark):
    """What is exchanged per row and table: vectors of counts are compressed, and all tables together are some bits."""
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.poisson(1.0, 128) / 11.3]) for i in range(200)], "node long, embedding array<double>")
    plan = Projections(9, 12)
    sizes = hashed(rows, plan).agg(F.max(F.octet_length("points") + F.octet_length("signs")), F.count("*")).first()
    assert sizes[0] < 400 and sizes[1] == 200 * 12  # 1,024 bytes of vector and 96 of keys uncompressed


def test_copies_collapse_as_in_a_grouping(spark):
    """Both zeros are one, NaN equals NaN, a missing number is neither; the lowest id stands for its copies."""
    nan = float("nan")
    rows = [("d", [0.0, 1.0]), ("b", [-0.0, 1.0]), ("c", [nan, 1.0]), ("a", [nan, 1.0]), ("e", [None, 1.0]), ("f", [None, 1.0]), ("g", None), (None, [2.0]), ("h", [])]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"paper_id string, embedding array<{kind}>")
        reps, members = V.collapse_copies(df, "paper_id")
        of = {r["node"]: (r["rep"], r["copies"]) for r in reps.collect()}
        assert sorted(of.values(), key=str) == sorted([("b", 2), ("a", 2), ("e", 2), (None, 1), ("h", 1)], key=str)
        assert sorted((str(r["member"]), str(of[r["node"]][0])) for r in members.collect()) == [
            ("None", "None"), ("a", "a"), ("b", "b"), ("c", "a"), ("d", "b"), ("e", "e"), ("f", "e"), ("h", "h")]
        assert dict(reps.dtypes)["embedding"] == f"array<{kind}>" and [r["node"] for r in reps.where("rep = 'a'").collect()] < [r["node"] for r in reps.where("rep = 'b'").collect()]


def test_packed_rows_come_back_as_they_were():
    from corpusradar.operators.blocks import packed_row, unpacked_row

    rng = np.random.default_rng(1)
    for row in (np.zeros(0), np.zeros(128), rng.poisson(2.0, 128) / 3.7, rng.normal(size=64), np.array([np.nan, 1.0] * 9), rng.integers(0, 255, 1000) * 0.1):
        for number in ("f4", "f8"):
            back = unpacked_row(packed_row(row.astype(number)), np.dtype(number))
            assert back.dtype == number and np.array_equal(back, row.astype(number), equal_nan=True)
