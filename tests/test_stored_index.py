"""A stored index holds what the texts of a chunk share once and reads back as it was."""

import os

import numpy as np
from pyspark.sql import functions as F

from corpusradar.operators.chunking import store_index
from corpusradar.plans import retrieve as R
from corpusradar.session import shared_folder, stored


def bytes_below(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder.removeprefix("file://")) for f in names)


def test_texts_of_a_chunk_are_stored_once(spark):
    rng = np.random.default_rng(3)
    raw = [" ".join("".join(map(chr, rng.integers(97, 123, 7))) for _ in range(400)) for _ in range(60)]
    rows = [(f"{i}", "[S | Page 1]\n" + r, r, f"tail of the one before [...] {r}") for i, r in enumerate(raw)]
    rows += [("odd", "text", "other", "third"), ("n1", None, "x", "x"), ("n2", "x", None, "x"), ("n3", "ax", "x", None), ("e", "", "", "abc"), ("n3", "ax", "x", None)]
    index = spark.createDataFrame(rows, "chunk_id string, text string, raw_text string, raw_text_ctx string")
    before = bytes_below(shared_folder(spark))
    kept = store_index(index)
    used = bytes_below(shared_folder(spark)) - before
    assert kept.columns == index.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, index.collect()))
    assert used < 1.5 * sum(map(len, raw))  # the three texts are three times as much
    assert stored(index.where("false")).count() == 0


def test_the_pool_of_a_search_leaves_out_contexts(spark, monkeypatch):
    """Texts that only the answer shows are not kept per question, and tables of texts and vectors are stored compressed."""
    kept = []
    monkeypatch.setattr(R, "stored", lambda df: kept.append(df.columns) or stored(df))
    chunks = spark.createDataFrame([(f"1_b{i}", 1, i, f"graph model {i}", 1, "Intro", 0, "text", False, False, False, f"graph model {i}", f"c graph model {i}") for i in range(6)],
                                   "chunk_id string, paper_id long, position int, text string, page int, section string, section_order int, type string, has_math boolean, "
                                   "has_list boolean, is_caption boolean, raw_text string, raw_text_ctx string")
    papers = spark.createDataFrame([(1, "abstract one"), (2, "abstract two")], "paper_id long, abstract string")
    queries = spark.createDataFrame([(7, 1, "what is the graph model"), (8, 2, "what is it about")], "query_id long, paper_id long, query string")
    got = {r["query_id"]: r for r in R.multi_query_merge(queries, chunks, papers).collect()}
    assert got[7]["mode"] == "deep" and "graph model 3" in got[7]["context"] and got[8]["mode"] == "abstract" and "abstract two" in got[8]["context"]
    pools = [c for c in kept if "fetch_n" in c]
    assert len(pools) == 1 and "raw_text" in pools[0] and "raw_text_ctx" not in pools[0] and ["chunk_id", "paper_id", "embedding"] in kept
    assert R.multi_query_merge(queries, chunks, papers).select(F.count("*")).first()[0] == 2
