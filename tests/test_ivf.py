"""Inverted lists: recall, lists read, ids of any type."""

import numpy as np
from test_search import distances, frame, vectors

from corpusradar.operators import vectors as V
from corpusradar.operators.ivf import build_lists, search_lists
from pyspark.sql import functions as F


def test_recall_and_exact_distances(spark, tmp_path):
    m = vectors(1500, 12, 4)
    d = distances(m)
    df = frame(spark, m).withColumn("vec_id", F.format_string("v%05d", "vec_id"))
    index = build_lists(df, str(tmp_path / "lists"), "vec_id")
    assert index.lists().select("list").distinct().count() > 20 and index.lists().count() == 1500
    asked = df.where("vec_id < 'v00050'").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in search_lists(index, asked, 10, 6).collect():
        q, v = int(r["query_id"][1:]), int(r["vec_id"][1:])
        assert r["distance"] == d[q, v] + 0.0
        got.setdefault(q, {})[r["rank"]] = v
    want = {q: set(sorted(range(1500), key=lambda i: (d[q, i], i))[:10]) for q in range(50)}
    assert np.mean([len(want[q] & set(got[q].values())) / 10 for q in range(50)]) >= 0.9
    one = search_lists(index, asked.limit(1), 10, 2)
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull" in plan or "list#" in plan.split("PartitionFilters", 1)[1][:200]


def test_no_rows_and_few_rows(spark, tmp_path):
    df = frame(spark, vectors(100, 3)[:3])
    asked = df.withColumnRenamed("vec_id", "query_id")
    got = V.knn_approx(asked, df, 10, n_probe=8, id_col="vec_id")
    assert got.groupBy("query_id").count().where("count = 3").count() == 3
    assert V.knn_approx(asked.where("false"), df, 10, id_col="vec_id").count() == 0
