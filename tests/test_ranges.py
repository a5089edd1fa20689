"""Look-back and medians over sampled ranges: any id and time type, one key with all rows."""

import random
import statistics

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusradar.operators.ordered import in_ranges, median_by_count, with_last_known, with_previous
from corpusradar.operators.sessions import job_transitions


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small data would end up in one range."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    data = [("hot" if i % 4 else f"k{i % 9}", f"2024-{i:05d}", rng.choice([None, rng.randint(0, 50)])) for i in range(800)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, o string, v int").cache()


def same(got, want):
    return sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_one_key_is_spread(spark, rows):
    hot = in_ranges(rows.where("k = 'hot'"), ["k"], ["o"]).groupBy("_bucket").agg(F.count("*").alias("n"), F.min("o").alias("a"), F.max("o").alias("b"))
    parts = hot.orderBy("_bucket").collect()
    assert len(parts) == 4 and max(p.n for p in parts) < 300
    assert all(x.b < y.a for x, y in zip(parts, parts[1:]))


def test_previous_by_string_order(rows):
    got = with_previous(rows, ["k"], ["o"], None, {"p": F.col("v")})
    assert same(got, rows.withColumn("p", F.lag("v").over(W.partitionBy("k").orderBy("o"))))


def test_last_known_by_string_order(rows):
    got = with_last_known(rows, ["k"], ["o"], None, {"p": F.col("v")})
    frame = W.partitionBy("k").orderBy("o").rowsBetween(W.unboundedPreceding, -1)
    assert same(got, rows.withColumn("p", F.last("v", ignorenulls=True).over(frame)))


def test_transitions_with_numbers_as_time(spark):
    events = [(1, i, i, s) for i, s in enumerate(["running", "done", "running", "failed", "done"])]
    got = job_transitions(spark.createDataFrame(events, "job_id int, event_id int, ts int, status string"))
    assert [(r.event_id, r.previous, r.status) for r in got.orderBy("event_id").collect()] == [(1, "running", "done"), (3, "running", "failed")]


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_medians(spark, keys):
    rng = random.Random(2)
    data = [(rng.choice(["hot", "hot", "hot", "b", "c", None]), rng.choice([None, 0.0, rng.random() * 1000, -5.0])) for _ in range(3001)]
    data += [("one", 4.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    groups = {}
    for k, v in data:
        if v is not None:
            groups.setdefault(k if keys else 0, []).append(v)
    got = median_by_count(spark.createDataFrame(data, "k string, v double"), keys, "v", "m").collect()
    assert {(r.k if keys else 0): r.m for r in got} == {k: statistics.median(v) for k, v in groups.items()}


def test_median_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert median_by_count(empty, ["k"], "v", "m").collect() == []
    assert [r.m for r in median_by_count(empty, [], "v", "m").collect()] == [None]
