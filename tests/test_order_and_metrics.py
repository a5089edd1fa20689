import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusradar.operators import opsmetrics as O
from corpusradar.operators.ordered import median_by_count, with_last_known, with_previous
from corpusradar.operators.velocity import snapshot_deltas, velocity_score
from corpusradar.operators.clusters import global_rank


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [("hot" if i % 3 else f"k{i % 7}", i, rng.choice([None, rng.randint(0, 9)])) for i in range(600)]
    return spark.createDataFrame(data, "k string, o int, v int").cache()


def test_bucketed_lag_equals_plain_window(rows):
    got = with_previous(rows, ["k"], ["o"], F.floor(F.col("o") / 17), {"p": F.col("v")})
    want = rows.withColumn("p", F.lag("v").over(W.partitionBy("k").orderBy("o")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_bucketed_last_known_equals_plain_window(rows):
    got = with_last_known(rows, ["k"], ["o"], F.floor(F.col("o") / 5), {"p": F.col("v")})
    frame = W.partitionBy("k").orderBy("o").rowsBetween(W.unboundedPreceding, -1)
    want = rows.withColumn("p", F.last("v", ignorenulls=True).over(frame))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_median_by_count(rows):
    got = {r["k"]: r["m"] for r in median_by_count(rows, ["k"], "v", "m").collect()}
    data = {}
    for r in rows.collect():
        if r["v"] is not None:
            data.setdefault(r["k"], []).append(r["v"])
    assert got == {k: statistics.median(v) for k, v in data.items()}


def test_global_rank(spark, rows):
    ranked = global_rank(rows.select("o"), "o", "n").orderBy("o").collect()
    assert [r["n"] for r in ranked] == list(range(600))


def calls(spark, values, agent="a", success=True):
    t0 = datetime(2024, 1, 1)
    data = [(i, agent, t0 + timedelta(minutes=i * 7), float(v), success, False, False, "", "m", None) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "event_id long, agent string, ts timestamp, latency_s double, success boolean, guardrail boolean, "
                                       "fallback boolean, error string, model string, score double")


@pytest.mark.parametrize("n", [1, 10, 20, 100, 130])
def test_p95_item(spark, n):
    values = list(range(n))
    last = sorted(values[-100:])
    want = float(last[min(int(len(last) * 0.95), len(last) - 1)])
    assert O.latency_p95(calls(spark, values)).first()["p95_latency_s"] == want


def test_ewma_equals_sequential_fold(spark):
    rng = random.Random(5)
    values = [round(rng.expovariate(0.3), 2) for _ in range(400)]
    avg = 0.0
    for v in values:
        avg = int((v if avg == 0 else 0.3 * v + 0.7 * avg) * 10 + 0.5) / 10
    got = O.ewma_latency(calls(spark, values), segment_seconds=3600).first()
    assert got["calls"] == 400 and got["ewma_latency_s"] == pytest.approx(avg)
    first, rest = calls(spark, values[:150]), calls(spark, values).where("event_id >= 150")
    start = O.ewma_latency(first).select("agent", "ewma_latency_s")
    assert O.ewma_latency(rest, initial=start).first()["ewma_latency_s"] == pytest.approx(avg)


def test_velocity_quirks(spark):
    df = spark.createDataFrame([(700, None, None, None, 7.0), (0, 700, None, None, 7.0), (None, 5, 70, 0, 7.0), (10000, 0, 10000, 0, 0.0),
                                (None, None, None, None, 7.0)], "s int, ps int, c int, pc int, d double")
    v = velocity_score(F.col("s"), F.col("ps"), F.col("c"), F.col("pc"), F.col("d"))
    assert [r[0] for r in df.select(v).collect()] == [60.0, -60.0, 40.0, 100.0, 0.0]


def test_deltas_carry_known_values(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, 1, t, 10, None), (1, 2, t + timedelta(days=1), None, 4), (1, 3, t + timedelta(days=2), 25, 0), (1, 4, t + timedelta(days=3), 0, 9)]
    df = spark.createDataFrame(rows, "paper_id long, event_id long, ts timestamp, stars long, citations long")
    got = [(r["stars_delta"], r["citations_delta"], r["known_stars"], r["known_citations"]) for r in snapshot_deltas(df).orderBy("event_id").collect()]
    assert got == [(10, None, 10, None), (None, 4, 10, 4), (15, None, 25, 0), (None, 9, 0, 9)]
