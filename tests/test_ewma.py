"""The running average as functions that fade, against the plain fold."""

import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusradar.operators import opsmetrics as O

SCHEMA = "event_id long, agent string, ts timestamp, latency_s double, success boolean"


def fold(values, state=0.0, alpha=0.3):
    for x in values:
        state = float(np.floor((x if state == 0 else alpha * x + (1 - alpha) * (state / 10.0)) * 10 + 0.5))
    return state


def at(function, state):
    zero, starts, states = function
    return zero if state == 0 else states[np.searchsorted(starts, state, "right") - 1]


latency = st.one_of(st.just(0.0), st.floats(0, 2), st.floats(0, 1e6), st.sampled_from([0.04, 0.05, 0.55, 1.25, 1e11]))


@settings(max_examples=80, deadline=None)
@given(st.lists(latency, min_size=80, max_size=140), st.lists(latency, min_size=80, max_size=90), st.sampled_from([0.05, 0.3, 0.5]),
       st.lists(st.integers(0, 200) | st.integers(0, 10**11), min_size=1, max_size=20))
def test_function_equals_fold(first, second, alpha, starts):
    n = O.fading_length(alpha)
    chunks = [np.resize(first, max(n, len(first))), np.resize(second, max(n, len(second)))]
    for values, function in zip(chunks, O.fading_steps(chunks, alpha)):
        for state in (0, 1, 2, *starts):
            assert at(function, state) == fold(values, float(state), alpha)


@pytest.mark.parametrize("level", [0.0, 0.05, 3.15, 1e6])
def test_functions_stay_small_and_their_levels_begin_right(level):
    rng = random.Random(1)
    values = np.array([level * rng.choice([1, 1, 1, 1.01]) for _ in range(300)])
    zero, starts, states = O.fading_steps([values], 0.3)[0]
    assert len(starts) <= 8
    for s, out in zip(starts, states):
        assert fold(values, s) == out and (s == 1 or fold(values, s - 1) < out)


def frame(spark, rows):
    t0 = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, a, t0 + timedelta(seconds=s), x, ok) for i, (a, s, x, ok) in enumerate(rows)], SCHEMA)


def expected(rows):
    got = {}
    for i, (a, s, x, ok) in sorted(enumerate(rows), key=lambda r: (r[1][1], r[0])):
        if ok and a is not None and x is not None and 0 <= x <= 1e11:
            got.setdefault(a, []).append(x)
    return {a: (len(v), fold(v) / 10) for a, v in got.items()}


def result(df):
    return {r["agent"]: (r["calls"], r["ewma_latency_s"]) for r in df.collect()}


@pytest.mark.parametrize("partitions", [1, 7])
def test_many_and_hot_agents(spark, partitions, monkeypatch):
    rng = random.Random(partitions)
    rows = [("hot" if i % 3 else f"a{rng.randint(0, 40)}", rng.randint(0, 9000), rng.choice([0.0, rng.expovariate(0.3), 1e6 * (i == 500)]),
             rng.random() < 0.9) for i in range(9000)]
    rows += [("odd", 1, None, True), ("odd", 2, float("nan"), True), ("odd", 3, -1.0, True), ("odd", 4, 1.23, True), ("odd", 5, 1e300, True),
             (None, 1, 2.0, True), ("failed", 1, 2.0, False)]
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        assert result(O.ewma_latency(frame(spark, rows))) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_and_start(spark):
    none = frame(spark, [("a", 1, 2.0, False)])
    assert result(O.ewma_latency(none)) == {}
    rows = [("a", i, float(i % 7), True) for i in range(300)]
    start = spark.createDataFrame([("a", 4.2), ("b", 1.0)], "agent string, ewma_latency_s double")
    assert result(O.ewma_latency(frame(spark, rows), initial=start)) == {"a": (300, fold([r[2] for r in rows], 42.0) / 10)}
    with pytest.raises(ValueError):
        O.ewma_latency(none, alpha=0.9)


def test_a_huge_value_costs_nothing():
    rng = np.random.default_rng(0)
    chunks = [rng.exponential(3, 512) for _ in range(2000)]
    began = time.time()
    O.fading_steps(chunks, 0.3)
    usual = time.time() - began
    chunks[7][100] = 1e6
    chunks[8][511] = 1e6
    began = time.time()
    O.fading_steps(chunks, 0.3)
    assert time.time() - began < 3 * usual + 0.5
