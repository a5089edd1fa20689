"""Operational metrics of model calls: ``calls(event_id, agent, ts, latency_s, success, guardrail, fallback, error, model, score)``.

"Last N" is a ranked window with ``<= N``, which Spark plans as a limit per group before the exchange, so a busy agent
ships N rows per task and not its history.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def newest() -> tuple[Column, Column]:
    return F.col("ts").desc(), F.col("event_id").desc()


def agent_counters(calls: DataFrame) -> DataFrame:
    """Counters, success rate, and the most recent non-empty error and model per agent."""

    def latest(name: str) -> Column:
        filled = F.coalesce(F.col(name), F.lit("")) != ""
        return F.max_by(F.col(name), F.when(filled, F.struct("ts", "event_id")))

    return calls.groupBy("agent").agg(
        F.count("*").alias("calls"), F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures"),
        F.count_if("guardrail").alias("guardrail_fails"), F.count_if("fallback").alias("fallbacks"),
        F.round(F.count_if("success") / F.count("*") * 100, 1).alias("success_rate"),
        F.coalesce(F.substring(latest("error"), 1, 200), F.lit("")).alias("last_error"),
        F.coalesce(latest("model"), F.lit("")).alias("last_model"))


def last_calls(calls: DataFrame, n: int) -> DataFrame:
    ranked = calls.withColumn("_recent", F.row_number().over(W.partitionBy("agent").orderBy(*newest())))
    return ranked.where(F.col("_recent") <= n).drop("_recent")


def latency_avg(calls: DataFrame, last: int = 100) -> DataFrame:
    return last_calls(calls, last).groupBy("agent").agg(F.round(F.avg("latency_s"), 1).alias("avg_latency_s"))


def latency_p95(calls: DataFrame, last: int = 100) -> DataFrame:
    """Item ``min(int(n * 0.95), n - 1)``, counted from 0, of the sorted last latencies."""
    lists = last_calls(calls, last).groupBy("agent").agg(F.sort_array(F.collect_list("latency_s")).alias("v"))
    n = F.size("v")
    return lists.select("agent", F.round(F.element_at("v", F.least(F.floor(n * 0.95).cast("int") + 1, n)), 1).alias("p95_latency_s"))


def score_stats(calls: DataFrame, last: int = 200) -> DataFrame:
    """Statistics of the last scores per agent; sample deviation, 0 for one score."""
    s = F.col("score")
    return last_calls(calls.where(s.isNotNull()), last).groupBy("agent").agg(
        F.round(F.avg(s), 2).alias("mean"), F.round(F.median(s), 2).alias("median"), F.round(F.min(s), 2).alias("min"),
        F.round(F.max(s), 2).alias("max"),
        F.when(F.count(s) > 1, F.round(F.stddev_samp(s), 2)).otherwise(0.0).alias("stdev"),
        F.count_if(s < 4).alias("skip"), F.count_if((s >= 4) & (s < 6)).alias("experiment"),
        F.count_if((s >= 6) & (s < 8)).alias("strong_experiment"), F.count_if(s >= 8).alias("adopt"))


def pipeline_rollup(runs: DataFrame, last: int = 100) -> DataFrame:
    """One row over ``runs(event_id, ts, success, latency_s)``: totals, success rate, mean latency of the last runs."""
    recent = runs.orderBy(*newest()).limit(last).agg(F.round(F.avg("latency_s"), 1).alias("v"))
    return runs.agg(
        F.count("*").alias("total_runs"), F.count_if("success").alias("successful_runs"),
        F.count_if(~F.col("success")).alias("failed_runs"),
        F.round(F.count_if("success") / F.greatest(F.count("*"), F.lit(1)) * 100, 1).alias("success_rate"),
    ).select("*", F.coalesce(recent.scalar(), F.lit(0.0)).alias("avg_total_latency_s"))


def health_flags(calls: DataFrame) -> DataFrame:
    """One row: scorer falling back often, hype model failing often, classifier answers failing checks."""
    of = lambda agent, cond: F.count_if((F.col("agent") == agent) & cond)
    yes = F.lit(True)
    counts = calls.agg(
        of("scorer", F.col("fallback")).alias("sf"), of("scorer", yes).alias("sn"),
        of("hype", ~F.col("success")).alias("hf"), of("hype", yes).alias("hn"),
        of("classifier", F.col("guardrail")).alias("cg"))
    issues = F.array_compact(F.array(
        F.when(F.col("sf") > F.col("sn") * 0.3, "scorer_fallbacks"),
        F.when((F.col("hf") > F.col("hn") * 0.5) & (F.col("hn") > 3), "hype_failures"),
        F.when(F.col("cg") > 5, "classifier_guardrails")))
    return counts.select((F.size(issues) == 0).alias("healthy"), issues.alias("issues"))


MOST_TENTHS = 1e12  # states and latencies end here (about 3,000 years)
CHUNK_ROWS = 512


def _smooth(state: np.ndarray, x: np.ndarray | float, alpha: float) -> np.ndarray:
    """One step on states in tenths; a state of zero takes the value as it is."""
    mixed = np.where(state == 0, x, alpha * x + (1 - alpha) * (state / 10.0))
    return np.floor(mixed * 10 + 0.5)


def _least_state(reach: np.ndarray, x: np.ndarray, alpha: float) -> np.ndarray:
    """Smallest state from 1 on that a step with ``x`` takes to ``reach`` or above."""
    guess = np.ceil(((reach - 0.5) / 10 - alpha * x) / (1 - alpha) * 10)
    start = np.clip(guess - 2, 1, None)  # the guess may be off by the rounding of doubles
    for _ in range(4):
        start = np.where(_smooth(start, x, alpha) < reach, start + 1, start)
    return start


def fading_length(alpha: float) -> int:
    """Values after which the largest state has faded to less than one tenth."""
    return int(np.ceil(np.log(MOST_TENTHS) / -np.log1p(-alpha)))


def fading_steps(chunks: list[np.ndarray], alpha: float) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """The running average over each chunk of values as a function of the state before it: ``(from_zero, starts, states)``.

    From 1 on the function never falls, and states that begin far apart end up a few tenths apart once enough values have
    passed. So its end points are carried forward, and only the few levels between them are traced back to where they begin.
    All chunks go through their values side by side. Work and size do not depend on how large the values are, provided that each
    chunk has the ``fading_length`` of values.
    """
    lengths = np.array([len(c) for c in chunks])
    values = np.full((lengths.max(), len(chunks)), np.nan)
    for i, c in enumerate(chunks):
        values[:len(c), i] = c
    ends = np.repeat([[0.0], [1.0], [MOST_TENTHS]], len(chunks), axis=1)
    for row in values:
        ends = np.where(np.isnan(row), ends, _smooth(ends, row, alpha))
    zero, low, high = ends
    levels = low + np.arange(1, int((high - low).max()) + 1)[:, None]
    starts = levels.copy()
    for row in values[::-1]:
        starts = np.where(np.isnan(row), starts, _least_state(starts, row, alpha))
    return [(zero[i], np.concatenate([[1.0], starts[levels[:, i] <= high[i], i]]), np.concatenate([[low[i]], levels[levels[:, i] <= high[i], i]]))
            for i in range(len(chunks))]


class _Stretch:
    """What one task knows of an agent: its first call, and either its few values or the function over them."""

    def __init__(self, agent, ts, event_id, alpha: float, least: int):
        self.first, self.alpha, self.least = (agent, ts, event_id), alpha, least
        self.n, self.raw, self.zero, self.starts, self.states = 0, np.empty(0), None, None, None

    def values(self, xs: np.ndarray) -> None:
        """Go on over few values one by one."""
        self.n += len(xs)
        if self.starts is None:
            self.raw = np.concatenate([self.raw, xs])
            if len(self.raw) >= self.least:
                self.zero, self.starts, self.states = fading_steps([self.raw], self.alpha)[0]
            return
        ends = np.concatenate([[self.zero], self.states])
        for x in xs:
            ends = _smooth(ends, x, self.alpha)
        self._take(ends[0], ends[1:])

    def chunk(self, n: int, zero: float, starts: np.ndarray, states: np.ndarray, xs: np.ndarray) -> None:
        """Go on over a chunk whose function is known."""
        if self.starts is None:
            if len(self.raw):
                self.values(xs)
            else:
                self.n, self.zero, self.starts, self.states = self.n + n, zero, starts, states
            return
        ends = np.concatenate([[self.zero], self.states])
        after = np.where(ends == 0, zero, states[np.clip(np.searchsorted(starts, ends, "right") - 1, 0, None)])
        self.n += n
        self._take(after[0], after[1:])

    def _take(self, zero: float, states: np.ndarray) -> None:
        keep = np.concatenate([[True], states[1:] != states[:-1]])
        self.zero, self.starts, self.states = zero, self.starts[keep], states[keep]

    def row(self) -> tuple:
        known = self.starts is not None
        return (*self.first, self.n, None if known else self.raw, self.zero, self.starts, self.states)


def ewma_latency(calls: DataFrame, alpha: float = 0.3, segment_seconds: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Running average of successful latencies per agent, rounded to one decimal at every step.

    The fold depends on order, yet a stretch of it is a function from the state before to the state after. Calls are sorted
    into ranges of (agent, time), so one busy agent is spread over many tasks. Each task returns one function per agent, of a
    few steps because old states fade (``fading_steps``), or the values themselves where they are too few to fade; these rows,
    at most one per agent and task, meet in order. ``initial(agent, ewma_latency_s)`` goes on from an earlier result.

    Latencies that are NULL, negative, not a number or beyond 1e11 s take no part. ``alpha`` lies between 0 and 0.5: above,
    a state of one tenth could fall back to zero and take the next value as it is. ``segment_seconds`` has no effect any more.
    """
    if not 0 < alpha <= 0.5:
        raise ValueError("alpha must lie above 0 and at most at 0.5")
    least = fading_length(alpha)
    chunk_rows = max(CHUNK_ROWS, 2 * least)
    good = calls.where(F.col("success") & F.col("latency_s").between(0, MOST_TENTHS / 10))
    kinds = {n: good.schema[n].dataType.simpleString() for n in ("agent", "ts", "event_id")}
    schema = (f"agent {kinds['agent']}, ts {kinds['ts']}, event_id {kinds['event_id']}, n bigint, raw array<double>, zero double, "
              "starts array<double>, states array<double>")
    names = ["agent", "ts", "event_id", "n", "raw", "zero", "starts", "states"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stretch, done = None, []
        for pdf in batches:
            agents, xs = pdf["agent"].to_numpy(dtype=object), pdf["latency_s"].to_numpy(dtype=float)
            cuts = np.flatnonzero(np.concatenate([[True], agents[1:] != agents[:-1]])) if len(xs) else np.empty(0, int)
            parts = [(a, min(a + chunk_rows, b)) for first, b in zip(cuts, [*cuts[1:], len(xs)]) for a in range(first, b, chunk_rows)]
            long = [(a, b) for a, b in parts if b - a >= least]
            functions = dict(zip(long, fading_steps([xs[a:b] for a, b in long], alpha))) if long else {}
            for a, b in parts:
                if stretch is None or stretch.first[0] != agents[a]:
                    if stretch is not None:
                        done.append(stretch.row())
                    stretch = _Stretch(agents[a], pdf["ts"].iloc[a], pdf["event_id"].iloc[a], alpha, least)
                if (a, b) in functions:
                    stretch.chunk(b - a, *functions[a, b], xs[a:b])
                else:
                    stretch.values(xs[a:b])
            if len(done) >= 1000:
                yield pd.DataFrame(done, columns=names)
                done = []
        if stretch is not None:
            yield pd.DataFrame([*done, stretch.row()], columns=names)

    order = ["agent", "ts", "event_id"]
    ready = good.where(F.col("agent").isNotNull()).select(*order, F.col("latency_s").cast("double").alias("latency_s"))
    stretches = ready.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(fold, schema)
    ordered = stretches.groupBy("agent").agg(F.sum("n").alias("calls"), F.sort_array(F.collect_list(
        F.struct("ts", "event_id", "raw", "zero", "starts", "states"))).alias("parts"))

    def step(state: Column, x: Column) -> Column:
        mixed = F.when(state == 0, x).otherwise(F.lit(alpha) * x + F.lit(1 - alpha) * (state / 10.0))
        return F.floor(mixed * 10 + 0.5).cast("double")

    def go_on(state: Column, part: Column) -> Column:
        table = F.when(state == 0, part["zero"]).otherwise(
            F.element_at(part["states"], F.greatest(F.size(F.filter(part["starts"], lambda s: s <= state)), F.lit(1))))
        return F.when(part["raw"].isNull(), table).otherwise(F.aggregate(part["raw"], state, step))

    start = F.lit(0.0)
    if initial is not None:
        ordered = ordered.join(initial.select("agent", F.round(F.col("ewma_latency_s") * 10).alias("_start")), "agent", "left")
        start = F.coalesce("_start", F.lit(0.0))
    return ordered.select("agent", "calls", (F.aggregate("parts", start, go_on) / 10).alias("ewma_latency_s"))


def warm_status(calls: DataFrame, as_of: Column, seconds: int = 1500) -> DataFrame:
    """Warm while the last success is at most ``seconds`` before ``as_of``."""
    last = calls.groupBy("agent").agg(F.max(F.when(F.col("success"), F.unix_timestamp("ts"))).alias("last_success"))
    ago = as_of - F.col("last_success")
    return last.select("agent", "last_success", F.coalesce(ago <= seconds, F.lit(False)).alias("is_warm"))
