"""Quality evaluation of scores, retrieval and answers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusradar import constants as C
from corpusradar.functions.scoring import generic_reason
from corpusradar.operators.ordered import median_by_count
from corpusradar.session import union_all


def range_misses(predictions: DataFrame, expected: DataFrame) -> DataFrame:
    """Labelled rows outside their range or without a prediction."""
    joined = expected.join(predictions, "paper_id", "left")
    return joined.where(~F.coalesce(F.col("score").between(F.col("lo"), F.col("hi")), F.lit(False)))


def range_accuracy(predictions: DataFrame, expected: DataFrame) -> DataFrame:
    """Share of ``expected(paper_id, lo, hi)`` whose ``score`` lies inside; rows without a prediction count as wrong."""
    joined = expected.join(predictions, "paper_id", "left")
    inside = F.coalesce(F.col("score").between(F.col("lo"), F.col("hi")), F.lit(False))
    return joined.agg(F.count("*").alias("labelled"), F.count_if(inside).alias("correct"),
                      F.round(F.count_if(inside) / F.count("*") * 100, 4).alias("accuracy"))


def discrimination_stats(scores: DataFrame) -> DataFrame:
    s = F.col("score")
    return scores.where(s.isNotNull()).agg(
        F.round(F.avg(s), 4).alias("mean"), F.round(F.stddev_pop(s), 4).alias("stdev"), F.min(s).alias("min"), F.max(s).alias("max"),
        F.count_if(s <= 4).alias("low"), F.count_if((s > 4) & (s <= 7)).alias("medium"), F.count_if(s > 7).alias("high"))


def precision_per_query(results: DataFrame, judgments: DataFrame, k: int = 5) -> DataFrame:
    """Relevant among the first ``k`` of ``results(query_id, doc_id, rank)`` over min(k, returned)."""
    top = results.where(F.col("rank") <= k)
    hits = judgments.select("query_id", "doc_id").distinct().withColumn("_hit", F.lit(1))
    return top.join(hits, ["query_id", "doc_id"], "left").groupBy("query_id").agg(
        F.round(F.count("_hit") / F.count("*"), 6).alias("precision"))


def precision_at_k(results: DataFrame, judgments: DataFrame, k: int = 5) -> DataFrame:
    """Mean precision over queries that returned something."""
    return precision_per_query(results, judgments, k).agg(
        F.count("*").alias("queries"), F.round(F.avg("precision"), 4).alias("precision_at_k"))


def answer_cites_source(answer: Column, first_title: Column) -> Column:
    """The first 30 characters of the first cited title occur in the answer, ignoring case."""
    head = F.substring(F.lower(first_title), 1, 30)
    return F.coalesce((head != "") & F.contains(F.lower(answer), head), F.lit(False))


def run_consistency(runs: DataFrame) -> DataFrame:
    """Difference of two scoring runs per paper of ``runs(paper_id, run, score)``; papers with both scores only."""
    both = runs.groupBy("paper_id").agg(F.max(F.when(F.col("run") == 1, F.col("score"))).alias("first"),
                                        F.max(F.when(F.col("run") == 2, F.col("score"))).alias("second"))
    delta = F.round(F.abs(F.col("first") - F.col("second")), 6)
    return both.where(delta.isNotNull()).select(
        "paper_id", delta.alias("delta"),
        F.when(delta <= 1.0, "consistent").when(delta <= 2.0, "moderate").otherwise("high variance").alias("band"))


def score_distribution(papers: DataFrame, phrases: Sequence[str] = C.GENERIC_REASON_PHRASES) -> DataFrame:
    """One row about analysed papers; zero scores are left out, as is ``has_code`` from the short projection."""
    s = F.when(F.col("overall_score") != 0, F.col("overall_score"))
    h = F.when(F.col("hype_score") != 0, F.col("hype_score"))
    generic = F.coalesce(generic_reason(F.col("hype_reason"), phrases), F.lit(False))
    code = F.coalesce(F.col("has_code"), F.lit(False)) if "has_code" in papers.columns else F.lit(False)
    median = median_by_count(papers.select(s.alias("score")), [], "score", "median").select("median")
    return papers.agg(
        F.count("*").alias("papers"), F.round(F.avg(s), 4).alias("mean"), F.round(F.stddev_pop(s), 4).alias("stdev"),
        F.min(s).alias("min"), F.max(s).alias("max"), F.count_distinct(F.round(s, 1)).alias("distinct_scores"),
        F.round(F.avg(h), 4).alias("hype_mean"), F.round(F.stddev_pop(h), 4).alias("hype_stdev"),
        F.round(F.count_if(generic) / F.greatest(F.count(h), F.lit(1)) * 100, 4).alias("generic_pct"),
        F.round(F.count_if(code) / F.count("*") * 100, 4).alias("code_pct"),
    ).select("*", F.round(median.scalar(), 4).alias("median"))


def share_by(papers: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Count and share in percent per value, most frequent first."""
    counts = papers.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(F.col(column).alias("value")).agg(F.count("*").alias("papers"))
    total = papers.select(F.count("*")).scalar()
    shares = counts.select("value", "papers", F.round(F.col("papers") / total * 100, 4).alias("share"))
    ordered = shares.orderBy(F.col("papers").desc(), "value")
    return ordered.limit(top) if top else ordered


def latency_status(requests: DataFrame, limits: Mapping[str, int] | None = None, default_ms: int = 3000) -> DataFrame:
    """Median and worst milliseconds per endpoint of ``requests(endpoint, ms)`` and whether the median is within its limit."""
    median = median_by_count(requests, ["endpoint"], "ms", "median_ms")
    worst = requests.groupBy("endpoint").agg(F.max("ms").alias("max_ms"), F.count("*").alias("requests"))
    limit = F.lit(default_ms)
    for name, ms in (limits or {}).items():
        limit = F.when(F.col("endpoint") == name, ms).otherwise(limit)
    return median.join(worst, "endpoint").select(
        "endpoint", "requests", "median_ms", "max_ms", F.when(F.col("median_ms") < limit, "ok").otherwise("slow").alias("status"))


def metric_rows(df: DataFrame, rows: Sequence[tuple[str, str, str, float | None]]) -> DataFrame:
    """Unpivot a one-row frame into ``(metric, value, status)``; a row is ``(label, column, '>=' or '<=', threshold)``."""
    items = []
    for label, column, op, threshold in rows:
        value = F.col(column).cast("double")
        good = None if threshold is None else (value >= threshold if op == ">=" else value <= threshold)
        status = F.lit("info") if good is None else F.when(good, "pass").otherwise("warn")
        items.append(F.struct(F.lit(label).alias("metric"), value.alias("value"), status.alias("status")))
    return df.select(F.inline(F.array(*items)))


def evaluation_report(accuracy: DataFrame, discrimination: DataFrame, precision: DataFrame, consistency: DataFrame,
                      distribution: DataFrame, gems: DataFrame) -> DataFrame:
    """All headline metrics with their thresholds."""
    mean_delta = consistency.agg(F.round(F.avg("delta"), 4).alias("delta"))
    parts = [
        metric_rows(accuracy, [("score accuracy", "accuracy", ">=", 70.0)]),
        metric_rows(discrimination, [("score discrimination", "stdev", ">=", 1.5)]),
        metric_rows(precision, [("precision at 5", "precision_at_k", ">=", 0.5)]),
        metric_rows(mean_delta, [("run difference", "delta", "<=", 1.0)]),
        metric_rows(distribution, [("papers analysed", "papers", "", None), ("score min", "min", "", None),
                                   ("score max", "max", "", None), ("score mean", "mean", "", None),
                                   ("papers with code %", "code_pct", "", None)]),
        metric_rows(gems.agg(F.count("*").alias("n")), [("hidden gems", "n", "", None)]),
    ]
    return union_all(*parts)
