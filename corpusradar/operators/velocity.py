"""Growth of papers over snapshots of stars and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusradar import constants as C
from corpusradar.operators.ordered import with_last_known


def velocity_score(stars: Column, prev_stars: Column, citations: Column, prev_citations: Column,
                   days: Column | float = C.VELOCITY_WINDOW_DAYS) -> Column:
    """Weighted growth per day on a scale to 100; no lower bound, unknown current values count as no growth."""
    days = days if isinstance(days, Column) else F.lit(float(days))
    span = F.greatest(F.when(days <= 0, 1.0).otherwise(days), F.lit(1.0))

    def pace(now: Column, before: Column, full: float) -> Column:
        return F.when(now.isNull(), 0.0).otherwise(
            F.least((now - F.coalesce(before, F.lit(0))) / span / full, F.lit(1.0)))

    total = (C.STAR_WEIGHT * pace(stars, prev_stars, C.STARS_PER_DAY_FULL)
             + C.CITATION_WEIGHT * pace(citations, prev_citations, C.CITATIONS_PER_DAY_FULL))
    return F.round(F.least(total * 100, F.lit(100.0)), 2)


def snapshot_deltas(snapshots: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Change of each snapshot against the last known values; NULL where the current value is NULL or 0.

    ``snapshots(paper_id, event_id, ts, stars, citations)``; the history of a busy paper is cut by ``bucket``, or into ranges.
    """
    known = with_last_known(
        snapshots, ["paper_id"], ["ts", "event_id"], bucket,
        {"prev_stars": F.col("stars"), "prev_citations": F.col("citations")})

    def delta(now: str, before: str) -> Column:
        return F.when(F.col(now) != 0, F.col(now) - F.coalesce(F.col(before), F.lit(0)))

    return known.select(
        "paper_id", "event_id", "ts", "stars", "citations", "prev_stars", "prev_citations",
        delta("stars", "prev_stars").alias("stars_delta"), delta("citations", "prev_citations").alias("citations_delta"),
        F.coalesce("stars", "prev_stars").alias("known_stars"), F.coalesce("citations", "prev_citations").alias("known_citations"))


def score_velocity(papers: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Latest growth per paper of ``papers(paper_id, repo_url)``; without a repository only citations count."""
    deltas = snapshot_deltas(snapshots)
    fields = ["ts", "stars", "prev_stars", "citations", "prev_citations", "stars_delta", "citations_delta", "known_stars",
              "known_citations"]
    latest = deltas.groupBy("paper_id").agg(F.max_by(F.struct(*fields), F.struct("ts", "event_id")).alias("last"))
    joined = papers.select("paper_id", F.col("repo_url").isNotNull().alias("has_repo")).join(latest, "paper_id")
    star = {n: F.when(F.col("has_repo"), F.col(f"last.{n}")) for n in ("stars", "prev_stars", "stars_delta", "known_stars")}
    return joined.select(
        "paper_id", "has_repo", star["known_stars"].alias("stars"), F.col("last.known_citations").alias("citations"),
        star["stars_delta"].alias("stars_delta"), F.col("last.citations_delta").alias("citations_delta"),
        velocity_score(star["stars"], star["prev_stars"], F.col("last.citations"), F.col("last.prev_citations"))
        .alias("velocity_score"))
