"""Growth queries."""

from pyspark.sql import functions as F

from corpusradar.operators.velocity import score_velocity, snapshot_deltas, velocity_score
from corpusradar.registry import query
from corpusradar.registry.sqlviews import view

view("known", """
SELECT *, last_value(stars IGNORE NULLS) OVER w AS prev_stars, last_value(citations IGNORE NULLS) OVER w AS prev_citations
FROM snapshots WINDOW w AS (PARTITION BY paper_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
     "snapshots")
VELOCITY = """CAST(round(least((0.6::DOUBLE * CASE WHEN {s} IS NULL THEN 0.0 ELSE least(({s} - coalesce({ps}, 0)) / {d} / 100.0::DOUBLE, 1.0) END
 + 0.4::DOUBLE * CASE WHEN {c} IS NULL THEN 0.0 ELSE least(({c} - coalesce({pc}, 0)) / {d} / 10.0::DOUBLE, 1.0) END) * 100, 100.0), 2) AS DOUBLE)"""


@query("velocity_score", f"""
SELECT event_id, {VELOCITY.format(s='stars', ps='prev_stars', c='citations', pc='prev_citations', d='7.0::DOUBLE')} AS velocity,
       {VELOCITY.format(s='stars', ps='prev_stars', c='citations', pc='prev_citations', d='1.0::DOUBLE')} AS velocity_one_day
FROM known""", "known")
def _(t):
    d = snapshot_deltas(t.snapshots)
    args = [F.col(c) for c in ("stars", "prev_stars", "citations", "prev_citations")]
    return d.select("event_id", velocity_score(*args).alias("velocity"), velocity_score(*args, F.lit(0.0)).alias("velocity_one_day"))


@query("snapshot_deltas", """
SELECT paper_id, event_id, CASE WHEN stars <> 0 THEN stars - coalesce(prev_stars, 0) END AS stars_delta,
       CASE WHEN citations <> 0 THEN citations - coalesce(prev_citations, 0) END AS citations_delta,
       coalesce(stars, prev_stars) AS known_stars, coalesce(citations, prev_citations) AS known_citations FROM known""", "known")
def _(t):
    return snapshot_deltas(t.snapshots).select(
        "paper_id", "event_id", "stars_delta", "citations_delta", "known_stars", "known_citations")


@query("score_velocity", f"""
SELECT paper_id, repo_url IS NOT NULL AS has_repo, CASE WHEN repo_url IS NOT NULL THEN coalesce(stars, prev_stars) END AS stars,
       coalesce(citations, prev_citations) AS citations,
       CASE WHEN repo_url IS NOT NULL AND stars <> 0 THEN stars - coalesce(prev_stars, 0) END AS stars_delta,
       CASE WHEN citations <> 0 THEN citations - coalesce(prev_citations, 0) END AS citations_delta,
       {VELOCITY.format(s='(CASE WHEN repo_url IS NOT NULL THEN stars END)', ps='prev_stars', c='citations', pc='prev_citations', d='7.0::DOUBLE')} AS velocity_score
FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY ts DESC, event_id DESC) AS rn FROM known) k
JOIN catalog USING (paper_id) WHERE rn = 1""", "known catalog")
def _(t):
    return score_velocity(t.catalog, t.snapshots)
