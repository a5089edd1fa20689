"""Evaluation queries."""

from pyspark.sql import functions as F

from corpusradar.operators import catalog as K
from corpusradar.operators import evaluation as E
from corpusradar.operators.vectors import cosine_topk
from corpusradar.registry import query
from corpusradar.registry.sqlviews import view
from corpusradar.registry.vectors import label_queries

view("expected", "SELECT doc_id AS paper_id, CASE WHEN quality = 1 THEN 3 ELSE 1 END AS lo, CASE WHEN quality = 1 THEN 10 ELSE 5 END AS hi FROM labels")
view("accuracy", """
SELECT count(*) AS labelled, count(*) FILTER (hype_score BETWEEN lo AND hi) AS correct,
       round(count(*) FILTER (hype_score BETWEEN lo AND hi) / count(*)::DOUBLE * 100, 4) AS accuracy
FROM expected LEFT JOIN analysis USING (paper_id)""", "expected analysis")
view("discrimination", """
SELECT round(avg(hype_score), 4) AS mean, round(stddev_pop(hype_score), 4) AS stdev, min(hype_score) AS min, max(hype_score) AS max,
       count(*) FILTER (hype_score <= 4) AS low, count(*) FILTER (hype_score > 4 AND hype_score <= 7) AS medium,
       count(*) FILTER (hype_score > 7) AS high FROM analysis WHERE hype_score IS NOT NULL""", "analysis")
view("runs", """
SELECT paper_id, 1 AS run, overall_score AS score FROM analysis
UNION ALL SELECT paper_id, 2, CASE WHEN hype_score IS NOT NULL THEN overall_score + (hype_score - 5) / 3 END FROM analysis""", "analysis")
view("consistency", """
SELECT paper_id, delta, CASE WHEN delta <= 1 THEN 'consistent' WHEN delta <= 2 THEN 'moderate' ELSE 'high variance' END AS band
FROM (SELECT a.paper_id, round(abs(a.score - b.score), 6) AS delta FROM runs a JOIN runs b USING (paper_id)
      WHERE a.run = 1 AND b.run = 2 AND a.score IS NOT NULL AND b.score IS NOT NULL)""", "runs")
view("reasons", """SELECT *, CASE WHEN is_analyzed THEN abstract END AS hype_reason FROM catalog WHERE is_analyzed""", "catalog")
view("distribution", """
SELECT count(*) AS papers, round(avg(s), 4) AS mean, round(stddev_pop(s), 4) AS stdev, min(s) AS min, max(s) AS max,
       count(DISTINCT round(s, 1)) AS distinct_scores, round(avg(h), 4) AS hype_mean, round(stddev_pop(h), 4) AS hype_stdev,
       round(count(*) FILTER (regexp_matches(lower(hype_reason), 'ther|lich')) / greatest(count(h), 1)::DOUBLE * 100, 4) AS generic_pct,
       round(count(*) FILTER (has_code) / count(*)::DOUBLE * 100, 4) AS code_pct, round(median(s), 4) AS median
FROM (SELECT *, nullif(overall_score, 0) AS s, nullif(hype_score, 0) AS h FROM reasons)""", "reasons")
GENERIC = ["ther", "lich"]


def expected(t):
    good = F.col("quality") == 1
    return t.labels.select(F.col("doc_id").alias("paper_id"), F.when(good, 3).otherwise(1).alias("lo"),
                           F.when(good, 10).otherwise(5).alias("hi"))


def hype(t):
    return t.analysis.select("paper_id", F.col("hype_score").alias("score"))


def runs(t):
    first = t.analysis.select("paper_id", F.lit(1).alias("run"), F.col("overall_score").alias("score"))
    return first.unionByName(t.analysis.select(
        "paper_id", F.lit(2).alias("run"), (F.col("overall_score") + (F.col("hype_score") - 5) / 3).alias("score")))


def analysed(t):
    return t.catalog.where("is_analyzed").withColumn("hype_reason", F.col("abstract"))


def label_precision(t):
    results = cosine_topk(label_queries(t), t.embeddings, k=5, id_col="vec_id").withColumnRenamed("vec_id", "doc_id")
    return results, t.embeddings.select(F.col("label").alias("query_id"), F.col("vec_id").alias("doc_id"))


@query("range_accuracy", "SELECT * FROM accuracy", "accuracy")
def _(t):
    return E.range_accuracy(hype(t), expected(t))


@query("range_misses", """
SELECT paper_id, hype_score AS score, lo, hi FROM expected LEFT JOIN analysis USING (paper_id)
WHERE NOT coalesce(hype_score BETWEEN lo AND hi, false)""", "expected analysis")
def _(t):
    return E.range_misses(hype(t), expected(t)).select("paper_id", "score", "lo", "hi")


@query("discrimination_stats", "SELECT * FROM discrimination", "discrimination")
def _(t):
    return E.discrimination_stats(hype(t))


@query("precision_at_k", """
SELECT count(*) AS queries, round(avg(p), 4) AS precision_at_k
FROM (SELECT query_id, round(count(*) FILTER (label = query_id) / count(*)::DOUBLE, 6) AS p
      FROM label_ranked JOIN embeddings USING (vec_id) WHERE rank <= 5 GROUP BY query_id)""", "label_ranked")
def _(t):
    return E.precision_at_k(*label_precision(t))


@query("answer_cites_source", """
SELECT a.conv_id, a.turn, left(lower(u.text), 30) <> '' AND contains(lower(a.text), left(lower(u.text), 30)) AS cites,
       contains(lower(concat(a.text, u.text)), left(lower(u.text), 30)) AS cites_quoted
FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE a.role = 'assistant'""")
def _(t):
    c = t.conversations
    title = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("title"))
    pairs = c.where("role = 'assistant'").join(title, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", E.answer_cites_source(F.col("text"), F.col("title")).alias("cites"),
                        E.answer_cites_source(F.concat("text", "title"), F.col("title")).alias("cites_quoted"))


@query("run_consistency", "SELECT * FROM consistency", "consistency")
def _(t):
    return E.run_consistency(runs(t))


@query("score_distribution", "SELECT * FROM distribution", "distribution")
def _(t):
    return E.score_distribution(analysed(t), GENERIC)


@query("action_distribution", """
SELECT * FROM (SELECT 'action' AS kind, action AS value, count(*) AS papers,
   round(count(*) / (SELECT count(*) FROM reasons)::DOUBLE * 100, 4) AS share FROM reasons GROUP BY action)
UNION ALL SELECT * FROM (SELECT 'domain', domain, count(*), round(count(*) / (SELECT count(*) FROM reasons)::DOUBLE * 100, 4)
   FROM reasons GROUP BY domain ORDER BY count(*) DESC, domain LIMIT 7)""", "reasons")
def _(t):
    p = analysed(t)
    return E.share_by(p, "action").select(F.lit("action").alias("kind"), "*").unionByName(
        E.share_by(p, "domain", 7).select(F.lit("domain").alias("kind"), "*"))


@query("latency_status", """
SELECT event_type AS endpoint, count(*) AS requests, median(ms) AS median_ms, max(ms) AS max_ms,
       CASE WHEN median(ms) < CASE WHEN event_type = 'view' THEN 5000 ELSE 3000 END THEN 'ok' ELSE 'slow' END AS status
FROM (SELECT event_type, CAST(round(value * 90) AS BIGINT) AS ms FROM events) GROUP BY event_type""")
def _(t):
    requests = t.events.select(F.col("event_type").alias("endpoint"), F.round(F.col("value") * 90).cast("bigint").alias("ms"))
    return E.latency_status(requests, {"view": 5000})


@query("evaluation_report", """
SELECT 'score accuracy' AS metric, accuracy AS value, CASE WHEN accuracy >= 70 THEN 'pass' ELSE 'warn' END AS status FROM accuracy
UNION ALL SELECT 'score discrimination', stdev, CASE WHEN stdev >= 1.5 THEN 'pass' ELSE 'warn' END FROM discrimination
UNION ALL SELECT 'precision at 5', v, CASE WHEN v >= 0.5 THEN 'pass' ELSE 'warn' END FROM (
  SELECT round(avg(p), 4) AS v FROM (SELECT round(count(*) FILTER (label = query_id) / count(*)::DOUBLE, 6) AS p
      FROM label_ranked JOIN embeddings USING (vec_id) WHERE rank <= 5 GROUP BY query_id))
UNION ALL SELECT 'run difference', v, CASE WHEN v <= 1 THEN 'pass' ELSE 'warn' END FROM (SELECT round(avg(delta), 4) AS v FROM consistency)
UNION ALL SELECT 'papers analysed', CAST(papers AS DOUBLE), 'info' FROM distribution
UNION ALL SELECT 'score min', min, 'info' FROM distribution UNION ALL SELECT 'score max', max, 'info' FROM distribution
UNION ALL SELECT 'score mean', mean, 'info' FROM distribution UNION ALL SELECT 'papers with code %', code_pct, 'info' FROM distribution
UNION ALL SELECT 'hidden gems', CAST(count(*) AS DOUBLE), 'info' FROM (SELECT 1 FROM catalog WHERE is_analyzed AND overall_score >= 7 AND hype_score <= 4)
""", "accuracy discrimination label_ranked consistency distribution catalog")
def _(t):
    return E.evaluation_report(
        E.range_accuracy(hype(t), expected(t)), E.discrimination_stats(hype(t)), E.precision_at_k(*label_precision(t)),
        E.run_consistency(runs(t)), E.score_distribution(analysed(t), GENERIC), K.hidden_gems(t.catalog, None))
