"""Operational metric queries."""

from pyspark.sql import functions as F

from corpusradar.operators import opsmetrics as O
from corpusradar.registry import query
from corpusradar.registry.sqlviews import view

view("recent_calls", """
SELECT *, row_number() OVER (PARTITION BY agent ORDER BY ts DESC, event_id DESC) AS rn FROM agent_calls""", "agent_calls")


@query("agent_counters", """
SELECT agent, count(*) AS calls, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures,
       count(*) FILTER (guardrail) AS guardrail_fails, count(*) FILTER (fallback) AS fallbacks,
       round(count(*) FILTER (success) / count(*)::DOUBLE * 100, 1) AS success_rate,
       coalesce(left(arg_max(error, ts) FILTER (error <> ''), 200), '') AS last_error,
       coalesce(arg_max(model, ts) FILTER (model <> ''), '') AS last_model
FROM agent_calls GROUP BY agent""", "agent_calls")
def _(t):
    return O.agent_counters(t.agent_calls)


@query("latency_avg", """
SELECT agent, round(avg(latency_s), 1) AS avg_latency_s FROM recent_calls WHERE rn <= 100 GROUP BY agent""", "recent_calls")
def _(t):
    return O.latency_avg(t.agent_calls)


@query("latency_p95", """
SELECT agent, round(l[least(CAST(floor(len(l) * 0.95) AS INTEGER) + 1, len(l))], 1) AS p95_latency_s
FROM (SELECT agent, list(latency_s ORDER BY latency_s) AS l FROM recent_calls WHERE rn <= 100 GROUP BY agent)""", "recent_calls")
def _(t):
    return O.latency_p95(t.agent_calls)


@query("score_stats", """
SELECT agent, round(avg(score), 2) AS mean, round(median(score), 2) AS median, round(min(score), 2) AS min, round(max(score), 2) AS max,
       CASE WHEN count(*) > 1 THEN round(stddev_samp(score), 2) ELSE 0.0 END AS stdev, count(*) FILTER (score < 4) AS skip,
       count(*) FILTER (score >= 4 AND score < 6) AS experiment, count(*) FILTER (score >= 6 AND score < 8) AS strong_experiment,
       count(*) FILTER (score >= 8) AS adopt
FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY ts DESC, event_id DESC) AS rn FROM agent_calls WHERE score IS NOT NULL)
WHERE rn <= 200 GROUP BY agent""", "agent_calls")
def _(t):
    return O.score_stats(t.agent_calls)


@query("pipeline_rollup", """
SELECT count(*) AS total_runs, count(*) FILTER (success) AS successful_runs, count(*) FILTER (NOT success) AS failed_runs,
       round(count(*) FILTER (success) / greatest(count(*), 1)::DOUBLE * 100, 1) AS success_rate,
       (SELECT round(avg(latency_s), 1) FROM (SELECT latency_s FROM agent_calls ORDER BY ts DESC, event_id DESC LIMIT 100)) AS avg_total_latency_s
FROM agent_calls""", "agent_calls")
def _(t):
    return O.pipeline_rollup(t.agent_calls)


@query("health_flags", """
SELECT issues = '' AS healthy, issues FROM (SELECT concat_ws(',',
  CASE WHEN count(*) FILTER (agent = 'scorer' AND fallback) > count(*) FILTER (agent = 'scorer') * 0.3 THEN 'scorer_fallbacks' END,
  CASE WHEN count(*) FILTER (agent = 'hype' AND NOT success) > count(*) FILTER (agent = 'hype') * 0.5
        AND count(*) FILTER (agent = 'hype') > 3 THEN 'hype_failures' END,
  CASE WHEN count(*) FILTER (agent = 'classifier' AND guardrail) > 5 THEN 'classifier_guardrails' END) AS issues FROM agent_calls)""",
       "agent_calls")
def _(t):
    return O.health_flags(t.agent_calls).withColumn("issues", F.array_join("issues", ","))


@query("ewma_latency", """
SELECT agent, len(l) AS calls, list_reduce(l, lambda a, x: CASE WHEN a = 0 THEN round(x, 1) ELSE round(0.3::DOUBLE * x + 0.7::DOUBLE * a, 1) END, 0.0::DOUBLE) AS ewma_latency_s
FROM (SELECT agent, list(latency_s ORDER BY ts, event_id) AS l FROM agent_calls WHERE success GROUP BY agent)""", "agent_calls")
def _(t):
    return O.ewma_latency(t.agent_calls)


@query("warm_status", """
SELECT agent, last_success, (SELECT CAST(floor(epoch(max(ts))) AS BIGINT) FROM events) - last_success <= 1500 AS is_warm
FROM (SELECT agent, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_success FROM agent_calls WHERE success GROUP BY agent)""", "agent_calls")
def _(t):
    return O.warm_status(t.agent_calls, t.events.select(F.unix_timestamp(F.max("ts"))).scalar())
