"""Streaming queries: run over what is available, then read what they wrote."""

from pyspark.sql import functions as F

from corpusradar.registry import query
from corpusradar.registry.sqlviews import view
from corpusradar.registry.ingest import stored
from corpusradar.registry.velocity import VELOCITY
from corpusradar.session import fresh_folder
from corpusradar.streaming import jobs as J
from corpusradar.streaming.state import run_event_time
from corpusradar.streaming.sources import StreamTables


def streams(t):
    return StreamTables(t.spark, t.folder)


@query("stream_ingest", """
SELECT DISTINCT paper_id FROM batch WHERE paper_id NOT IN (SELECT paper_id FROM stored)""", "batch stored")
def _(t):
    feed = streams(t).papers.select(F.md5("abstract").alias("paper_id"), F.col("paper_id").alias("doc_id"),
                                    F.col("published_at").cast("timestamp").alias("published_at"))
    new, _ = J.stream_ingest(feed, stored(t), "doc_id")
    return new.select("paper_id")


@query("stream_agent_metrics", """
SELECT agent, CAST(floor(epoch(w)) AS BIGINT) AS window_start, calls, successes, avg_latency_s FROM (
  SELECT agent, date_trunc('hour', ts) AS w, count(*) AS calls, count(*) FILTER (success) AS successes, round(avg(latency_s), 6) AS avg_latency_s
  FROM agent_calls GROUP BY 1, 2) WHERE w + INTERVAL '1' HOUR <= (SELECT max(ts) - INTERVAL '10' MINUTE FROM events)""", "agent_calls")
def _(t):
    out = J.run_append(J.stream_agent_metrics(streams(t).agent_calls))
    return out.select("agent", F.unix_timestamp("window_start").alias("window_start"), "calls", "successes",
                      F.round("avg_latency_s", 6).alias("avg_latency_s"))


@query("stream_activity_sessions", """
SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS session_start, count(*) AS activities FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, activity_id) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, activity_id) < INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS new FROM activity))
GROUP BY user_id, s HAVING max(ts) + INTERVAL '30' MINUTE <= (SELECT max(ts) - INTERVAL '10' MINUTE FROM events)""", "activity")
def _(t):
    out = J.run_append(J.stream_activity_sessions(streams(t).activity))
    return out.select("user_id", F.unix_micros("session_start").alias("session_start"), "activities")


@query("stream_sliding_activity", """
SELECT action_type, CAST(floor(epoch(w)) AS BIGINT) AS window_start, count(*) AS activities FROM (
  SELECT action_type, time_bucket(INTERVAL '15' MINUTE, ts) - k * INTERVAL '15' MINUTE AS w FROM activity, (SELECT unnest(range(4)) AS k))
WHERE w + INTERVAL '1' HOUR <= (SELECT max(ts) - INTERVAL '10' MINUTE FROM events) GROUP BY 1, 2""", "activity")
def _(t):
    out = J.run_append(J.stream_sliding_activity(streams(t).activity))
    return out.select("action_type", F.unix_timestamp("window_start").alias("window_start"), "activities")


# Events arrive in four parts, up to two days late; some of them far later, which the watermark drops.
ARRIVALS, LATE, DELAY = 4, 172_800, 172_801


def arrivals(t):
    """The ``events`` table part by part: a row arrives up to ``LATE`` seconds after its time, one in 97 in the last part."""
    seconds = F.unix_timestamp("ts")
    events = t.read("events").withColumn("ts", F.col("ts").cast("timestamp"))
    span = events.agg(F.min(seconds).alias("t0"), F.max(seconds).alias("t1"))
    on_time = F.least(F.lit(ARRIVALS - 1), F.floor(ARRIVALS * (seconds + F.col("event_id") * 7919 % LATE - F.col("t0")) / (F.col("t1") - F.col("t0") + 1)))
    return events.crossJoin(F.broadcast(span)).withColumn("part", F.when(F.col("event_id") % 97 == 5, ARRIVALS - 1).otherwise(on_time)).drop("t0", "t1")


view("arrived", f"""
SELECT event_id, ts, CASE WHEN event_id % 97 = 5 THEN {ARRIVALS - 1} ELSE least({ARRIVALS - 1},
         floor({ARRIVALS} * (floor(epoch(ts)) + event_id * 7919 % {LATE} - t0) / (t1 - t0 + 1))) END AS part
FROM events, (SELECT min(floor(epoch(ts))) AS t0, max(floor(epoch(ts))) AS t1 FROM events)""")
for _name in ("snapshots", "job_events", "agent_calls"):  # the watermark of a stream is that of its own rows
    view(f"{_name}_in_time", f"""
SELECT event_id FROM (SELECT a.event_id, epoch(a.ts) AS seen_at, (SELECT max(epoch(b.ts)) FROM own b WHERE b.part < a.part) AS newest FROM own a)
WHERE newest IS NULL OR seen_at >= newest - {DELAY}""".replace("own", f"(SELECT * FROM arrived WHERE event_id IN (SELECT event_id FROM {_name}))"), f"arrived {_name}")


def over_arrivals(t, name: str, step, key: str):
    """Output and state of ``step`` after all parts have arrived; every part is one more run over the same folder."""
    folder, parts = fresh_folder(t.spark, "arrivals"), arrivals(t)
    driver = None
    for i in range(ARRIVALS):
        parts.where(F.col("part") == i).drop("part").write.mode("append").parquet(f"{folder}/events/events.parquet")
        frame = getattr(StreamTables(t.spark, f"{folder}/events"), name)
        driver = run_event_time(frame, step, key, DELAY, f"{folder}/{name}")
    return driver.finish(t.spark, frame.schema)


@query("stream_velocity", f"""
SELECT paper_id, event_id, {VELOCITY.format(s='stars', ps='prev_stars', c='citations', pc='prev_citations', d='7.0::DOUBLE')} AS velocity FROM (
  SELECT *, last_value(stars IGNORE NULLS) OVER w AS prev_stars, last_value(citations IGNORE NULLS) OVER w AS prev_citations
  FROM snapshots WHERE event_id IN (SELECT event_id FROM snapshots_in_time) WINDOW w AS (PARTITION BY paper_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
       "snapshots snapshots_in_time")
def _(t):
    return over_arrivals(t, "snapshots", J.velocity_step, "paper_id")[0]


@query("stream_job_transitions", """
SELECT job_id, event_id, previous, status FROM (
  SELECT *, lag(status, 1, 'pending') OVER (PARTITION BY job_id ORDER BY ts, event_id) AS previous FROM job_events WHERE event_id IN (SELECT event_id FROM job_events_in_time))
WHERE previous IN ('pending', 'running') AND status IN ('done', 'failed')""", "job_events job_events_in_time")
def _(t):
    return over_arrivals(t, "job_events", J.transitions_step, "job_id")[0]


@query("stream_ewma", """
SELECT agent, len(l) AS calls, list_reduce(l, lambda a, x: CASE WHEN a = 0 THEN round(x, 1) ELSE round(0.3::DOUBLE * x + 0.7::DOUBLE * a, 1) END, 0.0::DOUBLE) AS ewma_latency_s,
       last_success, (SELECT CAST(floor(epoch(max(ts))) AS BIGINT) FROM agent_calls WHERE event_id IN (SELECT event_id FROM agent_calls_in_time)) - last_success <= 1500 AS is_warm
FROM (SELECT agent, list(latency_s ORDER BY ts, event_id) AS l, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_success
      FROM agent_calls WHERE success AND event_id IN (SELECT event_id FROM agent_calls_in_time) GROUP BY agent)""",
       "agent_calls agent_calls_in_time")
def _(t):
    return over_arrivals(t, "agent_calls", J.ewma_step, "agent")[1].drop("due")


@query("stream_static_enrich", """
SELECT event_id, user_id, event_type, c_name, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey""")
def _(t):
    static = t.customer.select(F.col("c_custkey").alias("user_id"), "c_name", "c_mktsegment")
    out = J.run_append(J.stream_static_enrich(streams(t).events, static, "user_id"))
    return out.select("event_id", "user_id", "event_type", "c_name", "c_mktsegment")
