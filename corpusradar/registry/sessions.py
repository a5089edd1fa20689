"""Session, activity and job queries."""

from pyspark.sql import functions as F

from corpusradar.operators import sessions as S
from corpusradar.registry import query
from corpusradar.registry.sqlviews import view
from corpusradar.sources.views import ntz

view("headers", """
SELECT conv_id, left(q, 80) || CASE WHEN length(q) > 80 THEN '...' ELSE '' END AS title, message_count, last_used, session_type,
       conv_id % 10 AS paper_id
FROM (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS q, count(*) // 2 AS message_count, max(last_used) AS last_used,
             max(session_type) AS session_type FROM turns GROUP BY conv_id)""", "turns")
view("transitions", """
SELECT job_id, event_id, ts, previous, status, CASE WHEN status = 'done' THEN 'Analysis complete' ELSE 'Analysis failed' END AS message
FROM (SELECT *, coalesce(lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id), 'pending') AS previous FROM job_events)
WHERE previous IN ('pending', 'running') AND status IN ('done', 'failed')""", "job_events")


def headers(t):
    return S.session_headers(t.turns, "last_used", "session_type").withColumn("paper_id", F.col("conv_id") % 10)


@query("build_sessions", """
SELECT conv_id, turn, title, message_count, role, text AS content FROM headers JOIN turns USING (conv_id)""", "headers")
def _(t):
    return S.build_sessions(t.turns).select("conv_id", "turn", "title", "message_count", "role", "content")


@query("append_turn", """
, inc AS (SELECT conv_id, count(*) FILTER (role <> 'system') AS history_count, arg_max(text, turn) AS message FROM turns GROUP BY conv_id),
old AS (SELECT * FROM headers WHERE session_type = 'deep')
SELECT conv_id, CASE WHEN old.title IS NOT NULL THEN title ELSE left(message, 80) || CASE WHEN length(message) > 80 THEN '...' ELSE '' END END AS title,
       CASE WHEN old.title IS NOT NULL THEN (history_count + 2) // 2 ELSE 1 END AS message_count,
       CAST(epoch(TIMESTAMP '2024-03-01 00:00:00') AS BIGINT) AS last_used, CASE WHEN old.title IS NOT NULL THEN 'updated' ELSE 'inserted' END AS status
FROM inc FULL OUTER JOIN old USING (conv_id)""", "headers")
def _(t):
    incoming = t.turns.groupBy("conv_id").agg(
        F.count_if(F.col("role") != "system").alias("history_count"), F.max_by("text", "turn").alias("message"))
    old = headers(t).where("session_type = 'deep'")
    return S.append_turn(old, incoming, ntz("2024-03-01 00:00:00")).withColumn("last_used", F.unix_timestamp("last_used"))


@query("list_sessions", """
SELECT conv_id, title, message_count, session_type FROM headers WHERE session_type = 'deep' ORDER BY last_used DESC, conv_id LIMIT 50""", "headers")
def _(t):
    return S.list_sessions(headers(t), "deep").select("conv_id", "title", "message_count", "session_type")


@query("latest_session", """
SELECT p.paper_id, l.doc_id IS NOT NULL AS index_built, h.conv_id, h.title, h.message_count, coalesce(n, 0) AS sessions
FROM papers p LEFT JOIN labels l ON p.paper_id = l.doc_id LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY last_used DESC, conv_id DESC) AS rn, count(*) OVER (PARTITION BY paper_id) AS n
  FROM headers) h ON h.paper_id = p.paper_id AND rn = 1""", "papers headers")
def _(t):
    papers = t.papers.join(t.labels.select(F.col("doc_id").alias("paper_id"), F.lit(True).alias("_l")), "paper_id", "left").select(
        "paper_id", F.col("_l").isNotNull().alias("index_built"))
    return S.latest_session(headers(t), papers).drop("last_used")


@query("clean_history", """
SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY turn) AS history
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM turns WHERE role IN ('user', 'assistant'))
WHERE rn <= 4 GROUP BY conv_id""", "turns")
def _(t):
    return S.clean_history(t.turns, 4)


@query("activity_feed", """
SELECT user_id, activity_id, action_type, details, position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, activity_id DESC) AS position
FROM activity) WHERE position <= 20""", "activity")
def _(t):
    return S.activity_feed(t.activity).select("user_id", "activity_id", "action_type", "details", "position")


@query("merge_preferences", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'segment=' || c_mktsegment || ',theme=light'
  ELSE 'lang=' || c_nationkey || ',segment=' || c_mktsegment || ',theme=dark' END AS preferences FROM customer""")
def _(t):
    old = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("theme"), F.lit("light"))
    new = F.when(F.col("c_acctbal") >= 0, F.create_map(
        F.lit("theme"), F.lit("dark"), F.lit("lang"), F.col("c_nationkey").cast("string")))
    merged = F.array_sort(F.transform(F.map_entries(S.merge_preferences(old, new)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return t.customer.select("c_custkey", F.array_join(merged, ",").alias("preferences"))


@query("job_state", """
SELECT job_id, status, CASE WHEN status IN ('pending', 'running') THEN 'open' ELSE status END AS state
FROM (SELECT job_id, arg_max(status, ts) AS status FROM job_events GROUP BY job_id)""", "job_events")
def _(t):
    return S.job_state(t.job_events)


@query("job_transitions", "SELECT job_id, event_id, previous, status, message FROM transitions", "transitions")
def _(t):
    return S.job_transitions(t.job_events).drop("ts")


@query("recent_notifications", """
SELECT user_id, activity_id, action_type, position, action_type <> 'view' AS unread FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, activity_id DESC) AS position FROM activity) WHERE position <= 20""", "activity")
def _(t):
    read = t.activity.where("action_type = 'view'")
    return S.recent_notifications(t.activity, read).select("user_id", "activity_id", "action_type", "position", "unread")
