"""Chat sessions, user activity, jobs and notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusradar.operators.ordered import with_previous


def cut_with_dots(text: Column, n: int) -> Column:
    return F.concat(F.substring(text, 1, n), F.when(F.length(text) > n, "...").otherwise(""))


def session_headers(turns: DataFrame, *carry: str) -> DataFrame:
    """``(conv_id, title, message_count, ...)``: title from the first user message, count of question-answer pairs.

    Combines per task, so a conversation of any length costs one row per task.
    """
    asked = F.when(F.col("role") == "user", F.col("turn"))
    return turns.groupBy("conv_id").agg(
        cut_with_dots(F.min_by("text", asked), 80).alias("title"),
        F.floor(F.count("*") / 2).cast("bigint").alias("message_count"), *[F.max(c).alias(c) for c in carry])


def build_sessions(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, title, message_count, role, content)``: every message beside the header of its conversation.

    One row per message at every length, so no row grows with its conversation.
    """
    return turns.select("conv_id", "turn", "role", F.col("text").alias("content")).join(session_headers(turns), "conv_id")


def append_turn(headers: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Session headers after one more exchange each; ``incoming(conv_id, history_count, message)``.

    A known session gets the length of the sent history plus the new pair as its messages; an unknown one starts with one
    pair and the message as title.
    """
    h, i = headers.alias("h"), incoming.alias("i")
    joined = h.join(i, F.col("h.conv_id") == F.col("i.conv_id"), "full_outer")
    known, touched = F.col("h.conv_id").isNotNull(), F.col("i.conv_id").isNotNull()
    return joined.select(
        F.coalesce("h.conv_id", "i.conv_id").alias("conv_id"),
        F.when(known, F.col("h.title")).otherwise(cut_with_dots(F.col("i.message"), 80)).alias("title"),
        F.when(known & touched, F.floor((F.col("i.history_count") + 2) / 2)).when(known, F.col("h.message_count")).otherwise(1)
        .cast("bigint").alias("message_count"),
        F.when(touched, now).otherwise(F.col("h.last_used")).alias("last_used"),
        F.when(known & touched, "updated").when(known, "kept").otherwise("inserted").alias("status"))


def list_sessions(headers: DataFrame, session_type: str | None = None, paper_id=None, limit: int = 50) -> DataFrame:
    if session_type:
        headers = headers.where(F.col("session_type") == session_type)
    if paper_id is not None:
        headers = headers.where(F.col("paper_id") == paper_id)
    return headers.orderBy(F.col("last_used").desc(), "conv_id").limit(limit)


def latest_session(headers: DataFrame, papers: DataFrame) -> DataFrame:
    """Newest session of every paper with the paper's index state; papers without sessions keep NULLs."""
    newest = headers.groupBy("paper_id").agg(
        F.max_by(F.struct("conv_id", "title", "message_count", "last_used"), F.struct("last_used", "conv_id")).alias("s"),
        F.count("*").alias("sessions"))
    return papers.select("paper_id", "index_built").join(newest, "paper_id", "left").select(
        "paper_id", "index_built", "s.*", F.coalesce("sessions", F.lit(0)).alias("sessions"))


def clean_history(turns: DataFrame, last: int = 4) -> DataFrame:
    """The last user and assistant messages of each conversation as ``User:`` / ``Assistant:`` lines."""
    spoken = turns.where(F.col("role").isin("user", "assistant"))
    recent = spoken.withColumn("_r", F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc())))
    label = F.when(F.col("role") == "user", "User: ").otherwise("Assistant: ")
    lines = recent.where(F.col("_r") <= last).select("conv_id", "turn", F.concat(label, "text").alias("line"))
    return lines.groupBy("conv_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda s: s["line"]), "\n").alias("history"))


def activity_feed(activity: DataFrame, limit: int = 20) -> DataFrame:
    """Newest activities per user."""
    order = W.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("activity_id").desc())
    return activity.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def merge_preferences(old: Column, new: Column) -> Column:
    """New keys win, missing maps change nothing."""
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(F.map_concat(kept, new))


def job_state(job_events: DataFrame) -> DataFrame:
    """Latest status per job and its group: open (pending, running), done or failed."""
    latest = job_events.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    return latest.select("job_id", "status", F.when(F.col("status").isin("pending", "running"), "open").otherwise(F.col("status")).alias("state"))


def job_transitions(job_events: DataFrame) -> DataFrame:
    """Rows where an open job becomes done or failed; a job starts out as pending."""
    seen = with_previous(job_events, ["job_id"], ["ts", "event_id"], None, {"previous": F.col("status")})
    was = F.coalesce("previous", F.lit("pending"))
    return seen.where(was.isin("pending", "running") & F.col("status").isin("done", "failed")).select(
        "job_id", "event_id", "ts", was.alias("previous"), "status",
        F.when(F.col("status") == "done", "Analysis complete").otherwise("Analysis failed").alias("message"))


def recent_notifications(notifications: DataFrame, read_ids: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """Newest notifications per user with an ``unread`` flag; the few that remain are checked against ``read_ids``."""
    order = W.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("activity_id").desc())
    top = notifications.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    if read_ids is None:
        return top.withColumn("unread", F.lit(True))
    seen = read_ids.select("activity_id", F.lit(True).alias("_seen"))
    return top.join(seen, "activity_id", "left").withColumn("unread", F.col("_seen").isNull()).drop("_seen")
