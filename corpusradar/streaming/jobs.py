"""Streaming jobs. Each takes a streaming frame and returns one, or is a step that ``state.run_event_time`` drives.

Tables written per batch carry the batch id in their path and are overwritten whole, so a batch that is run again after a
failure leaves the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusradar.operators.opsmetrics import ewma_latency
from corpusradar.operators.ordered import with_previous
from corpusradar.operators.velocity import snapshot_deltas, velocity_score
from corpusradar.session import UNION_PARTITIONING, fresh_folder, union_all
from corpusradar.sources.ingest import ingest_audit, ingest_new_only
from corpusradar.streaming.state import versions

LOCAL_SESSION_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def run_append(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Process what is available, append it to a Parquet table, and return that table."""
    spark = stream.sparkSession
    folder = folder or fresh_folder(spark, "stream")
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out")
             .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def stream_ingest(feed: DataFrame, stored: DataFrame, row_key: str, delay: str = "1 hour", folder: str | None = None,
                  buckets: int = 64) -> tuple[DataFrame, DataFrame]:
    """New papers of ``feed(paper_id, published_at, ...)``, each once, and one audit row per batch.

    Repeats inside the watermark fall away in the stream; later ones and stored papers by an anti join per batch. Ids that were
    let in are kept in ``buckets`` by hash; a batch opens those its own ids fall into, and its plan has one scan of them however
    many batches came before.
    """
    spark = feed.sparkSession
    folder = folder or fresh_folder(spark, "ingest")
    unique = feed.withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["paper_id"])

    bucket = F.pmod(F.xxhash64("paper_id"), F.lit(buckets)).cast("int")

    def process(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        session.conf.set(UNION_PARTITIONING, "false")
        batch.persist()
        known = stored.select("paper_id")
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # no more than there are buckets
        if batch_id and versions(session, f"{folder}/out"):
            seen = session.read.schema(batch.schema["paper_id"].simpleString().replace(":", " ") + ", batch long, bucket int").parquet(f"{folder}/seen")
            known = union_all(known, seen.where(F.col("bucket").isin(touched) & (F.col("batch") < batch_id)).select("paper_id"))
        new = ingest_new_only(batch, known, row_key)
        new.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")
        ids = session.read.schema(new.schema).parquet(f"{folder}/out/batch={batch_id}").select("paper_id", bucket.alias("bucket"))
        ids.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/seen/batch={batch_id}")
        ingest_audit(batch, known).write.mode("overwrite").parquet(f"{folder}/audit/batch={batch_id}")
        batch.unpersist()

    query = (unique.writeStream.foreachBatch(process).option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch"), spark.read.parquet(f"{folder}/audit")


def stream_agent_metrics(calls: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counters and mean latency per agent and closed time window; rows later than ``delay`` are dropped."""
    return calls.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "agent").agg(
        F.count("*").alias("calls"), F.count_if("success").alias("successes"), F.avg("latency_s").alias("avg_latency_s")
    ).select("agent", F.col("w.start").alias("window_start"), "calls", "successes", "avg_latency_s")


def stream_activity_sessions(activity: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions per user, closed by ``gap`` without activity; parts of a session merge per task before the exchange."""
    activity.sparkSession.conf.set(LOCAL_SESSION_MERGE, "true")
    return activity.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(
        F.count("*").alias("activities")).select(
        "user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "activities")


def stream_sliding_activity(activity: DataFrame, window: str = "1 hour", slide: str = "15 minutes", delay: str = "10 minutes") -> DataFrame:
    return activity.withWatermark("ts", delay).groupBy(F.window("ts", window, slide).alias("w"), "action_type").agg(
        F.count("*").alias("activities")).select("action_type", F.col("w.start").alias("window_start"), "activities")


def velocity_step(rows: DataFrame, state: DataFrame | None, mark: int) -> tuple[DataFrame, DataFrame]:
    """Velocity of each new snapshot against the last known values, which are the state."""
    deltas = snapshot_deltas(rows, F.to_date("ts"))
    if state is None:
        state = deltas.select("paper_id", F.col("known_stars").alias("old_stars"), F.col("known_citations").alias("old_citations")).where(F.lit(False))
    seen = deltas.join(state, "paper_id", "left")
    output = seen.select("paper_id", "event_id", velocity_score(
        F.col("stars"), F.coalesce("prev_stars", "old_stars"), F.col("citations"), F.coalesce("prev_citations", "old_citations")).alias("velocity"))
    latest = deltas.groupBy("paper_id").agg(F.max_by(F.struct("known_stars", "known_citations"), F.struct("ts", "event_id")).alias("k"))
    new_state = latest.join(state, "paper_id", "full_outer").select(
        "paper_id", F.coalesce("k.known_stars", "old_stars").alias("old_stars"), F.coalesce("k.known_citations", "old_citations").alias("old_citations"))
    return output, new_state


def transitions_step(rows: DataFrame, state: DataFrame | None, mark: int) -> tuple[DataFrame, DataFrame]:
    """Jobs that become done or failed; the state is the last status per job."""
    seen = with_previous(rows, ["job_id"], ["ts", "event_id"], F.to_date("ts"), {"previous": F.col("status")})
    if state is None:
        state = rows.select("job_id", F.col("status").alias("old_status")).where(F.lit(False))
    seen = seen.join(state, "job_id", "left").withColumn("previous", F.coalesce("previous", "old_status", F.lit("pending")))
    output = seen.where(F.col("previous").isin("pending", "running") & F.col("status").isin("done", "failed")).select(
        "job_id", "event_id", "previous", "status")
    latest = rows.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("_now"))
    return output, latest.join(state, "job_id", "full_outer").select("job_id", F.coalesce("_now", "old_status").alias("old_status"))


def ewma_step(rows: DataFrame, state: DataFrame | None, mark: int, warm_seconds: int = 1500) -> tuple[DataFrame, DataFrame]:
    """Running latency and warmth per agent as of ``mark``, for agents with new calls and for those that have just turned cold.

    ``due`` is when an agent turns cold (microseconds, none for cold ones): its bucket is then visited without a new call.
    """
    fresh = ewma_latency(rows, initial=state)
    last = rows.where("success").groupBy("agent").agg(F.max(F.unix_timestamp("ts")).alias("last_success"))
    now = fresh.join(last, "agent")
    if state is not None:
        old = state.select("agent", F.col("calls").alias("_c"), F.col("ewma_latency_s").alias("_e"), F.col("last_success").alias("_l"),
                           F.col("is_warm").alias("_w"))
        now = now.withColumn("_new", F.lit(True)).join(old, "agent", "full_outer").select(
            "agent", (F.coalesce("calls", F.lit(0)) + F.coalesce("_c", F.lit(0))).alias("calls"),
            F.coalesce("ewma_latency_s", "_e").alias("ewma_latency_s"), F.greatest("last_success", "_l").alias("last_success"), "_new", "_w")
    else:
        now = now.select("agent", "calls", "ewma_latency_s", "last_success", F.lit(True).alias("_new"), F.lit(None).cast("boolean").alias("_w"))
    warm = F.lit(mark // 1_000_000) - F.col("last_success") <= warm_seconds
    due = F.when(F.col("is_warm"), (F.col("last_success") + warm_seconds + 1) * 1_000_000).alias("due")
    judged = now.withColumn("is_warm", warm)
    columns = ["agent", "calls", "ewma_latency_s", "last_success", "is_warm"]
    return judged.where("_new OR (_w AND NOT is_warm)").select(*columns), judged.select(*columns, due)


def stream_static_enrich(stream: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """Left join of a stream with a stored table."""
    return stream.join(static, key, "left")
