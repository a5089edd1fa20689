"""Several small batches give the same as one job over everything."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql.types import StructType

from corpusradar.operators import opsmetrics as O
from corpusradar.operators.velocity import snapshot_deltas, velocity_score
from corpusradar.sources.views import Tables
from corpusradar.streaming import jobs as J
from corpusradar.streaming.sources import StreamTables
from corpusradar.streaming.state import run_event_time
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


class Slow(StreamTables):
    """One file per micro-batch."""

    def read(self, name):
        schema = self.spark.read.parquet(self.folder).schema
        return (self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(self.folder)
                .withColumn("ts", F.col("ts").cast("timestamp")))


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events"))
    ordered = Tables(spark, SF).events
    for i in range(3):  # files in time order, written one after the other
        ordered.where(F.floor(F.col("event_id") * 3 / 1000) == i).coalesce(1).write.mode("append").parquet(folder)
    return folder


def rows(df):
    return sorted(map(str, df.collect()))


def drive(spark, parts, name, step, key, delay=10 * 365 * 86_400):
    frame = getattr(Slow(spark, parts), name)
    driver = run_event_time(frame, step, key, delay, buckets=4)
    return driver, *driver.finish(spark, frame.schema)


def test_velocity_stream(spark, parts):
    deltas = snapshot_deltas(Tables(spark, SF).snapshots)
    want = deltas.select("paper_id", "event_id", velocity_score(*[F.col(c) for c in ("stars", "prev_stars", "citations", "prev_citations")]).alias("velocity"))
    for delay in (0, 86_400):
        _, out, _ = drive(spark, parts, "snapshots", J.velocity_step, "paper_id", delay)
        assert rows(out.select("paper_id", "event_id", "velocity")) == rows(want)


def test_ewma_stream(spark, parts):
    _, _, state = drive(spark, parts, "agent_calls", J.ewma_step, "agent", 3600)
    want = O.ewma_latency(Tables(spark, SF).agent_calls)
    assert rows(state.select("agent", "calls", F.round("ewma_latency_s", 6))) == rows(want.select("agent", "calls", F.round("ewma_latency_s", 6)))


JOBS = "job_id long, event_id long, ts timestamp, status string"


class Arrivals:
    """Rows that arrive file by file, each file a run over the same folder."""

    def __init__(self, spark, folder, step, key, delay, schema):
        self.spark, self.folder, self.step, self.key, self.delay, self.schema = spark, str(folder), step, key, delay, schema

    def arrive(self, *lines):
        data = [(*x[:2], datetime(2024, 1, 1) + timedelta(minutes=x[2]), *x[3:]) for x in lines]
        self.spark.createDataFrame(data, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        stream = self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in")
        self.driver = run_event_time(stream, self.step, self.key, self.delay * 60, f"{self.folder}/work", buckets=8)
        return self.driver.manifest(self.spark)

    def finish(self):
        return self.driver.finish(self.spark, StructType.fromDDL(self.schema))


def test_late_rows_count_in_time_order_and_too_late_ones_drop(spark, tmp_path):
    jobs = Arrivals(spark, tmp_path, J.transitions_step, "job_id", 90, JOBS)
    jobs.arrive((1, 1, 0, "running"), (1, 3, 120, "done"), (2, 4, 120, "running"))
    jobs.arrive((1, 2, 60, "running"), (1, 5, 180, "done"), (3, 9, 170, "failed"))  # the running of one hour comes late
    now = jobs.arrive((2, 6, 80, "done"), (2, 7, 181, "failed"))  # 80 is before the watermark of 90
    assert now.dropped == 1
    out, _ = jobs.finish()
    assert {(r.job_id, r.event_id, r.previous, r.status) for r in out.collect()} == {
        (1, 3, "running", "done"), (2, 7, "running", "failed"), (3, 9, "pending", "failed")}


def test_untouched_buckets_keep_their_files_and_old_ones_go(spark, tmp_path):
    jobs = Arrivals(spark, tmp_path, J.transitions_step, "job_id", 0, JOBS)
    jobs.arrive(*[(i, i, i, "running") for i in range(40)])
    first = jobs.arrive((1, 100, 100, "running"))
    second = jobs.arrive((1, 101, 101, "done"))
    moved = {b for b in first.versions if first.versions[b] != second.versions[b]}
    assert len(first.versions) == 8 and len(moved) == 1
    third = jobs.arrive((1, 102, 102, "running"))
    gone = [p for p in second.dead if "state" in p]
    assert gone and not any(os.path.exists(p) for p in gone) and len(third.versions) == 8
    assert jobs.finish()[1].count() == 40


def test_warmth_ends_without_a_new_call(spark, tmp_path):
    calls = Arrivals(spark, tmp_path, J.ewma_step, "agent", 0, "agent string, event_id long, ts timestamp, latency_s double, success boolean")
    calls.arrive(("a", 1, 0, 2.0, True), ("b", 2, 1, 4.0, True))
    calls.arrive(("b", 3, 20, 4.0, True))
    calls.arrive(("b", 4, 40, 4.0, True))  # by now a is cold, though it had no row
    out, state = calls.finish()
    seen = [(r.agent, r.calls, r.is_warm) for r in out.orderBy("calls").collect()]
    assert ("a", 1, False) in seen and seen.count(("a", 1, False)) == 1
    assert {(r.agent, r.is_warm, r.last_success % 86_400) for r in state.collect()} == {("a", False, 0), ("b", True, 2400)}


def test_ingest_stream_meets_each_paper_once(spark, parts):
    feed = Slow(spark, parts).events.select((F.col("user_id") % 40).alias("paper_id"), "event_id", F.col("ts").alias("published_at"))
    stored = spark.range(10).select(F.col("id").alias("paper_id"))
    new, audit = J.stream_ingest(feed, stored, "event_id", delay="1 minute")
    seen = [r["paper_id"] for r in new.collect()]
    want = {r["user_id"] % 40 for r in Tables(spark, SF).events.select("user_id").collect()} - set(range(10))
    assert len(seen) == len(set(seen)) and set(seen) == want
    assert sum(r["papers_new"] for r in audit.collect()) == len(want)
