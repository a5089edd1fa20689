"""State that follows event time, kept in hash buckets of which a batch rewrites only those it touches.

Rows wait until the watermark (newest time seen, less ``delay``) has passed them, so they reach the state in time order whatever
the order of their files; rows that come later than the watermark of the batches before are dropped. Everything that a batch
leaves is a table of its own below its batch id, and a manifest written last names what is current, so a batch that is run again
after a failure starts from the same state and leaves the same result. Versions that no manifest needs are deleted by the batch
after the next.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corpusradar.session import UNION_PARTITIONING, fresh_folder, union_all

# step(rows, state or None, mark) -> (output, new state of the touched keys). ``mark`` is the watermark in microseconds.
Step = Callable[[DataFrame, DataFrame | None, int], tuple[DataFrame, DataFrame]]


@dataclass
class Manifest:
    """What is current after a batch: newest event time, versions and due times by bucket, the waiting rows' table."""

    newest: int | None = None
    versions: dict[str, int] = field(default_factory=dict)
    due: dict[str, int] = field(default_factory=dict)
    waiting: int | None = None
    dead: list[str] = field(default_factory=list)
    dropped: int = 0


def file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Batch ids that have a table below ``path``."""
    where, fs = file_system(spark, path)
    if not fs.exists(where):
        return []
    found = (re.fullmatch(r"batch=(\d+)", s.getPath().getName()) for s in fs.listStatus(where))
    return sorted(int(m.group(1)) for m in found if m)


def _drop(spark: SparkSession, path: str) -> None:
    where, fs = file_system(spark, path)
    fs.delete(where, True)


class EventTimeState:
    """Drives ``step`` over the micro-batches of a stream; the same ``folder`` goes on where an earlier run stopped."""

    def __init__(self, step: Step, key: str, delay_seconds: int, folder: str, time: str = "ts", buckets: int = 32):
        self.step, self.key, self.delay, self.folder, self.time, self.buckets = step, key, delay_seconds * 1_000_000, folder, time, buckets

    def manifest(self, spark: SparkSession, before: int | None = None) -> Manifest:
        done = [v for v in versions(spark, f"{self.folder}/manifest") if before is None or v < before]
        if not done:
            return Manifest()
        text = spark.read.text(f"{self.folder}/manifest/batch={done[-1]}").first()[0]
        return Manifest(**json.loads(text))

    def state(self, spark: SparkSession, now: Manifest, buckets: list[int] | None = None) -> DataFrame | None:
        """The current rows of these buckets (of all)."""
        paths = [f"{self.folder}/state/batch={v}/_bucket={b}" for b, v in now.versions.items() if buckets is None or int(b) in buckets]
        return spark.read.parquet(*paths) if paths else None

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        spark.conf.set(UNION_PARTITIONING, "false")  # the session of the stream, not the caller's
        was = self.manifest(spark, batch_id)
        for path in was.dead:  # the batch before is committed; nothing reads these any more
            _drop(spark, path)
        now = Manifest(versions=dict(was.versions), due=dict(was.due))
        at = F.unix_micros(self.time)
        batch = batch.persist()
        fresh = batch if was.newest is None else batch.where(at >= was.newest - self.delay)
        newest, n_fresh = fresh.agg(F.max(at), F.count("*")).first()
        now.dropped = batch.count() - n_fresh
        now.newest = max(x for x in (was.newest, newest, 0) if x is not None) if newest is not None or was.newest is not None else None
        mark = (now.newest or 0) - self.delay
        rows = fresh
        if was.waiting is not None:
            rows = union_all(fresh, spark.read.schema(batch.schema).parquet(f"{self.folder}/waiting/batch={was.waiting}"))
        rows.where(at > mark).write.mode("overwrite").parquet(f"{self.folder}/waiting/batch={batch_id}")
        now.waiting = batch_id
        self._advance(spark, rows.where(at <= mark), mark, now, batch_id)
        if was.waiting is not None:
            now.dead.append(f"{self.folder}/waiting/batch={was.waiting}")
        now.dead += [f"{self.folder}/state/batch={v}/_bucket={b}" for b, v in was.versions.items() if now.versions[b] != v]
        spark.createDataFrame([(json.dumps(now.__dict__),)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{self.folder}/manifest/batch={batch_id}")
        batch.unpersist()

    def _advance(self, spark: SparkSession, ready: DataFrame, mark: int, now: Manifest, batch_id: int) -> None:
        touched = {r[0] for r in ready.select(self._bucket()).distinct().collect()}  # no more than there are buckets
        touched |= {int(b) for b, due in now.due.items() if due <= mark}
        if not touched:
            return
        output, state = self.step(ready, self.state(spark, now, sorted(touched)), mark)
        output.write.mode("overwrite").parquet(f"{self.folder}/out/batch={batch_id}")
        path = f"{self.folder}/state/batch={batch_id}"
        state.withColumn("_bucket", self._bucket()).write.mode("overwrite").partitionBy("_bucket").parquet(path)
        written = spark.read.schema(StructType([*state.schema.fields, StructField("_bucket", IntegerType())])).parquet(path)
        due = F.min("due") if "due" in state.columns else F.lit(None).cast("long")
        for bucket, when in written.groupBy("_bucket").agg(due).collect():
            now.versions[str(bucket)] = batch_id
            now.due.pop(str(bucket), None)
            if when is not None:
                now.due[str(bucket)] = when

    def finish(self, spark: SparkSession, schema) -> tuple[DataFrame, DataFrame]:
        """Output and state as if no row were to come: what waits is worked off aside, and the folder stays as it is."""
        now = self.manifest(spark)
        state, empty = self.state(spark, now), spark.createDataFrame([], schema)
        rows = empty if now.waiting is None else spark.read.schema(schema).parquet(f"{self.folder}/waiting/batch={now.waiting}")
        last, after = self.step(rows, state, now.newest or 0)
        parts = [spark.read.schema(last.schema).parquet(f"{self.folder}/out/batch={v}") for v in versions(spark, f"{self.folder}/out")[:1]]
        if parts:  # one read over all batches, whatever their number
            parts = [spark.read.schema(last.schema).option("basePath", f"{self.folder}/out").parquet(f"{self.folder}/out").select(last.columns)]
        return union_all(last, *parts), after


def run_event_time(stream: DataFrame, step: Step, key: str, delay_seconds: int, folder: str | None = None, time: str = "ts",
                   buckets: int = 32) -> EventTimeState:
    """Work off what is available. Returns the handle; ``finish`` reads the result."""
    folder = folder or fresh_folder(stream.sparkSession, "stream")
    driver = EventTimeState(step, key, delay_seconds, folder, time, buckets)
    query = (stream.writeStream.foreachBatch(driver.process).option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return driver
