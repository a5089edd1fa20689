"""Session settings, the shared working folder, and size checks."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Spark 4.1 may treat a union of co-partitioned inputs as co-partitioned although its inputs no longer are once the plan
# adapts at run time; a grouping above it then sees a key twice. Off, the grouping exchanges its rows as usual.
UNION_PARTITIONING = "spark.sql.unionOutputPartitioning"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_LOCAL_SHARED: dict[str, str] = {}


def build_session(app: str = "corpusradar", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE, skew join, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        UNION_PARTITIONING: "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a ``local`` master may fall back to a temporary folder: there the driver and the
    executors are one process, so the folder is shared by construction.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SHARED:
        _LOCAL_SHARED[app] = tempfile.mkdtemp(prefix="corpusradar-")
    return _LOCAL_SHARED[app]


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{purpose}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(fresh_folder(spark, "lineage"))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a compressed table of columns in the shared folder: like ``cut_lineage``, for long texts, long arrays and tables of
    which later steps read some columns only."""
    folder = fresh_folder(df.sparkSession, "stored")
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession) -> None:
    """Free the disk of shuffle files and checkpoints that nothing refers to any more.

    Spark deletes them once the driver's JVM has collected their owners, which it may do after the next exchange has filled the disk.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only after counting; larger inputs keep the shuffle join (AQE splits skew)."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def union_all(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Union by name whose result may safely be grouped (see ``UNION_PARTITIONING``)."""
    first.sparkSession.conf.set(UNION_PARTITIONING, "false")
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def bound_batches(spark: SparkSession, most: int) -> None:
    """From now on no batch that goes to Python holds more than ``most`` bytes (or one row)."""
    now = spark.conf.get(ARROW_BYTES, None)
    if now is None or not now.rstrip("b").isdigit() or int(now.rstrip("b")) > most:
        spark.conf.set(ARROW_BYTES, str(most))
