"""Stored tables that are updated in place: Parquet in hash buckets of an id, of which an update rewrites those it touches.

An update reads the touched buckets only (partition pruning), writes their new rows to a staging folder, and then overwrites
just these partitions dynamically; files of other buckets stay as they are. Every update has a run name. What is staged whole
is carried out by the next call, whoever makes it, and a run that has left its receipt is not applied again, so a driver that
dies at any point may simply call once more. One writer at a time; a reader that needs one state must not read during the
overwrite. Rows are spread by ``REBALANCE``, so a bucket that a hot id fills is written by many tasks.

Rows of an update without id take no part. Of several rows of one id in an update one is taken, by hash and so always the
same; stored rows that share an id are all updated.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from corpusradar.operators.sessions import append_turn
from corpusradar.operators.vectors import Encoder, embed_pending, hashing_encoder
from corpusradar.session import union_all
from corpusradar.sources.store import ANALYSIS_COLUMNS, vector_metadata

BUCKET, STATUS = "_bucket", "_status"


def one_per_key(rows: DataFrame, key: str) -> DataFrame:
    """One row per id that is not NULL."""
    whole = F.struct(*rows.columns)
    picked = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, F.xxhash64(whole)).alias("_row"))
    return picked.select("_row.*")


@dataclass(frozen=True)
class BucketedTable:
    """A table of ``schema`` below ``folder`` (which all executors reach), cut by the hash of ``key``."""

    spark: SparkSession
    folder: str
    key: str
    schema: StructType
    buckets: int = 64

    @property
    def data(self) -> str:
        return f"{self.folder}/data"

    def _path(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        where, fs = self._path(path)
        return fs.exists(where)

    def _drop(self, path: str) -> None:
        where, fs = self._path(path)
        fs.delete(where, True)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, path: str, dynamic: bool = False) -> None:
        spread = rows.hint("rebalance", F.col(BUCKET))
        (spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if dynamic else "static")
         .option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").partitionBy(BUCKET).parquet(path))

    def create(self, rows: DataFrame) -> BucketedTable:
        """Write the first rows; columns that are missing become NULL."""
        if self._exists(self.data):
            raise ValueError(f"there is a table in {self.folder}")
        self._write(self._shaped(rows).withColumn(BUCKET, self.bucket()), self.data)
        return self

    def _shaped(self, rows: DataFrame, *extra: str) -> DataFrame:
        have = set(rows.columns)
        return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema], *extra)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The stored rows, of some buckets if asked; other buckets are not opened."""
        if not self._exists(self.data):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(StructType([*self.schema.fields, StructField(BUCKET, IntegerType())])).parquet(self.data)
        if buckets is not None:
            rows = rows.where(F.col(BUCKET).isin(buckets))
        return rows.drop(BUCKET)

    def finish(self) -> None:
        """Carry out the update that is staged whole, if there is one, and forget one that is not."""
        where, fs = self._path(f"{self.folder}/stage")
        if not fs.exists(where):
            return
        for found in fs.listStatus(where):
            run = found.getPath().getName()
            stage = f"{self.folder}/stage/{run}"
            if self._exists(f"{stage}/_SUCCESS") and not self._exists(f"{self.folder}/runs/{run}/_SUCCESS"):
                self._apply(run, stage)
            self._drop(stage)

    def _apply(self, run: str, stage: str) -> None:
        staged = self.spark.read.schema(StructType([*self.schema.fields, StructField(STATUS, StringType()),
                                                    StructField(BUCKET, IntegerType())])).parquet(stage)
        self._write(staged.where(F.col(STATUS) != "removed").drop(STATUS), self.data, dynamic=True)
        counts = staged.groupBy(F.col(STATUS).alias("status")).agg(F.count("*").alias("rows")).coalesce(1)
        counts.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.folder}/runs/{run}")

    def update(self, run: str, ids: DataFrame, change: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
        """Replace the buckets of ``ids(key)`` by ``change(their rows)`` and return the rows per status.

        ``change`` gives every row that the touched buckets are to hold, marked in ``_status`` (``inserted``, ``updated``,
        ``kept``), and may report ``removed`` ones. It must leave a row in each bucket that loses some.
        """
        if not re.fullmatch(r"[A-Za-z0-9][\w.-]*", run):
            raise ValueError(f"not a run name: {run}")
        self.finish()
        receipt = f"{self.folder}/runs/{run}"
        if not self._exists(f"{receipt}/_SUCCESS"):
            touched = [r[0] for r in ids.where(F.col(self.key).isNotNull()).select(self.bucket()).distinct().collect()]  # at most `buckets`
            rows = self._shaped(change(self.read(touched)), STATUS).withColumn(BUCKET, self.bucket())
            self._write(rows, f"{self.folder}/stage/{run}")
            self.finish()
        found = self.spark.read.schema("status string, rows long").parquet(receipt).collect()  # one row per status
        return {"inserted": 0, "updated": 0, "kept": 0, "removed": 0, **{r["status"]: r["rows"] for r in found}}

    def merge(self, run: str, rows: DataFrame, insert: bool = True) -> dict[str, int]:
        """Known ids take the given columns of ``rows(key, ...)``; unknown ones are inserted, or ignored without ``insert``."""
        rows = one_per_key(rows, self.key)
        given = [c for c in rows.columns if c != self.key and c in self.schema.names]

        def change(stored: DataFrame) -> DataFrame:
            new = rows.select(self.key, F.struct(F.lit(True).alias("_hit"), *given).alias("_new"))
            both = stored.withColumn("_old", F.lit(True)).join(new, self.key, "full_outer" if insert else "left")
            hit = F.col("_new").isNotNull()
            pick = lambda f: F.when(hit, F.col("_new")[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)
            status = F.when(F.col("_old").isNull(), "inserted").when(hit, "updated").otherwise("kept").alias(STATUS)
            return both.select(*[pick(f) if f.name in given else f.name for f in self.schema], status)

        return self.update(run, rows, change)


def save_analysis(papers: BucketedTable, results: DataFrame, run: str) -> dict[str, int]:
    """Analysis columns of known papers, which become analysed; unknown ids change nothing."""
    if "latency" in results.columns:
        results = results.withColumnRenamed("latency", "latency_score")
    given = [c for c in ANALYSIS_COLUMNS if c in results.columns]
    return papers.merge(run, results.select(papers.key, *given, F.lit(True).alias("is_analyzed")), insert=False)


def save_metadata(vectors: BucketedTable, papers: DataFrame, run: str) -> dict[str, int]:
    """New metadata of the stored vectors of these papers; the vectors stay."""
    return vectors.merge(run, vector_metadata(papers), insert=False)


def save_chunks(chunks: BucketedTable, new: DataFrame, run: str) -> dict[str, int]:
    """The chunks of all papers in ``new`` are replaced by ``new``."""
    new = new.where(F.col(chunks.key).isNotNull())
    redone = new.select(chunks.key).distinct()

    def change(stored: DataFrame) -> DataFrame:
        old = stored.join(redone.withColumn("_gone", F.lit(True)), chunks.key, "left")
        gone = F.col("_gone").isNotNull()
        fields = [F.col(f.name) if f.name == chunks.key else F.when(~gone, F.col(f.name)).alias(f.name) for f in chunks.schema]
        kept = old.select(*fields, F.when(gone, "removed").otherwise("kept").alias(STATUS))
        return union_all(kept, new.withColumn(STATUS, F.lit("inserted")))

    return chunks.update(run, redone, change)


def save_turns(headers: BucketedTable, incoming: DataFrame, now: Column, run: str) -> dict[str, int]:
    """One more exchange per session of ``incoming(conv_id, history_count, message)``."""
    incoming = one_per_key(incoming, headers.key)
    return headers.update(run, incoming, lambda stored: append_turn(stored, incoming, now).withColumnRenamed("status", STATUS))


def embed_stored(papers: BucketedTable, vectors: BucketedTable, run: str, encoder: Encoder = hashing_encoder) -> int:
    """Encode the papers that are not embedded yet, store their vectors, flip their flags, and return their number.

    The flag follows the vector: only papers whose vector is stored get it, so a run that is repeated loses none.
    """
    papers.finish()
    pending = papers.read().where(~F.coalesce("is_embedded", F.lit(False)))
    vectors.merge(run, embed_pending(pending, encoder))
    done = pending.join(vectors.read(), papers.key, "left_semi").select(papers.key, F.lit(True).alias("is_embedded"))
    return papers.merge(run, done, insert=False)["updated"]
