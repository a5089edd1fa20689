"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition sorts its digests and collapses them into one run (a digest, how many rows had it, and the identifier
that stays). Runs then meet in binomial rounds: in each round the runs whose numbers agree after division by ``fan_in`` come
together, separately for each range of digests, the shuffle hands the sorted runs over, and one streaming pass merges them and
keeps one entry per digest. No task ever holds more than one entry of a digest from each run, so a text that a third of all
rows share costs one entry per run. Entries merge only if digest, byte length and a second hash all agree.

Nulls count as empty texts. Rows that repeat an identifier and a text count each in ``group_size`` and share the verdict. A
null identifier stays only if its whole group has none. An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusradar.llm.common import ascii_lower, stored, whole_text

KEY = ["digest", "length", "check"]


def _collapser(largest: bool):
    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Merge rows sorted by run, key and identifier into one row per run and key; the open key waits for the next batch."""
        held = None
        for batch in batches:
            table = pa.table(batch.columns, names=batch.schema.names)
            table = (pa.concat_tables([held, table]) if held is not None else table).combine_chunks()
            n = table.num_rows
            if not n:
                continue
            new = np.ones(n, bool)
            if n > 1:
                new[1:] = False
                for name in ["run", *KEY]:
                    col = table.column(name)
                    new[1:] |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            picks = np.append(starts[1:], n) - 1 if largest else starts
            merged = table.take(pa.array(picks))
            counts = np.add.reduceat(table.column("n").to_numpy(), starts)
            merged = merged.set_column(merged.schema.get_field_index("n"), "n", pa.array(counts, pa.int64()))
            held = merged.slice(merged.num_rows - 1)
            yield from merged.slice(0, merged.num_rows - 1).to_batches()
        if held is not None:
            yield from held.to_batches()

    return collapse


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, digest, length, check`` of every row's text after lower-casing A-Z."""
    text = ascii_lower(whole_text(text_col))
    return df.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"),
                     F.octet_length(text).cast("long").alias("length"), F.xxhash64(text).alias("check"))


def merge_runs(prints: DataFrame, keep: str = "largest", runs: int = 256, fan_in: int = 16) -> DataFrame:
    """One row per distinct key: ``digest, length, check, keep_id, group_size``.

    ``runs`` numbers the leaves (input partition modulo ``runs``), ``fan_in`` how many runs a round merges into one.
    """
    largest = {"largest": True, "smallest": False}[keep]
    order: Column = F.col("id").asc_nulls_first() if largest else F.col("id").asc_nulls_last()
    level = prints.select((F.spark_partition_id() % runs).alias("run"), *KEY, "id", F.lit(1).cast("long").alias("n"))
    schema, collapse = level.schema, _collapser(largest)
    level = level.sortWithinPartitions("run", *KEY, order).mapInArrow(collapse, schema)
    while runs > 1:
        runs = -(-runs // fan_in)
        level = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        level = (level.repartition("run", F.substring("digest", 1, 2)).sortWithinPartitions("run", *KEY, order)
                 .mapInArrow(collapse, schema))
    return level.select(*KEY, F.col("id").alias("keep_id"), F.col("n").alias("group_size"))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", **tree: int) -> DataFrame:
    """Per row of ``df``: ``id, keep_id, group_size, kept, text_sha256``; of equal texts the row ``keep`` names stays."""
    prints = stored(fingerprints(df, id_col, text_col), "digests")
    merged = merge_runs(prints, keep, **tree)
    return prints.join(merged, KEY).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``df`` that stay, all columns. Rows that repeat the staying identifier and text all stay."""
    prints = stored(fingerprints(df, id_col, text_col), "digests")
    gone = prints.join(merge_runs(prints, keep), KEY).where(~F.col("id").eqNullSafe(F.col("keep_id")))
    gone = stored(gone.select(F.col("id").alias("__id"), F.col("check").alias("__check")).distinct(), "dropped")
    mine = F.xxhash64(ascii_lower(whole_text(text_col)))
    return df.join(gone, df[id_col].eqNullSafe(F.col("__id")) & (mine == F.col("__check")), "left_anti")


def query(spark, folder: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
           FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, d.h AS text_sha256 FROM d JOIN g ON d.h = g.h
"""
