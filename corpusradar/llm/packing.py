"""Best-fit packing of documents into training sequences, with conflicts.

Documents longer than a bin fill whole bins with their first pieces; what is left of each document is packed best-fit, longest
first. A bin carries what room is left, and bitmaps of the sources and duplicate clusters it holds; bins are kept in order of
their room. The search starts at the successor of the piece's length and goes on to the next roomier bin until one holds neither
the piece's source nor its cluster: the tightest compatible bin. If there is none, a bin is opened.

Rows are dealt at random to shards of about ``rows_per_shard`` rows, each packed in one task, so neither memory nor time of a task
grows with the table, and a hot source is spread over all shards.

Null texts count as empty; a piece of no length is packed like others. A null source or cluster conflicts with nothing. Rows
that repeat are packed each; equal lengths go by id, then by arrival. An empty table gives an empty table. Extra columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusradar.llm.common import ascii_lower, stored, whole_text


class Bins:
    """Open bins of one shard in order of their room."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room = capacity, []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """Put a piece whose source and cluster are single bits (or 0) into the tightest compatible bin: bin and offset in it."""
        at = bisect_left(self.by_room, (length, -1))
        while at < len(self.by_room):
            room, number = self.by_room[at]
            if not (self.sources[number] & source or self.clusters[number] & cluster):
                del self.by_room[at]
                break
            at += 1
        else:
            room, number = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[number] |= source
        self.clusters[number] |= cluster
        insort(self.by_room, (room - length, number))
        return number, self.capacity - room


def _bits(values: pd.Series, once: bool = False) -> list[int]:
    """One bit per distinct value, none for null; ``once``: none for a value that occurs once, which conflicts with nothing."""
    codes, names = pd.factorize(values)
    if once:
        often = pd.Series(codes).map(pd.Series(codes).value_counts()).to_numpy() > 1
        codes = pd.factorize(pd.Series(codes).where(often & (codes >= 0)))[0]
    return [1 << c if c >= 0 else 0 for c in codes.tolist()]


def _packer(capacity: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "id"], ascending=[False, True], kind="stable", na_position="last")
        bins = Bins(capacity)
        placed = [bins.place(n, s, c) for n, s, c in zip(rows["length"].tolist(), _bits(rows["source"]), _bits(rows["cluster"], True), strict=True)]
        return rows.assign(bin=[b for b, _ in placed], offset=[o for _, o in placed])[["shard", "id", "piece", "length", "bin", "offset"]]

    return pack


def packed(df: DataFrame, capacity: int = 2048, rows_per_shard: int = 8192) -> DataFrame:
    """``id, piece, start, length, bin, offset`` of every piece of ``id, length, source, cluster``: where it starts in its document,
    its bin (a number unique over all shards) and where it lies in the bin."""
    rows = stored(df.select("id", F.coalesce("length", F.lit(0)).cast("long").alias("length"), "source", "cluster"), "pack")
    shards = max(1, -(-rows.count() // rows_per_shard))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    whole = F.when(F.col("length") > 0, F.floor((F.col("length") - 1) / capacity)).otherwise(0).cast("int")
    rows = rows.withColumn("piece", whole)
    kind = rows.schema["id"].dataType.simpleString()
    rest = rows.withColumn("length", F.col("length") - F.col("piece") * capacity).groupBy("shard").applyInPandas(
        _packer(capacity), f"shard int, id {kind}, piece int, length long, bin long, offset long")
    rest = rest.select("id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), "length",
                       F.format_string("%d-%d", "shard", "bin").alias("bin"), "offset")
    full = rows.where("piece > 0").select("id", "shard", F.monotonically_increasing_id().alias("row"),
                                          F.explode(F.sequence(F.lit(0), F.col("piece") - 1)).alias("piece"))
    full = full.select("id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"),
                       F.format_string("full-%d-%d", "row", "piece").alias("bin"), F.lit(0).cast("long").alias("offset"))
    return rest.union(full)


def pieces_of(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Length in words, source, and the cluster of texts that are equal after lower-casing A-Z."""
    text = whole_text(text_col)
    return documents.select(F.col(id_col).alias("id"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("length"), "source",
                            F.xxhash64(ascii_lower(text)).alias("cluster"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return packed(pieces_of(spark.read.parquet(f"{folder}/documents.parquet"))).withColumnRenamed("id", "doc_id")
