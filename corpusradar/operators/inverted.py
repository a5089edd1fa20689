"""A stored inverted index with block maxima: built once, searched many times, reading only what a search can still use.

The postings of a term are cut into blocks of like impact (what a posting adds to a score before the term's weight): first by
impact level, then by hash, so a term that is in every text is spread like any other. Each block keeps its largest impact. The
table is partitioned by a hash of the term and sorted by term inside.

A search first scores the best blocks of its terms; the k-th best of these partial sums is a score that k texts reach for sure. A
block is then needed only if its largest impact, with all other terms of the question at their largest, can reach that score: a
text in any other block stays below it however its other terms stand. Texts that have only the lightest terms, which cannot reach
it even together, are never candidates; postings of those terms count for the candidates alone. What remains is scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusradar.functions.text import search_tokens, words
from corpusradar.operators.lexical import MOST_QUERIES, _summed, postings
from corpusradar.session import broadcast_if_small, cut_lineage

LEVELS = 16
MOST_ASKED = 100_000  # asked terms of all questions that are sent to the tasks; beyond, they are joined
PUSHED_TERMS = 1000  # up to so many asked terms are named to the Parquet reader besides the join


@dataclass(frozen=True)
class InvertedIndex:
    """The tables ``blocks``, ``terms`` and ``stats`` below ``folder``."""

    spark: SparkSession
    folder: str
    id_col: str
    id_type: str
    buckets: int
    k1: float
    b: float

    def read(self, name: str) -> DataFrame:
        schemas = {
            "stats": "n long, avgdl double",
            "postings": f"{self.id_col} {self.id_type}, dl int, term string, tf long, impact double, level int",
            "blocks": f"term string, level int, part int, top double, rows array<struct<id: {self.id_type}, dl: int, tf: long>>, bucket int",
            "terms": "term string, df long, most double, best_level int, bucket int",
        }
        return self.spark.read.schema(schemas[name]).parquet(f"{self.folder}/{name}")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")


def build_index(corpus: DataFrame, folder: str, id_col: str = "paper_id", block_rows: int = 128, buckets: int = 64, k1: float = 1.5,
                b: float = 0.75) -> InvertedIndex:
    """Write the index of ``corpus(id_col, text)``; average length in white-space words, own length in tokens."""
    index = InvertedIndex(corpus.sparkSession, folder, id_col, corpus.schema[id_col].dataType.simpleString(), buckets, k1, b)
    corpus.agg(F.count("*").alias("n"), F.avg(F.size(words(F.col("text")))).alias("avgdl")).write.parquet(f"{folder}/stats")
    average = index.read("stats").select("avgdl").scalar()
    impact = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / average))
    level = F.least(F.floor(F.col("impact") * LEVELS / (k1 + 1)), F.lit(LEVELS - 1)).cast("int")
    post = postings(corpus, id_col).withColumn("impact", impact).withColumn("level", level)
    post.write.parquet(f"{folder}/postings")
    post = index.read("postings")
    long = post.groupBy("term", "level").agg(F.ceil(F.count("*") / block_rows).alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64(id_col), F.coalesce("parts", F.lit(1))).cast("int")
    parted = post.join(broadcast_if_small(cut_lineage(long)), ["term", "level"], "left").withColumn("part", part)
    spread = F.pmod(F.xxhash64("term", "part"), F.lit(4))  # a bucket is written by a few tasks
    # One exchange of single postings serves grouping and writing: rows of a block follow each other in a task and are cut there.
    dealt = parted.withColumns({"bucket": index.bucket(), "spread": spread}).repartition("bucket", "spread").select(
        "bucket", "term", "level", "part", "impact", F.col(id_col).alias("id"), "dl", F.col("tf").cast("bigint").alias("tf"))
    blocks = dealt.sortWithinPartitions("bucket", "term", "level", "part").mapInArrow(
        _cut_blocks, f"term string, level int, part int, top double, rows array<struct<id: {index.id_type}, dl: int, tf: bigint>>, bucket int")
    blocks.sortWithinPartitions("bucket", "term", "level", "part").write.partitionBy("bucket").parquet(f"{folder}/blocks")
    terms = index.read("blocks").groupBy("bucket", "term").agg(F.sum(F.size("rows")).alias("df"), F.max("top").alias("most"), F.max("level").alias("best_level"))
    terms.repartition("bucket").sortWithinPartitions("term").write.partitionBy("bucket").parquet(f"{folder}/terms")
    return index


def _cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted postings to blocks; the last block of a batch may go on in the next."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        starts = _starts(rows)
        if len(starts) > 1:
            yield _blocks(rows.slice(0, starts[-1]), starts[:-1])
        held = rows.slice(starts[-1])
    if held is not None:
        yield _blocks(held, np.zeros(1, np.int64))


def _starts(rows: pa.RecordBatch) -> np.ndarray:
    """Where a block begins: another term, level or part than in the row before."""
    keys = [rows.column("term").dictionary_encode().indices, rows.column("level"), rows.column("part")]
    other = np.append(True, np.zeros(rows.num_rows - 1, bool))
    for key in keys:
        key = key.to_numpy(zero_copy_only=False)
        other[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(other)


def _blocks(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    texts = pa.StructArray.from_arrays([rows.column(c) for c in ("id", "dl", "tf")], names=["id", "dl", "tf"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, rows.num_rows), pa.int32()), texts)
    top = np.maximum.reduceat(rows.column("impact").to_numpy(zero_copy_only=False), starts)
    term, level, part, bucket = (rows.column(c).take(pa.array(starts)) for c in ("term", "level", "part", "bucket"))
    return pa.RecordBatch.from_arrays([term, level, part, pa.array(top), lists, bucket], names=["term", "level", "part", "top", "rows", "bucket"])


def _asked(index: InvertedIndex, queries: DataFrame) -> DataFrame:
    """``query_id, bucket, term, weight, best_level, others, upto``: asked terms that the index has; ``others`` is what all other
    terms of the question can add at most, ``upto`` what this term and the lighter ones can."""
    asked = queries.select("query_id", F.explode(search_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(
        F.count("*").alias("qtf")).withColumn("bucket", index.bucket())
    found = _of_terms(index, "terms", cut_lineage(asked))
    n = index.read("stats").select("n").scalar()
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weighted = found.select("query_id", "bucket", "term", (F.col("qtf") * idf).alias("weight"), "most", "best_level")
    reach = F.col("weight") * F.col("most")
    question = W.partitionBy("query_id")
    return cut_lineage(weighted.withColumns({"others": F.sum(reach).over(question) - reach, "upto": F.sum(reach).over(
        question.orderBy(reach, "term").rowsBetween(W.unboundedPreceding, W.currentRow))}).drop("most"))


def _of_terms(index: InvertedIndex, name: str, asked: DataFrame) -> DataFrame:
    """Rows of a table of the index that belong to asked terms: only their buckets and, for few terms, their row groups are read."""
    table = index.read(name)
    some = [r[0] for r in asked.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    buckets = [r[0] for r in asked.select("bucket").distinct().collect()]  # no more than there are buckets
    table = table.where(F.col("bucket").isin(buckets))
    if len(some) <= PUSHED_TERMS:
        table = table.where(F.col("term").isin(some))
    return table.join(broadcast_if_small(asked), ["bucket", "term"])


def _rows(blocks: DataFrame) -> DataFrame:
    return blocks.select("query_id", "weight", F.explode("rows").alias("r")).withColumn("id", F.col("r.id"))


def _scored(index: InvertedIndex, rows: DataFrame) -> DataFrame:
    average = index.read("stats").select("avgdl").scalar()
    part = F.col("weight") * F.col("r.tf") * (index.k1 + 1) / (F.col("r.tf") + index.k1 * (1 - index.b + index.b * F.col("r.dl") / average))
    return rows.groupBy("query_id", F.col("id").alias(index.id_col)).agg(F.round(F.sum(part), 6).alias("score"))


def needed_blocks(index: InvertedIndex, queries: DataFrame, k: int) -> DataFrame:
    """Blocks, per question, that the k best texts have rows in, with the question's weight of their term; ``leads`` where a text
    may be found that way."""
    blocks = _of_terms(index, "blocks", _with_least(index, _asked(index, queries), k))
    return blocks.where(F.col("weight") * F.col("top") + F.col("others") >= F.col("least")).withColumn("leads", F.col("upto") >= F.col("least"))


def _with_least(index: InvertedIndex, asked: DataFrame, k: int) -> DataFrame:
    """Asked terms with ``least``, a score that k texts reach for sure."""
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), index.id_col)
    first = _of_terms(index, "blocks", asked).where("level = best_level AND part = 0")
    sure = _scored(index, _rows(first)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    sure = cut_lineage(sure.select("query_id", (F.col("score") - 2e-6).alias("_sure")))
    return asked.join(sure, "query_id", "left").withColumn("least", F.coalesce("_sure", F.lit(0.0))).drop("_sure")


def candidates(blocks: DataFrame) -> DataFrame:
    """``query_id, id``: texts that may be among the k best."""
    return _rows(blocks.where("leads")).select("query_id", "id").distinct()


def search(index: InvertedIndex, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, id_col, score, rank)`` of the k best texts per question, equal scores by id.

    Up to ``MOST_QUERIES`` questions are worked on together: a block that any of them needs is read once, its rows cross the network
    once, dealt by text, and are summed as arrays of the questions. Beyond, there is a row per question and posting.
    """
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), index.id_col)
    asked = _asked(index, queries)
    if asked.limit(MOST_ASKED + 1).count() <= MOST_ASKED and asked.select("query_id").distinct().count() <= MOST_QUERIES:
        scored = _summed_rows(index, queries, _with_least(index, asked, k), k)
    else:
        blocks = needed_blocks(index, queries, k)
        some = broadcast_if_small(cut_lineage(candidates(blocks)))
        scored = _scored(index, _rows(blocks).join(some, ["query_id", "id"], "left_semi"))
    ranked = scored.select("query_id", index.id_col, "score").withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("rank") <= k) & (F.col("score") > 0))


def _summed_rows(index: InvertedIndex, queries: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k best per question and task. A term's blocks are needed down to the smallest maximum that serves one of its questions;
    for the other questions the rows of such a block are true parts of scores as well."""
    asked = cut_lineage(asked)
    bars = asked.groupBy("bucket", "term").agg(F.min((F.col("least") - F.col("others")) / F.col("weight")).alias("_bar"))
    codes = cut_lineage(bars.withColumn("_code", F.monotonically_increasing_id()))
    table = asked.join(F.broadcast(codes), ["bucket", "term"]).select("_code", "query_id", "weight").toArrow()  # MOST_ASKED rows at most
    blocks = _of_terms(index, "blocks", codes).where(F.col("top") >= F.col("_bar") - 1e-9)
    average = index.read("stats").select("avgdl").scalar()
    share = F.col("r.tf") * (index.k1 + 1) / (F.col("r.tf") + index.k1 * (1 - index.b + index.b * F.col("r.dl") / average))
    shares = blocks.select("_code", F.explode("rows").alias("r")).select(F.col("r.id").alias("id"), "_code", share.alias("_share"))
    kind = queries.schema["query_id"].dataType.simpleString()
    return shares.repartition("id").sortWithinPartitions("id").mapInArrow(
        _summed(shares, table, k, index.id_col), f"`{index.id_col}` {index.id_type}, query_id {kind}, score double")
