"""The best documents for every search item, by reversed search: documents stream through an inverted index over the items' terms.

1. The terms of the items (never of the documents) make a vocabulary and an inverted index term -> items. Items are dealt into
   blocks of about ``block_postings`` postings, so what is broadcast is bounded however many items there are.
2. One pass over the whole texts of all documents leaves each document's length and its counts of vocabulary terms, and per task
   the number of documents, of terms, and of documents per vocabulary term, which are summed over all tasks.
3. The stored counts stream through the index. A task keeps one bounded heap per item: a score below the heap's last one is
   dropped at once. The heaps are merged in two rounds, first those of neighbouring tasks.

Scores are exact integers (see ``weights``): a term is found by a 64-bit hash and then compared byte by byte. A term is a maximal
run of letters and digits A-Z, a-z, 0-9 and of all characters beyond ASCII, with only A-Z lower-cased. Null texts have no terms.
Rows of one item id are one item, whose terms add up; a null id is an id. Each document row is a document of its own, repeated
ids and texts included. Equal scores go by document id, a null id last. Items without a scored document give no rows, empty
tables an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusradar.llm.common import SLICES, array_parts, array_total, fold_bytes, span_hashes, stored, text_blocks, whole_text, words
from corpusradar.session import fresh_folder

GAP = np.ones(256, bool)
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    GAP[_first:_last + 1] = False
MERGED_TASKS = 64


@dataclass(frozen=True)
class Settings:
    k: int = 20
    block_postings: int = 1 << 20
    grid: int = 1 << 22  # scores, or postings met, that a task works on at a time


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """``floor(1000 * ln((2 N + 2) / (2 df + 1)))`` per term."""
    return np.array([floor(1000 * log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def parts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """``(10**9 tf) div (1000 tf + 12 m)`` with ``m = 75 + (25 n N) div L``: grows with the count, less in long documents."""
    wide = n.astype(object) if len(n) and 25 * int(n.max()) * n_docs >= 1 << 63 else n.astype(np.int64)
    m = (75 + 25 * wide * n_docs // n_terms).astype(np.int64)
    return 10**9 * tf // (1000 * tf + 12 * m)


class Vocabulary:
    """Distinct terms, looked up by hash and confirmed by their bytes. Terms that share a hash go to different tables."""

    def __init__(self, terms: list[bytes]):
        self.size, lengths = len(terms), np.array([len(t) for t in terms], np.int64)
        self.octets, self.lengths, self.begins = np.frombuffer(b"".join(terms), np.uint8), lengths, np.cumsum(lengths) - lengths
        hashes, left, self.tables = span_hashes(self.octets, self.begins, self.begins + lengths), np.arange(len(terms)), []
        while len(left):
            values, at = np.unique(hashes[left], return_index=True)
            self.tables.append((values, left[at]))
            left = np.delete(left, at)

    def find(self, octets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of the term at each span, -1 for others."""
        found, hashes = np.full(len(starts), -1, np.int64), span_hashes(octets, starts, ends)
        for values, numbers in self.tables:
            at = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
            hit = np.flatnonzero(values[at] == hashes)
            term = numbers[at[hit]]
            same = self.lengths[term] == ends[hit] - starts[hit]
            hit, term = hit[same], term[same]
            size = self.lengths[term]
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            other = octets[np.repeat(starts[hit], size) + step] != self.octets[np.repeat(self.begins[term], size) + step]
            right = np.ones(len(hit), bool)
            right[np.repeat(np.arange(len(hit)), size)[other]] = False
            found[hit[right]] = term[right]
        return found


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item, term, n``: distinct terms of every item id with their number."""
    rows = items.select(F.col(id_col).alias("item"), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, octets, bounds in text_blocks(batch.column(1)):
                octets = fold_bytes(octets)
                starts, ends, of = words(octets, bounds, GAP)
                raw = octets.tobytes()
                terms = pa.array([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of + row)), terms], names=["item", "term"])

    found = rows.mapInArrow(run, f"item {rows.schema['item'].dataType.simpleString()}, term binary")
    return found.groupBy("item", "term").agg(F.count("*").alias("n"))


def counted(docs: DataFrame, id_col: str, text_col: str, vocabulary: Vocabulary) -> tuple[DataFrame, np.ndarray]:
    """``id, n, terms, tfs`` per document that has vocabulary terms, and the sums: df per term, documents, terms."""
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kind = shared.value, None
        sums, names = np.zeros(known.size + 2, np.int64), ["id", "n", "terms", "tfs", "slice", "part"]
        for batch in batches:
            kind = batch.schema.field(0).type
            for row, end, octets, bounds in text_blocks(batch.column(1)):
                octets = fold_bytes(octets)
                starts, ends, of = words(octets, bounds, GAP)
                lengths = np.bincount(of, minlength=end - row)
                sums[-2:] += np.count_nonzero(lengths), len(of)
                term = known.find(octets, starts, ends)
                pairs, tf = np.unique(of[term >= 0] * known.size + term[term >= 0], return_counts=True)
                of, term = np.divmod(pairs, max(1, known.size))
                sums[:-2] += np.bincount(term, minlength=known.size)
                docs_, first = np.unique(of, return_index=True)
                if not len(docs_):
                    continue
                cut = [pa.array([x.astype("<i4").tobytes() for x in np.split(v, first[1:])], pa.binary()) for v in (term, tf)]
                n = len(docs_)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs_ + row)), pa.array(lengths[docs_]), *cut,
                                                  pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if kind is not None and sums.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, kind), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.binary()),
                                              pa.nulls(SLICES, pa.binary()), *array_parts(sums)], names=names)

    kind = rows.schema["id"].dataType.simpleString()
    both = stored(rows.mapInArrow(run, f"id {kind}, n long, terms binary, tfs binary, slice int, part binary"), "term-counts", compression="zstd")
    return both.where("slice IS NULL").select("id", "n", "terms", "tfs"), array_total(both.where("slice IS NOT NULL"), vocabulary.size + 2)


class _Heaps:
    """The ``k`` best scores of every item so far, equal ones by id."""

    def __init__(self, n_items: int, k: int, kind: pa.DataType):
        self.k, self.bar = k, np.ones(n_items, np.int64)
        self.rows = pa.table({"item": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "id": pa.array([], kind)})

    def offer(self, scores: np.ndarray, ids: pa.Array) -> None:
        """``scores``: documents x items."""
        if len(scores) > self.k:
            self.bar = np.maximum(self.bar, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
        doc, item = np.nonzero(scores >= self.bar)
        if not len(doc):
            return
        fresh = pa.table({"item": pa.array(item), "score": pa.array(scores[doc, item]), "id": ids.take(pa.array(doc))})
        rows = pa.concat_tables([self.rows, fresh]).combine_chunks()
        rows = rows.take(pc.sort_indices(rows, [("item", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_end"))
        items = rows["item"].to_numpy()
        rank = np.arange(len(items)) - np.searchsorted(items, items)
        self.rows = rows.filter(pa.array(rank < self.k)).combine_chunks()
        last = np.flatnonzero(rank == self.k - 1)
        self.bar[items[last]] = np.maximum(self.bar[items[last]], rows["score"].to_numpy()[last])


def streamed(counts: DataFrame, sums: np.ndarray, items: pa.Array, postings: tuple[np.ndarray, np.ndarray, np.ndarray], rule: Settings) -> DataFrame:
    """``item, rank, id, score`` of the block's items, from the documents' counts.

    ``postings``: per term its first posting, then item numbers and counts.
    """
    n_docs, n_terms = int(sums[-2]), int(sums[-1])
    starts, of, times = postings
    most = int(np.bincount(of, times).max()) * 10**6 * 1000 * ceil(log(2 * n_docs + 2))  # no item's score is larger
    shared = counts.sparkSession.sparkContext.broadcast((weights(n_docs, sums[:-2]), starts, of, times, items))
    kinds = counts.schema["id"].dataType.simpleString(), {pa.int64(): "bigint", pa.int32(): "int"}.get(items.type, "string")

    def scores(term: np.ndarray, doc: np.ndarray, part: np.ndarray, size: int) -> np.ndarray:
        weight, first, item, qtf, names = shared.value
        met = first[term + 1] - first[term]
        at = np.repeat(first[term] - (np.cumsum(met) - met), met) + np.arange(met.sum())
        cell = np.repeat(doc, met) * len(names) + item[at]
        value = np.repeat(weight[term] * part, met) * qtf[at]
        if most < 1 << 53:  # whole numbers that a double holds
            total = np.bincount(cell, value, minlength=size * len(names)).astype(np.int64)
        else:
            total = np.zeros(size * len(names), np.int64)
            np.add.at(total, cell, value)
        return total.reshape(size, len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, _, _, names = shared.value
        heaps = None
        for batch in batches:
            heaps = heaps or _Heaps(len(names), rule.k, batch.schema.field(0).type)
            term, tf = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<i4").astype(np.int64) for c in (2, 3))
            sizes = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False) // 4
            ends = np.cumsum(sizes)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            part = parts(tf, batch.column(1).to_numpy()[doc], n_docs, n_terms)
            met = np.append(0, np.cumsum(first[term + 1] - first[term]))[ends]
            row = 0
            while row < len(sizes):
                end = int(np.searchsorted(met, (met[row - 1] if row else 0) + rule.grid, side="right"))
                end = min(max(row + 1, end), row + max(1, rule.grid // len(names)), len(sizes))
                span = slice(ends[row] - sizes[row], ends[end - 1])
                heaps.offer(scores(term[span], doc[span] - row, part[span], end - row), batch.column(0).slice(row, end - row))
                row = end
        if heaps:
            rows = heaps.rows
            yield from pa.table({"slot": rows["item"], "item": names.take(rows["item"].combine_chunks()), "id": rows["id"],
                                 "score": rows["score"]}).to_batches()

    found = counts.mapInArrow(run, f"slot long, item {kinds[1]}, id {kinds[0]}, score long").withColumn(
        "task", F.floor(F.spark_partition_id() / MERGED_TASKS))
    for keys in (["slot", "task"], ["slot"]):
        order = W.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rule.k)
    return found.select("item", "rank", "id", "score")


def ranked(items: DataFrame, docs: DataFrame, item_col: str = "item_id", doc_col: str = "doc_id", text_col: str = "text",
           rule: Settings | None = None) -> DataFrame:
    """``item_col, rank, doc_col, score``: the ``k`` best documents of every item, best first."""
    rule, spark = rule or Settings(), docs.sparkSession
    terms = stored(item_terms(items, item_col, text_col), "item-terms")
    blocks = ceil(terms.count() / rule.block_postings)
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((items, item_col), (docs, doc_col))]
    path, kind = fresh_folder(spark, "ranked"), f"item {kinds[0]}, rank int, id {kinds[1]}, score long"
    spark.createDataFrame([], kind).write.parquet(path)
    for block in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow().combine_chunks()  # about `block_postings` rows
        if not rows.num_rows:
            continue
        names, words_ = (pc.dictionary_encode(rows[c], null_encoding="encode").combine_chunks() for c in ("item", "term"))
        term = words_.indices.to_numpy()
        order = np.argsort(term, kind="stable")
        starts = np.searchsorted(term[order], np.arange(len(words_.dictionary) + 1))
        index = starts, names.indices.to_numpy()[order].astype(np.int64), rows["n"].to_numpy()[order]
        counts, sums = counted(docs, doc_col, text_col, Vocabulary(words_.dictionary.to_pylist()))
        if sums[-2]:
            streamed(counts, sums, names.dictionary, index, rule).write.mode("append").parquet(path)
    return spark.read.schema(kind).parquet(path).toDF(item_col, "rank", doc_col, "score")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{folder}/benchmark.parquet"), spark.read.parquet(f"{folder}/documents.parquet"))


SQL = r"""
WITH doc_terms AS (
    SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)
), item_terms AS (
    SELECT item_id, term, count(*) AS qtf
    FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
    GROUP BY item_id, term
), lengths AS (
    SELECT row, doc_id, count(*) AS n FROM doc_terms GROUP BY row, doc_id
), totals AS (
    SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths
), tfs AS (
    SELECT row, term, count(*) AS tf FROM doc_terms GROUP BY row, term
), weighted AS (
    SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY term, n_docs
), scored AS (
    SELECT i.item_id, l.row, l.doc_id, CAST(sum(i.qtf * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 12 * (100 - 25 + (25 * l.n * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM item_terms i JOIN weighted w ON w.term = i.term JOIN tfs t ON t.term = i.term JOIN lengths l ON l.row = t.row, totals
    GROUP BY i.item_id, l.row, l.doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, row) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, row) <= 20
"""
