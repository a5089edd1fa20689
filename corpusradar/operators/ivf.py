"""Approximate neighbours from stored inverted lists with product-quantised residuals, re-scored exactly.

A bounded sample places the centres of the lists, whose number follows the square root of the rows, and the codebooks of the
residuals. Every vector is then written to the list of its nearest centre with a short code of its residual. A search reads the
lists nearest to its questions only (the table is partitioned by list), ranks their rows by distances looked up from the codes,
and computes true distances for the best ``shortlist`` rows per question and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusradar.operators.blocks import unit_rows
from corpusradar.operators.kbest import _Best, _matrix, rounds_for
from corpusradar.session import union_all

MOST_LISTS = 4096
CODES = 256


@dataclass(frozen=True)
class IvfIndex:
    """Lists stored below ``folder``; centres (lists x dims) and codebooks (parts x codes x dims of a part) fit a broadcast."""

    spark: SparkSession
    folder: str
    schema: str
    centres: np.ndarray
    books: list[np.ndarray]

    def lists(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.folder)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1)[None, :] - 2 * rows @ centres.T).argmin(axis=1)


def k_means(rows: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Centres of a sample; an empty cell keeps its centre."""
    draw = np.random.default_rng(seed)
    centres = rows[draw.permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(rows, centres)
        sums, sizes = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, rows)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def build_lists(vectors: DataFrame, folder: str, id_col: str, n_lists: int | None = None, parts: int = 8, sample_per_list: int = 64,
                seed: int = 42) -> IvfIndex:
    """Write the index of ``vectors(id_col, embedding)``. The sample has ``sample_per_list`` rows per list, by hash of the id."""
    rows = vectors.select(id_col, "embedding").where("embedding IS NOT NULL")
    n_lists = max(1, min(n_lists or ceil(sqrt(max(1, rows.count()))), MOST_LISTS))
    sample = rows.orderBy(F.xxhash64(id_col)).limit(max(n_lists * sample_per_list, 4 * CODES)).select("embedding").toArrow().combine_chunks()
    points = unit_rows(_matrix(sample["embedding"].combine_chunks())) if len(sample) else np.zeros((1, 1))
    centres = k_means(points, n_lists, seed)
    cuts = np.array_split(np.arange(points.shape[1]), min(parts, points.shape[1]))
    rest = points - centres[_nearest(points, centres)]
    books = [k_means(rest[:, cut], CODES, seed + 1 + i) for i, cut in enumerate(cuts)]
    shared = vectors.sparkSession.sparkContext.broadcast((centres, books, cuts))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books, cuts = shared.value
        for batch in batches:
            if batch.num_rows:
                m = unit_rows(_matrix(batch.column(1)))
                own = _nearest(m, centres)
                rest = m - centres[own]
                codes = np.column_stack([_nearest(rest[:, cut], book) for cut, book in zip(cuts, books, strict=True)]).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()),
                                                  pa.array(own, pa.int32())], names=[id_col, "embedding", "codes", "list"])

    kinds = dict(rows.dtypes)
    schema = f"{id_col} {kinds[id_col]}, embedding {kinds['embedding']}, codes binary, list int"
    placed = rows.mapInArrow(place, schema).repartition("list", F.pmod(F.xxhash64(id_col), F.lit(4)))  # a long list is written by a few tasks
    placed.write.partitionBy("list").parquet(folder)
    return IvfIndex(vectors.sparkSession, folder, schema, centres, books)


def search_lists(index: IvfIndex, queries: DataFrame, k: int, n_probe: int, shortlist: int | None = None) -> DataFrame:
    """``(query_id, id, distance, rank)`` (cosine) from the ``n_probe`` lists nearest to each question."""
    asked = queries.select("query_id", "embedding").where("embedding IS NOT NULL")
    rounds, shortlist = rounds_for(asked), shortlist or 20 * k
    id_col = index.lists().columns[0]
    kinds = dict(asked.dtypes)["query_id"], dict(index.lists().dtypes)[id_col]
    found = []
    for r in range(rounds):
        block = asked if rounds == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r)
        table = block.toArrow().combine_chunks()
        if not len(table):
            continue
        points = unit_rows(_matrix(table["embedding"].combine_chunks()))
        far = (index.centres * index.centres).sum(axis=1)[None, :] - 2 * points @ index.centres.T
        probes = np.argsort(far, axis=1, kind="stable")[:, :n_probe]
        rows = index.lists().where(F.col("list").isin(np.unique(probes).tolist()))  # MOST_LISTS at most
        found.append(rows.mapInArrow(_searcher(index, table["query_id"].combine_chunks(), points, probes, k, shortlist, id_col),
                                     f"query_id {kinds[0]}, {id_col} {kinds[1]}, distance double"))
    if not found:
        found = [index.lists().mapInArrow(lambda batches: iter(()), f"query_id {kinds[0]}, {id_col} {kinds[1]}, distance double")]
    order = W.partitionBy("query_id").orderBy("distance", id_col)
    return union_all(*found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _searcher(index: IvfIndex, names: pa.Array, points: np.ndarray, probes: np.ndarray, k: int, shortlist: int, id_col: str):
    of_list: dict[int, list[int]] = {}
    for q, lists in enumerate(probes.tolist()):
        for number in lists:
            of_list.setdefault(number, []).append(q)
    shared = index.spark.sparkContext.broadcast((names, points, of_list, index.centres, index.books))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, points, of_list, centres, books = shared.value
        best = _Best(len(names), k)
        widths = np.cumsum([book.shape[1] for book in books])[:-1]
        for batch in batches:
            number = batch.column(3).to_numpy()
            order = np.argsort(number, kind="stable")
            near: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # question, row, looked-up distance
            for value, at in zip(*np.unique(number[order], return_index=True), strict=True):
                rows = order[at:at + np.count_nonzero(number == value)]
                asked = np.array(of_list.get(int(value), ()), np.int64)
                if not len(asked):
                    continue
                codes = np.frombuffer(b"".join(batch.column(2).take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1)
                rest = np.split(points[asked] - centres[value], widths, axis=1)
                guess = np.zeros((len(asked), len(rows)))
                for part, book, code in zip(rest, books, codes.T, strict=True):
                    table = ((part[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
                    guess += table[:, code]
                near.append((np.repeat(asked, len(rows)), np.tile(rows, len(asked)), guess.reshape(-1)))
            if not near:
                continue
            q, row, guess = (np.concatenate(x) for x in zip(*near, strict=True))
            order = np.lexsort((guess, q))
            q, row = q[order], row[order]
            short = np.arange(len(q)) - np.searchsorted(q, q) < shortlist
            q, row = q[short], row[short]
            m = unit_rows(_matrix(batch.column(1)))
            for question in np.unique(q):
                some = row[q == question]
                dist = np.round(1.0 - m[some] @ points[question], 6) + 0.0
                best.offer(np.array([question]), dist[:, None], batch.column(0).take(pa.array(some)))
        rows = best.cut()
        if rows is not None:
            yield from pa.table({"query_id": names.take(rows["q"].combine_chunks()), id_col: rows["id"], "distance": rows["distance"]}).to_batches()

    return scan
