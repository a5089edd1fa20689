"""The k nearest vectors by one scan: question blocks go to the vectors, never the other way.

The questions of a round are broadcast (a round is bounded in bytes), every task keeps the k best rows per question, and only
these leave it. Vectors are read where they lie; no exchange carries them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusradar.operators.blocks import unit_rows
from corpusradar.session import union_all

ROUND_BYTES = 16 << 20  # of question vectors that are broadcast at once
MOST_ROUNDS = 16  # beyond this the vectors are exchanged in blocks instead of scanned again and again
GRID = 1 << 21  # distances worked on at a time
PENDING = 1 << 20  # rows held before they are cut back to k per question


def rounds_for(queries: DataFrame) -> int:
    """How many broadcasts of bounded size the questions need."""
    numbers = queries.agg(F.sum(F.size("embedding"))).first()[0] or 0
    return max(1, ceil(8 * numbers / ROUND_BYTES))


class _Best:
    """The k nearest rows per question so far; equal distances go to the lower id."""

    def __init__(self, n: int, k: int, bar: float = np.inf, nulls: str = "at_end"):
        self.k, self.bar, self.parts, self.size, self.nulls = k, np.full(n, bar), [], 0, nulls

    def offer(self, asked: np.ndarray, dist: np.ndarray, ids: pa.Array) -> None:
        """``dist``: rows of ``ids`` x questions ``asked``."""
        if len(dist) > self.k:
            self.bar[asked] = np.minimum(self.bar[asked], np.partition(dist, self.k - 1, axis=0)[self.k - 1])
        row, at = np.nonzero(dist <= self.bar[asked])
        self._hold(asked[at], dist[row, at], ids, row)

    def offer_rows(self, asked: np.ndarray, dist: np.ndarray, ids: pa.Array, row: np.ndarray) -> None:
        """One distance per entry, of row ``row`` of ``ids`` and question ``asked``."""
        near = dist <= self.bar[asked]
        self._hold(asked[near], dist[near], ids, row[near])

    def _hold(self, asked: np.ndarray, dist: np.ndarray, ids: pa.Array, row: np.ndarray) -> None:
        self.parts.append(pa.table({"q": pa.array(asked), "distance": pa.array(dist), "id": ids.take(pa.array(row))}))
        self.size += len(row)
        if self.size > PENDING:
            self.cut()

    def cut(self) -> pa.Table | None:
        if not self.parts:
            return None
        rows = pa.concat_tables(self.parts).combine_chunks()
        rows = rows.take(pc.sort_indices(rows, [("q", "ascending"), ("distance", "ascending"), ("id", "ascending")], null_placement=self.nulls))
        q = rows["q"].to_numpy()
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = np.flatnonzero(rank == self.k - 1)
        self.bar[q[last]] = np.minimum(self.bar[q[last]], rows["distance"].to_numpy()[last])
        rows = rows.filter(pa.array(rank < self.k)).combine_chunks()
        self.parts, self.size = [rows], len(rows)
        return rows


def scan_nearest(queries: DataFrame, vectors: DataFrame, k: int, metric: str, id_col: str, query_col: str, group: str | None, rounds: int) -> DataFrame:
    """Per task the k best ``(query_col, id_col, distance)`` of every question; with ``group`` only rows of the question's group."""
    found = []
    asked = queries.select(query_col, "embedding", *[group] * bool(group)).where("embedding IS NOT NULL")
    rows = vectors.select(id_col, "embedding", *[group] * bool(group)).where("embedding IS NOT NULL")
    kinds = dict(asked.dtypes), dict(rows.dtypes)
    schema = f"{query_col} {kinds[0][query_col]}, {id_col} {kinds[1][id_col]}, distance double"
    for r in range(rounds):
        block = asked if rounds == 1 else asked.where(F.pmod(F.xxhash64(query_col), F.lit(rounds)) == r)
        table = block.toArrow().combine_chunks()  # about ROUND_BYTES
        if not len(table) and r < rounds - 1:
            continue
        found.append(rows.mapInArrow(_scanner(rows, table, k, metric, id_col, query_col, group), schema))
    return union_all(*found) if found else rows.mapInArrow(lambda batches: iter(()), schema)


def _scanner(rows: DataFrame, table: pa.Table, k: int, metric: str, id_col: str, query_col: str, group: str | None):
    names = table[query_col].combine_chunks()
    points = _matrix(table["embedding"].combine_chunks()) if len(table) else np.zeros((0, 0))
    points = unit_rows(points) if metric == "cosine" and len(points) else points
    of_group: dict = {}
    if group:
        for i, value in enumerate(table[group].to_pylist()):
            of_group.setdefault(value, []).append(i)
        of_group = {value: np.array(at) for value, at in of_group.items() if value is not None}
    shared = rows.sparkSession.sparkContext.broadcast((names, points, of_group))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, points, of_group = shared.value
        best, every = _Best(len(names), k), np.arange(len(names))
        for batch in batches:
            if not batch.num_rows or not len(names):
                continue
            if group:
                codes = batch.column(2).dictionary_encode()
                code = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                order = np.argsort(code, kind="stable")
                bounds = np.searchsorted(code[order], np.arange(len(codes.dictionary) + 1))
                parts = [(order[bounds[c]:bounds[c + 1]], of_group[value]) for c, value in enumerate(codes.dictionary.to_pylist()) if value in of_group]
                if not parts:
                    continue
            else:
                parts = [(np.arange(batch.num_rows), every)]
            m = _matrix(batch.column(1))
            m = unit_rows(m) if metric == "cosine" else m
            for at, asked in parts:
                step = max(1, GRID // len(asked))
                for a in range(0, len(at), step):
                    some, q = at[a:a + step], points[asked]
                    if metric == "cosine":
                        dist = 1.0 - m[some] @ q.T
                    else:
                        dist = (m[some] * m[some]).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :] - 2.0 * m[some] @ q.T
                    best.offer(asked, np.round(dist, 6) + 0.0, batch.column(0).take(pa.array(some)))
        rows = best.cut()
        if rows is not None:
            yield from pa.table({query_col: names.take(rows["q"].combine_chunks()), id_col: rows["id"], "distance": rows["distance"]}).to_batches()

    return scan


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(column), -1)
