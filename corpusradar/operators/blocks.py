"""Block joins: compare two sets of vectors without a row per pair.

Both sides are cut into blocks of bounded size; a pair of blocks is one group, worked on as one small matrix product, and
only what a kernel keeps (k best, counts, a spanning forest, ...) leaves it. A key that holds much of the data simply has
many blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusradar.session import broadcast_if_small, cut_lineage


def _block_counts(df: DataFrame, group: str, rows: int, name: str) -> DataFrame:
    return df.groupBy(group).agg(F.ceil(F.count("*") / rows).cast("int").alias(name))


def _cut(df: DataFrame, key: Column, own: str, own_n: Column, other: str, other_n: Column, columns: list[str]) -> DataFrame:
    """Give each row its own block and one copy per block of the other side."""
    return df.select(  # fresh aliases: both sides may come from one frame
        *[F.col(c).alias(c) for c in columns], F.pmod(F.xxhash64(key), own_n).cast("int").alias(own),
        F.explode(F.sequence(F.lit(0), other_n - 1)).alias(other))


def block_join(
    left: DataFrame, right: DataFrame, group: str | None, left_key: str, right_key: str,
    kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, left_rows: int = 1024, right_rows: int = 8192,
) -> DataFrame:
    """Run ``kernel`` once per pair of blocks (of the same ``group``, if given) and unite what it returns.

    The sizes are counted first, so both sides should be stored tables or checkpointed.
    """
    l_cols, r_cols = left.columns, right.columns
    if group is None:
        ln, rn = (F.lit(max(1, -(-df.count() // n))) for df, n in ((left, left_rows), (right, right_rows)))
        keys = ["_lb", "_rb"]
    else:
        counts = broadcast_if_small(cut_lineage(
            _block_counts(left, group, left_rows, "_ln").join(_block_counts(right, group, right_rows, "_rn"), group)))
        left, right, ln, rn = left.join(counts, group), right.join(counts, group), F.col("_ln"), F.col("_rn")
        keys = [group, "_lb", "_rb"]
    a = _cut(left, F.col(left_key), "_lb", ln, "_rb", rn, l_cols)
    b = _cut(right, F.col(right_key), "_rb", rn, "_lb", ln, r_cols)
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(
        lambda x, y: kernel(x, y) if len(x) and len(y) else pd.DataFrame(columns=_names(schema)), schema)


def _names(schema: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in schema.split(",")]


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


def unit_rows(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm == 0, 1.0, norm)


def packed_row(row: np.ndarray) -> bytes:
    """The numbers of a vector without loss: few different ones as a list and a byte for each place, then compressed."""
    values, at = np.unique(row, return_inverse=True)
    few = len(values) <= 256 and len(values) < len(row) // 2
    body = values.tobytes() + at.astype("u1").tobytes() if few else row.tobytes()
    return (len(values) if few else 0).to_bytes(2, "little") + zlib.compress(body, 1)


def unpacked_row(packed: bytes, number: np.dtype) -> np.ndarray:
    n, body = int.from_bytes(packed[:2], "little"), zlib.decompress(packed[2:])
    return np.frombuffer(body, number, n)[np.frombuffer(body, "u1", offset=n * number.itemsize)] if n else np.frombuffer(body, number)


def topk_kernel(left_key: str, right_key: str, k: int, metric: str) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """k smallest distances per left row, rounded to 6 places; equal distances go to the lower id."""

    def kernel(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        a, b = matrix(q["embedding"]), matrix(v["embedding"])
        if metric == "cosine":
            dist = 1.0 - unit_rows(a) @ unit_rows(b).T
        else:
            dist = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * a @ b.T
        dist = np.round(dist, 6) + 0.0
        ids, out = v[right_key].to_numpy(), []
        for i, qid in enumerate(q[left_key].to_numpy()):
            row = dist[i]
            near = np.arange(len(row)) if len(row) <= k else np.flatnonzero(row <= np.partition(row, k - 1)[k - 1])
            best = near[np.lexsort((ids[near], row[near]))][:k]
            out.append(pd.DataFrame({left_key: qid, right_key: ids[best], "distance": row[best]}))
        return pd.concat(out)

    return kernel
