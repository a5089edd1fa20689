"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusradar.session import fresh_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back: lineage ends there and survives lost executors."""
    path = fresh_folder(df.sparkSession, purpose)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def text_blocks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``limit`` bytes (one text at least): first row, end row, UTF-8 bytes, row offsets in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    octets = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, side="right")) - 1)
        yield row, end, octets[bounds[row]:bounds[end]], bounds[row:end + 1] - bounds[row]
        row = end


_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_POWERS = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        if size > 1 << 22:
            return have
        _POWERS[base] = have
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def span_hashes(octets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span ``[start, end)``, from prefix sums of one rolling polynomial."""
    n = len(octets)
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((octets.astype(np.uint64) + np.uint64(1)) * _powers(_MULTIPLIER, n)[:n], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * _powers(_INVERSE, n)[starts] + (ends - starts).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def words(octets: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that are not marked in ``gap`` (ASCII white space), never across rows: starts, ends, row of each."""
    n = len(octets)
    ink = np.zeros(n + 1, bool)
    np.logical_not(gap[octets], out=ink[:n])
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = ink[:-1]
    starts = np.flatnonzero(ink & (first | ~before))
    ends = np.flatnonzero(before & (first | ~ink))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def fold_bytes(octets: np.ndarray) -> np.ndarray:
    """A-Z to a-z, byte by byte (other UTF-8 bytes stay)."""
    return _FOLD[octets]


SLICES = 64


def array_parts(values: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """A task's integer sums as ``SLICES`` rows: slice numbers and little-endian 64-bit parts."""
    parts = np.array_split(values.reshape(-1).astype(np.int64), SLICES)
    return pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())


def array_total(parts: DataFrame, size: int) -> np.ndarray:
    """Sum of the arrays of all tasks from their rows ``slice, part``; in two rounds, the first over ``SLICES`` neighbouring tasks,
    so no task reads the rows of all tasks and few tasks send little on."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, octets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(octets, np.int64)
                total[k] = total[k] + part if k in total else part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array([x.tobytes() for x in total.values()])],
                                             names=["slice", "part"])

    level = parts.select("slice", "part").repartition("slice", F.floor(F.spark_partition_id() / SLICES)).mapInArrow(summed, "slice int, part binary")
    level = level.repartition("slice").mapInArrow(summed, "slice int, part binary")
    rows = {row["slice"]: np.frombuffer(row["part"], np.int64) for row in level.collect()}  # `size` integers, however many tasks
    return np.concatenate([rows[k] for k in range(SLICES)]) if rows else np.zeros(size, np.int64)
