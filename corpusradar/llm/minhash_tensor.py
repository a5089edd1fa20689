"""Near duplicates by MinHash with tensored banding.

1. One pass cuts every text into its set of word shingles and takes ``2 * m * h`` minhashes: two collections of ``m`` bands of
   ``h`` each. Documents with the same set collapse into one node.
2. The ``m * m`` hash tables are the pairs of a band of the first and a band of the second collection, so a table's key is made of
   ``2 * h`` minhashes, yet every minhash serves ``m`` tables: the number of minhashes is about the square root of what tables of
   their own would need. Keys are dealt over all tasks by their value; keys that only one node has are dropped.
3. Nodes that share a key are candidates. In a group of near copies nearly all pairs are, so nodes are first compared with the
   most promising centres of their lists (``ngram_join`` has the same rounds over prefix lists). In lists that still hold several
   components, every remaining candidate pair is verified where it meets, in its first shared band, and only links leave the task.
   Pairs whose minhashes agree too rarely are passed over.
4. Every link is confirmed on the full sets, so no clean document is lost to a hash collision.

A pair at the threshold of 0.8 shares no key with probability below 2.1e-5 at the default ``h = 3, m = 16`` (``missed``), and fails
the agreement test with ``rare = 1e-6``; more similar pairs far less, and a missed link only shows where no other path joins the two.

Nulls count as empty texts; empty texts have no shingles and link with nothing. Rows that repeat an id and a text share the
answer; the same id with another text counts as another document of that id. A null id is reached only if no other id is. An
empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusradar.llm.common import mixed, stored, text_blocks, whole_text
from corpusradar.llm.ngram_join import Alike, _may_overlap, _sets_of, joined_components, linked, promising_pairs, texts_of, with_components
from corpusradar.llm.shingles import shingle_sets
from corpusradar.session import broadcast_if_small


LIST_NODES, LIST_SHINGLES = 2048, 1 << 20  # of a block, on average
WORTH = 10  # a round of centres is followed by another while one in so many of its pairs links


@dataclass(frozen=True)
class Bands:
    """``m`` bands of ``h`` minhashes in each of two collections."""

    h: int = 3
    m: int = 16
    rare: float = 1e-6
    seed: int = 7

    @property
    def hashes(self) -> int:
        return 2 * self.m * self.h

    def missed(self, similarity: float) -> float:
        """Probability that a pair of this similarity shares no key."""
        return 1 - (1 - (1 - similarity ** self.h) ** self.m) ** 2

    def least_agreement(self, similarity: float) -> int:
        """Fewer equal minhashes than this have a probability of ``rare`` at most."""
        total, k = 0.0, 0
        while k < self.hashes:
            total += comb(self.hashes, k) * similarity ** k * (1 - similarity) ** (self.hashes - k)
            if total > self.rare:
                break
            k += 1
        return k


def minhashes(values: np.ndarray, starts: np.ndarray, bands: Bands) -> np.ndarray:
    """Minhashes of the sets that begin at ``starts`` in ``values`` (well mixed 64-bit hashes): sets x ``hashes``."""
    draw = np.random.default_rng(bands.seed)
    flips = draw.integers(0, 1 << 64, bands.hashes, np.uint64, endpoint=False)
    steps = draw.integers(0, 1 << 64, bands.hashes, np.uint64, endpoint=False) | np.uint64(1)
    out = np.empty((len(starts), bands.hashes), np.uint64)
    scratch = np.empty_like(values)
    with np.errstate(over="ignore"):
        for i in range(bands.hashes):
            np.bitwise_xor(values, flips[i], out=scratch)
            np.multiply(scratch, steps[i], out=scratch)
            out[:, i] = np.minimum.reduceat(scratch, starts)
    return out


def band_hashes(least: np.ndarray, bands: Bands) -> np.ndarray:
    """One hash per band, both collections after another: sets x ``2 m``."""
    with np.errstate(over="ignore"):
        grid = least.reshape(len(least), 2 * bands.m, bands.h)
        value = np.broadcast_to(np.arange(2 * bands.m, dtype=np.uint64), grid.shape[:2])
        for i in range(bands.h):
            value = mixed(value * np.uint64(0xD6E8FEB86659FD93) + grid[:, :, i])
        return value


def sketched(df: DataFrame, id_col: str, text_col: str, rule: Alike, bands: Bands) -> DataFrame:
    """``id, n, print, bands, sketch`` per row: set size, digest of the set, band hashes, one byte of every minhash."""
    rows = df.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, octets, bounds in text_blocks(batch.column(1)):
                sets = shingle_sets(octets, bounds, rule.size)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                keys, bytes_ = [None] * len(sets), [None] * len(sets)
                if len(full):
                    least = minhashes(np.concatenate(sets), np.cumsum(sizes[full]) - sizes[full], bands)
                    short = mixed(least).astype(np.uint8)
                    for i, k, b in zip(full.tolist(), band_hashes(least, bands).astype("<u8"), short, strict=True):
                        keys[i], bytes_[i] = k.tobytes(), b.tobytes()
                prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(sizes), *[
                    pa.array(x, pa.binary()) for x in (prints, keys, bytes_)]], names=["id", "n", "print", "bands", "sketch"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n long, print binary, bands binary, sketch binary")


def table_keys(nodes: DataFrame, bands: Bands) -> DataFrame:
    """``key, node``: one key per hash table, from a band of each collection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                value = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u8").reshape(part.num_rows, 2, bands.m)
                with np.errstate(over="ignore"):
                    key = mixed(value[:, 0, :, None] * np.uint64(0x9E3779B97F4A7C15) + value[:, 1, None, :])
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(
                    part.column(0).to_numpy(), bands.m * bands.m))], names=["key", "node"])

    return nodes.select("node", "bands").mapInArrow(run, "key long, node long")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by key, whose key occurs again; the last row of a batch waits for the next batch."""
    held, again_held = (np.zeros(0, np.int64),) * 2, False
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = (np.append(h, batch.column(i).to_numpy()) for i, h in enumerate(held))
        again = np.zeros(len(key), bool)
        again[0] = again_held
        same = key[1:] == key[:-1]
        again[1:] |= same
        again[:-1] |= same
        held, again_held = (key[-1:], node[-1:]), bool(again[-1])
        again[-1] = False
        yield pa.RecordBatch.from_arrays([pa.array(key[again]), pa.array(node[again])], names=["h", "node"])
    if again_held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["h", "node"])


def candidate_lists(nodes: DataFrame, bands: Bands) -> DataFrame:
    """``h, node, n, at, shared``: keys that two nodes at least have; ``shared`` counts a node's such keys."""
    met = table_keys(nodes, bands).repartition("key").sortWithinPartitions("key").mapInArrow(_met, "h long, node long")
    met = stored(met, "met")
    shared = met.groupBy("node").agg(F.count("*").alias("shared")).join(nodes.select("node", "n"), "node")
    return stored(met.join(shared, "node").withColumn("at", F.lit(0)), "candidates")


def agreeing(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """The pairs with at least so many equal bytes in their sketches."""
    sides = [nodes.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}")) for x in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sketch_a", "sketch_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                yield batch.filter(pa.array((x == y).sum(axis=1) >= least)).select([0, 1])

    return both.mapInArrow(run, "a long, b long")


def _verified(cell: pa.Table, least: int, rule: Alike, bands: Bands) -> pa.Table:
    """Links that join components, among the rows of one list (or of two blocks of it): ``a, b``.

    A pair is looked at if the list's band is the first of its collection that both share, any band of the other collection agrees,
    sizes fit and minhashes agree often enough; it is decided by whole sets, and passed over once links found here join its ends.
    """
    n, node, own = (cell[c].to_numpy() for c in ("n", "node", "own"))
    at, alone = cell["at"][0].as_py(), cell["low"][0] == cell["high"][0]
    keys = np.frombuffer(b"".join(cell["bands"].to_pylist()), "<u8").reshape(len(n), 2, bands.m)
    sketch = np.frombuffer(b"".join(cell["sketch"].to_pylist()), np.uint8).reshape(len(n), -1)
    sets = list(_sets_of(cell["text"], rule.size))
    label = np.unique(cell["component"].to_numpy(), return_inverse=True)[1]  # components, merged by the links found
    found = []
    for x in range(len(n) - 1):
        y = np.arange(x + 1, len(n))
        y = y[(label[y] != label[x]) & (alone | (own[y] != own[x]))
              & (rule.den * np.minimum(n[y], n[x]) >= rule.num * np.maximum(n[y], n[x]))]
        y = y[~(keys[y, 0, :at] == keys[x, 0, :at]).any(axis=1) & (keys[y, 1] == keys[x, 1]).any(axis=1)]
        y = y[(sketch[y] == sketch[x]).sum(axis=1) >= least]
        for k in y.tolist():
            if label[k] == label[x]:
                continue
            overlap = rule.overlap(len(sets[x]), len(sets[k]))
            if _may_overlap(sets[x], sets[k], overlap) and len(np.intersect1d(sets[x], sets[k], assume_unique=True)) >= overlap:
                found.append((node[x], node[k]))
                label[label == label[k]] = label[x]
    return pa.table([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ((), ()))], names=["a", "b"])


def remaining_links(lists: DataFrame, nodes: DataFrame, df: DataFrame, id_col: str, text_col: str, rule: Alike, bands: Bands, least: int) -> DataFrame:
    """``a, b``: links that join the components of ``lists`` further. No pair leaves the task that verifies it unless it links.

    The nodes meet by the bands of the first collection, each pair in the first one it shares; a long list is cut into blocks of
    bounded size that meet two by two.
    """
    some = stored(lists.select("node", "component").distinct().join(nodes.select("node", "n", "print", "rep", "bands", "sketch"), "node"), "mixed-nodes")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u8").reshape(batch.num_rows, 2, bands.m)[:, 0].reshape(-1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.tile(np.arange(bands.m, dtype=np.int32), batch.num_rows)), *[
                pa.array(np.repeat(batch.column(i).to_numpy(), bands.m)) for i in range(3)]], names=["list", "at", "node", "component", "n"])

    rows = stored(some.select("node", "component", "n", "bands").mapInArrow(explode, "list long, at int, node long, component long, n long"), "band-rows")
    sizes = rows.groupBy("list").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.ceil(F.greatest(
        F.count("*") / LIST_NODES, F.sum("n") / LIST_SHINGLES)).cast("int").alias("blocks")).where("x < y")
    sizes = broadcast_if_small(stored(sizes.select("list", "blocks"), "band-lists"))
    dealt = rows.join(sizes, "list").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("list", "at", "node", "own", other).select("list", "at", "node", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    texts = texts_of(some.select(F.col("rep").alias("id")), df, id_col, text_col, rule)
    whole = stored(some.drop("rep").join(texts, "print").drop("print"), "mixed-texts")
    cells = dealt.join(whole, "node").groupBy("list", "low", "high")
    return stored(cells.applyInArrow(lambda cell: _verified(cell, least, rule, bands), "a long, b long"), "near")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Alike | None = None, bands: Bands | None = None) -> DataFrame:
    """Per row of ``df``: ``id, n_shingles, component_id`` (smallest id that links reach, its own included), ``kept``."""
    rule, bands = rule or Alike(), bands or Bands()
    least = bands.least_agreement(rule.num / rule.den)
    rows = stored(sketched(df, id_col, text_col, rule, bands), "sketches", compression="zstd")
    classes = rows.where("n > 0").groupBy("print").agg(F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "bands", "sketch")])
    nodes = stored(stored(classes, "classes").withColumn("node", F.monotonically_increasing_id()), "nodes")
    lists, found, tried, round_no = candidate_lists(nodes, bands), None, None, 0
    while True:
        pairs = stored(promising_pairs(lists, round_no, rule), "pairs")
        fresh = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        fresh = stored(agreeing(fresh, nodes, least), "agreeing")
        tried = pairs if tried is None else tried.union(pairs)
        links = linked(fresh, df, nodes, id_col, text_col, rule)
        found = joined_components(found, links)
        lists = stored(with_components(lists, found), "lists")
        round_no += 1
        if links.count() * WORTH <= fresh.count():  # centres bring together no more; the rest is compared pair by pair
            break
    found = joined_components(found, remaining_links(lists, nodes, df, id_col, text_col, rule, bands, least))
    labelled = nodes.join(found, "node", "left").select("print", "rep", F.coalesce("component", "node").alias("component"))
    smallest = stored(labelled.groupBy("component").agg(F.min("rep").alias("component_id")), "component-ids")
    by_print = labelled.join(smallest, "component").select("print", "component_id")
    full = rows.where("n > 0").select("id", "n", "print").join(by_print, "print").select("id", "n", "component_id")
    every = full.union(rows.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return every.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"), rule=Alike(2, 80, 100))
