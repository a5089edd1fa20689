"""Documents whose word n-gram sets are alike, by a prefix-filtered Jaccard self-join.

1. Documents with the same set collapse into one node. The same pass counts shingles in a fixed number of buckets.
2. A node's shingles are ordered rare first (by bucket count, then hash: one order for all). Two sets that reach the threshold
   share a shingle within their prefixes, so only prefixes are exchanged, with position and set size.
3. Nodes that share a prefix shingle are candidates if they pass the length filter (sizes differ too much) and the positional
   filter (too little is left after the shared shingle). A suffix filter bounds the overlap of the rest from a few splits
   before sets are compared, and every pair is compared once.
4. Within a group of near copies nearly all pairs are candidates, and none but a spanning few matter. So nodes are first
   compared with the most promising centres of their lists (in ``STAR_ROUNDS`` rounds, of which later ones only look at members
   outside their list's largest component); links give components. Then every remaining candidate pair of nodes from different
   components is compared. In a list all of one component nothing remains, otherwise members outside the list's largest
   component meet the others. No link between components can be missed, and no cap is set anywhere.
5. The rounds of 4 are a shortcut to the components alone. ``near_links`` is the join itself: all candidate pairs of the prefix
   lists inside a component, each verified once. Long lists are split into blocks that meet the whole list one by one. Pairs are
   verified in cells, one for each two blocks of a component's nodes, so a text crosses the network once per cell that needs it.

Nulls count as empty texts; empty texts have no shingles and link with nothing. Rows that repeat an id and a text share the
answer; the same id with another text counts as another document of that id. An empty table gives an empty table. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusradar.llm.common import SLICES, array_parts, array_total, stored, text_blocks, whole_text
from corpusradar.llm.components import components
from corpusradar.llm.shingles import shingle_sets
from corpusradar.session import broadcast_if_small

BROADCAST_ROWS = 1 << 20  # one long each: 8 MB
STAR_ROUNDS = 3
KEY_BYTES, AT_BITS = 6, 16  # together one long
LAST_AT = (1 << AT_BITS) - 1
LIST_PART = 512  # nodes of a list, or pairs of a node, that one key may bring together
BLOCK_NODES, BLOCK_SHINGLES = 512, 1 << 19  # of a block, on average


class Alike:
    """Sets link when ``den * |intersection| >= num * |union|``, over ``size``-word shingles."""

    def __init__(self, size: int = 5, num: int = 80, den: int = 100, bucket_bits: int = 20):
        self.size, self.num, self.den, self.bucket_bits = size, num, den, bucket_bits

    def overlap(self, a, b):
        """Least intersection of sets of sizes ``a`` and ``b`` that link (rounded up)."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def prefix(self, n: int) -> int:
        return n + (-self.num * n // self.den) + 1

    def band(self, n: Column) -> Column:
        """Sizes that may link are in the same or in neighbouring bands."""
        return F.floor(F.log(n.cast("double")) / (log(self.den / self.num) * 1.0001)).cast("int")

    def fits(self, na: Column, pa_: Column, nb: Column, pb: Column) -> Column:
        """Length and positional filter."""
        left = 1 + F.least(na - pa_ - 1, nb - pb - 1)
        return ((self.den * F.least(na, nb) >= self.num * F.greatest(na, nb))
                & ((self.num + self.den) * left >= self.num * (na + nb)))


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))


def surveyed(df: DataFrame, id_col: str, text_col: str, rule: Alike) -> tuple[DataFrame, np.ndarray]:
    """One pass over the texts: ``id, n, print, text_hash`` per row, and the bucket counts of all shingles."""
    rows = _rows(df, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    shift = np.uint64(64 - rule.bucket_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names, kind = np.zeros(1 << rule.bucket_bits, np.int64), ["id", "n", "print", "text_hash", "slice", "part"], None
        for batch in batches:
            kind = batch.schema.field(0).type
            sizes, prints = [], []
            for _, _, octets, bounds in text_blocks(batch.column(1)):
                sets = shingle_sets(octets, bounds, rule.size)
                sizes += map(len, sets)
                prints += map(_digest, sets)
                counts += np.bincount((np.concatenate(sets) >> shift).astype(np.int64), minlength=len(counts))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), batch.column(2),
                                              pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if kind is not None and counts.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, kind), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.binary()),
                                              pa.nulls(SLICES, pa.int64()), *array_parts(counts)], names=names)

    kind = rows.schema["id"].dataType.simpleString()
    both = stored(rows.mapInArrow(run, f"id {kind}, n long, print binary, text_hash long, slice int, part binary"), "shingle-survey", compression="zstd")
    counts = array_total(both.where("slice IS NOT NULL"), 1 << rule.bucket_bits)
    return both.where("slice IS NULL").select("id", "n", "print", "text_hash"), counts


def prefixes(df: DataFrame, id_col: str, text_col: str, rule: Alike, counts: np.ndarray) -> DataFrame:
    """``print, prefix``: the rarest shingles of every row's set, rare first, ``KEY_BYTES`` of each hash.

    Shingles that agree in these bytes only meet as candidates; pairs are decided by whole hashes.
    """
    rank = np.unique(counts, return_inverse=True)[1].astype(np.int32)
    shared = df.sparkSession.sparkContext.broadcast(rank)  # 2**bucket_bits integers
    shift = np.uint64(64 - rule.bucket_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for batch in batches:
            for _, _, octets, bounds in text_blocks(batch.column(0)):
                sets = [s for s in shingle_sets(octets, bounds, rule.size) if len(s)]
                firsts = []
                for s in sets:
                    order = np.argsort(ranks[(s >> shift).astype(np.int64)], kind="stable")[:rule.prefix(len(s))]
                    firsts.append(s[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes())
                if sets:
                    yield pa.RecordBatch.from_arrays([pa.array(map(_digest, sets), pa.binary()), pa.array(firsts, pa.binary())],
                                                     names=["print", "prefix"])

    return _rows(df, id_col, text_col).select("text").mapInArrow(run, "print binary, prefix binary")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per prefix shingle its node and ``key``: the bytes of the hash, then the position in the lowest ``AT_BITS``.

    Later positions count as the last one that fits, which only weakens the positional filter.
    """
    for batch in batches:
        sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False) // KEY_BYTES
        ends = np.cumsum(sizes)
        row = 0
        while row < len(sizes):
            end = max(row + 1, int(np.searchsorted(ends, ends[row] + (1 << 18), side="right")))
            raw = np.frombuffer(b"".join(batch.column(1).slice(row, end - row).to_pylist()), np.uint8).reshape(-1, KEY_BYTES)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, 8 - KEY_BYTES:] = raw
            at = np.arange(len(raw)) - np.repeat(ends[row:end] - sizes[row:end] - (ends[row] - sizes[row]), sizes[row:end])
            key = wide.view("<u8").reshape(-1) | np.minimum(at, LAST_AT).astype(np.uint64)
            node = np.repeat(batch.column(0).to_numpy()[row:end], sizes[row:end])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node)], names=["key", "node"])
            row = end


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``h, node, at`` of those rows, sorted by ``key``, whose ``h`` occurs again."""
    last_key, last_node, last_again = np.zeros(0, np.int64), np.zeros(0, np.int64), False

    def rows(key: np.ndarray, node: np.ndarray, again: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[again]) for x in (key >> AT_BITS, node, key & LAST_AT)], names=["h", "node", "at"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.append(last_key, batch.column(0).to_numpy())
        node = np.append(last_node, batch.column(1).to_numpy())
        again = np.zeros(len(key), bool)
        again[0] = last_again  # the row kept back may have been decided with the batch before
        same = key[1:] >> AT_BITS == key[:-1] >> AT_BITS
        again[1:] |= same
        again[:-1] |= same
        last_key, last_node, last_again = key[-1:], node[-1:], bool(again[-1])
        yield rows(key[:-1], node[:-1], again[:-1])
    if last_again:
        yield rows(last_key, last_node, np.ones(1, bool))


def shared_postings(nodes: DataFrame, firsts: DataFrame) -> DataFrame:
    """``h, node, at``: prefix shingles that two nodes at least have."""
    one = firsts.groupBy("print").agg(F.first("prefix").alias("prefix"))
    rows = one.join(nodes.select("print", "node"), "print").select("node", "prefix").mapInArrow(_keyed, "key long, node long")
    return rows.repartition(F.shiftright("key", AT_BITS)).sortWithinPartitions("key").mapInArrow(_shared_only, "h long, node long, at long")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def with_components(postings: DataFrame, found: DataFrame) -> DataFrame:
    """Postings of lists with several components, with ``component`` and the list's ``largest``."""
    lists = postings.drop("component", "largest").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = lists.groupBy("h", "component").agg(F.count("*").alias("members"))
    mixed = sizes.groupBy("h").agg(F.max_by("component", F.struct("members", "component")).alias("largest"), F.count("*").alias("kinds"))
    return lists.join(mixed.where("kinds > 1").drop("kinds"), "h")


def promising_pairs(lists: DataFrame, round_no: int, rule: Alike) -> DataFrame:
    """``a, b``: for every node outside its lists' largest components the centres of these it shares most lists with.

    Two centres stand for a component: the member with the most shared prefix shingles (an original has more of them than its
    edited copies), and one drawn by hash.
    """
    inner = lists if round_no == 0 else lists.where("component = largest")
    rank = F.struct("shared", F.xxhash64("node").alias("x"), "node", "n", "at")
    drawn = F.struct(F.lit(0).cast("long").alias("shared"), F.xxhash64("h", "node", F.lit(round_no)).alias("x"), "node", "n", "at")
    centres = inner.groupBy("h").agg(F.max(rank).alias("most"), F.max(drawn).alias("any"))
    centres = centres.select("h", F.posexplode(F.array("most", "any")).alias("kind", "c")).select(
        "h", "kind", F.col("c.node").alias("centre"), F.col("c.n").alias("cn"), F.col("c.at").alias("cat"))
    centres = stored(centres, "centres")  # a plain exchange on either side: Spark may then split a long list
    outer = lists if round_no == 0 else lists.where("component <> largest")
    met = outer.join(centres, "h").where((F.col("node") != F.col("centre")) & rule.fits(F.col("n"), F.col("at"), F.col("cn"), F.col("cat")))
    best = met.groupBy("node", "kind", "centre").agg(F.count("*").alias("lists")).groupBy("node", "kind").agg(
        F.max_by("centre", F.struct("lists", "centre")).alias("centre"))
    return best.select(*_ordered("node", "centre")).distinct()


def remaining_pairs(lists: DataFrame, rule: Alike) -> DataFrame:
    """``a, b``: candidates from different components, as often as they share lists."""
    side = lists.withColumn("band", rule.band(F.col("n")))
    small = side.where("component <> largest").withColumn("band", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])))
    x, y = small.alias("x"), side.alias("y")
    met = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.component") != F.col("y.component"))
                 & rule.fits(F.col("x.n"), F.col("x.at"), F.col("y.n"), F.col("y.at")))
    return met.select(*_ordered("x.node", "y.node")).distinct()


def _may_overlap(a: np.ndarray, b: np.ndarray, least: int, depth: int = 3) -> bool:
    """Suffix filter: split both sorted sets at a middle value; the overlap is at most the sum over the parts."""
    parts = [(a, b)]
    for _ in range(depth):
        halves = []
        for p, q in parts:
            if len(p) < 2 or len(q) < 2:
                halves.append((p, q))
                continue
            value = p[len(p) // 2]
            i, j = len(p) // 2, int(np.searchsorted(q, value))
            halves += [(p[:i], q[:j]), (p[i:], q[j:])]
        parts = halves
        if sum(min(len(p), len(q)) for p, q in parts) < least:
            return False
    return True


def texts_of(reps: DataFrame, df: DataFrame, id_col: str, text_col: str, rule: Alike, parts: DataFrame | None = None) -> DataFrame:
    """``print, part, text``: one text of every set that a row with an id of ``reps`` has, once per part (``parts(print, parts)``)."""
    ids = stored(reps.distinct(), "needed")
    if ids.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long") and ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    texts = _rows(df, id_col, text_col).alias("t").join(ids.alias("w"), F.col("t.id").eqNullSafe(F.col("w.id")), "left_semi").select("text")
    size = rule.size

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, octets, bounds in text_blocks(batch.column(0)):
                prints = map(_digest, shingle_sets(octets, bounds, size))
                yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), batch.column(0).slice(row, end - row)], names=["print", "text"])

    printed = texts.mapInArrow(digests, "print binary, text string")
    if parts is None:
        return printed.groupBy("print").agg(F.first("text").alias("text"))
    last = F.coalesce("parts", F.lit(1)) - 1
    printed = printed.join(parts, "print", "left").select("print", F.explode(F.sequence(F.lit(0), last)).alias("part"), "text")
    return printed.groupBy("print", "part").agg(F.first("text").alias("text"))


def linked(pairs: DataFrame, df: DataFrame, nodes: DataFrame, id_col: str, text_col: str, rule: Alike) -> DataFrame:
    """The pairs that link, by their whole sets. These are cut from the texts of the pairs' nodes, which cross the network once by
    the digest of their set and once more beside their pair (half as large as the hashes); neither is ever written. A text that
    more than ``LIST_PART`` pairs need is copied to as many parts as keeps each below that."""
    names = [nodes.select(F.col("node").alias(x), F.col("print").alias(f"print_{x}"), F.col("rep").alias(f"rep_{x}")) for x in "ab"]
    named = stored(pairs.join(names[0], "a").join(names[1], "b"), "named-pairs")
    needed = named.select(F.explode(F.array("print_a", "print_b")).alias("print")).groupBy("print").agg(F.count("*").alias("n"))
    parts = broadcast_if_small(stored(needed.where(F.col("n") > LIST_PART).select("print", F.ceil(F.col("n") / LIST_PART).cast("int").alias("parts")), "parts"))
    texts = texts_of(named.select(F.explode(F.array("rep_a", "rep_b")).alias("id")), df, id_col, text_col, rule, parts)
    size = rule.size
    both = named.select("a", "b", "print_a", "print_b")
    for x, y in ("ab", "ba"):
        own = parts.toDF(f"print_{x}", "parts")
        part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(y), F.col("parts"))).cast("int")
        both = both.join(own, f"print_{x}", "left").withColumn(f"part_{x}", part).drop("parts")
    for x in "ab":
        both = both.join(texts.toDF(f"print_{x}", f"part_{x}", f"text_{x}"), [f"print_{x}", f"part_{x}"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(_sets_of(batch.column(2), size), _sets_of(batch.column(3), size), strict=True):
                least = rule.overlap(len(a), len(b))
                keep.append(_may_overlap(a, b, least) and len(np.intersect1d(a, b, assume_unique=True)) >= least)
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return stored(both.select("a", "b", "text_a", "text_b").mapInArrow(link, "a long, b long"), "near")


def _sets_of(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    for _, _, octets, bounds in text_blocks(column):
        yield from shingle_sets(octets, bounds, size)


def joined_components(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of the nodes that have any, after more links."""
    if found is None:
        return stored(components(links), "components")
    if not links.limit(1).count():
        return found
    ends = links.alias("l").join(found.toDF("a", "ca").alias("x"), "a", "left").join(found.toDF("b", "cb").alias("y"), "b", "left")
    merged = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))).toDF("old", "new")
    alone = merged.join(found.select(F.col("node").alias("old")), "old", "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
    moved = found.join(merged, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    return stored(moved.union(alone), "components")


def grouped(df: DataFrame, id_col: str, text_col: str, rule: Alike) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of ``surveyed``; ``node, print, rep, n, component`` of every distinct set that is not empty; and the prefix lists."""
    prints, counts = surveyed(df, id_col, text_col, rule)
    classes = stored(prints.where("n > 0").groupBy("print").agg(F.min("id").alias("rep"), F.first("n").alias("n")), "shingle-classes")
    nodes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "shingle-nodes")
    postings = shared_postings(nodes, prefixes(df, id_col, text_col, rule, counts))
    postings = stored(postings, "shingle-postings")
    shared = postings.groupBy("node").agg(F.count("*").alias("shared"))
    postings = stored(postings.join(shared.join(nodes.select("node", "n"), "node"), "node"), "shingle-postings")
    lists, found, tried = postings, None, None
    for round_no in range(STAR_ROUNDS + 1):
        if found is not None:  # components only grow: a list all of one component stays so
            lists = stored(with_components(lists, found), "lists")
        pairs = promising_pairs(lists, round_no, rule) if round_no < STAR_ROUNDS else remaining_pairs(lists, rule)
        pairs = stored(pairs, "pairs")
        fresh = pairs if tried is None else stored(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.union(fresh)
        found = joined_components(found, linked(fresh, df, nodes, id_col, text_col, rule))
    labelled = nodes.join(found, "node", "left").select("node", "print", "rep", "n", F.coalesce("component", "node").alias("component"))
    return prints, stored(labelled, "labelled-nodes"), postings


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Alike | None = None) -> DataFrame:
    """Per row of ``df``: ``id, n_shingles, component_id`` (smallest id that links reach, its own included)."""
    prints, labelled, _ = grouped(df, id_col, text_col, rule or Alike())
    smallest = stored(labelled.groupBy("component").agg(F.min("rep").alias("component_id")), "component-ids")
    by_print = labelled.join(smallest, "component").select("print", "component_id")
    empty = prints.where("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return prints.where("n > 0").join(by_print, "print").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id").union(empty)


def candidate_pairs(postings: DataFrame, labelled: DataFrame, rule: Alike) -> DataFrame:
    """``a, b``: nodes of one component that share a prefix shingle and pass the length and the positional filter, once each."""
    members = labelled.groupBy("component").agg(F.count("*").alias("members")).where("members > 1")
    some = labelled.join(members, "component", "left_semi").select("node", "component")
    lists = stored(postings.select("h", "node", "at", "n").join(some, "node").withColumn("band", rule.band(F.col("n"))), "component-lists")
    sizes = lists.groupBy("h", "component").agg(F.count("*").alias("members")).where(F.col("members") > LIST_PART)
    long = broadcast_if_small(stored(sizes.select("h", "component", F.ceil(F.col("members") / LIST_PART).cast("int").alias("parts")), "long-lists"))
    parted = lists.join(long, ["h", "component"], "left")
    own = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.col("parts"))).cast("int")
    x = parted.withColumn("part", own).withColumn("band", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])))
    y = parted.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    met = x.alias("x").join(y.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.component") == F.col("y.component"))
                            & (F.col("x.part") == F.col("y.part")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.node") < F.col("y.node"))
                            & rule.fits(F.col("x.n"), F.col("x.at"), F.col("y.n"), F.col("y.at")))
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def linked_in_cells(pairs: DataFrame, nodes: DataFrame, df: DataFrame, id_col: str, text_col: str, rule: Alike) -> DataFrame:
    """``a, b, shared`` of the pairs that link, for ``pairs(team, a, b)`` of which many have a node in common.

    The nodes of a team are dealt into blocks of bounded size; a cell is two blocks with the pairs between them, and gets the text
    of every node that its pairs need once. Each pair is in one cell.
    """
    ends = pairs.select("team", F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "print", "rep", "n"), "node")
    ends = stored(ends, "ends")
    blocks = ends.groupBy("team").agg(F.ceil(F.greatest(F.count("*") / BLOCK_NODES, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = ends.join(broadcast_if_small(stored(blocks, "blocks")), "team").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = stored(dealt.drop("blocks"), "dealt")
    sides = [dealt.select("team", F.col("node").alias(x), F.col("block").alias(f"block_{x}")) for x in "ab"]
    low, high = F.least("block_a", "block_b").alias("low"), F.greatest("block_a", "block_b").alias("high")
    cells = stored(pairs.join(sides[0], ["team", "a"]).join(sides[1], ["team", "b"]).select("team", low, high, "a", "b"), "cells")
    needed = cells.select(F.col("team").alias("of"), F.col("low").alias("i"), F.col("high").alias("j"), F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = texts_of(ends.select(F.col("rep").alias("id")), df, id_col, text_col, rule)
    sets = needed.join(nodes.select("node", "print"), "node").join(texts, "print").select("of", "i", "j", "node", "text")

    def verify(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        every = dict(zip(sets["node"].to_pylist(), _sets_of(sets["text"], rule.size), strict=True)) if sets.num_rows else {}
        out = []
        for a, b in zip(*(pairs[c].to_pylist() for c in "ab"), strict=True):
            x, y = every[a], every[b]
            least = rule.overlap(len(x), len(y))
            if _may_overlap(x, y, least):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if shared >= least:
                    out.append((a, b, shared))
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ((), (), ()))], names=["a", "b", "shared"])

    return cells.groupBy("team", "low", "high").cogroup(sets.groupBy("of", "i", "j")).applyInArrow(verify, "a long, b long, shared long")


def near_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Alike | None = None) -> DataFrame:
    """Every pair of distinct shingle sets that links, once: ``id_a, print_a, n_a, id_b, print_b, n_b, shared``.

    ``print`` is a set's digest, the smaller one is ``a``; ``id`` the smallest id that has the set, ``n`` its size. The rows of a
    set are those of its digest in the first table of ``surveyed``; rows of one set are alike without a link.
    """
    rule = rule or Alike()
    _, labelled, postings = grouped(df, id_col, text_col, rule)
    pairs = candidate_pairs(postings, labelled, rule).join(labelled.select(F.col("node").alias("a"), F.col("component").alias("team")), "a")
    links = stored(linked_in_cells(stored(pairs, "candidates"), labelled, df, id_col, text_col, rule), "links")
    side = lambda x: labelled.select(F.col("node").alias(x), F.struct(F.col("rep").alias("id"), "print", "n").alias(f"side_{x}"))
    named = links.join(side("a"), "a").join(side("b"), "b")
    swap = F.col("side_a.print") > F.col("side_b.print")
    low, high = F.when(swap, F.col("side_b")).otherwise(F.col("side_a")), F.when(swap, F.col("side_a")).otherwise(F.col("side_b"))
    return named.select(*[end[c].alias(f"{c}_{x}") for x, end in (("a", low), ("b", high)) for c in ("id", "print", "n")], "shared")


def drop_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Alike | None = None) -> DataFrame:
    """One document of each group, all columns of ``df``: the one with the smallest id, a null id last, then by its set's digest.

    Rows are told apart by id and text. Of several texts with one set and one id, and of repeated rows, all stay or none.
    """
    prints, labelled, _ = grouped(df, id_col, text_col, rule or Alike())
    keeper = labelled.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "print")).alias("keeper"))
    keepers = stored(labelled.join(keeper, "component").select("print", "keeper"), "keepers")
    gone = prints.where("n > 0").join(keepers, "print").where(
        (F.col("print") != F.col("keeper.print")) | ~F.col("id").eqNullSafe(F.col("keeper.rep")))
    gone = stored(gone.select(F.col("id").alias("__id"), F.col("text_hash").alias("__text")).distinct(), "dropped")
    mine = F.xxhash64(whole_text(text_col))
    return df.join(gone, df[id_col].eqNullSafe(F.col("__id")) & (mine == F.col("__text")), "left_anti")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"), rule=Alike(4, 85, 100))


def links_query(spark: SparkSession, folder: str) -> DataFrame:
    links = near_links(spark.read.parquet(f"{folder}/documents.parquet"), rule=Alike(4, 85, 100))
    return links.withColumns({c: F.lower(F.hex(c)) for c in ("print_a", "print_b")})
