"""Hard negatives for contrastive training, by exact score-window searches over an STR-packed R-tree.

1. Components become integers ``floor(scale * x)``. Spark packs the rows into tiles sort-tile-recursively: by label, then by the
   coordinates that spread most, with cut points from grouped quantiles. A tile that ends up too large (many equal rows) is split
   by hash. Each tile is one row of a stored table: its vectors in leaf order and the bounding boxes of its nodes.
2. A box bounds every coordinate, and so the inner product with an anchor from above and below. For every anchor a task walks its
   tiles best-first, from one queue ordered by the upper bound, and skips boxes whose interval lies outside every score window of
   the anchor or strictly below the k-th best score found. Equal bounds are still opened, since ties go to the smaller id.
3. A positive is one of the best rows of the anchor's own label; its score spans the window of the negatives. Both searches run
   in rounds of at most about ``round_anchors`` anchors, which are broadcast; no vector of the index crosses the network again.
   The best rows of all tasks are merged per anchor. An anchor starts from the k-th best score of its own tile.

Boxes only prune: the result is exact. Rows with a null label or vector, or a null or non-finite component, take no part. Vectors
of different lengths have no score. A null id takes part, sorts after all others and comes back as null (as does 2**63 - 1).
Repeated rows and ids are rows of their own; "other" rows of an anchor are all but itself. Equal scores go by id. An empty table,
or one without anchors, gives an empty result. Further columns are ignored. Ids are integers. Inner products beyond 64 bits raise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusradar.llm.common import stored
from corpusradar.session import broadcast_if_small, fresh_folder

NO_ID = (1 << 63) - 1
QUANTILES = 128
INDEX = "dims int, n int, width string, reach long, id binary, uid binary, label binary, vec binary, lo binary, hi binary, " \
        "label_lo binary, label_hi binary, first binary, size binary, leaves int, anchor binary, floor binary"


@dataclass(frozen=True)
class Settings:
    """``low`` and ``high``: a negative's score in percent of its positive's."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    scale: int = 256
    tile_rows: int = 1024
    leaf_rows: int = 64
    fanout: int = 16
    axes: int = 2
    sample_rows: int = 4096  # from which the axes are chosen, which only steers how well boxes prune
    round_anchors: int = 1 << 14
    task_bytes: int = 32 << 20


def prepared(df: DataFrame, id_col: str, vec_col: str, label_col: str, anchors: Column, rule: Settings) -> DataFrame:
    """``uid, id, label, vec, dims, anchor`` of the rows that take part."""
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                     F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = rows.where("label IS NOT NULL AND vec IS NOT NULL").where(whole)
    return rows.select(F.monotonically_increasing_id().alias("uid"), F.coalesce("id", F.lit(NO_ID)).alias("id"), "label",
                       F.transform("vec", lambda x: F.floor(x * rule.scale)).alias("vec"), F.size("vec").alias("dims"), "anchor")


def spread_axes(rows: DataFrame, rule: Settings) -> list[int]:
    """The coordinates of the largest variance over a bounded number of rows."""
    some = [r["vec"] for r in rows.select("vec").limit(rule.sample_rows).collect()]
    longest = max(map(len, some), default=0)
    if not longest:
        return []
    return [int(i) for i in np.argsort(-np.var([v for v in some if len(v) == longest], axis=0), kind="stable")[:rule.axes]]


def tiled(rows: DataFrame, rule: Settings) -> DataFrame:
    """Every row with its ``tile`` and ``chunk``: slabs by label, those cut by the first axis, and so on, in equal parts."""
    axes = [F.col("label"), *[F.coalesce(F.get("vec", F.lit(i)), F.lit(0)) for i in spread_axes(rows, rule)]]
    placed = rows.withColumn("tile", F.lit(0).cast("long"))
    steps = [i / QUANTILES for i in range(1, QUANTILES)]
    for level, axis in enumerate(axes):
        placed = placed.withColumn("axis", axis)
        parts = F.least(F.lit(QUANTILES), F.ceil(F.pow(F.count("*") / rule.tile_rows, F.lit(1 / (len(axes) - level)))))
        slabs = placed.groupBy("dims", "tile").agg(parts.cast("int").alias("parts"), F.percentile_approx("axis", steps, 1000).alias("cuts"))
        taken = F.filter(F.transform(F.sequence(F.lit(1), F.col("parts")), lambda i: F.get(
            F.col("cuts"), F.floor(i * QUANTILES / F.col("parts")).cast("int") - 1)), lambda c: c.isNotNull())
        slabs = broadcast_if_small(stored(slabs.select("dims", "tile", taken.alias("cuts")), "slabs"), QUANTILES * QUANTILES)
        placed = placed.join(slabs, ["dims", "tile"]).withColumn("tile", F.col("tile") * (QUANTILES + 1) + F.size(
            F.filter("cuts", lambda c: c < F.col("axis")))).drop("cuts", "axis")
    sizes = placed.groupBy("dims", "tile").agg(F.ceil(F.count("*") / rule.tile_rows).cast("int").alias("chunks"))
    return placed.join(sizes, ["dims", "tile"]).withColumn("chunk", F.pmod(F.xxhash64("uid"), "chunks").cast("int")).drop("chunks")


def _leaves(values: np.ndarray, order: np.ndarray, axes: list[int], size: int) -> list[np.ndarray]:
    """Sort-tile-recursive runs of about ``size`` rows."""
    if len(order) <= size:
        return [order]
    if not axes:
        return np.array_split(order, -(-len(order) // size))
    order = order[np.argsort(values[order, axes[0]], kind="stable")]
    slabs = np.array_split(order, ceil((len(order) / size) ** (1 / len(axes))))
    return [leaf for slab in slabs for leaf in _leaves(values, slab, axes[1:], size)]


def _narrow(values: np.ndarray) -> str:
    return next(t for t in ("<i2", "<i4", "<i8") if t == "<i8" or not values.size or np.abs(values).max() < np.iinfo(t).max)


def _pack(table: pa.Table, rule: Settings) -> pa.Table:
    """One tile as one row: rows in leaf order, nodes from the leaves up to the root, k-th best positive scores of its anchors."""
    n = table.num_rows
    uid, ids, label = (table[c].to_numpy() for c in ("uid", "id", "label"))
    vec = table["vec"].combine_chunks().flatten().to_numpy().reshape(n, -1)
    spread = [int(i) + 1 for i in np.argsort(-vec.var(axis=0), kind="stable")[:rule.axes]]
    leaves = _leaves(np.column_stack([label, vec]), np.arange(n), [0, *spread], rule.leaf_rows)
    order = np.concatenate(leaves)
    uid, ids, label, vec = uid[order], ids[order], label[order], vec[order]
    size = np.array([len(x) for x in leaves])
    first = np.cumsum(size) - size
    boxes = [f(x, first, axis=0) for x in (vec, label) for f in (np.minimum.reduceat, np.maximum.reduceat)]
    firsts, sizes, level, done = [first], [size], boxes, 0
    while len(level[0]) > 1:
        cut = np.arange(0, len(level[0]), rule.fanout)
        firsts.append(cut + done)
        sizes.append(np.minimum(rule.fanout, len(level[0]) - cut))
        done += len(level[0])
        level = [f(x, cut, axis=0) for x, f in zip(level, (np.minimum.reduceat, np.maximum.reduceat) * 2, strict=True)]
        boxes = [np.concatenate(pair) for pair in zip(boxes, level, strict=True)]
    at = np.flatnonzero(table["anchor"].to_numpy(zero_copy_only=False)[order])
    floor = np.full(len(at), np.iinfo(np.int64).min)
    for i, row in enumerate(at):
        same = np.flatnonzero(label == label[row])
        if len(same) > rule.positives:
            scores = np.sort(_products(vec[same[same != row]], vec[row]))
            floor[i] = scores[len(scores) - rule.positives]
    width = _narrow(vec)
    raw = lambda x, t="<i8": x.astype(t).tobytes()
    one = {"dims": vec.shape[1], "n": n, "width": width, "reach": int(np.abs(vec).max()) if vec.size else 0, "id": raw(ids), "uid": raw(uid),
           "label": raw(label), "vec": raw(vec, width), "lo": raw(boxes[0], width), "hi": raw(boxes[1], width), "label_lo": raw(boxes[2]),
           "label_hi": raw(boxes[3]), "first": raw(np.concatenate(firsts)), "size": raw(np.concatenate(sizes)), "leaves": len(leaves),
           "anchor": raw(at), "floor": raw(floor)}
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = (part.split(" ") for part in INDEX.split(", "))
    return pa.table({name: pa.array([one[name]], kinds[kind]) for name, kind in types})


def _products(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers."""
    reach = int(np.abs(rows).max() if rows.size else 0) * int(np.abs(one).max() if one.size else 0) * max(1, len(one))
    if reach < 1 << 53:  # every partial sum is a whole number that a double holds
        return (rows.astype(np.float64) @ one.astype(np.float64)).astype(np.int64)
    if reach >= 1 << 63:
        raise ValueError("inner products of these vectors may not fit 64 bits")
    return rows.astype(np.int64) @ one.astype(np.int64)


class _Tile:
    """A stored tile, opened."""

    def __init__(self, row: dict):
        self.dims, self.leaves, self.reach = row["dims"], row["leaves"], row["reach"]
        self.kind = np.float64 if self.reach * self.reach * max(1, self.dims) < 1 << 53 else np.int64
        wide = lambda name, t="<i8": np.frombuffer(row[name], t)
        self.id, self.uid, self.label, self.first, self.size = (wide(x) for x in ("id", "uid", "label", "first", "size"))
        self.label_lo, self.label_hi, self.anchor, self.floor = (wide(x) for x in ("label_lo", "label_hi", "anchor", "floor"))
        self.raw = wide("vec", row["width"]).reshape(row["n"], self.dims)
        self.vec = self.raw.astype(self.kind)
        self.lo, self.hi = (wide(x, row["width"]).reshape(len(self.first), self.dims).astype(self.kind) for x in ("lo", "hi"))


class _Best:
    """The k best scores of one window, equal ones by id; ``bar`` is what a score has to reach."""

    __slots__ = ("low", "high", "k", "bar", "score", "id", "uid")

    def __init__(self, low: int, high: int, k: int):
        self.low, self.high, self.k, self.bar = low, high, k, low
        self.score = self.id = self.uid = np.zeros(0, np.int64)

    def offer(self, score: np.ndarray, ids: np.ndarray, uid: np.ndarray) -> None:
        fit = (score >= self.bar) & (score <= self.high)
        if not fit.any():
            return
        score, ids, uid = (np.append(a, b[fit]) for a, b in ((self.score, score), (self.id, ids), (self.uid, uid)))
        order = np.lexsort((uid, ids, -score))[:self.k]
        self.score, self.id, self.uid = score[order], ids[order], uid[order]
        if len(order) == self.k:
            self.bar = max(self.low, int(self.score[-1]))


def _walk(tiles: list[_Tile], roots: np.ndarray, lows: np.ndarray, vec: np.ndarray, label: int, uid: int, same: bool, windows: list[_Best]) -> None:
    """Best-first over the boxes of ``tiles``, given the bounds of their roots."""
    plus, minus = np.maximum(vec, 0), np.minimum(vec, 0)

    def useless(upper: float, lower: float) -> bool:
        return all(upper < w.bar or lower > w.high for w in windows)

    def shut(tile: _Tile, node: int) -> bool:
        if same:
            return not tile.label_lo[node] <= label <= tile.label_hi[node]
        return tile.label_lo[node] == label == tile.label_hi[node]

    queue = [(-up, t, len(tiles[t].first) - 1) for t, (up, low) in enumerate(zip(roots, lows, strict=True))
             if not useless(up, low) and not shut(tiles[t], len(tiles[t].first) - 1)]
    heapify(queue)
    while queue:
        up, t, node = heappop(queue)
        if all(-up < w.bar for w in windows):
            return
        tile, begin = tiles[t], tiles[t].first[node]
        part = slice(begin, begin + tile.size[node])
        if node < tile.leaves:
            score = (tile.vec[part] @ vec).astype(np.int64)
            fits = (tile.label[part] == label) & (tile.uid[part] != uid) if same else tile.label[part] != label
            if fits.any():
                for w in windows:
                    w.offer(score[fits], tile.id[part][fits], tile.uid[part][fits])
            continue
        lo, hi = tile.lo[part], tile.hi[part]
        uppers, lowers = (hi @ plus + lo @ minus).tolist(), (lo @ plus + hi @ minus).tolist()
        for k in range(len(uppers)):
            if not useless(uppers[k], lowers[k]) and not shut(tile, begin + k):
                heappush(queue, (-uppers[k], t, begin + k))


def searched(index: DataFrame, anchors: dict[str, np.ndarray], windows: list[list[tuple[int, int]]], same: bool, k: int) -> DataFrame:
    """``anchor, window, id, uid, score``: per task the k best rows of each window of each anchor.

    ``anchors``: ``uid, label`` and, as objects, ``vec``; all of them are broadcast, so their number has to be bounded.
    """
    shared = index.sparkSession.sparkContext.broadcast((anchors, windows))
    names = ["anchor", "window", "id", "uid", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, spans = shared.value
        best = [[_Best(low, high, k) for low, high in own] for own in spans]
        reach = max((int(np.abs(v).max()) for v in asked["vec"] if len(v)), default=0)
        for batch in batches:
            tiles = [_Tile(row) for row in batch.to_pylist()]
            for dims in {t.dims for t in tiles}:
                some = [t for t in tiles if t.dims == dims]
                among = [i for i, v in enumerate(asked["vec"]) if len(v) == dims and best[i]]
                most = reach * max(t.reach for t in some) * max(1, dims)
                if most >= 1 << 63:
                    raise ValueError("inner products of these vectors may not fit 64 bits")
                kind = np.float64 if most < 1 << 53 else np.int64
                for t in some:
                    t.vec, t.lo, t.hi = (x.astype(kind, copy=False) for x in (t.vec, t.lo, t.hi))
                lo, hi = (np.stack([x[-1] for x in side]) for side in ([t.lo for t in some], [t.hi for t in some]))
                for i in among:
                    v = asked["vec"][i].astype(kind)
                    plus, minus = np.maximum(v, 0), np.minimum(v, 0)
                    _walk(some, hi @ plus + lo @ minus, lo @ plus + hi @ minus, v, int(asked["label"][i]), int(asked["uid"][i]), same, best[i])
        for i, own in enumerate(best):
            found = [(w, b) for w, b in enumerate(own) if len(b.id)]
            if found:
                sizes = [len(b.id) for _, b in found]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(sum(sizes), asked["uid"][i])), pa.array(np.repeat([w for w, _ in found], sizes).astype(np.int32)),
                    *[pa.array(np.concatenate([getattr(b, c) for _, b in found])) for c in ("id", "uid", "score")]], names=names)

    found = index.mapInArrow(run, "anchor long, window int, id long, uid long, score long")
    order = W.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def packed(df: DataFrame, id_col: str, vec_col: str, label_col: str, anchors: Column, rule: Settings) -> DataFrame:
    """The stored index: one row per tile, dealt to as many partitions as its size or the cluster asks for."""
    rows = stored(prepared(df, id_col, vec_col, label_col, anchors, rule), "vectors")
    tiles = tiled(rows, rule).groupBy("dims", "tile", "chunk").applyInArrow(lambda table: _pack(table, rule), INDEX)
    tiles = stored(tiles, "tiles", compression="zstd")
    n, size = tiles.agg(F.count("*"), F.sum(F.col("n") * F.greatest("dims", F.lit(1)) * 8)).first()
    parts = max(1, min(n, 2 * df.sparkSession.sparkContext.defaultParallelism), ceil((size or 0) / rule.task_bytes))
    return stored(tiles.repartition(parts), "rtree", compression="zstd")


def anchors_of(index: DataFrame) -> DataFrame:
    """``uid, id, label, vec, floor`` of the anchors in the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                t = _Tile(row)
                vecs = pa.array([x.astype(np.int64) for x in t.raw[t.anchor]], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*[pa.array(x[t.anchor]) for x in (t.uid, t.id, t.label)], vecs, pa.array(t.floor)],
                                                 names=["uid", "id", "label", "vec", "floor"])

    return index.where("length(anchor) > 0").mapInArrow(run, "uid long, id long, label long, vec array<bigint>, floor long")


def hard_negatives(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                   anchors: Column | None = None, rule: Settings | None = None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``anchors`` holds (all)."""
    rule, spark = rule or Settings(), df.sparkSession
    index = packed(df, id_col, vec_col, label_col, F.lit(True) if anchors is None else anchors, rule)
    asked = stored(anchors_of(index), "anchors")
    rounds = ceil(asked.count() / rule.round_anchors)
    path, kind = fresh_folder(spark, "negatives"), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    spark.createDataFrame([], kind).write.parquet(path)
    for r in range(rounds):
        rows = asked.where(F.pmod(F.xxhash64("uid"), F.lit(rounds)) == r).toArrow()  # about `round_anchors` rows
        if not rows.num_rows:
            continue
        block = {"uid": rows["uid"].to_numpy(), "label": rows["label"].to_numpy(),
                 "vec": [np.asarray(v, np.int64) for v in rows["vec"].to_pylist()]}
        top = np.iinfo(np.int64).max
        floors = [[(int(f), top)] for f in rows["floor"].to_numpy()]
        positives = stored(searched(index, block, floors, True, rule.positives), "positives")
        spans: dict[int, dict[int, tuple[int, int]]] = {}
        for anchor, score in positives.select("anchor", "score").toLocalIterator():
            low, high = -(-rule.low * score // 100), rule.high * score // 100
            if low <= high:
                spans.setdefault(anchor, {})[score] = low, high
        windows = [list(spans.get(uid, {}).values()) for uid in block["uid"].tolist()]
        table = [(uid, w, score) for uid, own in spans.items() for w, score in enumerate(own)]
        if not table:
            continue
        numbered = spark.createDataFrame(table, "anchor long, window int, positive_score long")
        negatives = searched(index, block, windows, False, rule.negatives).select(
            "anchor", "window", "rank", F.col("id").alias("negative"), F.col("score").alias("negative_score"))
        of = positives.select("anchor", F.col("id").alias("positive"), F.col("score").alias("positive_score"))
        joined = of.join(numbered, ["anchor", "positive_score"]).join(negatives, ["anchor", "window"]).join(
            asked.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
        joined.select(named("anchor_id").alias("anchor_id"), named("positive").alias("positive_id"), "rank", named("negative").alias("negative_id"),
                      "positive_score", "negative_score").write.mode("append").parquet(path)
    return spark.read.schema(kind).parquet(path)


def query(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), anchors=F.col("vec_id") % 100 == 0)


SQL = """
WITH cleaned AS (
    SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.uid AS anchor, a.vec_id AS anchor_id, r.uid, r.vec_id, r.label = a.label AS same,
           CAST(list_inner_product(a.vec, r.vec) AS BIGINT) AS score
    FROM cleaned a JOIN cleaned r ON a.uid <> r.uid AND len(a.vec) = len(r.vec)
    WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, uid) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor, p.uid ORDER BY n.score DESC, n.vec_id, n.uid) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor, p.uid ORDER BY n.score DESC, n.vec_id, n.uid) <= 5
"""
