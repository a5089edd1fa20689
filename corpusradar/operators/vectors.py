"""Embedding and similarity search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b, md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusradar import constants as C
from corpusradar.functions.text import search_tokens
from corpusradar.operators.blocks import block_join, packed_row, topk_kernel, unpacked_row
from corpusradar.operators.ivf import build_lists, search_lists
from corpusradar.operators.kbest import MOST_ROUNDS, rounds_for, scan_nearest
from corpusradar.operators.paired import close_pairs, pair_rows, vector_blocks
from corpusradar.operators.projections import Projections, block_rows_for, bucket_pairs, crowded, plan_tables
from corpusradar.session import broadcast_if_small, cut_lineage, fresh_folder, release, union_all

Encoder = Callable[[DataFrame, str, str], DataFrame]
NAMED_IDS = 10_000


def embedding_text(title: Column, abstract: Column) -> Column:
    """The title counts twice."""
    return F.concat(title, F.lit(". "), title, F.lit(". "), abstract)


def hashing_encoder(df: DataFrame, id_col: str, text_col: str, dims: int = 128) -> DataFrame:
    """Counts of search tokens in ``dims`` hash buckets, scaled to length 1: ``(id_col, embedding)``.

    A task counts the tokens of its texts as arrays and hashes each distinct token of some rows once; ``dims`` counts per row cross
    the network, which rows that repeat an id share. A text without tokens gets the zero vector.
    """
    tokens = F.coalesce(search_tokens(F.col(text_col)), F.array().cast("array<string>"))
    kind = df.schema[id_col].dataType.simpleString()
    counts = df.select(F.col(id_col).alias("id"), tokens.alias("_t")).mapInArrow(_bucket_counts(dims), f"id {kind}, _c array<bigint>")
    zero = F.lit(0).cast("bigint")
    shared = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.aggregate("_l", zero, lambda a, c: a + c[d]))
    rows = counts.groupBy("id").agg(F.collect_list("_c").alias("_l")).select(
        F.col("id").alias(id_col), F.when(F.size("_l") == 1, F.col("_l")[0]).otherwise(shared).alias("_n"))
    normed = rows.select(id_col, "_n", F.sqrt(F.aggregate("_n", zero, lambda a, n: a + n * n)).alias("_norm"))
    scaled = normed.select(id_col, "_n", F.when(F.col("_norm") > 0, F.col("_norm")).otherwise(1.0).alias("_scale"))
    return scaled.select(id_col, F.transform("_n", lambda n: n / F.col("_scale")).alias("embedding"))


def _bucket_counts(dims: int, rows: int = 1024):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                ids, lists = (batch.slice(at, rows).column(i) for i in (0, 1))
                named = ids.dictionary_encode()
                code = named.indices.fill_null(len(named.dictionary)).to_numpy(zero_copy_only=False)
                _, first, row = np.unique(code, return_index=True, return_inverse=True)  # rows of one id are counted together
                tokens = lists.flatten().dictionary_encode()
                bucket = np.array([int(md5(t.encode()).hexdigest()[:4], 16) % dims for t in tokens.dictionary.to_pylist()], np.int64)
                at_row = np.repeat(row, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                grid = np.bincount(at_row * dims + bucket[tokens.indices.to_numpy(zero_copy_only=False)], minlength=len(first) * dims)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(0, len(grid) + 1, dims), pa.int32()), pa.array(grid, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(first)), cells], names=["id", "_c"])

    return count


def embed_pending(papers: DataFrame, encoder: Encoder = hashing_encoder) -> DataFrame:
    """Vectors of the papers with ``is_embedded = false``; append them to the vector table and flip the flag by id."""
    pending = papers.where(~F.coalesce("is_embedded", F.lit(False)))
    texts = pending.select("paper_id", embedding_text(F.col("title"), F.col("abstract")).alias("_text"))
    return encoder(texts, "paper_id", "_text")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, metric: str, id_col: str, query_col: str = "query_id",
            group: str | None = None) -> DataFrame:
    """Exact ``(query_col, id_col, distance, rank)`` of the k nearest; with ``group`` only inside the query's own group.

    Questions that fit a few broadcasts are carried to the vectors; for more of them both sides are exchanged in blocks.
    """
    order = W.partitionBy(query_col).orderBy("distance", id_col)
    rounds = rounds_for(queries)
    if rounds <= MOST_ROUNDS:
        found = scan_nearest(queries, vectors, k, metric, id_col, query_col, group, rounds)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    keys = [] if group is None else [group]
    q = queries.select(*keys, query_col, "embedding")
    v = vectors.select(*keys, id_col, "embedding")
    types = {**dict(q.dtypes), **dict(v.dtypes)}
    found = block_join(q, v, group, query_col, id_col, topk_kernel(query_col, id_col, k, metric),
                       f"{query_col} {types[query_col]}, {id_col} {types[id_col]}, distance double")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, id_col: str = "paper_id") -> DataFrame:
    """k best per query with ``score = 1 - cosine distance`` to 4 places."""
    return nearest(queries, vectors, k, "cosine", id_col).select(
        "query_id", id_col, F.round(1 - F.col("distance"), 4).alias("score"), "rank")


def l2_topk(queries: DataFrame, chunk_vectors: DataFrame, n: int, id_col: str = "chunk_id", group: str = "paper_id") -> DataFrame:
    """n nearest chunks by squared distance inside the paper a query asks about."""
    return nearest(queries, chunk_vectors, n, "l2", id_col, group=group)


def dense_retrieve(queries: DataFrame, vectors: DataFrame, metadata: DataFrame, n: int = 8, max_dist: float = 1.2,
                   papers: DataFrame | None = None) -> DataFrame:
    """n nearest papers, then those farther than ``max_dist`` dropped, with metadata and its defaults.

    ``papers(query_id, paper_id)`` limits a question to its own papers; a question that has none there searches all of them.
    ``metadata`` joins only the few rows that were found.
    """
    if papers is None:
        hits = nearest(queries, vectors, n, "cosine", "paper_id")
    else:
        limited = queries.select("query_id", "embedding").join(papers.select("query_id", F.col("paper_id").alias("_only")).distinct(), "query_id")
        free = queries.join(papers, "query_id", "left_anti")
        own = nearest(cut_lineage(limited), vectors.withColumn("_only", F.col("paper_id")), n, "cosine", "paper_id", group="_only")
        own = own.drop("rank").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "paper_id")))
        hits = union_all(own.where(F.col("rank") <= n), nearest(cut_lineage(free), vectors, n, "cosine", "paper_id"))
    hits = hits.where(F.col("distance") <= max_dist)
    return with_metadata(hits, metadata).withColumn("source", F.lit("dense"))


def with_metadata(hits: DataFrame, metadata: DataFrame) -> DataFrame:
    """Paper columns for search hits: missing text as '', missing numbers as 0, a URL made from the id.

    Hits are few rows per question. Their ids are named to the metadata (joined beyond ``NAMED_IDS``), so only texts that were found
    are exchanged.
    """
    hits = cut_lineage(hits)
    found = hits.select("paper_id").where("paper_id IS NOT NULL").distinct()
    named = [r[0] for r in found.limit(NAMED_IDS + 1).collect()]
    if len(named) <= NAMED_IDS:  # a filter sinks to the tables below the metadata, a broadcast semi join stays above their joins
        metadata = metadata.where(F.col("paper_id").isin(named))
    else:
        metadata = metadata.join(broadcast_if_small(found), "paper_id", "left_semi")
    have = set(metadata.columns)
    text = lambda c, d="": F.coalesce(F.col(f"m.{c}"), F.lit(d)) if c in have else F.lit(d)
    num = lambda c: F.coalesce(F.col(f"m.{c}").cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
    url = F.when(text("paper_url") != "", text("paper_url")).otherwise(
        F.concat(F.lit(C.PAPER_URL_PREFIX), F.col("h.paper_id").cast("string")))
    joined = hits.alias("h").join(metadata.alias("m"), F.col("h.paper_id") == F.col("m.paper_id"), "left")
    return joined.select(
        "h.*", text("title", "Unknown").alias("title"), text("abstract").alias("abstract"), text("summary").alias("summary"),
        text("stack_fit").alias("stack_fit"), text("score_reasoning").alias("score_reasoning"),
        num("overall_score").alias("overall_score"), text("action").alias("action"), url.alias("paper_url"),
        num("velocity_score").alias("velocity_score"))


def knn_approx(queries: DataFrame, vectors: DataFrame, k: int = 10, n_lists: int | None = None, n_probe: int = 4,
               id_col: str = "paper_id", seed: int = 42) -> DataFrame:
    """k near rows per question from an index of inverted lists built for it; see ``ivf`` to build once and search often."""
    index = build_lists(vectors, fresh_folder(vectors.sparkSession, "lists"), id_col, n_lists, seed=seed)
    found = search_lists(index, queries, k, n_probe)
    return found.select("query_id", id_col, F.round(1 - F.col("distance"), 4).alias("score"), "rank")


def recall_against(approx: DataFrame, exact: DataFrame, id_col: str = "paper_id") -> DataFrame:
    hit = approx.select("query_id", id_col, F.lit(1).alias("_hit"))
    return exact.join(hit, ["query_id", id_col], "left").agg(F.round(F.count("_hit") / F.count("*"), 4).alias("recall"))


def collapse_copies(vectors: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors ``node, rep, copies, embedding`` with their lowest id, and ``(member, node)`` for every row that has a vector.

    ``node`` numbers the distinct vectors in the order of their lowest ids, whatever the type of the ids. Copies meet by a digest of
    128 bits; what is exchanged and kept are compressed vectors, and members cross the network without theirs.
    """
    kind = dict(vectors.dtypes)["embedding"]
    if kind not in ("array<float>", "array<double>"):
        vectors, kind = vectors.withColumn("embedding", F.col("embedding").cast("array<double>")), "array<double>"
    vectors = vectors.select(F.col(id_col).alias("id"), "embedding").where("embedding IS NOT NULL")
    id_kind, number = vectors.schema["id"].dataType.simpleString(), np.dtype("f4" if kind == "array<float>" else "f8")
    packed = vectors.mapInArrow(_packed(number, True), f"id {id_kind}, _key binary, _points binary")
    reps = packed.groupBy("_key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("_points").alias("_points"))
    reps = cut_lineage(global_rank(reps, "rep", "node"))
    release(reps.sparkSession)
    keys = vectors.mapInArrow(_packed(number, False), f"id {id_kind}, _key binary")
    members = keys.join(reps.select("_key", "node"), "_key").select(F.col("id").alias("member"), "node")
    return reps.select("node", "rep", "copies", "_points").mapInArrow(
        _unpacked(number), f"node bigint, rep {id_kind}, copies bigint, embedding {kind}"), members


def _packed(number: np.dtype, points: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten()
            numbers = flat.to_numpy(zero_copy_only=False).astype(number) + number.type(0)  # one zero and one NaN, as in a grouping
            numbers[np.isnan(numbers)] = np.nan
            ends = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
            gaps = np.asarray(flat.is_null()) if flat.null_count else None
            keys, rows = [], []
            for at, end in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
                key = blake2b(numbers[at:end].tobytes(), digest_size=16)
                if gaps is not None and gaps[at:end].any():
                    key.update(gaps[at:end].tobytes())
                keys.append(key.digest())
                if points:
                    rows.append(packed_row(numbers[at:end]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), *([pa.array(rows, pa.binary())] * points)],
                                             names=["id", "_key", *["_points"] * points])

    return run


def _unpacked(number: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [unpacked_row(row, number) for row in batch.column(3).to_pylist()]
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, number), *rows])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], names=["node", "rep", "copies", "embedding"])

    return run


def global_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Number rows 0, 1, 2, ... by ``column`` without one task holding them all: sort, then add offsets per partition."""
    placed = cut_lineage(df.orderBy(column).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_pos")))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))  # one row per partition
    return placed.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_before") + F.col("_pos")).alias(name))


def buckets_for(reps: DataFrame, max_dist: float, recall: float) -> tuple[Projections, DataFrame]:
    """The hash tables of random projections for these rows, and the buckets of more than one block.

    The work stays near linear; a pair at ``max_dist`` may be missed with chance ``1 - recall``.
    """
    rows = reps.count()
    plan = plan_tables(rows, max_dist, recall)
    return plan, crowded(reps, plan, block_rows_for(rows))


def is_exact(method: str) -> bool:
    """``exact``: all blocks that pivots cannot tell apart (``paired``), which misses nothing; ``projections``: ``buckets_for``."""
    if method not in ("exact", "projections"):
        raise ValueError(f"no method {method!r}")
    return method == "exact"


def similarity_pairs(vectors: DataFrame, max_dist: float, id_col: str = "vec_id", pivots: int | None = None, method: str = "exact",
                     recall: float = 0.999) -> DataFrame:
    """``(id_a, id_b, distance)`` with ``id_a < id_b`` for all distinct vectors within ``max_dist``; ids of any type.

    Exact copies are tied to their lowest id only, never to each other, so a big group of copies stays linear. For ``method`` and
    ``recall`` see ``is_exact``.
    """
    exact = is_exact(method)
    reps, members = collapse_copies(vectors, id_col)
    names, rows = reps.select("node", "rep"), reps.select("node", "rep", "embedding")
    united = pair_rows("rep", dict(reps.dtypes)["rep"])
    if exact:
        blocks, parts = vector_blocks(rows, pivots)
        named = close_pairs(blocks, parts, max_dist, *united)
    else:
        named = bucket_pairs(rows, *buckets_for(rows, max_dist, recall), max_dist, *united)
    stars = members.join(names, "node").where("member <> rep").select(
        F.col("rep").alias("id_a"), F.col("member").alias("id_b"), F.lit(0.0).alias("distance"))
    return union_all(named, stars)
