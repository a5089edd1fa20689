"""Batch retrieval: context and citations for many questions in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusradar import constants as C
from corpusradar.functions import dialog as D
from corpusradar.operators import fusion as X
from corpusradar.operators.lexical import bm25_topk, expand_query, keyword_overlap_topk
from corpusradar.operators.vectors import Encoder, hashing_encoder, nearest, with_metadata
from corpusradar.session import broadcast_if_small, cut_lineage, release, stored, union_all

MOST_IDS = 1_000_000  # ids that are broadcast rather than that texts are exchanged
CHUNK_FIELDS = ["section", "section_order", "page", "has_list", "is_caption", "raw_text", "raw_text_ctx"]


def retrieve_hits(queries: DataFrame, chunks: DataFrame, encoder: Encoder = hashing_encoder, scorer=None,
                  neighbor_order: str = "document", vectors: DataFrame | None = None, max_fetch: int = 30) -> DataFrame:
    """Chunks for each question about one paper, in reading order.

    ``queries(query_id, paper_id, query, intent, n)``; ``chunks`` as stored by the index. Dense search fetches
    ``min(3n, 30)`` chunks of the paper; intent-favoured sections move up; BM25 ranks the same pool with the pool's own
    statistics; both ranks fuse with boosts; ``2n`` go to the pair scorer, ``n`` stay; some intents add neighbours.
    The pool has at most ``max_fetch`` rows per question and is written once, as every later step starts from it.
    """
    asked = queries.select("query_id", "paper_id", "query", "intent", "n", F.least(F.col("n") * 3, F.lit(max_fetch)).alias("fetch_n"))
    papers = broadcast_if_small(asked.select("paper_id").distinct(), MOST_IDS)
    wanted = chunks.join(papers, "paper_id", "left_semi")
    if vectors is None:
        vectors = encoder(wanted.select("chunk_id", "text"), "chunk_id", "text")
    # Vectors come grouped by chunk, so the papers go to them; they are stored with the paper that their search is limited to.
    located = stored(wanted.select("paper_id", "chunk_id").join(vectors, "chunk_id"))
    release(located.sparkSession)
    expanded = asked.select("query_id", expand_query(F.col("query")).alias("text"))
    query_vectors = cut_lineage(asked.select("query_id", "paper_id").join(encoder(expanded, "query_id", "text"), "query_id"))
    dense = nearest(query_vectors, located, max_fetch, "l2", "chunk_id", group="paper_id")
    pool = stored(
        dense.join(asked, "query_id").where(F.col("rank") <= F.col("fetch_n"))
        .join(wanted.select("chunk_id", "section", "has_list", "is_caption", "raw_text"), "chunk_id"))
    release(pool.sparkSession)

    boosted = X.section_boost(pool.select("query_id", "chunk_id", "section", "intent", "rank"))
    own = pool.select("query_id", F.col("query_id").alias("pool"), "query").distinct()
    corpus = pool.select(F.col("query_id").alias("pool"), "chunk_id", F.col("raw_text").alias("text"))
    lexical = bm25_topk(own, corpus, max_fetch, "chunk_id", "pool")
    fused = X.fuse_with_boosts(own.select("query_id", "query"), boosted, lexical, pool, "chunk_id", flag_keys=["query_id", "chunk_id"])
    candidates = fused.select("query_id", "chunk_id", "rank").join(
        pool.select("query_id", "chunk_id", "paper_id", "query", "intent", "n", F.col("raw_text").alias("text")), ["query_id", "chunk_id"])
    selected = X.pair_rerank(candidates, "chunk_id", F.col("n"), scorer).select("query_id", "paper_id", "chunk_id", "intent", "rank")
    selected = cut_lineage(selected)
    release(selected.sparkSession)

    chained = selected.where(F.col("intent").isin(C.CHAIN_INTENTS))
    if neighbor_order == "document":
        places = wanted.where("position IS NOT NULL").select("paper_id", "chunk_id", "position", "section")
        extra = X.neighbor_expand(chained, places, "chunk_id", key="paper_id")
    else:
        places = pool.select("query_id", "chunk_id", F.col("rank").alias("position"), "section")
        extra = X.neighbor_expand(chained, places, "chunk_id")
    chosen = union_all(selected.select("query_id", "chunk_id", "rank"), extra.select("query_id", "chunk_id", "rank"))
    distances = pool.select("query_id", "chunk_id", "distance")
    # A neighbour that was not in the pool has no distance and counts as near, like the chunk that brought it.
    hits = chosen.join(distances, ["query_id", "chunk_id"], "left").join(wanted.select("chunk_id", *CHUNK_FIELDS), "chunk_id")
    return X.reading_order(hits.withColumn("distance", F.coalesce("distance", F.lit(0.0)))).withColumnRenamed("raw_text_ctx", "context_text")


def with_citations(context: DataFrame, citations: DataFrame) -> DataFrame:
    """Join ``citations(query_id, type, value, citation_no)`` to the contexts as one ordered array."""
    lists = citations.groupBy("query_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("citation_no", "type", "value"))),
        lambda c: F.struct(c["type"].alias("type"), c["value"].alias("value"))).alias("citations"))
    return context.join(lists, "query_id", "left")


def retrieve_context(queries: DataFrame, chunks: DataFrame, **options) -> DataFrame:
    """``(query_id, context, citations)`` for questions about one paper each."""
    hits = stored(retrieve_hits(queries, chunks, **options))
    release(hits.sparkSession)
    return with_citations(X.assemble_context(hits), X.context_citations(hits))


def multi_query_merge(queries: DataFrame, chunks: DataFrame, papers: DataFrame, abstract_chars: int = 1000, **options) -> DataFrame:
    """Decompose each question, retrieve per part, and merge what is distinct: ``(query_id, context, citations, mode)``.

    ``queries(query_id, paper_id, query)``; off-topic questions get mode ``blocked`` and nothing is retrieved for them; without any
    context the abstract (its first ``abstract_chars``) and analysis of ``papers`` stand in, with a note that says so.
    """
    text = F.col("query")
    planned = queries.where(~F.coalesce(D.off_topic(text), F.lit(False))).withColumn("intent", D.deep_intent(text)).withColumn("subs", D.decompose_query(text, F.col("intent")))
    n = D.sub_query_budget(D.chunk_budget(F.col("intent")), F.size("subs"))
    parts = planned.select("query_id", "paper_id", "intent", n.alias("n"), F.posexplode("subs").alias("sub_no", "query"))
    part_id = F.concat(F.col("_query").cast("string"), F.lit("#"), F.lpad(F.col("sub_no").cast("string"), 2, "0"))
    keyed = cut_lineage(parts.withColumnRenamed("query_id", "_query").withColumn("query_id", part_id))
    hits = stored(retrieve_hits(keyed, chunks, **options))
    release(hits.sparkSession)
    names = keyed.select("query_id", "_query", "sub_no")

    contexts = X.assemble_context(hits).join(names, "query_id").where(F.col("context") != "")
    once = contexts.groupBy("_query", "context").agg(F.min("sub_no").alias("sub_no"))
    merged = once.groupBy(F.col("_query").alias("query_id")).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("sub_no", "context"))), lambda s: s["context"]), "\n\n").alias("context"))
    cited = X.context_citations(hits).join(names, "query_id").groupBy(F.col("_query").alias("query_id"), "type", "value").agg(
        F.min(F.struct("sub_no", "citation_no")).alias("citation_no"))

    found = stored(with_citations(merged, cited))
    release(found.sparkSession)
    have = papers.columns
    note = lambda c: F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")
    fallback = F.concat(
        F.lit("[Paper Abstract]\n"), F.substring(F.coalesce("abstract", F.lit("")), 1, abstract_chars), F.lit("\n\n[Analysis]\nScore Reasoning: "),
        note("score_reasoning"), F.lit("\nStack Fit: "), note("stack_fit"), F.lit("\n\n" + C.NOT_INDEXED_NOTE))
    about = queries.select("query_id", "paper_id", F.coalesce(D.off_topic(text), F.lit(False)).alias("_blocked")).join(papers.select("paper_id", fallback.alias("_fallback")), "paper_id", "left")
    return about.join(found, "query_id", "left").select(
        "query_id", F.when(~F.col("_blocked"), F.coalesce("context", "_fallback")).alias("context"), "citations",
        F.when(F.col("_blocked"), "blocked").when(F.col("context").isNotNull(), "deep").otherwise("abstract").alias("mode"))


def global_retrieve(queries: DataFrame, papers: DataFrame, vectors: DataFrame, live: DataFrame | None = None, n: int = 5,
                    encoder: Encoder = hashing_encoder, max_dist: float = 1.2) -> tuple[DataFrame, DataFrame]:
    """Ranked papers per question over the whole corpus, and ``(query_id, intent, mode)``.

    Off-topic questions get mode ``blocked`` and no papers. ``live`` holds rows from an outside source per question
    (with the columns of a search hit); they count only where local hits are few or the question asks for the latest.
    """
    text = F.col("query")
    marked = queries.select("query_id", "query", D.global_intent(text).alias("intent"), D.off_topic(text).alias("blocked"))
    open_queries = marked.where(~F.col("blocked"))
    query_vectors = cut_lineage(encoder(open_queries, "query_id", "query"))
    near = nearest(query_vectors, vectors, n + 3, "cosine", "paper_id").where(F.col("distance") <= max_dist)
    dense = cut_lineage(with_metadata(near, papers).withColumn("source", F.lit("dense")))
    words = keyword_overlap_topk(open_queries, papers, n).select("query_id", "paper_id", "distance", "rank")
    lexical = with_metadata(words, papers).withColumn("source", F.lit("bm25"))
    if live is None:
        live = dense.where(F.lit(False)).withColumn("source", F.lit("live"))
    modes = X.retrieval_mode(open_queries, dense, live)
    live = live.join(modes.where("wants_live").select("query_id"), "query_id", "left_semi")
    merged = X.merge_sources(dense, lexical, live).join(open_queries.select("query_id", "intent"), "query_id")
    ranked = X.intent_rerank(merged, n + 1)
    summary = marked.join(modes, "query_id", "left").select(
        "query_id", "intent", F.when(F.col("blocked"), "blocked").otherwise(F.col("mode")).alias("mode"))
    return ranked, summary
