"""Rank fusion, boosts, reranking and context assembly for many queries at once.

Every frame here holds a bounded number of rows per query (candidate lists), so a window per query is small whatever the
number of queries.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusradar import constants as C
from corpusradar.functions.text import contains_any, search_tokens
from corpusradar.operators.lexical import named_entities
from corpusradar.session import union_all

Scorer = Callable[[DataFrame], DataFrame]


def by_query(*order) -> W:
    return W.partitionBy("query_id").orderBy(*order)


def section_boost(ranked: DataFrame, boosts: Mapping[str, Sequence[str]] = C.SECTION_BOOSTS) -> DataFrame:
    """Move hits from sections that suit the intent to the front; order is otherwise kept. Adds ``boosted`` and a new ``rank``."""
    boosted = F.lit(False)
    for intent, names in boosts.items():
        boosted = boosted | ((F.col("intent") == intent) & contains_any(F.col("section"), names))
    marked = ranked.withColumn("boosted", boosted)
    return marked.withColumn("rank", F.row_number().over(by_query(F.col("boosted").desc(), "rank")))


def rrf_fuse(dense: DataFrame, lexical: DataFrame, id_col: str, k: int = 60, lexical_bonus: Column | None = None) -> DataFrame:
    """``sum 1 / (k + rank)`` over both lists of ``(query_id, id_col, rank)``; ``lexical_bonus`` adds weight to the lexical side."""
    weight = F.lit(1.0) if lexical_bonus is None else F.lit(1.0) + lexical_bonus
    votes = union_all(dense.select("query_id", id_col, (F.lit(1.0) / (k + F.col("rank"))).alias("_v")),
                      lexical.select("query_id", id_col, (weight / (k + F.col("rank"))).alias("_v")))
    return votes.groupBy("query_id", id_col).agg(F.round(F.sum("_v"), 9).alias("score"))


def entity_boost(query: Column, bonus: float = 0.4) -> Column:
    """Extra lexical weight for queries that name something."""
    return F.when(F.size(named_entities(query)) > 0, bonus).otherwise(0.0)


def list_boost(query: Column, has_list: Column, factor: float = 1.5) -> Column:
    return F.when(contains_any(query, C.LIST_TRIGGERS) & has_list, factor).otherwise(1.0)


def caption_boost(query: Column, is_caption: Column, factor: float = 1.6) -> Column:
    return F.when(query.rlike(C.CAPTION_QUERY_PATTERN) & is_caption, factor).otherwise(1.0)


def fuse_with_boosts(queries: DataFrame, dense: DataFrame, lexical: DataFrame, flags: DataFrame, id_col: str, k: int = 60,
                     flag_keys: Sequence[str] = ()) -> DataFrame:
    """All boosts together: ``(query_id, id_col, score, rank)``; ``flags(id_col, has_list, is_caption)``."""
    bonus = queries.select("query_id", entity_boost(F.col("query")).alias("_bonus"))
    lexical = lexical.join(bonus, "query_id")
    fused = rrf_fuse(dense, lexical, id_col, k, F.col("_bonus"))
    keys = list(flag_keys) or [id_col]
    scored = fused.join(flags.select(*keys, "has_list", "is_caption"), keys).join(queries.select("query_id", "query"), "query_id")
    q = F.col("query")
    boosted = scored.select("query_id", id_col, F.round(
        F.col("score") * list_boost(q, F.col("has_list")) * caption_boost(q, F.col("is_caption")), 9).alias("score"))
    return boosted.withColumn("rank", F.row_number().over(by_query(F.col("score").desc(), id_col)))


def overlap_scorer(id_col: str) -> Scorer:
    """Default pair score: rarity-weighted tokens shared by the query and the text, rarity counted inside the pool."""

    def score(pairs: DataFrame) -> DataFrame:
        shared = F.array_intersect(F.array_distinct(search_tokens(F.col("query"))), F.array_distinct(search_tokens(F.col("_text"))))
        terms = pairs.select("query_id", id_col, F.col("_n"), F.explode(shared).alias("term"))
        df = terms.withColumn("_df", F.count("*").over(W.partitionBy("query_id", "term")))
        sums = df.groupBy("query_id", id_col).agg(F.round(F.sum(F.log(1 + F.col("_n") / F.col("_df"))), 6).alias("pair_score"))
        return pairs.join(sums, ["query_id", id_col], "left").withColumn("pair_score", F.coalesce("pair_score", F.lit(0.0)))

    return score


def pair_rerank(candidates: DataFrame, id_col: str, top_n: Column, scorer: Scorer | None = None,
                max_chars: int | None = None) -> DataFrame:
    """Score (query, text, or its first ``max_chars``) jointly for the first ``2 * top_n`` candidates and keep ``top_n``.

    ``candidates(query_id, id_col, query, text, rank)``. A list no longer than ``top_n``, or a missing scorer (``False``),
    keeps its order. A plug-in scorer gets the pairs and adds ``pair_score``.
    """
    pool = candidates.where(F.col("rank") <= 2 * top_n).withColumn("_n", F.count("*").over(W.partitionBy("query_id")))
    pool = pool.withColumn("_text", F.substring("text", 1, max_chars) if max_chars else F.col("text"))
    if scorer is False:
        scored = pool.withColumn("pair_score", F.lit(0.0))
    else:
        scored = (scorer or overlap_scorer(id_col))(pool)
    key = F.when(F.col("_n") <= top_n, F.lit(0.0)).otherwise(-F.col("pair_score"))
    reranked = scored.withColumn("new_rank", F.row_number().over(by_query(key, "rank")))
    return reranked.where(F.col("new_rank") <= top_n).drop("_n", "_text", "rank").withColumnRenamed("new_rank", "rank")


def neighbor_expand(selected: DataFrame, pool: DataFrame, id_col: str, max_extra: int = 4, key: str = "query_id") -> DataFrame:
    """Previous and next chunk of the same section for each selected chunk: ``(query_id, id_col, rank)`` of the additions.

    ``selected(query_id, id_col, rank)``, ``pool(key, id_col, position, section)``: with ``key='paper_id'`` (then also a
    column of ``selected``) positions count in the document, with ``key='query_id'`` in the retrieved list. Selected chunks
    are visited by rank; once the additions reach ``max_extra`` no further chunk is visited, so the last one may still bring
    both of its neighbours.
    """
    s = selected.join(pool, [key, id_col]).select(
        *dict.fromkeys(["query_id", key]), F.col("rank").alias("_rank"), F.col("section").alias("_section"), F.col("position").alias("_at"))
    sides = s.withColumn("_side", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("position", F.col("_at") + F.col("_side"))
    near = sides.join(pool, [key, "position"]).where(F.col("section") == F.col("_section"))
    fresh = near.join(selected.select("query_id", id_col), ["query_id", id_col], "left_anti")
    first = fresh.groupBy("query_id", id_col).agg(F.min(F.struct("_rank", "_side")).alias("_from"))
    earlier = F.count("*").over(W.partitionBy("query_id").orderBy("_from._rank").rangeBetween(W.unboundedPreceding, -1))
    kept = first.withColumn("_earlier", earlier).where(F.col("_earlier") < max_extra)
    last = selected.groupBy("query_id").agg(F.max("rank").alias("_last"))
    return kept.join(last, "query_id").select("query_id", id_col, (F.col("_last") + F.row_number().over(by_query("_from"))).alias("rank"))


def reading_order(hits: DataFrame) -> DataFrame:
    """Number hits as they stand in the paper: section, page, then rank."""
    return hits.withColumn("position", F.row_number().over(by_query("section_order", "page", "rank")))


def assemble_context(hits: DataFrame, max_dist: float = 1.8) -> DataFrame:
    """``(query_id, context)`` from ``hits(query_id, position, section, context_text, distance)``.

    A section is announced once, before its first text.
    """
    near = hits.where(F.col("distance") <= max_dist)
    first = F.row_number().over(W.partitionBy("query_id", "section").orderBy("position")) == 1
    named = F.coalesce("section", F.lit("")) != ""
    part = F.when(first & named, F.concat(F.lit("── "), F.col("section"), F.lit(" ──\n"), F.col("context_text"))).otherwise(F.col("context_text"))
    return near.select("query_id", "position", part.alias("part")).groupBy("query_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("position", "part"))), lambda s: s["part"]), "\n\n").alias("context"))


def context_citations(hits: DataFrame, max_dist: float = 1.8) -> DataFrame:
    """Distinct pages and sections of the used hits, numbered by first appearance; a hit cites its page before its section."""
    near = hits.where(F.col("distance") <= max_dist)
    page = F.when(F.col("page") != 0, F.struct(F.lit(0).alias("k"), F.lit("page").alias("type"), F.col("page").cast("string").alias("value")))
    section = F.when(F.coalesce("section", F.lit("")) != "", F.struct(
        F.lit(1).alias("k"), F.lit("section").alias("type"), F.col("section").alias("value")))
    cited = near.select("query_id", "position", F.explode(F.array_compact(F.array(page, section))).alias("c"))
    first = cited.groupBy("query_id", "c.type", "c.value").agg(F.min(F.struct("position", "c.k")).alias("_seen"))
    return first.select("query_id", "type", "value", F.row_number().over(by_query("_seen")).alias("citation_no"))


def merge_sources(*sources: DataFrame) -> DataFrame:
    """One row per (query, paper) from lists in order of priority: dense, lexical, live.

    The first list's row stays, with the smallest distance and all sources; a summary and what belongs to it are filled in
    from the first list that has one.
    """
    parts = [
        df.select("query_id", "paper_id", "title", "abstract", "summary", "stack_fit", "score_reasoning", "overall_score",
                         "action", "paper_url", "velocity_score", "distance", "rank", "source", F.lit(i).alias("priority"))
        for i, df in enumerate(sources)]
    union = union_all(*parts)
    late = ["summary", "stack_fit", "action", "overall_score"]
    keep = ["title", "abstract", "score_reasoning", "paper_url", "velocity_score", "source", "rank", *late]
    grouped = union.groupBy("query_id", "paper_id").agg(
        F.min_by(F.struct(*keep, "priority"), "priority").alias("f"), F.min("distance").alias("distance"),
        F.min_by(F.struct(*late), F.when(F.coalesce("summary", F.lit("")) != "", F.col("priority"))).alias("s"),
        F.transform(F.array_sort(F.collect_list(F.struct("priority", "source"))), lambda x: x["source"]).alias("sources"))
    filled = [F.when(F.col("s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"f.{c}")).alias(c) for c in late]
    return grouped.select("query_id", "paper_id", *[F.col(f"f.{c}").alias(c) for c in keep if c not in late], *filled, "distance",
                          F.array_distinct("sources").alias("sources"), F.col("f.priority").alias("priority"))


def intent_rerank(papers: DataFrame, n: int = 6) -> DataFrame:
    """First ``n`` papers per query by the weights of its ``intent``; equal scores keep the order of arrival."""
    action = F.coalesce("action", F.lit(""))
    sim = 1 - F.coalesce("distance", F.lit(0.5))
    prod = F.coalesce("overall_score", F.lit(0.0)) / 10
    vel = F.least(F.coalesce("velocity_score", F.lit(0.0)) / 100, F.lit(1.0))
    multi = F.when(F.size("sources") > 1, 0.2).otherwise(0.0)
    summed = F.when(F.coalesce("summary", F.lit("")) != "", 0.1).otherwise(0.0)
    adopt = F.when(F.contains(F.lower(action), F.lit("adopt")), 0.15).otherwise(0.0)
    fresh = F.when(action == "unanalyzed", -0.1).otherwise(0.0)
    live = F.when(F.col("source") == "live", 0.3).otherwise(0.0)
    i = F.col("intent")
    score = (
        F.when(i == "practical", sim * 0.3 + prod * 0.4 + adopt * 0.2 + multi * 0.1)
        .when(i == "latest", sim * 0.4 + live + multi * 0.1 + vel * 0.2)
        .when(i == "learning", sim * 0.4 + prod * 0.25 + summed * 0.2 + adopt * 0.15)
        .when(i == "compare", sim * 0.5 + prod * 0.2 + multi * 0.2 + vel * 0.1)
        .when(i == "recommend", sim * 0.35 + prod * 0.3 + vel * 0.15 + multi * 0.2)
        .otherwise(sim * 0.5 + prod * 0.3 + multi * 0.2 + fresh)
    )
    scored = papers.withColumn("rerank_score", F.round(score, 9))
    order = by_query(F.col("rerank_score").desc(), "priority", "rank", "paper_id")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def paper_context(papers: DataFrame, queries: DataFrame | None = None, abstract_chars: int = 300, summary_chars: int = 200,
                  reasoning_chars: int = 150) -> DataFrame:
    """``(query_id, context)``: a numbered block per paper, with the lines its intent asks for.

    With ``queries(query_id)`` those without any paper get a text that says so; the lengths are those of the shown texts.
    """
    intent = F.col("intent")
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    score = F.when(F.coalesce("overall_score", F.lit(0.0)) != 0, F.format_string("%.1f/10", "overall_score")).otherwise("not yet analyzed")
    part = F.concat(
        F.lit("[Paper "), F.col("place").cast("string"), F.lit("] "), F.col("title"), F.lit("\nArXiv: "), F.col("paper_url"),
        F.lit("\nScore: "), score, F.lit(" | Action: "), F.coalesce("action", F.lit("")), F.lit(" | Source: "),
        F.array_join("sources", ", "), F.lit("\nAbstract: "), F.substring("abstract", 1, abstract_chars), F.lit("\n"),
        F.when(filled("summary"), F.concat(F.lit("Summary: "), F.substring("summary", 1, summary_chars), F.lit("\n"))).otherwise(""),
        F.when(filled("stack_fit") & (intent == "practical"), F.concat(F.lit("Stack Fit: "), F.col("stack_fit"), F.lit("\n"))).otherwise(""),
        F.when(filled("score_reasoning") & intent.isin("recommend", "practical"),
               F.concat(F.lit("Reasoning: "), F.substring("score_reasoning", 1, reasoning_chars), F.lit("\n"))).otherwise(""))
    gathered = papers.select("query_id", "intent", "place", "source", part.alias("part")).groupBy("query_id").agg(
        F.first("intent").alias("intent"), F.count("*").alias("n"), F.bool_or(F.col("source") == "live").alias("live"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "part"))), lambda s: s["part"]), "\n---\n").alias("body"))
    header = F.concat(F.lit("[Retrieved "), F.col("n").cast("string"), F.lit(" papers | Intent: "), F.upper("intent"),
                      F.when(F.col("live"), " | Includes live ArXiv results").otherwise(""), F.lit("]\n\n"))
    found = gathered.select("query_id", F.concat(header, "body").alias("context"))
    if queries is None:
        return found
    return queries.select("query_id").join(found, "query_id", "left").withColumn("context", F.coalesce("context", F.lit(C.NO_PAPERS_TEXT)))


def paper_citations(papers: DataFrame) -> DataFrame:
    return papers.select("query_id", "paper_id", "title", F.col("overall_score").alias("score"), "action", F.col("paper_url").alias("url"),
                         "source", F.round(F.coalesce("distance", F.lit(1.0)), 3).alias("distance"), "place")


def retrieval_mode(queries: DataFrame, dense: DataFrame, live: DataFrame) -> DataFrame:
    """Local confidence, whether the live source is wanted, and which sources answered, per query."""
    d = dense.groupBy("query_id").agg(F.count("*").alias("n_dense"), F.count_if(F.col("distance") < 0.5).alias("near"))
    v = live.groupBy("query_id").agg(F.count("*").alias("n_live"))
    near, n_dense = F.coalesce("near", F.lit(0)), F.coalesce("n_dense", F.lit(0))
    wanted = (F.col("intent") == "latest") | (near < 2)
    got = F.when(wanted, F.coalesce("n_live", F.lit(0))).otherwise(0)
    return queries.join(d, "query_id", "left").join(v, "query_id", "left").select(
        "query_id", near.alias("local_confidence"), wanted.alias("wants_live"),
        F.when((got > 0) & (n_dense == 0), "arxiv_live").when(got == 0, "local_db").otherwise("hybrid").alias("mode"))
