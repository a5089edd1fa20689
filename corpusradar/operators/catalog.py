"""Catalog queries over papers and their analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusradar.functions.scoring import overhyped

BRIEF_COLUMNS = [
    "paper_id", "title", "summary", "stack_fit", "action", "action_reason", "overall_score", "score_reasoning", "hype_score",
    "hype_reason", "contributions", "domain", "novelty", "paper_url", "repo_url", "index_built", "index_sections", "index_pages",
]
FULL_ONLY_COLUMNS = [
    "abstract", "summary", "stack_fit", "score_reasoning", "contributions", "has_code", "pdf_url", "index_doc_id",
]


def list_papers(papers: DataFrame, limit: int = 20, offset: int = 0, action: str | None = None, domain: str | None = None,
                has_repo: bool | None = None, analyzed_only: bool = False) -> DataFrame:
    """Newest ingested first; ``has_repo=False`` filters nothing, only ``True`` does."""
    if action:
        papers = papers.where(F.col("action") == action)
    if domain:
        papers = papers.where(F.col("domain") == domain)
    if has_repo:
        papers = papers.where(F.col("repo_url").isNotNull())
    if analyzed_only:
        papers = papers.where(F.col("is_analyzed"))
    return papers.orderBy(F.col("ingested_at").desc(), "paper_id").offset(offset).limit(limit)


def get_paper(papers: DataFrame, paper_id) -> DataFrame:
    return papers.where(F.col("paper_id") == paper_id)


def get_papers(papers: DataFrame, wanted: DataFrame) -> DataFrame:
    """Many point lookups as one semi join."""
    return papers.join(wanted.select("paper_id"), "paper_id", "left_semi")


def brief(papers: DataFrame) -> DataFrame:
    """The brief projection; columns the table does not have come out as NULL."""
    return papers.select([F.col(c) if c in papers.columns else F.lit(None).cast("string").alias(c) for c in BRIEF_COLUMNS])


def hidden_gems(papers: DataFrame, limit: int | None = 10) -> DataFrame:
    """Well rated papers with little hype, best first; ``limit=None`` gives all of them, in no order."""
    gems = papers.where(F.col("is_analyzed") & (F.col("overall_score") >= 7.0) & (F.col("hype_score") <= 4.0))
    return gems if limit is None else gems.orderBy(F.col("overall_score").desc(), "paper_id").limit(limit)


def analyzed(papers: DataFrame, action: str | None = None, recent: bool = False, limit: int = 50, hours: int = 2) -> DataFrame:
    """Best first; ``recent`` keeps papers ingested within ``hours`` of the newest ingest of any paper."""
    rows = papers.where(F.col("is_analyzed"))
    if action:
        rows = rows.where(F.col("action") == action)
    if recent:
        start = papers.select((F.max("ingested_at") - F.make_dt_interval(F.lit(0), F.lit(hours))).alias("start"))
        rows = rows.where(F.col("ingested_at") >= start.scalar())
    return rows.orderBy(F.col("overall_score").desc(), "paper_id").limit(limit)


def health_counts(papers: DataFrame, indexed: Column) -> DataFrame:
    return papers.agg(F.count("*").alias("papers"), F.count_if(F.coalesce("is_analyzed", F.lit(False))).alias("analyzed"),
                      F.count_if(indexed).alias("indexed"))


def paper_view(papers: DataFrame, full: bool = False) -> DataFrame:
    """Public projection: NULL lists become empty; the short form leaves the long columns out."""
    columns = []
    for c in papers.columns:
        if not full and c in FULL_ONLY_COLUMNS:
            continue
        if c in ("authors", "categories"):
            columns.append(F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c))
        else:
            columns.append(F.col(c))
    return papers.select(columns)


def merge_catalog(papers: DataFrame, analysis: DataFrame) -> DataFrame:
    """Overlay analysis rows on papers by id; analysed rows missing from papers are added."""
    left, right = papers.alias("l"), analysis.alias("r")
    joined = left.join(right, F.col("l.paper_id") == F.col("r.paper_id"), "full_outer")
    matched = F.col("r.paper_id").isNotNull()
    names = list(dict.fromkeys(papers.columns + analysis.columns))
    out = []
    for n in names:
        if n == "paper_id":
            out.append(F.coalesce("l.paper_id", "r.paper_id").alias(n))
        elif n in papers.columns and n in analysis.columns:
            out.append(F.when(matched, F.col(f"r.{n}")).otherwise(F.col(f"l.{n}")).alias(n))
        else:
            out.append(F.col(f"{'l' if n in papers.columns else 'r'}.{n}"))
    return joined.select(out)


def substring_search(papers: DataFrame, text: str,
                     fields: Sequence[str] = ("title", "abstract", "summary", "contributions")) -> DataFrame:
    """Case-insensitive contains in any of the text fields; an empty query keeps everything."""
    if not text:
        return papers
    hit = F.lit(False)
    types = dict(papers.dtypes)
    for f in fields:
        if f in types:
            col = F.array_join(f, ",") if types[f].startswith("array") else F.col(f)
            hit = hit | F.coalesce(F.contains(F.lower(col), F.lit(text.lower())), F.lit(False))
    return papers.where(hit)


def stack_match(papers: DataFrame, stack: Sequence[str]) -> DataFrame:
    """Papers whose ``stack_fit`` contains any of the given items."""
    hit = F.lit(False)
    for item in stack:
        hit = hit | F.contains(F.lower("stack_fit"), F.lit(item.lower()))
    return papers.where(F.coalesce(hit, F.lit(False)))


def tab_filter(papers: DataFrame, kind: str, gems: DataFrame | None = None, stack: Sequence[str] = ()) -> DataFrame:
    if kind in ("adopt", "experiment"):
        return papers.where(F.contains(F.lower("action"), F.lit(kind)))
    if kind == "watch":
        return papers.where(F.col("action") == "Watch")
    if kind == "gems":
        return papers.join(gems.select("paper_id"), "paper_id", "left_semi")
    if kind == "stack":
        return stack_match(papers, stack)
    if kind == "new":
        return papers.where(~F.coalesce("is_analyzed", F.lit(False)))
    return papers


def daily_digest(papers: DataFrame) -> DataFrame:
    has = lambda word: F.coalesce(F.contains(F.lower("action"), F.lit(word)), F.lit(False))
    return papers.agg(
        F.count("*").alias("papers"),
        F.count_if(has("adopt")).alias("adopt"), F.count_if(has("experiment")).alias("experiment"),
        F.count_if(F.coalesce(F.col("action") == "Watch", F.lit(False))).alias("watch"),
        F.count_if(overhyped(F.col("overall_score"), F.col("hype_score"))).alias("overhyped"),
        F.round(F.avg(F.coalesce("overall_score", F.lit(0.0))), 1).alias("mean_score"))
