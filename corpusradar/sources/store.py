"""Updates of tables, written as joins: the result replaces the old table. ``bucketed`` applies them in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusradar.session import union_all

ANALYSIS_COLUMNS = [
    "domain", "novelty", "contributions", "has_code", "overall_score", "reproducibility", "compute_cost", "latency_score",
    "adoption", "score_reasoning", "summary", "stack_fit", "action", "action_reason", "hype_score", "hype_reason",
]


def upsert_analysis(papers: DataFrame, results: DataFrame) -> DataFrame:
    """Overwrite the analysis columns of papers with a result and mark them analysed; unknown ids change nothing."""
    if "latency" in results.columns:
        results = results.withColumnRenamed("latency", "latency_score")
    given = [c for c in ANALYSIS_COLUMNS if c in results.columns]
    r = results.select("paper_id", F.struct(*given).alias("_new"))
    types = dict(papers.dtypes)
    joined = papers.join(r, "paper_id", "left")
    matched = F.col("_new").isNotNull()
    new_types = dict(results.dtypes)
    updated = []
    for c in given:
        old = F.col(c) if c in types else F.lit(None).cast(new_types[c])
        updated.append(F.when(matched, F.col(f"_new.{c}")).otherwise(old).alias(c))
    old_flag = F.coalesce("is_analyzed", F.lit(False)) if "is_analyzed" in types else F.lit(False)
    rest = [c for c in papers.columns if c not in given and c != "is_analyzed"]
    return joined.select(*rest, *updated, (matched | old_flag).alias("is_analyzed"))


def vector_metadata(papers: DataFrame) -> DataFrame:
    """What is stored beside the vector of a paper, without NULLs."""
    have = dict(papers.dtypes)
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
    joined = lambda c, n=None: (F.coalesce(F.array_join(F.slice(c, 1, n) if n else F.col(c), ", "), F.lit(""))
                                if c in have else F.lit(""))
    return papers.select(
        "paper_id", F.substring(text("title"), 1, 500).alias("title"), joined("authors", 5).alias("authors"),
        joined("categories").alias("categories"), text("paper_url").alias("paper_url"), text("repo_url").alias("repo_url"),
        number("velocity_score").alias("velocity_score"), F.substring(text("summary"), 1, 500).alias("summary"),
        text("stack_fit").alias("stack_fit"), F.substring(text("score_reasoning"), 1, 300).alias("score_reasoning"),
        number("overall_score").alias("overall_score"), text("action").alias("action"))


def refresh_vector_metadata(vectors: DataFrame, papers: DataFrame) -> DataFrame:
    """New metadata for stored vectors without encoding again; vectors of unknown papers keep NULL metadata."""
    return vectors.select("paper_id", "embedding").join(vector_metadata(papers), "paper_id", "left")


def replace_partition(chunks: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """Drop every stored chunk of the papers in the new batch and add the new chunks; in place by ``bucketed.save_chunks``."""
    redone = new_chunks.select("paper_id").distinct()
    return union_all(chunks.join(redone, "paper_id", "left_anti").select(chunks.columns), new_chunks)
