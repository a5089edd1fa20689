"""The four analysis stages over a whole table of papers, as one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusradar import constants as C
from corpusradar.functions import guards as G
from corpusradar.functions import scoring as S
from corpusradar.functions.text import string_array


def stage_defaults(outputs: DataFrame) -> DataFrame:
    """Per-stage verdicts, failure defaults and the accumulated ``errors``; hype stays NULL on failure."""
    classifier = G.run_guardrails(F.col("classifier_raw"), C.CLASSIFIER_KEYS)["passed"]
    scorer = G.run_guardrails(F.col("scorer_raw"), C.SCORER_KEYS, C.SCORER_RANGES)["passed"]
    brief = G.run_guardrails(F.col("brief_raw"), C.BRIEF_KEYS, source=F.col("abstract"))["passed"]
    hype = G.parse_hype(F.col("hype_raw"))
    parsed_c = F.try_parse_json(G.clean_model_json(F.col("classifier_raw")))
    parsed_s = F.try_parse_json(G.clean_model_json(F.col("scorer_raw")))
    parsed_b = F.try_parse_json(G.clean_model_json(F.col("brief_raw")))
    scores = G.validate_scores(G.clean_model_json(F.col("scorer_raw")), C.SCORER_RANGES)["scores"]
    flags = outputs.select("*", classifier.alias("_c"), scorer.alias("_s"), brief.alias("_b"), hype.alias("_h"),
                           parsed_c.alias("_pc"), parsed_s.alias("_ps"), parsed_b.alias("_pb"), scores.alias("_sc"))
    ok_hype = F.col("_h.score") >= 0
    score_cols = [F.when(F.col("_s"), F.col(f"_sc.{n}")).alias({"latency": "latency_score"}.get(n, n))
                  for n in C.SCORER_RANGES if n != "overall_score"]
    return flags.select(
        *outputs.columns,
        F.when(F.col("_c"), G.json_field(F.col("_pc"), "domain")).otherwise("Other").alias("domain"),
        F.when(F.col("_c"), G.json_field(F.col("_pc"), "novelty")).otherwise("incremental").alias("novelty"),
        F.when(F.col("_c"), F.try_variant_get(F.col("_pc"), "$.contributions", "array<string>"))
        .otherwise(string_array([])).alias("contributions"),
        F.when(F.col("_c"), F.coalesce(G.json_field(F.col("_pc"), "has_code", "boolean"), F.lit(False)))
        .otherwise(False).alias("has_code"),
        F.when(F.col("_s"), F.col("_sc.overall_score")).alias("model_score"),
        *score_cols,
        F.when(F.col("_s"), G.json_field(F.col("_ps"), "reasoning")).otherwise("scoring_failed").alias("score_reasoning"),
        *[F.when(F.col("_b"), G.json_field(F.col("_pb"), n)).alias(n) for n in ("summary", "stack_fit", "action_reason")],
        F.col("_b").alias("brief_ok"),
        F.when(ok_hype, F.col("_h.score")).alias("model_hype"),
        F.when(ok_hype, F.col("_h.reason")).alias("hype_reason"),
        F.array_compact(F.array(
            F.when(~F.col("_c"), "classifier_failed"), F.when(~F.col("_s"), "scorer_failed"),
            F.when(~F.col("_b"), "brief_failed"), F.when(~ok_hype, "hype_failed"))).alias("errors"),
    )


def analyze_corpus(
    papers: DataFrame,
    outputs: DataFrame,
    known_domains: Sequence[str] = C.KNOWN_DOMAINS,
    lexicons: S.Lexicons = S.Lexicons(),
) -> DataFrame:
    """Classify, score, brief and hype for every paper with model answers: one join, then narrow columns."""
    staged = stage_defaults(papers.select("paper_id", "title", "abstract").join(outputs, "paper_id"))
    with_code = S.extract_signals(F.col("abstract"), F.col("has_code"), lexicons)
    plain = S.extract_signals(F.col("abstract"), None, lexicons)
    scored = staged.select(
        "*",
        F.coalesce(S.calibrate_score(F.col("model_score"), F.col("domain"), with_code, known_domains), F.lit(0.0))
        .alias("overall_score"),
        S.correct_hype(F.col("model_hype"), plain).alias("hype_score"),
    )
    return scored.select(
        "paper_id", "domain", "novelty", "contributions", "has_code", "overall_score", "reproducibility", "compute_cost",
        "latency_score", "adoption", "score_reasoning", "summary", "stack_fit",
        F.when(F.col("brief_ok"), S.action_label(F.col("overall_score"))).alias("action"),
        "action_reason", "hype_score", "hype_reason",
        S.hidden_gem(F.col("overall_score"), F.col("hype_score")).alias("is_hidden_gem"),
        "errors",
    )
