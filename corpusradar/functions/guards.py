"""Checks on raw model answers: parse, required keys, score ranges, grounding. JVM expressions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusradar import constants as C
from corpusradar.functions.text import first_match, string_array, strip, word_set


def clean_model_json(raw: Column) -> Column:
    """Drop thinking passages, then code fences."""
    return strip(F.regexp_replace(strip(F.regexp_replace(raw, C.THINK_PATTERN, "")), C.FENCE_PATTERN, ""))


def verdict(passed: Column, output: Column, errors: Column, retryable: Column) -> Column:
    return F.struct(passed.alias("passed"), output.alias("output"), errors.alias("errors"), retryable.alias("retryable"))


def json_field(parsed: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(parsed, f"$.{name}", kind)


def missing_keys(cleaned: Column, keys: Sequence[str]) -> Column:
    return F.array_except(string_array(keys), F.coalesce(F.json_object_keys(cleaned), string_array([])))


def validate_schema(raw: Column, keys: Sequence[str]) -> Column:
    cleaned = clean_model_json(F.coalesce(raw, F.lit("")))
    valid = F.try_parse_json(cleaned).isNotNull()
    missing = missing_keys(cleaned, keys)
    errors = (
        F.when(~valid, F.array(F.lit("Invalid JSON")))
        .when(F.size(missing) > 0, F.array(F.concat(F.lit("Missing required keys: "), F.array_join(missing, ", "))))
        .otherwise(string_array([]))
    )
    passed = valid & (F.size(missing) == 0)
    return verdict(passed, F.when(valid, cleaned), errors, ~passed)


def validate_scores(cleaned: Column, ranges: Mapping[str, tuple[float, float]]) -> Column:
    """Clamped score fields and warnings; never fails the answer."""
    parsed = F.try_parse_json(cleaned)
    values, warnings = [], []
    for name, (lo, hi) in ranges.items():
        text, number = json_field(parsed, name), json_field(parsed, name, "double")
        clamped = F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), number))
        values.append(F.when(number.isNotNull(), clamped).alias(name))
        warnings.append(
            F.when(text.isNull(), F.lit(f"Missing score field: {name}"))
            .when(number.isNull(), F.lit(f"{name} is not a number"))
            .when(~number.between(float(lo), float(hi)), F.lit(f"{name} out of range"))
        )
    return F.struct(F.struct(*values).alias("scores"), F.array_compact(F.array(*warnings)).alias("warnings"))


def clamped_json(cleaned: Column, ranges: Mapping[str, tuple[float, float]]) -> Column:
    """The answer with every score that is out of range set to the nearest bound; all other fields as they are."""
    parsed, limited = F.try_parse_json(cleaned), lambda k, v: v
    fields = F.from_json(cleaned, "map<string,variant>")
    for name, (lo, hi) in ranges.items():
        number = json_field(parsed, name, "double")
        bound = F.when(number < float(lo), F.parse_json(F.lit(str(lo)))).when(number > float(hi), F.parse_json(F.lit(str(hi))))
        limited = (lambda k, v, name=name, bound=bound, before=limited:
                   F.when((k == name) & bound.isNotNull(), bound).otherwise(before(k, v)))
    return F.to_json(F.transform_values(fields, lambda k, v: limited(k, v)))


def grounding_overlap(claim: Column, source: Column, min_len: int = 5) -> Column:
    claimed = word_set(F.coalesce(claim, F.lit("")), min_len)
    known = word_set(F.coalesce(source, F.lit("")), min_len)
    return F.size(F.array_intersect(known, claimed)) / F.greatest(F.size(claimed), F.lit(1))


def validate_grounding(claim: Column, source: Column, min_overlap: float = 0.1) -> Column:
    """Passes when the claim shares words with its source, or when either has no text to compare."""
    nothing = (F.coalesce(claim, F.lit("")) == "") | ~F.coalesce(source, F.lit("")).rlike(r"[\p{L}\p{N}_]{5}")
    return nothing | (grounding_overlap(claim, source) >= min_overlap)


def run_guardrails(
    raw: Column,
    keys: Sequence[str],
    ranges: Mapping[str, tuple[float, float]] | None = None,
    source: Column | None = None,
    claim_field: str = "summary",
) -> Column:
    """Schema, then score warnings, then grounding; the first hard failure decides. Scores out of range come out clamped."""
    schema = validate_schema(raw, keys)
    cleaned = clean_model_json(F.coalesce(raw, F.lit("")))
    passed, errors, output = schema["passed"], schema["errors"], schema["output"]
    if ranges:
        output = F.when(passed, clamped_json(cleaned, ranges)).otherwise(output)
        errors = F.when(passed, validate_scores(cleaned, ranges)["warnings"]).otherwise(errors)
    if source is not None:
        grounded = validate_grounding(json_field(F.try_parse_json(cleaned), claim_field), source)
        errors = F.when(passed & ~grounded, F.array(F.lit("Low grounding score"))).when(passed & grounded, string_array([])) \
            .otherwise(errors)
        passed = passed & grounded
    return verdict(passed, output, errors, ~passed)


def parse_hype(raw: Column, on_fail: str = "none") -> Column:
    """``struct(score, reason)``: JSON in range, else the pattern on the uncleaned text, else the failure value.

    ``on_fail='none'`` gives -1 and an empty reason, ``'neutral'`` gives 5.0 and ``parse fallback``.
    """
    text = F.coalesce(raw, F.lit(""))
    parsed = F.try_parse_json(clean_model_json(text))
    score = json_field(parsed, "hype_score", "double")
    loose = first_match(text, C.HYPE_SCORE_PATTERN, 1).try_cast("double")
    loose_reason = F.coalesce(first_match(text, C.HYPE_REASON_PATTERN, 1), F.lit("parsed via fallback"))
    fail_score, fail_reason = (-1.0, "") if on_fail == "none" else (5.0, "parse fallback")
    in_range, loose_in_range = score.between(1.0, 10.0), loose.between(1.0, 10.0)
    return F.struct(
        F.when(in_range, score).when(loose_in_range, loose).otherwise(fail_score).alias("score"),
        F.when(in_range, F.coalesce(json_field(parsed, "reason"), F.lit("")))
        .when(loose_in_range, loose_reason).otherwise(fail_reason).alias("reason"),
    )


def judge_verdict(raw: Column, context: Column, min_context: int = 100) -> Column:
    """``struct(score, adequate)`` of a retrieval judge's answer, with its defaults."""
    cleaned = strip(F.regexp_replace(F.coalesce(raw, F.lit("")), C.FENCE_PATTERN, ""))
    parsed = F.try_parse_json(cleaned)
    given = json_field(parsed, "score", "double").cast("int")
    score = (
        F.when(F.length(F.coalesce(context, F.lit(""))) < min_context, F.lit(1))
        .otherwise(F.coalesce(given, F.lit(3)))
    )
    return F.struct(score.alias("score"), (score >= 3).alias("adequate"))
