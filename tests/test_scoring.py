import pytest
from pyspark.sql import functions as F

from corpusradar.functions import guards as G
from corpusradar.functions import scoring as S


def column(spark, rows, schema, expr):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in df.select(expr.alias("v"), "i").orderBy("i").collect()]


def test_signals_are_substrings(spark):
    rows = [("An encoder without speed gains", None), ("boundary cases", None), ("No code released", None), ("plain", True), (None, None)]
    s = S.extract_signals(F.col("t"), F.col("c"))
    got = column(spark, rows, "t string, c boolean", F.struct(s.theory, s.practical, s.infra))
    assert [tuple(g) for g in got] == [
        (False, True, True), (True, False, False), (False, True, False), (False, True, False), (False, False, False)]


@pytest.mark.parametrize("score,domain,text,want", [
    (0.5, "LLM", "x", 5.0), (0.0, "LLM", "x", 0.0), (1.0, "LLM", "x", 1.0), (0.99, None, "x", 6.0), (6.0, "Biology", "x", 6.0),
    (6.1, "Biology", "x", 6.0), (9.0, "Biology", "code and latency", 7.0), (9.0, "RAG", "code and latency", 9.0),
    (3.0, "RAG", "code and latency", 7.0), (6.9, "RAG", "latency only", 6.9),
])
def test_calibration_order(spark, score, domain, text, want):
    s = S.extract_signals(F.col("t"))
    assert column(spark, [(score, domain, text)], "s double, d string, t string", S.calibrate_score(F.col("s"), F.col("d"), s)) == [want]


def test_action_steps(spark):
    got = column(spark, [(v,) for v in (0.0, 3.9, 4.0, 5.9, 6.0, 7.9, 8.0, None)], "s double", S.action_label(F.col("s")))
    assert got == ["Skip", "Skip", "Experiment", "Experiment", "Strong Experiment", "Strong Experiment", "Adopt", None]


def test_hype_rules_and_null(spark):
    rows = [(9.0, "a theorem"), (9.0, "nothing here"), (9.0, "with code"), (2.0, "code and memory"), (None, "code and memory"), (2.0, "a proof")]
    s = S.extract_signals(F.col("t"))
    assert column(spark, rows, "h double, t string", S.correct_hype(F.col("h"), s)) == [3.0, 5.0, 6.0, 7.0, None, 2.0]


def test_gem_and_overhyped_edges(spark):
    rows = [(7.0, 4.0), (6.9, 4.0), (7.0, 4.1), (4.9, 7.0), (5.0, 7.0), (None, 7.0), (8.0, None)]
    schema = "s double, h double"
    assert column(spark, rows, schema, S.hidden_gem(F.col("s"), F.col("h"))) == [True] + [False] * 6
    assert column(spark, rows, schema, S.overhyped(F.col("s"), F.col("h"))) == [False, False, False, True, False, False, False]


def test_schema_branches(spark):
    raws = ['{"a": 1, "b": 2}', '```json\n{"a": 1, "b": 2}\n```', '<think>x\ny</think> {"a": 1, "b": null}', '{"a": 1}', "{broken", "", None]
    v = G.validate_schema(F.col("r"), ["a", "b"])
    got = column(spark, [(r,) for r in raws], "r string", F.struct(v["passed"], v["errors"], v["retryable"]))
    assert [g[0] for g in got] == [True, True, True, False, False, False, False]
    assert got[3][1] == ["Missing required keys: b"] and got[4][1] == ["Invalid JSON"] and got[4][2]


def test_scores_clamp_and_warn(spark):
    v = G.validate_scores(F.col("r"), {"x": (0, 10), "y": (0, 1), "z": (0, 5)})
    got = column(spark, [('{"x": 12, "y": "abc"}',)], "r string", v)[0]
    assert got["scores"]["x"] == 10.0 and got["scores"]["y"] is None
    assert got["warnings"] == ["x out of range", "y is not a number", "Missing score field: z"]


def test_grounding(spark):
    rows = [("alpha network results", "the network learns"), ("totally unrelated wording", "the network learns"), ("", "network"),
            ("network words", "a b c"), (None, "network")]
    assert column(spark, rows, "c string, s string", G.validate_grounding(F.col("c"), F.col("s"))) == [True, False, True, True, True]


def test_hype_parse_branches(spark):
    raws = ['{"hype_score": 7, "reason": "r"}', '```json\n{"hype_score": 7.5}\n```', 'x "hype_score": 3 "reason": "cut off', 'x "hype_score": 4',
            '{"hype_score": 11}', '{"hype_score": 0}', "none", None]
    strict = column(spark, [(r,) for r in raws], "r string", G.parse_hype(F.col("r")))
    assert [(s["score"], s["reason"]) for s in strict] == [
        (7.0, "r"), (7.5, ""), (3.0, "cut off"), (4.0, "parsed via fallback"), (-1.0, ""), (-1.0, ""), (-1.0, ""), (-1.0, "")]
    neutral = column(spark, [("none",)], "r string", G.parse_hype(F.col("r"), "neutral"))[0]
    assert tuple(neutral) == (5.0, "parse fallback")


def test_judge_defaults(spark):
    rows = [('{"score": 2}', "c" * 100), ('{"score": 4}', "short"), ("bad", "c" * 100), ('```json\n{"score": 3}\n```', "c" * 100)]
    got = column(spark, rows, "r string, c string", G.judge_verdict(F.col("r"), F.col("c")))
    assert [tuple(g) for g in got] == [(2, False), (1, False), (3, True), (3, True)]
