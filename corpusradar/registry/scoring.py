"""Signals, score rules, answer checks and the composed analysis."""

from pyspark.sql import functions as F

from corpusradar import constants as C
from corpusradar.functions import guards as G
from corpusradar.functions import scoring as S
from corpusradar.operators.learned import learned_score
from corpusradar.plans.analyze import analyze_corpus, stage_defaults
from corpusradar.registry import query
from corpusradar.registry.sqlviews import view

# Words of the test corpus stand in for the default vocabulary, which does not occur in it.
LEX = S.Lexicons(theory=["thor", "reau"], practical=["blest", "lichk", "menton"], infra=["whin", "dasun", "aleè"])
DOMAINS = [f"src{i}" for i in range(15)]

_has = lambda col, ws: f"regexp_matches(lower({col}), '{'|'.join(ws)}')"
view("signals", f"""
SELECT paper_id, {_has('abstract', LEX.theory)} AS theory,
       coalesce(has_code, false) OR {_has('abstract', LEX.practical)} AS practical_code,
       {_has('abstract', LEX.practical)} AS practical, {_has('abstract', LEX.infra)} AS infra,
       domain, overall_score, hype_score, has_code
FROM catalog""", "catalog")
DOMAIN_SQL = "(" + ", ".join(f"'{d}'" for d in DOMAINS) + ")"
CALIBRATED = f"""round(CASE WHEN infra AND practical_code AND capped < 7 THEN 7.0 ELSE capped END, 1)"""
view("rescaled", "SELECT *, CASE WHEN overall_score < 1 THEN overall_score * 10 ELSE overall_score END AS rescaled FROM signals", "signals")
view("capped", f"""
SELECT *, CASE WHEN NOT coalesce(domain IN {DOMAIN_SQL}, false) AND rescaled > 6 THEN 6.0 ELSE rescaled END AS capped
FROM rescaled""", "rescaled")
view("calibrated", f"SELECT *, CAST({CALIBRATED} AS DOUBLE) AS calibrated FROM capped", "capped")
HYPE_SQL = """CASE WHEN {h} IS NULL THEN NULL WHEN infra AND {p} THEN greatest({h}, 7.0)
 WHEN theory AND NOT {p} THEN least({h}, 3.0) WHEN NOT {p} THEN least({h}, 5.0) WHEN NOT infra THEN least({h}, 6.0) END"""
ACTION_SQL = """CASE WHEN {s} < 4 THEN 'Skip' WHEN {s} < 6 THEN 'Experiment' WHEN {s} < 8 THEN 'Strong Experiment'
 WHEN {s} IS NOT NULL THEN 'Adopt' END"""


def _signals(t):
    return S.extract_signals(F.col("abstract"), F.col("has_code"), LEX), S.extract_signals(F.col("abstract"), None, LEX)


@query("extract_signals", """
SELECT paper_id, theory AS is_theory, practical_code AS has_practical, infra AS has_infra FROM signals""", "signals")
def _(t):
    s, _ = _signals(t)
    return t.catalog.select("paper_id", s.theory.alias("is_theory"), s.practical.alias("has_practical"), s.infra.alias("has_infra"))


@query("calibrate_score", """
SELECT paper_id, round(rescaled, 6) AS rescaled, round(capped, 6) AS capped, calibrated,
       coalesce(calibrated, 0.0::DOUBLE) AS overall_score,
       CASE WHEN overall_score IS NULL THEN 'scoring_failed' END AS score_reasoning,
       CASE WHEN overall_score IS NULL THEN 'scorer_failed' END AS error
FROM calibrated""", "calibrated")
def _(t):
    s, _ = _signals(t)
    score, domain = F.col("overall_score"), F.col("domain")
    calibrated = S.calibrate_score(score, domain, s, DOMAINS)
    return t.catalog.select(
        "paper_id", F.round(S.rescale_score(score), 6).alias("rescaled"),
        F.round(S.domain_cap(S.rescale_score(score), domain, DOMAINS), 6).alias("capped"),
        calibrated.alias("calibrated"), F.coalesce(calibrated, F.lit(0.0)).alias("overall_score"),
        F.when(score.isNull(), "scoring_failed").alias("score_reasoning"),
        F.when(score.isNull(), "scorer_failed").alias("error"))


@query("action_label", f"SELECT paper_id, calibrated, {ACTION_SQL.format(s='calibrated')} AS action FROM calibrated", "calibrated")
def _(t):
    s, _ = _signals(t)
    scored = t.catalog.select(
        "paper_id", S.calibrate_score(F.col("overall_score"), F.col("domain"), s, DOMAINS).alias("calibrated"))
    return scored.select("*", S.action_label(F.col("calibrated")).alias("action"))


@query("correct_hype", f"""
SELECT paper_id, hype_score, CAST(round({HYPE_SQL.format(h='hype_score', p='practical')}, 1) AS DOUBLE) AS corrected
FROM signals""", "signals")
def _(t):
    _, s = _signals(t)
    return t.catalog.select("paper_id", "hype_score", S.correct_hype(F.col("hype_score"), s).alias("corrected"))


@query("hidden_gem", """
SELECT paper_id, coalesce(overall_score >= 7 AND hype_score <= 4, false) AS is_hidden_gem FROM catalog""", "catalog")
def _(t):
    return t.catalog.select("paper_id", S.hidden_gem(F.col("overall_score"), F.col("hype_score")).alias("is_hidden_gem"))


@query("overhyped", """
SELECT paper_id, coalesce(hype_score >= 7 AND overall_score < 5, false) AS is_overhyped FROM catalog""", "catalog")
def _(t):
    return t.catalog.select("paper_id", S.overhyped(F.col("overall_score"), F.col("hype_score")).alias("is_overhyped"))


view("cleaned", r"""
SELECT *, trim(regexp_replace(trim(regexp_replace(raw, '(?s)<think>.*?</think>', '', 'g'), ' ' || chr(10) || chr(9) || chr(13)),
  '```(?:json)?\s*|\s*```', '', 'g'), ' ' || chr(10) || chr(9) || chr(13)) AS cleaned FROM raw_outputs""", "raw_outputs")


@query("clean_model_json", "SELECT event_id, cleaned FROM cleaned", "cleaned")
def _(t):
    return t.raw_outputs.select("event_id", G.clean_model_json(F.col("raw")).alias("cleaned"))


@query("validate_schema", """
SELECT event_id, 'props' AS origin, false AS passed, 'Missing required keys: m' AS errors, true AS retryable
FROM events WHERE json_valid(props)
UNION ALL
SELECT event_id, 'raw', json_valid(cleaned), CASE WHEN json_valid(cleaned) THEN '' ELSE 'Invalid JSON' END, NOT json_valid(cleaned)
FROM cleaned""", "cleaned")
def _(t):
    def rows(df, origin, raw, keys):
        v = G.validate_schema(raw, keys)
        return df.select("event_id", F.lit(origin).alias("origin"), v["passed"].alias("passed"),
                         F.array_join(v["errors"], "; ").alias("errors"), v["retryable"].alias("retryable"))
    return rows(t.events, "props", F.col("props"), ["k", "m"]).unionByName(
        rows(t.raw_outputs, "raw", F.col("raw"), ["hype_score", "reason"]))


@query("validate_scores", """
SELECT event_id, greatest(0.0::DOUBLE, least(50.0::DOUBLE, k)) AS k,
       CASE WHEN k NOT BETWEEN 0 AND 50 THEN 'k out of range; Missing score field: m' ELSE 'Missing score field: m' END AS warnings
FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)""")
def _(t):
    v = G.validate_scores(F.col("props"), {"k": (0, 50), "m": (0, 1)})
    return t.events.select("event_id", v["scores"]["k"].alias("k"), F.array_join(v["warnings"], "; ").alias("warnings"))


WORDS5 = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{5,}}'))"


@query("validate_grounding", f"""
SELECT conv_id, turn, round(overlap, 6) AS overlap, ns = 0 OR claim = '' OR overlap >= 0.1 AS grounded
FROM (SELECT a.conv_id, a.turn, a.text AS claim, len({WORDS5.format('u.text')}) AS ns,
             len(list_intersect({WORDS5.format('a.text')}, {WORDS5.format('u.text')})) / greatest(len({WORDS5.format('a.text')}), 1) AS overlap
      FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
      WHERE a.role = 'assistant')""")
def _(t):
    c = t.conversations
    source = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source"))
    pairs = c.where("role = 'assistant'").join(source, ["conv_id", "turn"])
    claim, src = F.col("text"), F.col("source")
    return pairs.select("conv_id", "turn", F.round(G.grounding_overlap(claim, src), 6).alias("overlap"),
                        G.validate_grounding(claim, src).alias("grounded"))


WS = "' ' || chr(10) || chr(9) || chr(13)"


def clean_sql(col: str) -> str:
    return (rf"trim(regexp_replace(trim(regexp_replace({col}, '(?s)<think>.*?</think>', '', 'g'), {WS}), "
            rf"'```(?:json)?\s*|\s*```', '', 'g'), {WS})")


view("checked", f"""
SELECT o.paper_id, p.abstract, c, s, b, h, hype_raw, json_valid(c) AND len(list_intersect(CASE WHEN json_valid(c) THEN json_keys(c) END, {C.CLASSIFIER_KEYS})) = 4 AS c_ok,
  json_valid(s) AND len(list_intersect(CASE WHEN json_valid(s) THEN json_keys(s) END, {C.SCORER_KEYS})) = 6 AS s_ok,
  json_valid(b) AS b_schema, CASE WHEN json_valid(b) THEN json_extract_string(b, '$.summary') END AS claim
FROM (SELECT *, {clean_sql('classifier_raw')} AS c, {clean_sql('scorer_raw')} AS s, {clean_sql('brief_raw')} AS b,
             {clean_sql('hype_raw')} AS h FROM model_outputs) o JOIN papers p USING (paper_id)""", "model_outputs papers")
view("grounded", f"""
SELECT *, b_schema AND (coalesce(claim, '') = '' OR len({WORDS5.format('abstract')}) = 0
  OR len(list_intersect({WORDS5.format('abstract')}, {WORDS5.format("coalesce(claim, '')")}))
     / greatest(len({WORDS5.format("coalesce(claim, '')")}), 1) >= 0.1) AS b_ok
FROM checked""", "checked")


@query("run_guardrails", """
SELECT paper_id, b_ok AS passed, CASE WHEN NOT b_schema THEN 'Invalid JSON' WHEN NOT b_ok THEN 'Low grounding score' ELSE '' END AS errors,
       NOT b_ok AS retryable, s_ok AS scorer_passed,
       CASE WHEN NOT s_ok THEN 'Missing required keys: reproducibility, compute_cost, latency, adoption, reasoning'
            WHEN CAST(json_extract_string(s, '$.overall_score') AS DOUBLE) > 10 AND CAST(json_extract_string(s, '$.reproducibility') AS DOUBLE) <= 10
            THEN 'overall_score out of range; latency out of range' ELSE 'latency out of range' END AS scorer_warnings,
       CASE WHEN s_ok THEN round(greatest(0, least(10, CAST(json_extract_string(s, '$.overall_score') AS DOUBLE))), 6) END AS clamped_score,
       CASE WHEN s_ok THEN round(greatest(0, least(10, CAST(json_extract_string(s, '$.latency') AS DOUBLE))), 6) END AS clamped_latency,
       CASE WHEN s_ok THEN json_extract_string(s, '$.reasoning') END AS scorer_reasoning
FROM grounded""", "grounded")
def _(t):
    df = t.papers.select("paper_id", "abstract").join(t.model_outputs, "paper_id")
    brief = G.run_guardrails(F.col("brief_raw"), C.BRIEF_KEYS, source=F.col("abstract"))
    scorer = G.run_guardrails(F.col("scorer_raw"), C.SCORER_KEYS, C.SCORER_RANGES)
    return df.select("paper_id", brief["passed"].alias("passed"), F.array_join(brief["errors"], "; ").alias("errors"),
                     brief["retryable"].alias("retryable"), scorer["passed"].alias("scorer_passed"),
                     F.array_join(scorer["errors"], "; ").alias("scorer_warnings"),
                     *[F.round(F.when(scorer["passed"], F.get_json_object(scorer["output"], f"$.{field}").cast("double")), 6).alias(name)
                       for name, field in (("clamped_score", "overall_score"), ("clamped_latency", "latency"))],
                     F.when(scorer["passed"], F.get_json_object(scorer["output"], "$.reasoning")).alias("scorer_reasoning"))


def hype_sql(raw: str, cleaned: str) -> tuple[str, str, str]:
    js = f"CASE WHEN json_valid({cleaned}) THEN TRY_CAST(json_extract_string({cleaned}, '$.hype_score') AS DOUBLE) END"
    loose = rf"""TRY_CAST(nullif(regexp_extract({raw}, '"hype_score"\s*:\s*([0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE)"""
    reason = (rf"""CASE WHEN regexp_matches({raw}, '"reason"\s*:\s*"([^"]{{0,200}})') THEN """
              rf"""regexp_extract({raw}, '"reason"\s*:\s*"([^"]{{0,200}})', 1) ELSE 'parsed via fallback' END""")
    return js, loose, reason


_js, _loose, _reason = hype_sql("raw", "cleaned")
view("hype_parsed", f"""
SELECT event_id, js, loose, CASE WHEN js BETWEEN 1 AND 10 THEN js WHEN loose BETWEEN 1 AND 10 THEN loose ELSE -1 END AS score,
       CASE WHEN js BETWEEN 1 AND 10 THEN coalesce(json_extract_string(cleaned, '$.reason'), '')
            WHEN loose BETWEEN 1 AND 10 THEN loose_reason ELSE '' END AS reason
FROM (SELECT event_id, raw, cleaned, {_js} AS js, {_loose} AS loose, {_reason} AS loose_reason FROM cleaned)""", "cleaned")


@query("parse_hype", """
SELECT event_id, CAST(score AS DOUBLE) AS score, reason, CAST(CASE WHEN score < 0 THEN 5.0 ELSE score END AS DOUBLE) AS neutral_score,
       CASE WHEN score < 0 THEN 'parse fallback' ELSE reason END AS neutral_reason
FROM hype_parsed""", "hype_parsed")
def _(t):
    strict, neutral = G.parse_hype(F.col("raw")), G.parse_hype(F.col("raw"), "neutral")
    return t.raw_outputs.select("event_id", strict["score"].alias("score"), strict["reason"].alias("reason"),
                                neutral["score"].alias("neutral_score"), neutral["reason"].alias("neutral_reason"))


_js2, _loose2, _reason2 = hype_sql("hype_raw", "h")
view("staged", f"""
SELECT paper_id, CASE WHEN c_ok THEN json_extract_string(c, '$.domain') ELSE 'Other' END AS domain,
  CASE WHEN c_ok THEN json_extract_string(c, '$.novelty') ELSE 'incremental' END AS novelty,
  CASE WHEN c_ok THEN json_extract_string(c, '$.contributions[0]') ELSE '' END AS contributions,
  CASE WHEN c_ok THEN CAST(json_extract_string(c, '$.has_code') AS BOOLEAN) ELSE false END AS has_code,
  CASE WHEN s_ok THEN least(10.0, CAST(json_extract_string(s, '$.overall_score') AS DOUBLE)) END AS model_score,
  CASE WHEN s_ok THEN least(10.0::DOUBLE, CAST(json_extract_string(s, '$.reproducibility') AS DOUBLE)) END AS reproducibility,
  CASE WHEN s_ok THEN CAST(json_extract_string(s, '$.compute_cost') AS DOUBLE) END AS compute_cost,
  CASE WHEN s_ok THEN least(10.0::DOUBLE, CAST(json_extract_string(s, '$.latency') AS DOUBLE)) END AS latency_score,
  CASE WHEN s_ok THEN CAST(json_extract_string(s, '$.adoption') AS DOUBLE) END AS adoption,
  CASE WHEN s_ok THEN json_extract_string(s, '$.reasoning') ELSE 'scoring_failed' END AS score_reasoning,
  CASE WHEN b_ok THEN claim END AS summary, CASE WHEN b_ok THEN json_extract_string(b, '$.stack_fit') END AS stack_fit,
  CASE WHEN b_ok THEN json_extract_string(b, '$.action_reason') END AS action_reason, b_ok, abstract,
  CASE WHEN hype >= 0 THEN hype END AS model_hype, CASE WHEN hype >= 0 THEN hype_reason END AS hype_reason,
  concat_ws(',', CASE WHEN NOT c_ok THEN 'classifier_failed' END, CASE WHEN NOT s_ok THEN 'scorer_failed' END,
            CASE WHEN NOT b_ok THEN 'brief_failed' END, CASE WHEN hype < 0 THEN 'hype_failed' END) AS errors
FROM (SELECT *, CASE WHEN js BETWEEN 1 AND 10 THEN js WHEN loose BETWEEN 1 AND 10 THEN loose ELSE -1 END AS hype,
             CASE WHEN js BETWEEN 1 AND 10 THEN coalesce(json_extract_string(h, '$.reason'), '') ELSE loose_reason END AS hype_reason
      FROM (SELECT *, {_js2} AS js, {_loose2} AS loose, {_reason2} AS loose_reason FROM grounded))""", "grounded")


@query("stage_defaults", """
SELECT paper_id, domain, novelty, contributions, has_code, CAST(model_score AS DOUBLE) AS model_score, score_reasoning, summary,
       CAST(model_hype AS DOUBLE) AS model_hype, hype_reason, errors FROM staged""", "staged")
def _(t):
    staged = stage_defaults(t.papers.select("paper_id", "abstract").join(t.model_outputs, "paper_id"))
    return staged.select("paper_id", "domain", "novelty", F.array_join("contributions", ",").alias("contributions"), "has_code",
                         "model_score", "score_reasoning", "summary", "model_hype", "hype_reason",
                         F.array_join("errors", ",").alias("errors"))


_pr, _in, _th = (_has("abstract", LEX.practical), _has("abstract", LEX.infra), _has("abstract", LEX.theory))
ANALYZED = f"""
, sig AS (SELECT *, {_th} AS theory, {_pr} AS practical, has_code OR {_pr} AS practical_code, {_in} AS infra,
            CASE WHEN model_score < 1 THEN model_score * 10 ELSE model_score END AS rescaled FROM staged),
cap AS (SELECT *, CASE WHEN domain NOT IN {DOMAIN_SQL} AND rescaled > 6 THEN 6.0 ELSE rescaled END AS capped FROM sig),
fin AS (SELECT *, CAST(coalesce({CALIBRATED}, 0) AS DOUBLE) AS final_score,
          CAST(round({HYPE_SQL.format(h='model_hype', p='practical')}, 1) AS DOUBLE) AS final_hype FROM cap)
SELECT paper_id, domain, novelty, contributions, has_code, final_score AS overall_score, reproducibility, compute_cost,
       latency_score, adoption, score_reasoning, summary, stack_fit,
       CASE WHEN b_ok THEN {ACTION_SQL.format(s='final_score')} END AS action, action_reason, final_hype AS hype_score, hype_reason,
       coalesce(final_score >= 7 AND final_hype <= 4, false) AS is_hidden_gem, errors
FROM fin"""


@query("analyze_corpus", ANALYZED, "staged")
def _(t):
    out = analyze_corpus(t.papers, t.model_outputs, DOMAINS, LEX)
    return out.withColumn("contributions", F.array_join("contributions", ",")).withColumn("errors", F.array_join("errors", ","))


@query("learned_score")
def _(t):
    docs = t.documents
    train = docs.join(t.labels, "doc_id").select("text", F.col("quality").alias("label"))
    return learned_score(train, docs.select(F.col("doc_id").alias("paper_id"), "text", F.col("source").alias("domain")),
                         DOMAINS, LEX)


@query("generic_reason", """
SELECT paper_id, regexp_matches(lower(abstract), 'lorem|thinblest|the of') AS is_generic FROM papers""", "papers")
def _(t):
    return t.papers.select("paper_id", S.generic_reason(F.col("abstract"), ["lorem", "thinblest", "the of"]).alias("is_generic"))
