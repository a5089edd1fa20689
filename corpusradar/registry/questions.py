"""Question understanding queries."""

from pyspark.sql import functions as F

from corpusradar import constants as C
from corpusradar.functions import dialog as D
from corpusradar.functions import guards as G
from corpusradar.registry import query
from corpusradar.registry.sqlviews import view


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_sql(col: str, patterns) -> str:
    return f"regexp_matches({col}, {lit('(?i)' + '|'.join(f'(?:{p})' for p in patterns))})"


def has_sql(col: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{w}')" for w in words) + ")"


def deep_sql(col: str) -> str:
    totals = {n: "(" + " + ".join(f"CAST({any_sql(col, [p])} AS INTEGER)" for p in ps) + f") * {w}"
              for n, (w, ps) in C.DEEP_INTENT_PATTERNS.items()}
    best = f"greatest({', '.join(totals.values())})"
    cases = " ".join(f"WHEN {t} = {best} THEN '{n}'" for n, t in totals.items())
    return f"CASE WHEN {best} = 0 THEN 'discuss' {cases} END"


def global_sql(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_sql(col, ps)} THEN '{n}'" for n, ps in C.GLOBAL_INTENT_PATTERNS.items()) + " ELSE 'factual' END"


def budget_sql(col: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{n}' THEN {k}" for n, k in C.CHUNK_BUDGETS.items()) + " ELSE 10 END"


def decompose_sql(col: str, intent: str) -> str:
    tails = lambda ts: ", ".join(f"{col} || '{t}'" for t in ts)
    triggered = ", ".join(f"CASE WHEN {has_sql(col, cues)} THEN {col} || '{tail}' END" for cues, tail in C.DECOMPOSE_IMPLEMENT_TRIGGERED)
    return f"""list_filter(CASE WHEN {intent} = 'implement' THEN [{col}, {tails(C.DECOMPOSE_IMPLEMENT_ALWAYS)}, {triggered}]
 WHEN {intent} IN ('explain', 'discuss') AND {has_sql(col, C.DECOMPOSE_SYSTEM_WORDS)} THEN [{col}, {tails(C.DECOMPOSE_SYSTEM)}]
 WHEN {intent} = 'math' THEN [{col}, {tails(C.DECOMPOSE_MATH)}] WHEN {intent} = 'formula' THEN [{col}, {tails(C.DECOMPOSE_FORMULA)}]
 ELSE [{col}] END, lambda q: q IS NOT NULL)"""


view("intents", f"SELECT *, {deep_sql('text')} AS intent FROM decorated_turns", "decorated_turns")
view("decomposed", f"SELECT *, {decompose_sql('text', 'intent')} AS subs FROM intents", "intents")


def intents(t):
    return t.decorated_turns.withColumn("intent", D.deep_intent(F.col("text")))


@query("off_topic", f"SELECT conv_id, turn, {any_sql('text', C.OFF_TOPIC_PATTERNS)} AS blocked FROM decorated_turns", "decorated_turns")
def _(t):
    return t.decorated_turns.select("conv_id", "turn", D.off_topic(F.col("text")).alias("blocked"))


@query("global_intent", f"SELECT conv_id, turn, {global_sql('text')} AS intent FROM decorated_turns", "decorated_turns")
def _(t):
    return t.decorated_turns.select("conv_id", "turn", D.global_intent(F.col("text")).alias("intent"))


@query("deep_intent", f"SELECT conv_id, turn, intent, {budget_sql('intent')} AS budget FROM intents", "intents")
def _(t):
    return intents(t).select("conv_id", "turn", "intent", D.chunk_budget(F.col("intent")).alias("budget"))


@query("decompose_query", """
SELECT conv_id, turn, unnest(range(len(subs))) AS sub_no, unnest(subs) AS sub_query FROM decomposed""", "decomposed")
def _(t):
    subs = D.decompose_query(F.col("text"), F.col("intent"))
    return intents(t).select("conv_id", "turn", F.posexplode(subs).alias("sub_no", "sub_query")).withColumn(
        "sub_no", F.col("sub_no").cast("bigint"))


@query("route_model", f"""
SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'fast' WHEN intent IN ('math', 'implement', 'formula') THEN 'precise' ELSE 'fast' END AS model,
       CASE intent {' '.join(f"WHEN '{n}' THEN '{v}'" for n, v in C.LENGTH_LIMITS.items())} ELSE '' END AS length_limit FROM intents""", "intents")
def _(t):
    preference = F.when(F.col("role") == "system", "fast").otherwise("auto")
    return intents(t).select("conv_id", "turn", D.route_model(F.col("intent"), preference).alias("model"),
                             D.length_limit(F.col("intent")).alias("length_limit"))


STOP = "(" + ", ".join(f"'{w}'" for w in C.ANSWER_STOP_WORDS) + ")"
AW = (r"list_distinct(list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z]{{5,}}$') AND w NOT IN "
      + STOP + "))")


@query("confidence_note", f"""
SELECT conv_id, turn, CASE WHEN context <> '' AND len(said) > 0 AND len(list_intersect(said, known)) / len(said) < 0.2
       THEN answer || {lit(C.CAVEAT)} ELSE answer END AS answer
FROM (SELECT a.conv_id, a.turn, a.text AS answer, u.text AS context, {AW.format('a.text')} AS said, {AW.format('u.text')} AS known
      FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE a.role = 'assistant')""")
def _(t):
    c = t.conversations
    context = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    pairs = c.where("role = 'assistant'").join(context, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", D.confidence_note(F.col("text"), F.col("context")).alias("answer"))


@query("inline_citations", r"""
SELECT type, value, count(*) AS citations FROM (
  SELECT 'page' AS type, CAST(CAST(unnest(regexp_extract_all(text, '\[\[page:([0-9]+)\]\]', 1)) AS BIGINT) AS VARCHAR) AS value FROM decorated_turns
  UNION ALL SELECT 'section', unnest(regexp_extract_all(text, '\[\[section:([^\]]+)\]\]', 1)) FROM decorated_turns) GROUP BY type, value""",
       "decorated_turns")
def _(t):
    found = t.decorated_turns.select(F.inline(D.inline_citations(F.col("text"))))
    return found.groupBy("type", "value").agg(F.count("*").alias("citations"))


@query("judge_verdict", """
SELECT event_id, CASE WHEN length(raw) < 30 THEN 1 WHEN json_valid(c) THEN coalesce(CAST(trunc(TRY_CAST(json_extract_string(c, '$.hype_score') AS DOUBLE)) AS INTEGER), 3) ELSE 3 END AS score,
       CASE WHEN length(raw) < 30 THEN false WHEN json_valid(c) THEN coalesce(trunc(TRY_CAST(json_extract_string(c, '$.hype_score') AS DOUBLE)) >= 3, true) ELSE true END AS adequate
FROM (SELECT event_id, raw, trim(regexp_replace(raw, '```(?:json)?\\s*|\\s*```', '', 'g'), ' ' || chr(10)) AS c FROM raw_outputs)""", "raw_outputs")
def _(t):
    v = G.judge_verdict(F.replace(F.col("raw"), F.lit("hype_score"), F.lit("score")), F.col("raw"), 30)
    return t.raw_outputs.select("event_id", v["score"].alias("score"), v["adequate"].alias("adequate"))


@query("code_blocks", r"""
SELECT lang, type, count(*) AS blocks, CAST(sum(length(value)) AS BIGINT) AS chars FROM (
  SELECT 'code' AS type, CASE WHEN l = '' THEN 'text' ELSE l END AS lang, regexp_replace(b, '\n\z', '') AS value FROM (
    SELECT unnest(regexp_extract_all(text, '(?s)```([A-Za-z0-9_]*)\n?(.*?)```', 1)) AS l, unnest(regexp_extract_all(text, '(?s)```([A-Za-z0-9_]*)\n?(.*?)```', 2)) AS b FROM decorated_turns)
  UNION ALL SELECT 'text', NULL, v FROM (SELECT unnest(regexp_split_to_array(text, '(?s)```([A-Za-z0-9_]*)\n?(.*?)```')) AS v FROM decorated_turns) WHERE v <> '')
GROUP BY lang, type""", "decorated_turns")
def _(t):
    parts = t.decorated_turns.select(F.inline(D.code_blocks(F.col("text"))))
    return parts.groupBy("lang", "type").agg(F.count("*").alias("blocks"), F.sum(F.length("value")).alias("chars"))
