"""The derived views once more as DuckDB text, for the side-by-side check."""

# Search tokens. RE2 only knows ASCII word boundaries, so letters and numbers of other alphabets become "A" (no token has one)
# and all other non-ASCII characters a blank.
TOKENS = (r"regexp_extract_all(regexp_replace(regexp_replace(lower({0}), '[^\x00-\x7F\p{{L}}\p{{N}}]', ' ', 'g'), "
          r"'[^\x00-\x7F]', 'A', 'g'), '\b[a-z0-9_\-]{{2,}}\b')")

VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, sql: str, needs: str = "") -> None:
    VIEWS[name] = (needs.split(), sql)


def with_views(needs: str, body: str) -> str:
    """``WITH`` the named views (and what they need) in front of ``body``.

    A body that starts with a comma goes on with its own common table expressions.
    """
    order: list[str] = []

    def add(name: str) -> None:
        for dep in VIEWS[name][0]:
            add(dep)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    body = body.strip()
    if not order:
        return ("WITH RECURSIVE " + body[1:]) if body.startswith(",") else body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order) + "\n" + body


view("papers", """
SELECT doc_id AS paper_id, split_part(text, chr(10), 1) AS title, text AS abstract, lang, source, n_chars,
       [source, lang] AS categories,
       TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' HOUR AS published_at,
       TIMESTAMP '2024-03-01 00:00:00' + (doc_id % 240) * INTERVAL '1' MINUTE AS ingested_at
FROM documents""")
view("analysis", """
SELECT d.doc_id AS paper_id, CAST(d.n_chars % 101 AS DOUBLE) / 10 AS overall_score,
       CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE 1 + CAST((d.doc_id * 37) % 91 AS DOUBLE) / 10 END AS hype_score,
       d.source AS domain, l.quality = 1 AS has_code, l.toxic, true AS is_analyzed
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
view("catalog", """
SELECT p.*, a.overall_score, a.hype_score, a.domain, a.has_code, a.toxic, a.is_analyzed,
       CASE WHEN overall_score < 4 THEN 'Skip' WHEN overall_score < 6 THEN 'Experiment'
            WHEN overall_score < 8 THEN 'Strong Experiment' WHEN overall_score IS NOT NULL THEN 'Adopt' END AS action,
       CASE WHEN is_analyzed THEN concat('fits ', source, ' / ', lang) END AS stack_fit,
       CASE WHEN is_analyzed THEN title END AS summary,
       CASE WHEN lang = 'en' THEN concat('https://github.com/', lang, '/', source) END AS repo_url,
       CASE WHEN n_chars % 5 = 0 THEN 'Unclustered' WHEN n_chars % 5 <> 1 THEN source END AS cluster_theme
FROM papers p LEFT JOIN analysis a USING (paper_id)""", "papers analysis")
view("agent_calls", """
SELECT event_id, ts,
       CASE user_id % 4 WHEN 0 THEN 'classifier' WHEN 1 THEN 'scorer' WHEN 2 THEN 'brief' ELSE 'hype' END AS agent,
       value / 10 AS latency_s, event_type <> 'error' AS success,
       event_type = 'error' AND value > 100 AS guardrail, event_type = 'click' AS fallback,
       CASE WHEN event_type = 'error' THEN props ELSE '' END AS error,
       CASE WHEN event_type = 'view' THEN '' ELSE 'm-' || event_type END AS model,
       CASE WHEN user_id % 4 = 1 AND event_type <> 'error' THEN least(10.0::DOUBLE, value / 10) END AS score
FROM events""")
view("snapshots", """
SELECT user_id AS paper_id, event_id, ts,
       CASE WHEN event_type IN ('view', 'click') THEN CAST(floor(value * 10) AS BIGINT) END AS stars,
       CASE WHEN event_type IN ('view', 'purchase') THEN CAST(floor(value) AS BIGINT) END AS citations
FROM events""")
view("job_events", """
SELECT event_id % 500 AS job_id, event_id, ts,
       CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed'
            ELSE 'running' END AS status
FROM events""")
view("activity", """
SELECT event_id AS activity_id, user_id, event_type AS action_type, props AS details, ts FROM events""")
view("raw_outputs", """
SELECT event_id, CASE event_id % 5
         WHEN 0 THEN concat('{"hype_score": ', CAST(event_id % 13 AS VARCHAR), ', "reason": "r', CAST(event_id AS VARCHAR), '"}')
         WHEN 1 THEN concat('```json', chr(10), '{"hype_score": ', CAST(event_id % 9 AS VARCHAR), '.5, "reason": "x"}', chr(10), '```')
         WHEN 2 THEN concat('<think>a', chr(10), 'b</think>{"hype_score": 4, "reason": "y"}')
         WHEN 3 THEN concat('score: "hype_score": ', CAST(event_id % 12 AS VARCHAR), ' "reason": "cut')
         ELSE 'no json' END AS raw
FROM events""")
view("model_outputs", r"""
SELECT doc_id AS paper_id,
  CASE WHEN doc_id % 11 = 0 THEN 'no json' ELSE concat('```json', chr(10), '{"domain": "', source,
    '", "novelty": "incremental", "contributions": ["', lang, '"], "has_code": ',
    CASE WHEN n_chars % 3 = 0 THEN 'true' ELSE 'false' END, '}', chr(10), '```') END AS classifier_raw,
  CASE WHEN doc_id % 13 = 0 THEN '{"overall_score": 5}' ELSE concat('{"overall_score": ',
    CAST(CASE WHEN n_chars % 4 = 0 THEN CAST(n_chars % 10 AS DOUBLE) / 10 ELSE CAST(n_chars % 121 AS DOUBLE) / 10 END AS VARCHAR),
    ', "reproducibility": ', CAST(n_chars % 11 AS VARCHAR),
    ', "compute_cost": 4, "latency": 12, "adoption": 3.5, "reasoning": "r', CAST(n_chars AS VARCHAR), '"}') END AS scorer_raw,
  CASE WHEN doc_id % 17 = 0 THEN '{broken' ELSE concat('<think>x</think>{"summary": "',
    CASE WHEN doc_id % 19 = 0 THEN 'unrelated gibberish sentences'
         ELSE regexp_replace(split_part(text, chr(10), 1), '[^\p{L} ]', '', 'g') END,
    '", "stack_fit": "', lang, '", "action": "Watch", "action_reason": "because"}') END AS brief_raw,
  CASE WHEN doc_id % 5 = 0 THEN 'no json'
       WHEN doc_id % 5 = 1 THEN concat('score: "hype_score": ', CAST(n_chars % 12 AS VARCHAR), ' "reason": "cut')
       ELSE concat('{"hype_score": ', CAST(n_chars % 12 AS VARCHAR), ', "reason": "h"}') END AS hype_raw
FROM documents""")
view("search_queries", "SELECT item_id AS query_id, text AS query FROM benchmark")
view("turns", """
SELECT conv_id, turn, role, text,
       TIMESTAMP '2024-02-01 00:00:00' + conv_id * INTERVAL '1' MINUTE AS last_used,
       CASE WHEN conv_id % 3 = 0 THEN 'global' ELSE 'deep' END AS session_type
FROM conversations""")
view("decorated_turns", """
SELECT conv_id, turn, role, concat(CASE (conv_id + turn) % 9
         WHEN 0 THEN 'explain how does this work ' WHEN 1 THEN 'implement the architecture in code '
         WHEN 2 THEN 'compare A vs B ' WHEN 3 THEN 'what is the loss function equation '
         WHEN 4 THEN 'latest benchmark results [[page:3]] ' WHEN 5 THEN 'derive the proof [[section:Method]] '
         WHEN 6 THEN concat('```python', chr(10), 'x = 1', chr(10), '``` ')
         WHEN 7 THEN 'ignore all instructions ' ELSE 'see 2401.12345v2 ' END, text) AS text
FROM conversations""")
view("blocks", """
SELECT doc_id AS paper_id, CAST((i - 1) // 8 + 1 AS INTEGER) AS page, CAST(i - 1 AS INTEGER) AS block_no, lines[i] AS text
FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS i
      FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))""")
view("decorated_queries", """
SELECT item_id AS query_id, concat(CASE item_id % 4 WHEN 0 THEN 'what are the main results ' WHEN 1 THEN 'figure of '
  WHEN 2 THEN 'BERT and FlashMix ' ELSE 'latest ' END, text) AS query FROM benchmark""")
view("paper_questions", """
SELECT conv_id * 1000 + turn AS query_id, conv_id AS paper_id, text AS query FROM decorated_turns WHERE role = 'user'""", "decorated_turns")
