"""Ingest and table update queries."""

import json

from pyspark.sql import functions as F

from corpusradar.registry import query
from corpusradar.registry.sqlviews import view
from corpusradar.sources import ingest as I
from corpusradar.sources import store as S
from corpusradar.sources.views import ntz

LINK = r"(?i)https?://[a-z.]*example\.[a-z]+/[A-Za-z0-9_.\-]+/[A-Za-z0-9_.\-]+"
view("raw_feed", """
SELECT 'http://feed.example.org/abs/2401.' || lpad(CAST(doc_id AS VARCHAR), 5, '0') || 'v' || (doc_id % 3 + 1) AS entry_id,
       ' ' || split_part(text, chr(10), 1) || chr(10) AS title, text || chr(10) AS summary, url AS comment, source, lang, doc_id
FROM documents LEFT JOIN pages ON doc_id = page_id""")
view("batch", "SELECT doc_id, md5(text) AS paper_id, text FROM documents")
view("stored", "SELECT DISTINCT md5(text) AS paper_id FROM documents JOIN labels USING (doc_id)")


def raw_feed(t):
    d = t.documents.join(t.pages.select(F.col("page_id").alias("doc_id"), "url"), "doc_id", "left")
    return d.select(
        F.concat(F.lit("http://feed.example.org/abs/2401."), F.lpad(F.col("doc_id").cast("string"), 5, "0"), F.lit("v"),
                 (F.col("doc_id") % 3 + 1).cast("string")).alias("entry_id"),
        F.concat(F.lit(" "), F.split_part(F.col("text"), F.lit("\n"), F.lit(1)), F.lit("\n")).alias("title"),
        F.concat("text", F.lit("\n")).alias("summary"), F.col("url").alias("comment"), F.array("source").alias("authors"),
        F.array("source", "lang").alias("categories"), ntz("2024-01-01 00:00:00").alias("published"),
        ntz("2024-01-02 00:00:00").alias("updated"), F.lit(None).cast("string").alias("pdf_url"))


def batch(t):
    return t.documents.select("doc_id", F.md5("text").alias("paper_id"), "text")


def stored(t):
    return batch(t).join(t.labels.select("doc_id"), "doc_id").select("paper_id").distinct()


TRIM = "' ' || chr(10) || chr(9) || chr(13)"


@query("normalize_papers", rf"""
SELECT split_part(string_split(entry_id, '/')[-1], 'v', 1) AS paper_id,
       replace(regexp_replace(title, '^\s+|\s+$', '', 'g'), chr(10), ' ') AS title,
       replace(regexp_replace(summary, '^\s+|\s+$', '', 'g'), chr(10), ' ') AS abstract, source AS authors,
       source || ',' || lang AS categories, entry_id AS paper_url,
       coalesce(nullif(regexp_replace(regexp_extract(summary, '{LINK}'), '[.,)]+$', ''), ''),
                nullif(regexp_replace(regexp_extract(comment, '{LINK}'), '[.,)]+$', ''), '')) AS repo_url
FROM raw_feed""", "raw_feed")
def _(t):
    p = I.normalize_papers(raw_feed(t), LINK)
    return p.select("paper_id", "title", "abstract", F.array_join("authors", ",").alias("authors"),
                    F.array_join("categories", ",").alias("categories"), "paper_url", "repo_url")


@query("extract_repo_link", rf"""
SELECT page_id, nullif(regexp_replace(regexp_extract(url, '{LINK}'), '[.,)]+$', ''), '') AS link,
       nullif(regexp_replace(regexp_extract('see ' || url || ').', '{LINK}'), '[.,)]+$', ''), '') AS quoted FROM pages""")
def _(t):
    return t.pages.select("page_id", I.extract_repo_link(F.col("url"), LINK).alias("link"),
                          I.extract_repo_link(F.concat(F.lit("see "), "url", F.lit(").")), LINK).alias("quoted"))


@query("parse_repo", """
SELECT page_id, CASE WHEN len(p) >= 2 THEN p[1] END AS owner, CASE WHEN len(p) >= 2 THEN p[2] END AS repo
FROM (SELECT page_id, string_split(string_split(regexp_replace(url, '/+$', ''), 'example.com/')[-1], '/') AS p FROM pages)""")
def _(t):
    return t.pages.select("page_id", I.parse_repo(F.col("url"), "example.com").alias("r")).select("page_id", "r.owner", "r.repo")


@query("extract_paper_id", """
SELECT conv_id, turn, nullif(regexp_extract(text, '[0-9]{4}\\.[0-9]{4,5}'), '') AS found FROM decorated_turns""", "decorated_turns")
def _(t):
    return t.decorated_turns.select("conv_id", "turn", I.extract_paper_id(F.col("text")).alias("found"))


@query("select_feed", """
SELECT paper_id, title FROM papers WHERE source IN ('src1', 'src4') OR lang = 'de' ORDER BY published_at DESC, paper_id LIMIT 100""",
       "papers")
def _(t):
    return I.select_feed(t.papers, ["src1", "src4", "de"], 100).select("paper_id", "title")


@query("ingest_new_only", """
SELECT min(doc_id) AS doc_id, paper_id FROM batch WHERE paper_id NOT IN (SELECT paper_id FROM stored) GROUP BY paper_id""", "batch stored")
def _(t):
    return I.ingest_new_only(batch(t), stored(t), "doc_id").select("doc_id", "paper_id")


@query("ingest_audit", """
SELECT count(*) AS papers_found, count(DISTINCT b.paper_id) FILTER (s.paper_id IS NULL) AS papers_new,
       count(DISTINCT b.paper_id) FILTER (s.paper_id IS NOT NULL) AS papers_known, 'done' AS status, 'src0,src1' AS categories
FROM batch b LEFT JOIN stored s USING (paper_id)""", "batch stored")
def _(t):
    return I.ingest_audit(batch(t), stored(t), ["src0", "src1"]).withColumn("categories", F.array_join("categories", ","))


@query("seed_if_absent", """
SELECT p.paper_id, title, '' AS authors, source || ',' || lang AS categories,
       CAST(epoch(CASE WHEN lang = 'en' THEN published_at ELSE TIMESTAMP '2024-06-01 00:00:00' END) AS BIGINT) AS published,
       'https://arxiv.org/abs/' || p.paper_id AS paper_url, CASE WHEN l.doc_id IS NULL THEN 'added' ELSE 'exists' END AS status
FROM papers p LEFT JOIN labels l ON p.paper_id = l.doc_id""", "papers")
def _(t):
    rows = t.papers.withColumn("published_at", F.when(F.col("lang") == "en", F.col("published_at")))
    out = I.seed_if_absent(rows, t.labels.select(F.col("doc_id").alias("paper_id")), ntz("2024-06-01 00:00:00"))
    return out.select("paper_id", "title", F.array_join("authors", ",").alias("authors"),
                      F.array_join("categories", ",").alias("categories"), F.unix_timestamp("published_at").alias("published"),
                      "paper_url", "status")


@query("upsert_analysis", """
SELECT p.paper_id, title, coalesce(a.domain, 'old ' || source) AS domain, a.overall_score, a.hype_score, a.hype_score AS latency_score,
       coalesce(a.is_analyzed, false) AS is_analyzed FROM papers p LEFT JOIN analysis a USING (paper_id)""", "papers analysis")
def _(t):
    papers = t.papers.withColumn("domain", F.concat(F.lit("old "), "source"))
    results = t.analysis.select("paper_id", "domain", "overall_score", "hype_score", F.col("hype_score").alias("latency"))
    unknown = results.select((F.col("paper_id") + 1_000_000_000).alias("paper_id"), "domain", "overall_score", "hype_score", "latency")
    return S.upsert_analysis(papers, results.unionByName(unknown)).select(
        "paper_id", "title", "domain", "overall_score", "hype_score", "latency_score", "is_analyzed")


@query("refresh_vector_metadata", """
SELECT vec_id AS paper_id, len(embedding) AS dims, left(title, 500) AS title, source || ', ' || lang AS categories,
       left(coalesce(summary, ''), 500) AS summary, left(coalesce(abstract, ''), 300) AS score_reasoning, coalesce(stack_fit, '') AS stack_fit,
       coalesce(overall_score, 0) AS overall_score, coalesce(action, '') AS action, coalesce(repo_url, '') AS repo_url
FROM embeddings LEFT JOIN catalog ON vec_id = paper_id""", "catalog")
def _(t):
    vectors = t.embeddings.select(F.col("vec_id").alias("paper_id"), "embedding")
    papers = t.catalog.withColumn("score_reasoning", F.col("abstract"))
    return S.refresh_vector_metadata(vectors, papers).select(
        "paper_id", F.size("embedding").alias("dims"), "title", "categories", "summary", "score_reasoning", "stack_fit",
        "overall_score", "action", "repo_url")


BLOCK_TAGS = "h[1-6]|p|li|tr"
view("page_blocks", r"""
SELECT page_id AS doc_id, CAST((i - 1) // 8 + 1 AS INTEGER) AS page, CAST(i - 1 AS INTEGER) AS block_no,
       CASE WHEN b.tag LIKE 'h%' THEN 'heading' WHEN b.tag = 'tr' THEN 'table' ELSE 'text' END AS kind, b.text AS text
FROM (SELECT page_id, unnest(kept) AS b, unnest(range(1, len(kept) + 1)) AS i FROM (
  SELECT page_id, list_filter(list_transform(string_split(h, chr(1)), lambda p: {'tag': lower(split_part(p, chr(2), 1)),
      'text': trim(regexp_replace(split_part(p, chr(2), 2), '\s+', ' ', 'g'))}),
      lambda b: regexp_matches(b.tag, '^(h[1-6]|p|li|tr)$') AND b.text <> '') AS kept
  FROM (SELECT page_id, replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g'),
      '(?i)</t[dh]>', ' | ', 'g'), '(?i)<(h[1-6]|p|li|tr)(\s[^>]*)?>', chr(1) || '\1' || chr(2), 'g'),
      '(?i)</?(h[1-6]|p|li|tr|ul|ol|table|article|nav|div|body|html|footer|header|section)(\s[^>]*)?>', chr(1) || 'x' || chr(2), 'g'),
      '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS h
    FROM pages)))""")


@query("html_blocks", "SELECT * FROM page_blocks", "page_blocks")
def _(t):
    return I.html_blocks(t.pages)


@query("table_chunk_text", r"""
SELECT paper_id, CASE WHEN length(txt) >= 30 THEN txt END AS table_text
FROM (SELECT paper_id, header || chr(10) || repeat('-', greatest(30, length(header))) ||
        CASE WHEN len(lines) > 1 THEN chr(10) || array_to_string(lines[2:], chr(10)) ELSE '' END AS txt
  FROM (SELECT paper_id, lines, lines[1] AS header FROM (
    SELECT paper_id, list_transform(list_filter(string_split(abstract, chr(10)), lambda l: contains(l, '|')),
        lambda l: array_to_string(list_transform(string_split(l, '|'), lambda c: regexp_replace(c, '^\s+|\s+$', '', 'g')), ' | ')) AS lines
    FROM papers) WHERE len(lines) > 0))""", "papers")
def _(t):
    rows = F.transform(F.filter(F.split("abstract", "\n"), lambda line: F.contains(line, F.lit("|"))), lambda line: F.split(line, r"\|"))
    return t.papers.select("paper_id", rows.alias("rows")).where(F.size("rows") > 0).select(
        "paper_id", I.table_chunk_text(F.col("rows")).alias("table_text"))


def make_counter():
    """A stand-in model: answers with the text length, but fails some rows on each attempt."""

    def model(texts, attempt):
        n = texts.str.len()
        return (n.map(lambda v: json.dumps({"n": int(v)}))).where((n % 3 != 0) if attempt == 1 else (n % 5 != 0), "no json")

    return model


@query("bulk_infer", """
SELECT doc_id, CASE WHEN n % 3 <> 0 OR n % 5 <> 0 THEN '{"n": ' || n || '}' END AS output, CASE WHEN n % 3 <> 0 THEN 1 ELSE 2 END AS attempts,
       CASE WHEN n % 3 = 0 AND n % 5 = 0 THEN 'invalid output' END AS error
FROM (SELECT doc_id, length(text) AS n FROM documents)""")
def _(t):
    return I.bulk_infer(t.documents, "doc_id", "text", make_counter, lambda s: s.str.startswith("{"), 2)


@query("pending_work", """
SELECT paper_id, title FROM (SELECT * FROM catalog ORDER BY ingested_at DESC, paper_id LIMIT 100)
WHERE is_analyzed IS NULL AND repo_url IS NOT NULL ORDER BY ingested_at DESC, paper_id LIMIT 20""", "catalog")
def _(t):
    return I.pending_work(t.catalog, 20, True).select("paper_id", "title")
