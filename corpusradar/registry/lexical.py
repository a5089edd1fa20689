"""Keyword search queries."""

from pyspark.sql import functions as F

from corpusradar import constants as C
from corpusradar.functions.text import search_tokens
from corpusradar.operators import lexical as L
from corpusradar.operators.inverted import build_index, search
from corpusradar.registry import query
from corpusradar.registry.sqlviews import TOKENS, view
from corpusradar.session import fresh_folder

WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"


def bm25_views(name: str, corpus: str, id_col: str, queries: str, scope: str, corpus_needs: str, query_needs: str) -> None:
    """Views ``{name}_tf``, ``_df``, ``_stats`` and ``_scores`` of BM25 over ``corpus(id_col, scope, text)``."""
    view(f"{name}_tf", f"""
SELECT {id_col}, {scope} AS scope, dl, term, count(*) AS tf FROM (SELECT {id_col}, {scope}, len(t) AS dl, unnest(t) AS term
  FROM (SELECT {id_col}, {scope}, {TOKENS.format('text')} AS t FROM {corpus})) GROUP BY ALL""", corpus_needs)
    view(f"{name}_df", f"SELECT scope, term, count(*) AS df FROM {name}_tf GROUP BY ALL", f"{name}_tf")
    view(f"{name}_stats", f"SELECT {scope} AS scope, count(*) AS n, avg(len({WORDS.format('text')})) AS avgdl FROM {corpus} GROUP BY ALL", corpus_needs)
    view(f"{name}_scores", f"""
SELECT query_id, {id_col}, round(sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE
   / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
FROM (SELECT query_id, {scope} AS scope, term, count(*) AS qtf FROM (SELECT query_id, {scope}, unnest({TOKENS.format('query')}) AS term FROM {queries}) GROUP BY ALL) q
JOIN {name}_tf USING (scope, term) JOIN {name}_df USING (scope, term) JOIN {name}_stats USING (scope)
GROUP BY query_id, {id_col}""", f"{name}_tf {name}_df {name}_stats {query_needs}")


view("corpus", "SELECT doc_id AS paper_id, text, 0 AS one FROM documents")
view("dq1", "SELECT *, 0 AS one FROM decorated_queries", "decorated_queries")
bm25_views("docs", "corpus", "paper_id", "dq1", "one", "corpus", "dq1")
view("source_corpus", "SELECT doc_id, source, text FROM documents")
view("source_queries", "SELECT query_id || '/' || source AS query_id, query, source FROM decorated_queries, (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)", "decorated_queries")
bm25_views("bysource", "source_corpus", "doc_id", "source_queries", "source", "source_corpus", "source_queries")
view("lex_hits", """
SELECT * FROM (SELECT query_id, paper_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id) AS rank FROM docs_scores)
WHERE rank <= 15 AND score > 0""", "docs_scores")
STOP3 = "(" + ", ".join(f"'{w}'" for w in C.KEYWORD_STOP_WORDS) + ")"
W3 = r"list_filter(list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{3,}}')), lambda w: w NOT IN " + STOP3 + ")"
view("overlap_hits", rf"""
SELECT query_id, paper_id, round(raw, 6) AS score, round(1 - least(raw / 5, 1.0), 6) AS distance, rank, 'bm25' AS source FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 6) DESC, paper_id) AS rank FROM (
    SELECT query_id, paper_id, sum(w) / any_value(size)::DOUBLE AS raw FROM
      (SELECT query_id, len(q) AS size, unnest(q) AS term FROM (SELECT query_id, {W3.format('query')} AS q FROM decorated_queries))
      JOIN (SELECT paper_id, unnest({W3.format('title')}) AS term, 3 AS w FROM papers
            UNION ALL SELECT paper_id, unnest({W3.format("title || '. ' || abstract")}), 1 FROM papers) USING (term)
    GROUP BY query_id, paper_id)) WHERE rank <= 8""", "decorated_queries papers")


def corpus(t):
    return t.documents.select(F.col("doc_id").alias("paper_id"), "text")


@query("tokenize", "SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS distinct_tokens, list_max(t) AS top FROM (SELECT doc_id, "
       + TOKENS.format("text") + " AS t FROM documents)")
def _(t):
    tokens = search_tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(tokens).alias("tokens"), F.size(F.array_distinct(tokens)).alias("distinct_tokens"),
                              F.array_max(tokens).alias("top"))


@query("bm25_index", """
SELECT term, df, tf, n, round(avgdl, 6) AS avgdl FROM docs_df JOIN (SELECT scope, term, CAST(sum(tf) AS BIGINT) AS tf FROM docs_tf GROUP BY ALL)
USING (scope, term) JOIN docs_stats USING (scope)""", "docs_tf docs_df docs_stats")
def _(t):
    post, df, stats = L.bm25_index(corpus(t))
    total = post.groupBy("term").agg(F.sum("tf").alias("tf"))
    return df.join(total, "term").select("term", "df", "tf", stats.select("n").scalar().alias("n"),
                                         F.round(stats.select("avgdl").scalar(), 6).alias("avgdl"))


@query("bm25_score", "SELECT query_id, paper_id, score FROM docs_scores", "docs_scores")
def _(t):
    return L.bm25_score(t.decorated_queries, corpus(t))


@query("bm25_topk", """
SELECT 'all' AS pool, CAST(query_id AS VARCHAR) AS query_id, paper_id, score, rank FROM lex_hits
UNION ALL SELECT * FROM (SELECT 'source', query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM bysource_scores) WHERE rank <= 3 AND score > 0""", "lex_hits bysource_scores")
def _(t):
    sources = t.documents.select("source").where("source IS NOT NULL").distinct()
    pooled = t.decorated_queries.crossJoin(sources).select(  # every question asks every source
        F.concat_ws("/", F.col("query_id").cast("string"), "source").alias("query_id"), "query", "source")
    per_source = L.bm25_topk(pooled, t.documents.select("doc_id", "source", "text"), 3, "doc_id", "source")
    cols = ["query_id", "paper_id", "score", "rank"]
    return L.bm25_topk(t.decorated_queries, corpus(t), 15).withColumn("query_id", F.col("query_id").cast("string")).select(
        F.lit("all").alias("pool"), *cols).unionByName(
        per_source.withColumnRenamed("doc_id", "paper_id").select(F.lit("source").alias("pool"), *cols))


@query("bm25_topk_indexed", """
SELECT 'first' AS search, query_id, paper_id, score, rank FROM lex_hits
UNION ALL SELECT 'second', query_id, paper_id, score, rank FROM lex_hits WHERE rank <= 3 AND query_id % 2 = 0""", "lex_hits")
def _(t):
    """One stored index, two searches."""
    index = build_index(corpus(t), fresh_folder(t.spark, "inverted"))
    first, second = search(index, t.decorated_queries, 15), search(index, t.decorated_queries.where("query_id % 2 = 0"), 3)
    return first.select(F.lit("first").alias("search"), "*").unionByName(second.select(F.lit("second").alias("search"), "*"))


@query("keyword_overlap_topk", "SELECT * FROM overlap_hits", "overlap_hits")
def _(t):
    return L.keyword_overlap_topk(t.decorated_queries, t.papers, 8)


def expand_sql(col: str) -> str:
    parts = ", ".join(f"CASE WHEN contains(lower({col}), '{k}') THEN '{v}' END" for k, v in C.EXPANSIONS.items())
    return f"concat_ws(' ', {col}, {parts})"


@query("expand_query", f"SELECT conv_id, turn, {expand_sql('text')} AS expanded FROM decorated_turns", "decorated_turns")
def _(t):
    return t.decorated_turns.select("conv_id", "turn", L.expand_query(F.col("text")).alias("expanded"))


ENTITIES = (r"list_sort(list_distinct(list_filter(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+'), "
            r"lambda w: regexp_matches(w, '^(?:[A-Z][a-z]+(?:[A-Z][a-z]+)+|[A-Z]{{2,}})$'))))")


@query("named_entities", f"SELECT doc_id, array_to_string({ENTITIES.format('text')}, ',') AS entities FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(L.named_entities(F.col("text")), ",").alias("entities"))
