"""Similarity search queries. Questions to the ``embeddings`` table are the mean vectors of its labels."""

from pyspark.sql import functions as F

from corpusradar.operators import vectors as V
from corpusradar.operators.ivf import MOST_LISTS, build_lists, search_lists
from corpusradar.registry import query
from corpusradar.registry.sqlviews import TOKENS, view
from corpusradar.session import cut_lineage, fresh_folder


def label_queries(t):
    """One query vector per label: the mean of its members."""
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("d", "x"))
    means = parts.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return cut_lineage(means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("p")).select(
        F.col("label").alias("query_id"), F.transform("p", lambda s: s["x"]).alias("embedding")))


def pending(t):
    return t.catalog.withColumn("is_embedded", F.col("is_analyzed"))


def hashed_sql(source: str, id_col: str, text: str, dims: int = 128) -> str:
    """DuckDB text of the hashing encoder: ``(id_col, embedding)``."""
    return f"""
SELECT {id_col}, list(coalesce(n, 0) / CASE WHEN norm > 0 THEN norm ELSE 1 END ORDER BY d) AS embedding
FROM (SELECT g.{id_col}, g.d, c.n, sqrt(sum(coalesce(c.n, 0) * coalesce(c.n, 0)) OVER (PARTITION BY g.{id_col})) AS norm
      FROM (SELECT {id_col}, unnest(range({dims})) AS d FROM (SELECT DISTINCT {id_col} FROM {source})) g
      LEFT JOIN (SELECT {id_col}, CAST(('0x' || left(md5(tok), 4)) AS INTEGER) % {dims} AS d, count(*) AS n
                 FROM (SELECT {id_col}, unnest({TOKENS.format(text)}) AS tok FROM {source})
                 GROUP BY 1, 2) c ON g.{id_col} = c.{id_col} AND g.d = c.d)
GROUP BY {id_col}"""


view("label_queries", """
SELECT label AS query_id, list(x ORDER BY d) AS embedding
FROM (SELECT label, d, avg(x) AS x FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS d,
      CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, d) GROUP BY label""")
view("label_distances", """
SELECT query_id, vec_id, label, round(1 - list_cosine_similarity(q.embedding, CAST(e.embedding AS DOUBLE[])), 6) AS distance
FROM label_queries q, embeddings e""", "label_queries")
view("label_ranked", """
SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank
FROM label_distances""", "label_distances")
view("doc_vectors", hashed_sql("(SELECT paper_id, concat(title, '. ', title, '. ', abstract) AS text FROM papers)", "paper_id", "text"), "papers")
view("query_vectors", hashed_sql("search_queries", "query_id", "query"), "search_queries")


def doc_vectors(t):
    """Vectors of all documents, written once as the vector table they would be."""
    return cut_lineage(V.embed_pending(t.papers.withColumn("is_embedded", F.lit(False))))


def query_vectors(t):
    return V.hashing_encoder(t.search_queries, "query_id", "query")


@query("embed_pending", """
SELECT paper_id, array_to_string(list_transform(embedding, lambda x: CAST(round(x * 10000) AS BIGINT)), ',') AS vector
FROM doc_vectors JOIN catalog USING (paper_id) WHERE is_analyzed IS NULL""", "doc_vectors catalog")
def _(t):
    v = V.embed_pending(pending(t))
    return v.select("paper_id", F.array_join(F.transform("embedding", lambda x: F.round(x * 10000).cast("bigint")), ",").alias("vector"))


@query("cosine_topk", """
SELECT query_id, vec_id, round(1 - distance, 4) AS score, rank FROM label_ranked WHERE rank <= 10""", "label_ranked")
def _(t):
    return V.cosine_topk(label_queries(t), t.embeddings, 10, "vec_id")


@query("dense_retrieve", """
SELECT query_id, vec_id AS paper_id, distance, rank, coalesce(title, 'Unknown') AS title, coalesce(summary, '') AS summary,
       coalesce(overall_score, 0) AS overall_score, coalesce(action, '') AS action,
       'https://arxiv.org/abs/' || vec_id AS paper_url, 'dense' AS source
FROM label_ranked LEFT JOIN catalog ON vec_id = paper_id WHERE rank <= 8 AND distance <= 0.6""", "label_ranked catalog")
def _(t):
    vectors = t.embeddings.select(F.col("vec_id").alias("paper_id"), "embedding")
    return V.dense_retrieve(label_queries(t), vectors, t.catalog, 8, 0.6).select(
        "query_id", "paper_id", "distance", "rank", "title", "summary", "overall_score", "action", "paper_url", "source")


@query("l2_topk", """
SELECT query_id, vec_id, distance, rank FROM (
  SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank
  FROM (SELECT query_id, vec_id, round(list_sum(list_transform(range(1, len(q.embedding) + 1),
          lambda i: (q.embedding[i] - CAST(e.embedding AS DOUBLE[])[i]) ** 2)), 6) AS distance
        FROM label_queries q JOIN embeddings e ON e.label = q.query_id)) WHERE rank <= 12""", "label_queries")
def _(t):
    queries = label_queries(t).withColumn("paper_id", F.col("query_id"))
    chunks = t.embeddings.select(F.col("label").alias("paper_id"), "vec_id", "embedding")
    return V.l2_topk(queries, chunks, 12, "vec_id")


@query("knn_approx")
def _(t):
    q = label_queries(t)
    approx = V.knn_approx(q, t.embeddings, 10, n_probe=16, id_col="vec_id")
    recall = V.recall_against(approx, V.cosine_topk(q, t.embeddings, 10, "vec_id"), "vec_id")
    return approx.select("*", recall.scalar().alias("recall"))


@query("knn_approx_all_lists", """
SELECT query_id, vec_id, distance, rank FROM label_ranked WHERE rank <= 10""", "label_ranked")
def _(t):
    """With every list probed only the codes choose, and what they choose is scored exactly."""
    index = build_lists(t.embeddings.select("vec_id", "embedding"), fresh_folder(t.spark, "lists"), "vec_id")
    return search_lists(index, label_queries(t), 10, MOST_LISTS)


@query("similarity_pairs", """
, distinct_vectors AS (SELECT CAST(embedding AS DOUBLE[]) AS embedding, min(vec_id) AS rep FROM embeddings GROUP BY 1)
SELECT a.rep AS id_a, b.rep AS id_b, round(1 - list_cosine_similarity(a.embedding, b.embedding), 6) AS distance
FROM distinct_vectors a JOIN distinct_vectors b ON a.rep < b.rep
WHERE round(1 - list_cosine_similarity(a.embedding, b.embedding), 6) <= 0.7
UNION ALL SELECT d.rep, e.vec_id, 0.0 FROM embeddings e JOIN distinct_vectors d ON CAST(e.embedding AS DOUBLE[]) = d.embedding AND e.vec_id <> d.rep""")
def _(t):
    return V.similarity_pairs(t.embeddings, 0.7)


@query("embedding_pairs_of_copies", """
, distinct_vectors AS (SELECT embedding, min(paper_id) AS rep FROM doc_rounded GROUP BY 1)
SELECT a.rep AS id_a, b.rep AS id_b, round(1 - list_cosine_similarity(a.embedding, b.embedding), 6) AS distance
FROM distinct_vectors a JOIN distinct_vectors b ON a.rep < b.rep
WHERE round(1 - list_cosine_similarity(a.embedding, b.embedding), 6) <= 0.03
UNION ALL SELECT d.rep, e.paper_id, 0.0 FROM doc_rounded e JOIN distinct_vectors d ON e.embedding = d.embedding AND e.paper_id <> d.rep""",
       "doc_rounded")
def _(t):
    return V.similarity_pairs(rounded_doc_vectors(t), 0.03, "paper_id")


@query("similarity_pairs_projected", """
, named AS (SELECT 'p-' || paper_id AS paper_id, embedding FROM doc_rounded),
distinct_vectors AS (SELECT embedding, min(paper_id) AS rep FROM named GROUP BY 1)
SELECT a.rep AS id_a, b.rep AS id_b, round(1 - list_cosine_similarity(a.embedding, b.embedding), 6) AS distance
FROM distinct_vectors a JOIN distinct_vectors b ON a.rep < b.rep
WHERE round(1 - list_cosine_similarity(a.embedding, b.embedding), 6) <= 0.03
UNION ALL SELECT d.rep, e.paper_id, 0.0 FROM named e JOIN distinct_vectors d ON e.embedding = d.embedding AND e.paper_id <> d.rep""",
       "doc_rounded")
def _(t):
    """Hash tables of random projections over string ids."""
    return V.similarity_pairs(named_doc_vectors(t), 0.03, "paper_id", method="projections")


def named_doc_vectors(t):
    """Ids are strings, as those of real papers."""
    return rounded_doc_vectors(t).withColumn("paper_id", F.concat(F.lit("p-"), "paper_id"))


view("doc_rounded", """
SELECT paper_id, list_transform(embedding, lambda x: round(x, 9)) AS embedding FROM doc_vectors""", "doc_vectors")


def rounded_doc_vectors(t):
    """Vectors to 9 places, so that copies of a text compare equal whatever the order of summation."""
    return doc_vectors(t).select("paper_id", F.transform("embedding", lambda x: F.round(x, 9)).alias("embedding"))
