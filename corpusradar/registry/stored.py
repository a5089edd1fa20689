"""Updates of stored tables in place. What is read back must be what the joins of ``ingest``, ``chunking`` and ``sessions`` give."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from corpusradar.registry import _SQL, query
from corpusradar.registry.chunking import stored_chunks
from corpusradar.registry.sessions import headers
from corpusradar.registry.vectors import pending
from corpusradar.session import cut_lineage, fresh_folder
from corpusradar.sources import bucketed as B
from corpusradar.sources.views import ntz


def table(rows: DataFrame, key: str, **more: str) -> B.BucketedTable:
    """The rows as a stored table; ``more`` names columns that are to come with their types."""
    extra = StructType.fromDDL(", ".join(f"{n} {k}" for n, k in more.items())).fields if more else []
    schema = StructType([StructField(f.name, f.dataType) for f in rows.schema] + extra)
    return B.BucketedTable(rows.sparkSession, fresh_folder(rows.sparkSession, "stored"), key, schema, 16).create(rows)


def same_rows(name: str) -> tuple[str, str]:
    views, sql = _SQL[name]
    return sql, views


@query("upsert_analysis_stored", *same_rows("upsert_analysis"))
def _(t):
    papers = t.papers.select("paper_id", "title", F.concat(F.lit("old "), "source").alias("domain"), F.lit(False).alias("is_analyzed"))
    papers = table(papers, "paper_id", overall_score="double", hype_score="double", latency_score="double")
    results = t.analysis.select("paper_id", "domain", "overall_score", "hype_score", F.col("hype_score").alias("latency"))
    unknown = results.withColumn("paper_id", F.col("paper_id") + 1_000_000_000)
    for _ in range(2):  # the second call finds the receipt and changes nothing
        B.save_analysis(papers, results.unionByName(unknown), "analysis")
    return papers.read().select("paper_id", "title", "domain", "overall_score", "hype_score", "latency_score", "is_analyzed")


@query("refresh_vector_metadata_stored", *same_rows("refresh_vector_metadata"))
def _(t):
    vectors = table(t.embeddings.select(F.col("vec_id").alias("paper_id"), "embedding"), "paper_id", title="string", categories="string",
                    summary="string", score_reasoning="string", stack_fit="string", overall_score="double", action="string", repo_url="string")
    B.save_metadata(vectors, t.catalog.withColumn("score_reasoning", F.col("abstract")), "metadata")
    return vectors.read().select("paper_id", F.size("embedding").alias("dims"), "title", "categories", "summary", "score_reasoning",
                                 "stack_fit", "overall_score", "action", "repo_url")


@query("embed_pending_stored", """
SELECT paper_id, true AS is_embedded, (SELECT count(*) FROM catalog WHERE is_analyzed IS NULL) AS embedded_now,
       CASE WHEN is_analyzed IS NULL THEN array_to_string(list_transform(embedding, lambda x: CAST(round(x * 10000) AS BIGINT)), ',') END AS vector
FROM doc_vectors JOIN catalog USING (paper_id)""", "doc_vectors catalog")
def _(t):
    papers = table(pending(t).select("paper_id", "title", "abstract", "is_embedded"), "paper_id")
    fields = StructType([papers.schema["paper_id"], *StructType.fromDDL("embedding array<double>").fields])
    vectors = B.BucketedTable(t.spark, fresh_folder(t.spark, "stored"), "paper_id", fields, 16)
    n = B.embed_stored(papers, vectors, "embedding")
    text = F.array_join(F.transform("embedding", lambda x: F.round(x * 10000).cast("bigint")), ",")
    return papers.read().join(vectors.read(), "paper_id", "left").select(
        "paper_id", "is_embedded", F.lit(n).cast("bigint").alias("embedded_now"), text.alias("vector"))


@query("replace_partition_stored", *same_rows("replace_partition"))
def _(t):
    old = cut_lineage(stored_chunks(t).select("chunk_id", "paper_id", "raw_text", F.lit("old").alias("batch")))
    redone = old.join(t.labels.select(F.col("doc_id").alias("paper_id")), "paper_id", "left_semi").select(
        "chunk_id", "paper_id", F.reverse("raw_text").alias("raw_text"), F.lit("new").alias("batch"))
    chunks = table(old, "paper_id")
    B.save_chunks(chunks, redone, "again")
    return chunks.read()


@query("append_turn_stored", *same_rows("append_turn"))
def _(t):
    incoming = t.turns.groupBy("conv_id").agg(
        F.count_if(F.col("role") != "system").alias("history_count"), F.max_by("text", "turn").alias("message"))
    sessions = table(headers(t).where("session_type = 'deep'").select("conv_id", "title", "message_count", "last_used"), "conv_id")
    B.save_turns(sessions, incoming, ntz("2024-03-01 00:00:00"), "turns")
    old = headers(t).where("session_type = 'deep'").select("conv_id", F.lit("updated").alias("_known"))
    return sessions.read().join(old, "conv_id", "left").select(
        "conv_id", "title", "message_count", F.unix_timestamp("last_used").alias("last_used"), F.coalesce("_known", F.lit("inserted")).alias("status"))
