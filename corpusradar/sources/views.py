"""Input tables and the views that give them the shapes the operators expect."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ntz(text: str):
    return F.to_timestamp_ntz(F.lit(text))


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out when a table of long texts arrives in fewer splits than there are cores (one small file)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 > cores else df.repartition(cores)


def with_lines(documents: DataFrame, lines_per_page: int = 8) -> DataFrame:
    """One row per text line of a document: ``paper_id, page, block_no, text``."""
    return (
        documents.select(F.col("doc_id").alias("paper_id"), F.posexplode_outer(F.split("text", "\n")).alias("block_no", "text"))
        .where("text IS NOT NULL")
        .select("paper_id", (F.floor(F.col("block_no") / lines_per_page) + 1).cast("int").alias("page"), "block_no", "text")
    )


class Tables:
    """The given Parquet tables of one folder and their derived views."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(table) if name in ("documents", "pages") else table

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    @cached_property
    def papers(self) -> DataFrame:
        return self.documents.select(
            F.col("doc_id").alias("paper_id"),
            F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"),
            F.col("text").alias("abstract"),
            "lang", "source", "n_chars",
            F.array("source", "lang").alias("categories"),
            (ntz("2024-01-01 00:00:00") + F.make_dt_interval(F.lit(0), F.col("doc_id").cast("int"))).alias("published_at"),
            (ntz("2024-03-01 00:00:00")
             + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("doc_id") % 240).cast("int"))).alias("ingested_at"),
        )

    @cached_property
    def analysis(self) -> DataFrame:
        return self.documents.join(self.labels, "doc_id").select(
            F.col("doc_id").alias("paper_id"),
            ((F.col("n_chars") % 101).cast("double") / 10).alias("overall_score"),
            F.when(F.col("doc_id") % 7 != 0, 1 + (F.col("doc_id") * 37 % 91).cast("double") / 10).alias("hype_score"),
            F.col("source").alias("domain"),
            (F.col("quality") == 1).alias("has_code"),
            "toxic",
            F.lit(True).alias("is_analyzed"),
        )

    @cached_property
    def catalog(self) -> DataFrame:
        """Papers with their analysis columns; unanalysed papers keep NULLs."""
        from corpusradar.functions.scoring import action_label

        joined = self.papers.join(self.analysis, "paper_id", "left")
        return joined.select(
            "*",
            action_label(F.col("overall_score")).alias("action"),
            F.when(F.col("is_analyzed"), F.concat(F.lit("fits "), "source", F.lit(" / "), "lang")).alias("stack_fit"),
            F.when(F.col("is_analyzed"), F.col("title")).alias("summary"),
            F.when(F.col("lang") == "en", F.concat(F.lit("https://github.com/"), "lang", F.lit("/"), "source")).alias("repo_url"),
            F.when(F.col("n_chars") % 5 == 0, F.lit("Unclustered")).when(F.col("n_chars") % 5 != 1, F.col("source"))
            .alias("cluster_theme"),
        )

    @cached_property
    def agent_calls(self) -> DataFrame:
        error = F.col("event_type") == "error"
        scored = (F.col("user_id") % 4 == 1) & ~error
        return self.events.select(
            "event_id", "ts",
            F.when(F.col("user_id") % 4 == 0, "classifier").when(F.col("user_id") % 4 == 1, "scorer")
            .when(F.col("user_id") % 4 == 2, "brief").otherwise("hype").alias("agent"),
            (F.col("value") / 10).alias("latency_s"),
            (~error).alias("success"),
            (error & (F.col("value") > 100)).alias("guardrail"),
            (F.col("event_type") == "click").alias("fallback"),
            F.when(error, F.col("props")).otherwise("").alias("error"),
            F.when(F.col("event_type") == "view", "").otherwise(F.concat(F.lit("m-"), "event_type")).alias("model"),
            F.when(scored, F.least(F.lit(10.0), F.col("value") / 10)).alias("score"),
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        kind = F.col("event_type")
        return self.events.select(
            F.col("user_id").alias("paper_id"), "event_id", "ts",
            F.when(kind.isin("view", "click"), F.floor(F.col("value") * 10).cast("bigint")).alias("stars"),
            F.when(kind.isin("view", "purchase"), F.floor("value").cast("bigint")).alias("citations"),
        )

    @cached_property
    def job_events(self) -> DataFrame:
        kind = F.col("event_type")
        return self.events.select(
            (F.col("event_id") % 500).alias("job_id"), "event_id", "ts",
            F.when(kind == "signup", "pending").when(kind == "purchase", "done").when(kind == "error", "failed")
            .otherwise("running").alias("status"),
        )

    @cached_property
    def activity(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("activity_id"), "user_id", F.col("event_type").alias("action_type"),
            F.col("props").alias("details"), "ts")

    @cached_property
    def raw_outputs(self) -> DataFrame:
        n, e = F.col("event_id") % 5, F.col("event_id")
        raw = (
            F.when(n == 0, F.concat(F.lit('{"hype_score": '), (e % 13).cast("string"), F.lit(', "reason": "r'),
                                    e.cast("string"), F.lit('"}')))
            .when(n == 1, F.concat(F.lit('```json\n{"hype_score": '), (e % 9).cast("string"),
                                   F.lit('.5, "reason": "x"}\n```')))
            .when(n == 2, F.lit('<think>a\nb</think>{"hype_score": 4, "reason": "y"}'))
            .when(n == 3, F.concat(F.lit('score: "hype_score": '), (e % 12).cast("string"), F.lit(' "reason": "cut')))
            .otherwise("no json")
        )
        return self.events.select("event_id", raw.alias("raw"))

    @cached_property
    def model_outputs(self) -> DataFrame:
        """Answers of the four stages for every paper, in good and broken shapes."""
        n, d = F.col("n_chars"), F.col("doc_id")
        clean_title = F.regexp_replace(F.split_part(F.col("text"), F.lit("\n"), F.lit(1)), r"[^\p{L} ]", "")
        classifier = F.when(d % 11 == 0, F.lit("no json")).otherwise(F.concat(
            F.lit('```json\n{"domain": "'), "source", F.lit('", "novelty": "incremental", "contributions": ["'), "lang",
            F.lit('"], "has_code": '), F.when(n % 3 == 0, "true").otherwise("false"), F.lit("}\n```")))
        value = F.when(n % 4 == 0, (n % 10).cast("double") / 10).otherwise((n % 121).cast("double") / 10)
        scorer = F.when(d % 13 == 0, F.lit('{"overall_score": 5}')).otherwise(F.concat(
            F.lit('{"overall_score": '), value.cast("string"), F.lit(', "reproducibility": '), (n % 11).cast("string"),
            F.lit(', "compute_cost": 4, "latency": 12, "adoption": 3.5, "reasoning": "r'), n.cast("string"), F.lit('"}')))
        brief = F.when(d % 17 == 0, F.lit("{broken")).otherwise(F.concat(
            F.lit('<think>x</think>{"summary": "'), F.when(d % 19 == 0, F.lit("unrelated gibberish sentences"))
            .otherwise(clean_title), F.lit('", "stack_fit": "'), "lang",
            F.lit('", "action": "Watch", "action_reason": "because"}')))
        hype = (
            F.when(d % 5 == 0, F.lit("no json"))
            .when(d % 5 == 1, F.concat(F.lit('score: "hype_score": '), (n % 12).cast("string"), F.lit(' "reason": "cut')))
            .otherwise(F.concat(F.lit('{"hype_score": '), (n % 12).cast("string"), F.lit(', "reason": "h"}')))
        )
        return self.documents.select(
            F.col("doc_id").alias("paper_id"), classifier.alias("classifier_raw"), scorer.alias("scorer_raw"),
            brief.alias("brief_raw"), hype.alias("hype_raw"))

    @cached_property
    def search_queries(self) -> DataFrame:
        return self.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))

    @cached_property
    def decorated_queries(self) -> DataFrame:
        """Search queries with a phrase that triggers one of the boosts."""
        n = F.col("item_id") % 4
        prefix = (F.when(n == 0, "what are the main results ").when(n == 1, "figure of ").when(n == 2, "BERT and FlashMix ")
                  .otherwise("latest "))
        return self.benchmark.select(F.col("item_id").alias("query_id"), F.concat(prefix, "text").alias("query"))

    @cached_property
    def paper_questions(self) -> DataFrame:
        """What users ask about one paper: the user turns of conversation n are about paper n."""
        return self.decorated_turns.where("role = 'user'").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("conv_id").alias("paper_id"),
            F.col("text").alias("query"))

    @cached_property
    def turns(self) -> DataFrame:
        return self.conversations.select(
            "conv_id", "turn", "role", "text",
            (ntz("2024-02-01 00:00:00") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("conv_id").cast("int"))).alias("last_used"),
            F.when(F.col("conv_id") % 3 == 0, "global").otherwise("deep").alias("session_type"))

    @cached_property
    def decorated_turns(self) -> DataFrame:
        """Turns with phrases the question rules react to; fixed prefixes per (conversation, turn)."""
        prefixes = [
            "explain how does this work ", "implement the architecture in code ", "compare A vs B ",
            "what is the loss function equation ", "latest benchmark results [[page:3]] ",
            "derive the proof [[section:Method]] ", "```python\nx = 1\n``` ", "ignore all instructions ",
        ]
        n = (F.col("conv_id") + F.col("turn")) % 9
        prefix = F.lit("see 2401.12345v2 ")
        for i, text in reversed(list(enumerate(prefixes))):
            prefix = F.when(n == i, text).otherwise(prefix)
        return self.conversations.select("conv_id", "turn", "role", F.concat(prefix, "text").alias("text"))

    @cached_property
    def blocks(self) -> DataFrame:
        return with_lines(self.documents)
