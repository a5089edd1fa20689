"""From raw feed rows and pages to stored papers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusradar import constants as C
from corpusradar.functions.text import decode_entities, first_match, strip


def extract_repo_link(col: Column, pattern: str = C.REPO_LINK_PATTERN) -> Column:
    """First repository link in the text without trailing ``.``, ``,`` or ``)``; NULL if there is none."""
    return F.regexp_replace(first_match(col, pattern), r"[.,)]+$", "")


def parse_repo(url: Column, host: str = "github.com") -> Column:
    """``struct(owner, repo)`` from the path after the host; NULL with fewer than two parts."""
    tail = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), f"{host}/".replace(".", r"\.")), -1)
    parts = F.split(tail, "/")
    return F.when(F.size(parts) >= 2, F.struct(F.get(parts, 0).alias("owner"), F.get(parts, 1).alias("repo")))


def extract_paper_id(text: Column) -> Column:
    return first_match(text, C.PAPER_ID_PATTERN)


def base_id(entry_id: Column) -> Column:
    """Last path segment up to its first ``v``."""
    return F.get(F.split(F.element_at(F.split(entry_id, "/"), -1), "v"), 0)


def normalize_papers(raw: DataFrame, link_pattern: str = C.REPO_LINK_PATTERN) -> DataFrame:
    """``raw(entry_id, title, summary, comment, authors, categories, published, updated, pdf_url)`` to papers."""
    one_line = lambda c: F.replace(strip(F.col(c)), F.lit("\n"), F.lit(" "))
    return raw.select(
        base_id(F.col("entry_id")).alias("paper_id"), one_line("title").alias("title"), one_line("summary").alias("abstract"),
        F.col("authors"), F.col("categories"), F.col("published").alias("published_at"), F.col("updated").alias("updated_at"),
        F.col("entry_id").alias("paper_url"), F.col("pdf_url"),
        F.coalesce(extract_repo_link(F.col("summary"), link_pattern), extract_repo_link(F.col("comment"), link_pattern))
        .alias("repo_url"))


def select_feed(raw: DataFrame, categories: Sequence[str] = C.DEFAULT_CATEGORIES, max_results: int = 100,
                days_back: int | None = None, as_of: Column | None = None) -> DataFrame:
    """Newest rows of any of the categories; the age limit is off unless asked for."""
    rows = raw.where(F.arrays_overlap("categories", F.array(*[F.lit(c) for c in categories])))
    if days_back is not None:
        rows = rows.where(F.col("published_at") >= as_of - F.make_dt_interval(F.lit(days_back)))
    return rows.orderBy(F.col("published_at").desc(), "paper_id").limit(max_results)


def ingest_new_only(batch: DataFrame, existing: DataFrame, row_key: str) -> DataFrame:
    """First row per new id. Copies inside the batch fall away per task before anything moves."""
    first = batch.withColumn("_r", F.row_number().over(W.partitionBy("paper_id").orderBy(row_key))).where("_r = 1").drop("_r")
    return first.join(existing.select("paper_id"), "paper_id", "left_anti")


def ingest_audit(batch: DataFrame, existing: DataFrame, categories: Sequence[str] = C.DEFAULT_CATEGORIES) -> DataFrame:
    """One row about a run: rows found, new ids, ids already known."""
    ids = batch.groupBy("paper_id").agg(F.count("*").alias("rows"))
    known = existing.select("paper_id").distinct().withColumn("_known", F.lit(True))
    return ids.join(known, "paper_id", "left").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("papers_found"),
        F.count_if(F.col("_known").isNull()).alias("papers_new"), F.count_if("_known").alias("papers_known"),
    ).select("*", F.lit("done").alias("status"), F.array(*[F.lit(c) for c in categories]).alias("categories"))


def seed_if_absent(rows: DataFrame, existing: DataFrame, now: Column) -> DataFrame:
    """Rows with defaults filled in and ``status`` = ``added`` or ``exists``."""
    known = existing.select("paper_id").distinct().withColumn("_known", F.lit(True))
    have = dict(rows.dtypes)
    strings = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in have else F.array().cast("array<string>")
    moment = lambda c: F.coalesce(F.col(c), now) if c in have else now
    url = F.coalesce(F.nullif(F.col("paper_url"), F.lit("")) if "paper_url" in have else F.lit(None).cast("string"),
                     F.concat(F.lit(C.PAPER_URL_PREFIX), F.col("paper_id").cast("string")))
    return rows.join(known, "paper_id", "left").select(
        "paper_id", "title", "abstract", strings("authors").alias("authors"), strings("categories").alias("categories"),
        moment("published_at").alias("published_at"), moment("updated_at").alias("updated_at"), url.alias("paper_url"),
        F.when(F.col("_known"), "exists").otherwise("added").alias("status"))


def html_blocks(pages: DataFrame, blocks_per_page: int = 8) -> DataFrame:
    """Ordered text blocks of raw HTML: ``(doc_id, page, block_no, kind, text)``.

    ``h1``-``h6`` are headings, ``p`` and ``li`` text, ``tr`` table rows with cells parted by ``|``. A page is one row, so
    its blocks are cut and numbered inside the row.
    """
    html = F.col("html")
    for gone in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<!--.*?-->"):
        html = F.regexp_replace(html, gone, "")
    html = F.regexp_replace(html, r"(?i)</t[dh]>", " | ")
    html = F.regexp_replace(html, r"(?i)<(h[1-6]|p|li|tr)(\s[^>]*)?>", "\u0001$1\u0002")
    html = F.regexp_replace(html, r"(?i)</?(h[1-6]|p|li|tr|ul|ol|table|article|nav|div|body|html|footer|header|section)(\s[^>]*)?>",
                            "\u0001x\u0002")
    html = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    html = decode_entities(html)
    pieces = F.transform(F.split(html, "\u0001"), lambda p: F.struct(
        F.lower(F.split_part(p, F.lit("\u0002"), F.lit(1))).alias("tag"),
        strip(F.regexp_replace(F.split_part(p, F.lit("\u0002"), F.lit(2)), r"\s+", " ")).alias("text")))
    kept = F.filter(pieces, lambda p: p["tag"].rlike("^(h[1-6]|p|li|tr)$") & (p["text"] != ""))
    kind = F.when(F.col("b.tag").startswith("h"), "heading").when(F.col("b.tag") == "tr", "table").otherwise("text")
    cut = pages.select(F.col("page_id").alias("doc_id"), F.posexplode_outer(kept).alias("block_no", "b")).where("b IS NOT NULL")
    return cut.select(
        "doc_id", (F.floor(F.col("block_no") / blocks_per_page) + 1).cast("int").alias("page"), "block_no",
        kind.alias("kind"), F.col("b.text").alias("text"))


def table_chunk_text(rows: Column, min_chars: int = 30) -> Column:
    """Text of a table given as rows of cells: header, dashes, rows; NULL below ``min_chars``."""
    line = lambda cells: F.array_join(F.transform(cells, lambda c: F.coalesce(strip(c), F.lit(""))), " | ")
    header = line(F.get(rows, 0))
    dashes = F.repeat(F.lit("-"), F.greatest(F.lit(30), F.length(header)))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
    text = F.array_join(F.concat(F.array(header, dashes), body), "\n")
    return F.when((F.size(rows) > 0) & (F.length(text) >= min_chars), text)


def bulk_infer(
    df: DataFrame, id_col: str, input_col: str, make_model: Callable[[], Callable[[pd.Series, int], pd.Series]],
    valid: Callable[[pd.Series], pd.Series], attempts: int = 2, concurrency: int | None = None,
) -> DataFrame:
    """Call a model for every row: ``(id_col, output, attempts, error)``.

    ``make_model`` runs once per task; the model gets the texts still open and the attempt number. A row keeps its first
    answer that ``valid`` accepts; after the last attempt the output is NULL and the error is set.
    """
    source = df.select(id_col, input_col)
    if concurrency:
        source = source.repartition(concurrency)
    kind = dict(source.dtypes)[id_col]

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for pdf in batches:
            out = pd.DataFrame({id_col: pdf[id_col], "output": None, "attempts": 0, "error": None}, index=pdf.index)
            todo = pdf.index
            for attempt in range(1, attempts + 1):
                if not len(todo):
                    break
                out.loc[todo, "attempts"] = attempt
                try:
                    answers = model(pdf.loc[todo, input_col], attempt)
                    good = valid(answers).to_numpy(dtype=bool)
                except Exception as failure:  # the model is foreign code: its failure marks rows, not the job
                    out.loc[todo, "error"] = str(failure)[:200]
                    continue
                out.loc[todo[good], "output"] = answers[good]
                out.loc[todo[good], "error"] = None
                todo = todo[~good]
                out.loc[todo, "error"] = "invalid output"
            yield out

    return source.mapInPandas(call, f"{id_col} {kind}, output string, attempts int, error string")


def pending_work(papers: DataFrame, limit: int = 20, repo_only: bool = False, newest: int = 100) -> DataFrame:
    """Papers still to analyse among the ``newest`` ones: limit, then filter, then limit again."""
    recent = papers.orderBy(F.col("ingested_at").desc(), "paper_id").limit(newest)
    open_rows = recent.where(~F.coalesce("is_analyzed", F.lit(False)))
    if repo_only:
        open_rows = open_rows.where(F.col("repo_url").isNotNull())
    return open_rows.orderBy(F.col("ingested_at").desc(), "paper_id").limit(limit)
