"""Section-aware chunks with overlap from text blocks: ``blocks(paper_id, page, block_no, text[, kind])``.

All windows run per document. The blocks of a document come out of one stored text, so a window never exceeds one row's
text; they share one exchange on ``paper_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusradar import constants as C
from corpusradar.functions.text import strip, strip_column, words
from corpusradar.session import stored
from corpusradar.sources.store import replace_partition

MATH_FIRST = r"(?=[$\\∑∫≈→←⊕‖0-9E])"
CHUNK_COLUMNS = ["chunk_id", "text", "raw_text", "clean_text", "page", "section", "section_order", "type", "has_math", "has_list",
                 "is_caption", "paper_id", "position"]


def has_math(text: Column) -> Column:
    # What a formula may begin with comes first: at nearly every letter the alternatives then need not be tried one by one.
    return text.rlike(MATH_FIRST + C.MATH_PATTERN)


def has_list(text: Column) -> Column:
    return text.rlike(C.LIST_PATTERN)


def is_caption(text: Column) -> Column:
    return strip_column(text).rlike(C.CAPTION_PATTERN)


def block_is_noise(text: Column, min_chars: int = 20) -> Column:
    """Too short, page furniture, or hardly any letters and no formula."""
    bare = strip_column(text)
    letters = F.length(F.regexp_replace(bare, r"[^\p{L}]", ""))
    thin = (letters / F.greatest(F.length(bare), F.lit(1)) < 0.25) & ~has_math(bare)
    return (F.length(bare) < min_chars) | bare.rlike(C.NOISE_PATTERN) | thin


def is_section_header(line: Column, pattern: str = C.SECTION_PATTERN) -> Column:
    bare = strip(line)
    return F.length(bare).between(3, 90) & bare.rlike(pattern)


def section_spans(blocks: DataFrame, pattern: str = C.SECTION_PATTERN, min_chars: int = 20, header: Column | None = None) -> DataFrame:
    """Kept blocks with ``section`` and ``section_order``; headers stay in, marked ``is_header``.

    Noise goes first, so a short header is never seen. ``header`` replaces the pattern where the blocks know their kind.
    Tables of a page come before its text and belong to the section in force when the page starts.
    """
    if "kind" not in blocks.columns:
        blocks = blocks.withColumn("kind", F.lit("text"))
    table = F.col("kind") == "table"
    raw = F.when(table, F.col("text")).otherwise(strip_column(F.col("text")))
    marked = blocks.select("paper_id", "page", "block_no", "kind", table.alias("is_table"), raw.alias("raw")).repartition("paper_id")
    marked = marked.withColumn("table_no", F.when(table, F.row_number().over(
        W.partitionBy("paper_id", "page", "is_table").orderBy("block_no")) - 1))
    kept = marked.where(F.when(F.col("is_table"), F.length("raw") >= 30).otherwise(~block_is_noise(F.col("raw"), min_chars)))
    line = strip(F.get(F.split("raw", "\n"), 0))
    found = header if header is not None else is_section_header(line, pattern)
    heads = kept.select("*", (found & ~F.col("is_table")).alias("is_header"), line.alias("_line"))
    order = W.partitionBy("paper_id").orderBy("page", F.col("is_table").desc(), "block_no")
    return heads.select(
        "paper_id", "page", "block_no", "is_table", "table_no", "raw", "is_header",
        F.coalesce(F.last(F.when(F.col("is_header"), F.col("_line")), ignorenulls=True).over(order), F.lit("Abstract")).alias("section"),
        F.sum(F.col("is_header").cast("int")).over(order).cast("int").alias("section_order"))


def drop_references(spans: DataFrame, prefix: str = "refer") -> DataFrame:
    """Remove text of sections whose name starts with ``prefix``; tables stay."""
    return spans.where(F.col("is_table") | ~F.lower("section").startswith(prefix))


def overlap_prefix(spans: DataFrame, size: int = 50) -> DataFrame:
    """``raw_text``: the last words of the previous text chunk of the section in front of the block; captions take none."""
    before = F.lag("raw").over(W.partitionBy("paper_id", "section_order", "is_table").orderBy("page", "block_no"))
    last = lambda w: F.array_join(F.slice(w, F.greatest(F.size(w) - (size - 1), F.lit(1)), size), " ")
    tail = F.transform(F.array(words(F.col("_before"))), last)[0]  # the words are cut once for their number and the slice
    plain = F.col("is_table") | is_caption(F.col("raw")) | F.col("_before").isNull()
    return spans.withColumn("_before", before).withColumn("raw_text", F.when(plain, F.col("raw")).otherwise(
        F.concat(tail, F.lit(" [...] "), F.col("raw")))).drop("_before")


def chunk_records(blocks: DataFrame, pattern: str = C.SECTION_PATTERN, min_chars: int = 20, header: Column | None = None,
                  skip_prefix: str = "refer") -> DataFrame:
    """Chunks of all papers: labelled text for search apart from the clean text for readers."""
    spans = drop_references(section_spans(blocks, pattern, min_chars, header).where(~F.col("is_header")), skip_prefix)
    table = F.col("is_table")
    flagged = overlap_prefix(spans).select(
        "*", (~table & has_math(F.col("raw"))).alias("has_math"), (~table & has_list(F.col("raw"))).alias("has_list"),
        (~table & is_caption(F.col("raw"))).alias("is_caption"))
    order = W.partitionBy("paper_id").orderBy("page", F.col("is_table").desc(), "block_no")
    tags = F.array_compact(F.array(
        F.concat(F.lit("Page "), F.col("page").cast("string")), F.when(table, "TABLE"), F.when(F.col("has_math"), "MATH"),
        F.when(F.col("has_list"), "LIST"), F.when(F.col("is_caption"), "FIGURE")))
    label = F.concat(F.lit("["), F.col("section"), F.lit(" | "), F.array_join(tags, " | "), F.lit("]\n"))
    position = (F.row_number().over(order) - 1).alias("position")
    ids = F.concat(F.col("paper_id").cast("string"), F.lit("_p"), F.col("page").cast("string"),
                   F.when(table, F.concat(F.lit("_t"), F.col("table_no").cast("string")))
                   .otherwise(F.concat(F.lit("_b"), F.col("position").cast("string"))))
    return flagged.select("*", position).select(
        ids.alias("chunk_id"), F.concat(label, F.col("raw")).alias("text"), "raw_text", F.col("raw").alias("clean_text"), "page",
        "section", "section_order",
        F.when(table, "table").when(F.col("is_caption"), "caption").when(F.col("has_math"), "math").otherwise("text").alias("type"),
        "has_math", "has_list", "is_caption", "paper_id", "position")


def section_summaries(chunks: DataFrame, limit: int = 500) -> DataFrame:
    """First ``limit`` words of the clean texts of each section name; only chunks that reach into them are gathered."""
    text = chunks.where(F.col("type").isin("text", "math"))
    by = W.partitionBy("paper_id", "section").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    counted = text.withColumn("_before", F.coalesce(F.sum(F.size(words(F.col("clean_text")))).over(by), F.lit(0)))
    heads = counted.groupBy("paper_id", "section").agg(
        F.sort_array(F.collect_list(F.when(F.col("_before") < limit, F.struct("position", "clean_text")))).alias("_t"),
        F.max_by("section_order", "position").alias("section_order"), F.bool_or("has_math").alias("has_math"))
    joined = F.array_join(F.transform("_t", lambda s: s["clean_text"]), " ")
    slug = F.substring(F.regexp_replace(F.lower("section"), "[^a-z0-9]", "_"), 1, 40)
    trimmed = heads.withColumn("clean_text", F.array_join(F.slice(words(joined), 1, limit), " "))
    return trimmed.select(
        F.concat(F.col("paper_id").cast("string"), F.lit("_sum_"), slug).alias("chunk_id"),
        F.concat(F.lit("[SECTION OVERVIEW: "), "section", F.lit("]\n"), "clean_text").alias("text"),
        F.col("clean_text").alias("raw_text"), "clean_text", F.lit(0).alias("page"), "section", "section_order",
        F.lit("summary").alias("type"), "has_math", F.lit(False).alias("has_list"), F.lit(False).alias("is_caption"), "paper_id",
        F.lit(None).cast("int").alias("position"))


def chunks_with_summaries(chunks: DataFrame, limit: int = 500) -> DataFrame:
    """The chunks and, in the same pass, what ``section_summaries`` makes of them.

    Windows by paper and section keep the exchange on the paper that made the chunks. The first text chunk of a section
    carries at most ``limit`` words of the section and gives a second row; the text is neither computed nor moved twice.
    """
    section = W.partitionBy("paper_id", "section", "_counts")
    before = section.orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    own = words(F.col("clean_text"))
    marked = chunks.withColumn("_counts", F.col("type").isin("text", "math"))
    counted = marked.withColumn("_before", F.coalesce(F.sum(F.size(own)).over(before), F.lit(0)))
    reach = F.when(F.col("_before") < limit, F.struct("position", F.slice(own, 1, F.greatest(limit - F.col("_before"), F.lit(1)).cast("int")).alias("w")))
    whole = counted.select(
        "*", F.row_number().over(section.orderBy("position")).alias("_nth"), F.collect_list(reach).over(section).alias("_heads"),
        F.max_by("section_order", "position").over(section).alias("_order"), F.bool_or("has_math").over(section).alias("_math"))
    head = F.array_join(F.flatten(F.transform(F.sort_array("_heads"), lambda h: h["w"])), " ")
    slug = F.substring(F.regexp_replace(F.lower("section"), "[^a-z0-9]", "_"), 1, 40)
    kinds = dict(chunks.dtypes)
    summary = {
        "chunk_id": F.concat(F.col("paper_id").cast("string"), F.lit("_sum_"), slug),
        "text": F.concat(F.lit("[SECTION OVERVIEW: "), "section", F.lit("]\n"), "_head"), "raw_text": F.col("_head"), "clean_text": F.col("_head"),
        "page": F.lit(0), "section": F.col("section"), "section_order": F.col("_order"), "type": F.lit("summary"), "has_math": F.col("_math"),
        "has_list": F.lit(False), "is_caption": F.lit(False), "paper_id": F.col("paper_id"), "position": F.lit(None)}
    headed = whole.withColumn("_head", F.when(F.col("_counts") & (F.col("_nth") == 1), head))
    both = F.array_compact(F.array(
        F.struct(*[F.col(c) for c in CHUNK_COLUMNS]),
        F.when(F.col("_head").isNotNull(), F.struct(*[summary[c].cast(kinds[c]).alias(c) for c in CHUNK_COLUMNS]))))
    return headed.select(F.inline(both))


def index_stats(chunks: DataFrame, summaries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Sections, pages, chunks, math, tables, captions and summaries per paper."""
    pages = blocks.groupBy("paper_id").agg(F.max("page").alias("pages"))
    per_chunk = chunks.groupBy("paper_id").agg(
        F.count_distinct("section").alias("sections"), F.count("*").alias("_chunks"), F.count_if("has_math").alias("math"),
        F.count_if(F.col("type") == "table").alias("tables"), F.count_if("is_caption").alias("captions"))
    per_summary = summaries.groupBy("paper_id").agg(F.count("*").alias("summaries"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return pages.join(per_chunk, "paper_id", "left").join(per_summary, "paper_id", "left").select(
        "paper_id", zero("sections").alias("sections"), "pages", (zero("_chunks") + zero("summaries")).alias("chunks"),
        zero("math").alias("math"), zero("tables").alias("tables"), zero("captions").alias("captions"), zero("summaries").alias("summaries"))


def stored_form(chunks: DataFrame, clean_chars: int | None = None, context_chars: int | None = None) -> DataFrame:
    """What the index keeps for readers: clean text and text with overlap, whole unless lengths are given."""
    clean, context = (F.substring(c, 1, n) if n else F.col(c) for c, n in (("clean_text", clean_chars), ("raw_text", context_chars)))
    return chunks.select(
        "chunk_id", "paper_id", "position", "text", "page", "section", "section_order", "type", "has_math", "has_list", "is_caption",
        clean.alias("raw_text"), context.alias("raw_text_ctx"))


def build_index(blocks: DataFrame, stored: DataFrame | None = None, clean_chars: int | None = None, context_chars: int | None = None,
                **options) -> DataFrame:
    """Chunks and section summaries of all papers in ``blocks``, replacing what ``stored`` holds of these papers.

    Texts are stored whole; ``clean_chars`` and ``context_chars`` cut them for a smaller index.
    """
    fresh = stored_form(chunks_with_summaries(chunk_records(blocks, **options)), clean_chars, context_chars)
    return fresh if stored is None else replace_partition(stored, fresh)


def store_index(index: DataFrame) -> DataFrame:
    """The rows of ``build_index`` as a stored table that holds what a chunk's texts share once.

    Text and context nearly always end with the raw text: then only what comes before it is stored. Reading puts them together again.
    """
    longer = ["text", "raw_text_ctx"]
    ends = {c: F.coalesce(F.endswith(c, "raw_text"), F.lit(False)) for c in longer}
    head = lambda c: F.when(ends[c], F.substring(c, F.lit(1), F.length(c) - F.length("raw_text"))).otherwise(F.col(c))
    kept = stored(index.select(*[head(c).alias(c) if c in longer else c for c in index.columns], *[ends[c].alias(f"_{c}") for c in longer]))
    whole = lambda c: F.when(F.col(f"_{c}"), F.concat(c, "raw_text")).otherwise(F.col(c))
    return kept.select(*[whole(c).alias(c) if c in longer else c for c in index.columns])


def node_tree_stats(nodes: DataFrame) -> DataFrame:
    """Node count and last page per document of ``nodes(doc_id, node_id, parent_id, title, page_index, end_index)``."""
    end = F.coalesce("end_index", "page_index", F.lit(0))
    return nodes.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.max(end).alias("pages"))


def node_context(nodes: DataFrame) -> DataFrame:
    """Text of the retrieved nodes per document, each below a heading with its page."""
    page = F.when(F.coalesce("page_index", F.lit(0)) != 0, F.concat(F.lit(" | Page "), F.col("page_index").cast("string"))).otherwise("")
    part = F.concat(F.lit("[Section: "), F.coalesce("title", F.lit("")), page, F.lit("]\n"), F.col("text"))
    texts = nodes.where(F.coalesce("text", F.lit("")) != "").select("doc_id", "node_id", part.alias("part"))
    return texts.groupBy("doc_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("node_id", "part"))), lambda s: s["part"]), "\n\n---\n\n").alias("context"))


def node_citations(nodes: DataFrame) -> DataFrame:
    """Distinct page and section citations of the nodes with text, numbered by first appearance."""
    texts = nodes.where(F.coalesce("text", F.lit("")) != "")
    page = F.when(F.coalesce("page_index", F.lit(0)) != 0, F.struct(
        F.lit(0).alias("k"), F.lit("page").alias("type"), F.col("page_index").cast("string").alias("value")))
    section = F.when(F.coalesce("title", F.lit("")) != "", F.struct(
        F.lit(1).alias("k"), F.lit("section").alias("type"), F.col("title").alias("value")))
    cited = texts.select("doc_id", "node_id", F.explode(F.array_compact(F.array(page, section))).alias("c"))
    first = cited.groupBy("doc_id", "c.type", "c.value").agg(F.min(F.struct("node_id", "c.k")).alias("at"))
    return first.select("doc_id", "type", "value", F.row_number().over(W.partitionBy("doc_id").orderBy("at")).alias("position"))
