"""Language identification by Bayesian fusion of evidence.

Text: a naive Bayes model over hashed byte trigrams, counted over all texts by their declared language; the log likelihood per
trigram is weighted by a count that saturates, so a long text does not silence the other evidence. Declared markup language: the
chance of a declaration given the language, from a grouped count of what texts look like against what they declare. Address
suffix and host: grouped counts of what texts look like, smoothed host -> suffix -> all. Their sum of logarithms, normalised,
is the posterior. A document is accepted if its best language reaches ``min_confidence`` and its text has letters.

Every language with ``min_evidence`` declarations takes part, whatever its share. Counts of languages and trigrams are a sparse
grouped table, broadcast by trigram; it has an entry per trigram that occurs in a language, and no more than 2**bits of each. A row
keeps those languages that the other evidence could still lift, which leaves out less than a double can hold.

Texts never leave their task: what is grouped and joined are short rows, and a host with a third of all rows is pre-aggregated
before the shuffle and split by Spark's skew handling in the join.

Texts of one or two bytes have no trigram and are judged by the other evidence; accepted are texts with a letter (any character
beyond ASCII counts). Null texts count as empty: they have no letters, so they are not accepted. Null or unknown
declarations are no evidence; null hosts and suffixes are groups of their own. Ties go to the language that sorts first. Rows that
repeat are judged each. Without any declared language the result has a null language and nothing is accepted. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusradar.llm.common import stored, text_blocks, whole_text


@dataclass(frozen=True)
class Settings:
    bits: int = 14
    min_evidence: int = 1  # declarations a language needs, however many others have; codes of two or three letters bound the languages
    saturation: float = 200.0
    smoothing: float = 20.0
    min_confidence: float = 0.5


MOST_ENTRIES = 1 << 20  # counts, scores or table entries that a task holds at once
_LETTER = np.full(256, 32, np.uint8)  # ASCII letters in lower case and all other bytes of UTF-8; the rest is a blank
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def trigrams(octets: np.ndarray, bounds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every byte trigram that is not all blank and lies in one text."""
    b = _LETTER[octets].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    use = (code != 0x202020) & (rows[:-2] == rows[2:])
    return ((code[use] * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.int64), rows[:-2][use]


def language_code(declared: Column) -> Column:
    """The primary subtag, lower-cased; null if there is none."""
    code = F.regexp_extract(F.lower(F.trim(declared)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(code != "", code)


def evidence(df: DataFrame, id_col: str | Column, text: Column, declared: Column, host: Column, suffix: Column) -> DataFrame:
    return df.select((F.col(id_col) if isinstance(id_col, str) else id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text"), language_code(declared).alias("declared"),
                     F.coalesce(F.lower(host), F.lit("")).alias("host"), F.coalesce(F.lower(suffix), F.lit("")).alias("suffix"))


def _likelihoods(rows: DataFrame, languages: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log chances of the trigrams, from every declared text: that of a trigram a language never has, per language; then, by
    trigram, the first entry, and per entry its language and what it has above that."""
    size, place = 1 << s.bits, {code: i for i, code in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def rows_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (keys >> s.bits, keys & (size - 1), counts)], names=["lang", "gram", "n"])

        for batch in batches:
            own = np.array([place[code] for code in batch.column(1).to_pylist()], np.int64)
            for a, b, octets, bounds in text_blocks(batch.column(0)):
                grams, of = trigrams(octets, bounds, s.bits)
                fresh, n = np.unique(own[a:b][of] << s.bits | grams, return_counts=True)
                merged, at = np.unique(np.append(keys, fresh), return_inverse=True)
                counts = np.bincount(at, np.append(counts, n), len(merged)).astype(np.int64)
                keys = merged
                if len(keys) > MOST_ENTRIES:
                    yield rows_of()
                    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield rows_of()

    parts = rows.where(F.col("declared").isin(languages)).select("text", "declared").mapInArrow(run, "lang long, gram long, n long")
    table = stored(parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "trigram-counts")
    lang, gram, n = (np.asarray(column) for column in table.toArrow().columns)
    order = np.lexsort((lang, gram))
    lang, gram, n = lang[order], gram[order], n[order].astype(np.float64)
    never = np.log(0.5 / (np.bincount(lang, n, len(languages)) + 0.5 * size))
    return never, np.searchsorted(gram, np.arange(size + 1)), lang.astype(np.int32), np.log((n + 0.5) / 0.5).astype(np.float32)


def _text_scores(rows: DataFrame, table: tuple, reach: float, s: Settings) -> DataFrame:
    """``id, declared, host, suffix, lettered, looks, logs``: the language that fits best, and the weighted log likelihoods of
    those languages that are less than ``reach`` below it."""
    shared = rows.sparkSession.sparkContext.broadcast(table)
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "declared", "host", "suffix", "lettered", "looks", "logs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        never, first, lang, above = shared.value
        width = len(never)
        for batch in batches:
            for start, stop, octets, bounds in text_blocks(batch.column(1)):
                all_grams, all_of = trigrams(octets, bounds, s.bits)
                so_far = np.append(0, np.cumsum(_LETTER[octets] != 32))[bounds]
                step = max(1, MOST_ENTRIES // width)
                for a in range(0, stop - start, step):
                    b = min(a + step, stop - start)
                    lo, hi = np.searchsorted(all_of, [a, b])
                    cells, n = np.unique((all_of[lo:hi] - a) << s.bits | all_grams[lo:hi], return_counts=True)
                    of, grams = cells >> s.bits, cells & ((1 << s.bits) - 1)
                    each = first[grams + 1] - first[grams]
                    ends, sums, k = np.cumsum(each), np.zeros((b - a) * width), 0
                    while k < len(grams):
                        e = max(k + 1, int(np.searchsorted(ends, ends[k] + MOST_ENTRIES)))
                        at = np.arange(each[k:e].sum()) + np.repeat(first[grams[k:e]] - (ends[k:e] - each[k:e] - ends[k] + each[k]), each[k:e])
                        sums += np.bincount(np.repeat(of[k:e] * width, each[k:e]) + lang[at], np.repeat(n[k:e], each[k:e]) * above[at], len(sums))
                        k = e
                    letters = np.bincount(of, n, b - a).astype(np.int64)
                    logs = (sums.reshape(-1, width) + letters[:, None] * never) / (1 + letters / s.saturation)[:, None]
                    of, which = np.nonzero(logs >= logs.max(1, keepdims=True) - reach)
                    entries = pa.StructArray.from_arrays([pa.array(which), pa.array(logs[of, which])], names=["lang", "log"])
                    offsets = pa.array(np.searchsorted(of, np.arange(b - a + 1)), pa.int32())
                    yield pa.RecordBatch.from_arrays([
                        *[batch.column(i).slice(start + a, b - a) for i in (0, 2, 3, 4)], pa.array(so_far[a + 1:b + 1] > so_far[a:b]),
                        pa.array(logs.argmax(1), mask=letters == 0), pa.ListArray.from_arrays(offsets, entries)], names=names)

    return rows.select("id", "text", "declared", "host", "suffix").mapInArrow(
        run, f"id {kind}, declared string, host string, suffix string, lettered boolean, looks long, logs array<struct<lang:long,log:double>>")


def _dense(column: pa.Array, width: int, empty: float) -> np.ndarray:
    """A row of ``width`` values per list of (language, value), ``empty`` where it has none."""
    out, entries = np.full((len(column), width), empty), column.flatten()
    of = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    out[of, pc.struct_field(entries, 0).to_numpy()] = pc.struct_field(entries, 1).to_numpy()
    return out


def identified(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``id, language, confidence, accepted`` per row of ``evidence``."""
    s = settings
    declared = rows.where("declared IS NOT NULL").groupBy("declared").count().where(F.col("count") >= s.min_evidence)
    languages = sorted(r["declared"] for r in declared.collect())  # 26**2 + 26**3 codes at most
    if not languages:
        return rows.select("id", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), F.lit(False).alias("accepted"))
    width = len(languages)
    # the farthest that a declaration and a prior, smoothed twice, can move two languages apart, and what a sum of doubles loses
    n = rows.count()
    reach = 2 * float(np.log(n + width) + np.log((n + s.smoothing) / s.smoothing)) + 50
    scores = stored(_text_scores(rows, _likelihoods(rows, languages, s), reach, s), "language-scores")

    # declarations against looks, and looks overall
    place, said = {code: i for i, code in enumerate(languages)}, {}
    declaring, overall = np.zeros(width), np.zeros(width)
    for r in scores.where(F.col("declared").isin(languages) & F.col("looks").isNotNull()).groupBy("looks", "declared").count().collect():
        said.setdefault(place[r["declared"]], []).append((r["looks"], float(np.log(r["count"] + 1))))
        declaring[r["looks"]] += r["count"]
    for r in scores.where("looks IS NOT NULL").groupBy("looks").count().collect():
        overall[r["looks"]] = r["count"]
    overall = (overall + 1) / (overall.sum() + width)
    shared = rows.sparkSession.sparkContext.broadcast((place, said, -np.log(declaring + width), overall))

    entry = lambda n: F.when(F.col("looks").isNotNull(), F.struct("looks", F.col(n).cast("double").alias("n")))
    counts = stored(scores.groupBy("suffix", "host", "looks").agg(F.count("*").alias("n")), "language-counts")
    by_host = counts.groupBy("suffix", "host").agg(F.collect_list(entry("n")).alias("of_host"))
    by_suffix = counts.groupBy("suffix", "looks").agg(F.sum("n").alias("n")).groupBy("suffix").agg(F.collect_list(entry("n")).alias("of_suffix"))
    joined = scores.join(by_host.join(by_suffix, "suffix"), ["suffix", "host"]).select("id", "lettered", "declared", "logs", "of_host", "of_suffix")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, said, unsaid, overall = shared.value
        step = max(1, (1 << 18) // len(overall))
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                logs = _dense(batch.column(3), len(overall), -np.inf)
                codes = np.array([place.get(code, -1) for code in batch.column(2).to_pylist()], np.int64)
                logs[codes >= 0] += unsaid
                for code in np.unique(codes[codes >= 0]):
                    for looks, log in said.get(int(code), []):
                        logs[codes == code, looks] += log
                host, suffix = (_dense(batch.column(i), len(overall), 0.0) for i in (4, 5))
                above = (suffix + s.smoothing * overall) / (suffix.sum(1, keepdims=True) + s.smoothing)
                logs += np.log((host + s.smoothing * above) / (host.sum(1, keepdims=True) + s.smoothing))
                top = logs.max(1, keepdims=True)
                confidence = 1 / np.exp(logs - top).sum(1)
                accepted = batch.column(1).to_numpy(zero_copy_only=False) & (confidence >= s.min_confidence)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([names[i] for i in logs.argmax(1)], pa.string()), pa.array(confidence),
                                                  pa.array(accepted)], names=["id", "language", "confidence", "accepted"])

    names, kind = languages, scores.schema["id"].dataType.simpleString()
    return joined.mapInArrow(judge, f"id {kind}, language string, confidence double, accepted boolean")


def document_evidence(documents: DataFrame, id_col: str | Column = "doc_id") -> DataFrame:
    """``documents`` declare a language, their source is the host; they have no address."""
    return evidence(documents, id_col, whole_text(), F.col("lang"), F.col("source"), F.lit(None).cast("string"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Web pages: text between tags, ``lang`` of the html element, host and its last label from the address."""
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    declared = F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1)
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*+>|&[#A-Za-z0-9]++;", " ")
    return evidence(pages, "page_id", text, declared, host, F.regexp_extract(host, r"([^.]+)$", 1))


def drop_rejected(df: DataFrame, id_col: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """The accepted rows of ``df``, all columns. Rows are told apart by id, text, declaration and source, not by the id alone."""
    check = F.xxhash64(whole_text(), "lang", "source")
    judged = identified(document_evidence(df, F.struct(F.col(id_col).alias("id"), check.alias("check"))), settings)
    gone = stored(judged.where("NOT accepted").select(F.col("id.id").alias("__id"), F.col("id.check").alias("__check")).distinct(), "rejected")
    return df.join(gone, df[id_col].eqNullSafe(F.col("__id")) & (check == F.col("__check")), "left_anti")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return identified(document_evidence(spark.read.parquet(f"{folder}/documents.parquet"))).withColumnRenamed("id", "doc_id")


def pages_query(spark: SparkSession, folder: str) -> DataFrame:
    return identified(page_evidence(spark.read.parquet(f"{folder}/pages.parquet"))).withColumnRenamed("id", "page_id")
