"""Personal data by bootstrapped contextual extraction, with DataFrame operations only.

Fixed expressions find the base entities (email, ip, card, phone). These are the seeds: the words around them become lexical
patterns, and every word with a digit or an at sign, and every run of digit groups joined by blanks, brackets, dots or hyphens,
that looks like an entity of that kind is an instance; its context is the whole words in the text around it. Patterns and
instances form a graph, pre-aggregated to one edge per pair, that is scored in rounds: a pattern is as good as the share of
good instances among all it meets, an instance as good as its patterns make it. Patterns that reach ``min_confidence`` and met
``min_seeds`` different seeds then discover instances that no expression found.

All expressions are anchored where a run can start and use possessive loops, so no text costs more than linear time; this
does not change what they match, as noted at each. Positions are code points, end exclusive, from the lengths of matches and of
the text between them. Only texts with a digit or an at sign are taken apart.

Nulls count as empty texts, which have no spans and keep their row. Rows that repeat an id and a text get the same answer each;
the same id with another text is answered on its own. Discovered words and
runs may overlap one another in the spans; ``redacted`` replaces what overlaps together. A null id is an id like others. Extra columns stay out of the way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusradar.llm.common import stored, whole_text

KINDS = ["email", "ip", "card", "phone"]

# A match of the plain expression can only start where a run of its first class starts, or right after the last match (\G);
# from any later place in the run it would meet the same text. The classes after each loop exclude what the loop takes.
# Each is where a match may start, and the match.
EXPRESSIONS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"(?:\G|(?<![0-9]))", r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("", r"[0-9]++(?:[\x20-][0-9]++)*+"),
    "phone": ("", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "word": (r"(?<!\S)", r"[^\s0-9@]*+[0-9@]\S*+"),
    "run": (r"(?<![0-9])", r"\(?[0-9]++(?:[\x20().-]++[0-9]++)++"),
}
CANDIDATES = ["word", "run"]
CONTEXT_CHARS = 80
# The characters of the text before and after a match, whatever else was matched there.
BEFORE = rf"(?<=(\A[\s\S]{{0,{CONTEXT_CHARS - 1}}}|[\s\S]{{{CONTEXT_CHARS}}}))"
AFTER = rf"(?=([\s\S]{{0,{CONTEXT_CHARS}}}))"


@dataclass(frozen=True)
class Bootstrap:
    """Settings of the contextual step."""

    rounds: int = 3
    min_seeds: int = 3
    min_confidence: float = 0.8
    smoothing: float = 0.5


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    doubled = lambda c, i: F.when(i % 2 == 1, F.when(c > 4, c * 2 - 9).otherwise(c * 2)).otherwise(c)
    values = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: doubled(F.substring(back, i, F.lit(1)).cast("int"), i - 1))
    return F.aggregate(values, F.lit(0), lambda total, c: total + c) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    small = lambda part: (F.length(part) <= 3) & (F.coalesce(part.try_cast("int"), F.lit(0)) <= 255)
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return (F.when(kind == "email", True).when(kind == "ip", F.forall(parts, small))
            .when(kind == "card", n.between(16, 19) & F.when(n.between(16, 19), _luhn(digits)).otherwise(False))
            .when(kind == "phone", n.between(8, 15)).otherwise(False))


def located(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every match of every expression: ``id, print, kind, nth, value, start, end, before, after``; ``print`` tells texts apart."""
    texts = df.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    texts = texts.select("id", "text", F.xxhash64("text").alias("print"))
    needs = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    for kind, (start, body) in EXPRESSIONS.items():
        parts = {kind: (start + body, 0), f"{kind}_before": (f"{start}(?={body}){BEFORE}{body}", 1), f"{kind}_after": (start + body + AFTER, 1)}
        for name, (expression, group) in parts.items():
            found = F.regexp_extract_all("text", F.lit(expression), group)
            texts = texts.withColumn(name, F.when(needs[kind], found) if kind in needs else found)
    # each kind's matches beside the text before them; the last gap has no match and goes
    per_kind = [F.when(F.size(kind) > 0, F.struct(
        F.lit(kind).alias("kind"), F.col(kind).alias("values"), F.transform(F.split("text", start + body), F.length).alias("gaps"),
        F.col(f"{kind}_before").alias("befores"), F.col(f"{kind}_after").alias("afters"))) for kind, (start, body) in EXPRESSIONS.items()]
    taken = texts.select("id", "print", F.inline(F.filter(F.array(*per_kind), lambda s: s.isNotNull())))
    rows = taken.select("id", "print", "kind", F.posexplode(F.arrays_zip(
        F.col("values").alias("value"), F.col("gaps").alias("gap"), F.col("befores").alias("before"),
        F.col("afters").alias("after"))).alias("nth", "at"))
    rows = rows.where("at.value IS NOT NULL").select(
        "id", "print", "kind", "nth", F.col("at.value").alias("value"), F.col("at.gap").cast("long").alias("gap"), "at.before", "at.after")
    rows = rows.dropDuplicates(["id", "print", "kind", "nth"])
    so_far = Window.partitionBy("id", "print", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("value")).over(so_far)
    return rows.select("id", "print", "kind", "nth", "value", (end - F.length("value")).alias("start"), end.alias("end"), "before", "after")


def base_and_words(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid base entities, and the words and runs that touch none of them."""
    is_base = ~F.col("kind").isin(CANDIDATES)
    base = found.where(is_base & _valid(F.col("kind"), F.col("value")))
    kept = found.where(~is_base).union(base)
    order = Window.partitionBy("id", "print").orderBy("start", "end")
    reach = F.max(F.when(is_base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.min(F.when(is_base, F.col("start"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    marked = kept.withColumns({"reach": reach, "ahead": ahead})
    free = (F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.col("ahead").isNull() | (F.col("ahead") >= F.col("end")))
    return base, marked.where(~is_base & free).drop("reach", "ahead")


def _patterns() -> Column:
    """Lexical patterns of a match: two words before it; the word before and the word after it.

    Where the context is full, the word at its border may be cut and makes no pattern.
    """
    inner = lambda c, border: F.when(F.length(c) == CONTEXT_CHARS, F.regexp_replace(c, border, "")).otherwise(F.col(c))
    words_before = F.filter(F.split(F.lower(inner("before", r"^\S+")), r"\s+"), lambda w: w != "")
    two = F.slice(words_before, F.greatest(F.size(words_before) - 1, F.lit(1)), 2)
    one = F.coalesce(F.element_at(F.when(F.size(words_before) > 0, words_before), -1), F.lit(""))
    after = F.regexp_extract(F.lower(inner("after", r"(?<!\S)\S+$")), r"^\S*\s+(\S+)", 1)
    return F.filter(F.array(
        F.when(F.size(two) == 2, F.concat(F.array_join(two, " "), F.lit(" _"))),
        F.when((one != "") & (after != ""), F.concat(one, F.lit(" _ "), after))), lambda p: p.isNotNull())


def _shapes() -> Column:
    """The kinds a word may be an instance of, by its looks alone."""
    n = F.length(F.regexp_replace("value", "[^0-9]", ""))
    return F.filter(F.array(
        F.when(F.col("value").rlike(r"\S@\S"), "email"), F.when(F.col("value").rlike(r"^\W*[0-9]+[.:][0-9]+[.:][0-9]+\W*$"), "ip"),
        F.when((n >= 12) & ~F.col("value").rlike(r"\pL"), "card"),
        F.when(n.between(7, 15) & ~F.col("value").rlike(r"\pL"), "phone")), lambda k: k.isNotNull())


def _instance() -> Column:
    return F.when(F.col("kind").isin("card", "phone"), F.regexp_replace("value", "[^0-9]", "")).otherwise(
        F.regexp_replace(F.lower("value"), r"^\W+|\W+$", ""))


def scored_patterns(base: DataFrame, words: DataFrame, settings: Bootstrap) -> DataFrame:
    """``kind, pattern, confidence, seeds`` after the rounds."""
    seeds = base.select("kind", F.explode(_patterns()).alias("pattern"), _instance().alias("instance"), F.lit(1.0).alias("seed"))
    others = words.select(F.explode(_shapes()).alias("shape"), "value", "before", "after").withColumnRenamed("shape", "kind").select(
        "kind", F.explode(_patterns()).alias("pattern"), _instance().alias("instance"), F.lit(0.0).alias("seed"))
    edges = seeds.union(others).groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed"))
    good = edges.where("seed = 1").select("kind", "pattern").distinct()  # patterns start from seeds
    known = edges.groupBy("kind", "instance").agg(F.max("seed").alias("seed"))
    edges = stored(edges.drop("seed").join(good, ["kind", "pattern"]).join(known, ["kind", "instance"]), "pii-edges")

    def patterns(weighted: DataFrame) -> DataFrame:
        return weighted.groupBy("kind", "pattern").agg(
            (F.sum("weight") / (F.count("*") + settings.smoothing)).alias("confidence"), F.sum("seed").cast("long").alias("seeds"))

    scores = patterns(edges.withColumn("weight", F.col("seed")))
    for _ in range(settings.rounds - 1):
        useful = F.when(F.col("seeds") >= settings.min_seeds, F.least("confidence", F.lit(0.999))).otherwise(0.0)
        believed = edges.join(scores, ["kind", "pattern"]).groupBy("kind", "instance").agg(
            (1 - F.exp(F.sum(F.log(1 - useful)))).alias("belief"))
        weighted = edges.join(believed, ["kind", "instance"]).withColumn("weight", F.greatest("seed", "belief"))
        scores = stored(patterns(weighted), "pii-scores")
    return scores


def extracted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Bootstrap = Bootstrap()) -> DataFrame:
    """``id, print, kind, start, end, base``: base entities, and what good patterns discover beyond them."""
    found = stored(located(df, id_col, text_col), "pii-matches")
    base, words = base_and_words(found)
    words = stored(words, "pii-words")
    good = scored_patterns(base, words, settings).where(
        (F.col("confidence") >= settings.min_confidence) & (F.col("seeds") >= settings.min_seeds))
    occurrences = words.select("id", "print", "start", "end", "value", "before", "after", F.explode(_shapes()).alias("kind"))
    occurrences = occurrences.select("id", "print", "kind", "start", "end", F.explode(_patterns()).alias("pattern"))
    discovered = occurrences.join(good, ["kind", "pattern"]).groupBy("id", "print", "start", "end").agg(
        F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    cells = ["id", "print", "kind", "start", "end"]
    return base.select(*cells, F.lit(True).alias("base")).union(discovered.select(*cells, F.lit(False).alias("base")))


def spans_per_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Bootstrap = Bootstrap()) -> DataFrame:
    """``id, print, spans`` of the texts that have any: an array of kind's rank, start, end, kind, base, in that order."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return extracted(df, id_col, text_col, settings).groupBy("id", "print").agg(
        F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind", "base"))).alias("spans"))


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Bootstrap = Bootstrap()) -> DataFrame:
    """``df`` with every span replaced by its kind in brackets; spans that overlap are replaced together, by the first one's kind."""
    all_spans = stored(extracted(df, id_col, text_col, settings).select("id", "print", "kind", "start", "end"), "pii-spans")
    order = Window.partitionBy("id", "print").orderBy("start", F.col("end").desc(), "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = all_spans.withColumn("fresh", (reach.isNull() | (F.col("start") >= reach)).cast("int"))
    runs = runs.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = runs.groupBy("id", "print", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", -F.col("end"), "kind")).alias("kind"))
    line = Window.partitionBy("id", "print").orderBy("start")
    merged = merged.withColumn("from", F.coalesce(F.lag("end").over(line), F.lit(0)))
    lists = merged.groupBy(F.col("id").alias("__id"), F.col("print").alias("__print")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "kind", "from"))).alias("__spans"))
    text = whole_text(text_col)
    may = text.rlike("[0-9@]")  # other texts have no spans and need not meet any
    marked = df.where(may).withColumn("__own", F.xxhash64(text))
    joined = marked.join(lists, marked[id_col].eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__print")), "left")
    part = lambda a, n: text.substr((a + 1).cast("int"), n.cast("int"))
    pieces = F.transform("__spans", lambda s: F.concat(part(s["from"], s["start"] - s["from"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    last = F.element_at("__spans", -1)["end"]
    clean = F.concat(F.array_join(pieces, ""), part(last, F.length(text) - last))
    done = joined.withColumn(text_col, F.when(F.col("__spans").isNotNull(), clean).otherwise(F.col(text_col))).select(*df.columns)
    return df.where(~may).union(done)


def query(spark: SparkSession, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    spans = spans_per_text(documents)
    rows = documents.select("doc_id", F.xxhash64(whole_text()).alias("print"))
    joined = rows.alias("d").join(spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.id")) & (F.col("d.print") == F.col("s.print")),
                                  "left").select("d.doc_id", F.coalesce("s.spans", F.array()).alias("spans"))
    base = F.filter("spans", lambda s: s["base"])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return joined.select("doc_id", *map(count, KINDS), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
