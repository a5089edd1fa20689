"""Question understanding and answer checks as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusradar import constants as C
from corpusradar.functions.text import contains_any, matches_any, string_array


def off_topic(text: Column, patterns: Sequence[str] = C.OFF_TOPIC_PATTERNS) -> Column:
    return matches_any(text, patterns)


def global_intent(text: Column) -> Column:
    """First class that matches, in table order; else factual."""
    intent = F.lit("factual")
    for name, patterns in reversed(list(C.GLOBAL_INTENT_PATTERNS.items())):
        intent = F.when(matches_any(text, patterns), name).otherwise(intent)
    return intent


def deep_intent(text: Column) -> Column:
    """Every matching pattern adds its class weight; the highest total wins, ties by table order; none gives discuss."""
    votes = [F.struct(F.lit(0).alias("total"), F.lit(1).alias("order"), F.lit("discuss").alias("name"))]
    for place, (name, (weight, patterns)) in enumerate(C.DEEP_INTENT_PATTERNS.items()):
        hits = [matches_any(text, [p]).cast("int") for p in patterns]
        votes.append(F.struct((sum(hits[1:], hits[0]) * weight).alias("total"), F.lit(-place).alias("order"), F.lit(name).alias("name")))
    return F.array_max(F.array(*votes))["name"]


def lookup(table: dict, key: Column) -> Column:
    """Value of a literal table; the key is worked out once however many entries there are."""
    return F.try_element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), key)


def chunk_budget(intent: Column, default: int = 10) -> Column:
    return F.coalesce(lookup(C.CHUNK_BUDGETS, intent), F.lit(default))


def sub_query_budget(chunks: Column, sub_queries: Column) -> Column:
    """Chunks per sub-query; a single query keeps the whole budget."""
    return F.when(sub_queries == 1, chunks).otherwise(F.greatest(F.floor(chunks / sub_queries).cast("int") + 2, F.lit(5)))


def decompose_query(text: Column, intent: Column) -> Column:
    """The query and its expansions for separate retrieval, without repeats."""
    always = lambda tails: [F.concat(text, F.lit(t)) for t in tails]
    implement = always(C.DECOMPOSE_IMPLEMENT_ALWAYS) + [
        F.when(contains_any(text, cues), F.concat(text, F.lit(tail))) for cues, tail in C.DECOMPOSE_IMPLEMENT_TRIGGERED]
    system = contains_any(text, C.DECOMPOSE_SYSTEM_WORDS) & intent.isin("explain", "discuss")
    more = (
        F.when(intent == "implement", F.array_compact(F.array(*implement)))
        .when(system, F.array(*always(C.DECOMPOSE_SYSTEM)))
        .when(intent == "math", F.array(*always(C.DECOMPOSE_MATH)))
        .when(intent == "formula", F.array(*always(C.DECOMPOSE_FORMULA)))
        .otherwise(string_array([]))
    )
    return F.array_distinct(F.concat(F.array(text), more))


def route_model(intent: Column, preference: Column) -> Column:
    """An explicit preference wins; exact work goes to the precise model."""
    return F.when(F.coalesce(preference, F.lit("auto")) != "auto", preference).when(
        intent.isin(C.PRECISE_INTENTS), "precise").otherwise("fast")


def length_limit(intent: Column) -> Column:
    return F.coalesce(lookup(C.LENGTH_LIMITS, intent), F.lit(""))


def answer_words(text: Column, stop_words: Sequence[str] = C.ANSWER_STOP_WORDS) -> Column:
    """Distinct lower-cased words of five or more plain letters; a word with other characters in it does not count."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(runs, lambda w: w.rlike("^[a-z]{5,}$") & ~w.isin(list(stop_words))))


def confidence_note(answer: Column, context: Column, min_overlap: float = 0.20, note: str = C.CAVEAT) -> Column:
    """The answer, with a caveat appended when little of its wording occurs in the context."""
    said, known = answer_words(answer), answer_words(context)
    thin = (F.coalesce(context, F.lit("")) != "") & (F.size(said) > 0) & (F.size(F.array_intersect(said, known)) / F.size(said) < min_overlap)
    return F.when(thin, F.concat(answer, F.lit(note))).otherwise(answer)


def inline_citations(text: Column) -> Column:
    """Array of ``(type, value)``: all page marks, then all section marks."""
    pages = F.transform(F.regexp_extract_all(text, F.lit(r"\[\[page:([0-9]+)\]\]"), F.lit(1)),
                        lambda v: F.struct(F.lit("page").alias("type"), v.cast("bigint").cast("string").alias("value")))
    sections = F.transform(F.regexp_extract_all(text, F.lit(r"\[\[section:([^\]]+)\]\]"), F.lit(1)),
                           lambda v: F.struct(F.lit("section").alias("type"), v.alias("value")))
    return F.concat(pages, sections)


CODE_PATTERN = r"(?s)```([A-Za-z0-9_]*)\n?(.*?)```"


def code_blocks(text: Column) -> Column:
    """Array of ``(type, lang, value)``: text and fenced code in order, empty text left out."""
    code = F.transform(
        F.arrays_zip(F.regexp_extract_all(text, F.lit(CODE_PATTERN), F.lit(1)).alias("lang"),
                     F.regexp_extract_all(text, F.lit(CODE_PATTERN), F.lit(2)).alias("body")),
        lambda c: F.struct(F.lit("code").alias("type"), F.when(c["lang"] == "", "text").otherwise(c["lang"]).alias("lang"),
                           F.regexp_replace(c["body"], r"\n\z", "").alias("value")))
    plain = F.transform(F.split(text, CODE_PATTERN), lambda v: F.struct(
        F.lit("text").alias("type"), F.lit(None).cast("string").alias("lang"), v.alias("value")))
    mixed = F.flatten(F.transform(F.sequence(F.lit(0), F.size(plain) - 1), lambda i: F.array_compact(F.array(F.get(plain, i), F.get(code, i)))))
    return F.filter(mixed, lambda s: (s["type"] == "code") | (s["value"] != ""))
