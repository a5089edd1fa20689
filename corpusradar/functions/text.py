"""Small text column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(col: Column) -> Column:
    """Remove leading and trailing white space of any kind (``trim`` removes blanks only)."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def strip_column(col: Column) -> Column:
    """``strip`` of a plain column: cut at the ends without a pattern over the whole text.

    The pattern also drops white space before one last line end of a kind that is no white space to it; such texts, which are rare,
    still go by the pattern. ``col`` is named several times, so it should not be an expression that is dear to work out.
    """
    ends = F.endswith(col, F.lit("\u0085")) | F.endswith(col, F.lit("\u2028")) | F.endswith(col, F.lit("\u2029"))
    return F.when(ends, strip(col)).otherwise(F.btrim(col, F.lit(" \t\n\x0b\f\r")))


def contains_any(col: Column, words: Sequence[str]) -> Column:
    """True where any word occurs as a substring of the lower-cased text (a plain byte search, cheaper than a pattern)."""
    low, hit = F.lower(col), F.lit(False)
    for w in words:
        hit = hit | F.contains(low, F.lit(w.lower()))
    return F.coalesce(hit, F.lit(False))


def matches_any(col: Column, patterns: Sequence[str]) -> Column:
    """True where any pattern matches somewhere, ignoring case."""
    return F.coalesce(col.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


# A word boundary where letters and numbers of any alphabet and the underscore are word characters.
_WORD = r"[\p{L}\p{N}_]"
_EDGE = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def search_tokens(col: Column) -> Column:
    """Search tokens: two or more of a-z, 0-9, underscore, hyphen between word boundaries, on lower-cased text.

    A word with an accented letter gives no fragments of itself; only hyphenated parts that are whole words count.
    """
    return F.regexp_extract_all(F.lower(col), F.lit(rf"{_EDGE}[a-z0-9_\-]{{2,}}{_EDGE}"), F.lit(0))


def words(col: Column) -> Column:
    """White-space separated words, without empty ones."""
    return F.filter(F.split(col, r"\s+"), lambda w: w != "")


def word_set(col: Column, min_len: int) -> Column:
    """Distinct lower-cased words of at least ``min_len`` letters, digits or underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col), F.lit(r"[\p{L}\p{N}_]{%d,}" % min_len), F.lit(0)))


def first_match(col: Column, pattern: str, group: int = 0) -> Column:
    """First match or NULL (``regexp_extract`` gives an empty string for none)."""
    return F.when(col.rlike(pattern), F.regexp_extract(col, pattern, group))


def string_array(items: Sequence[str]) -> Column:
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
_COMMON = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def _character(code: Column) -> Column:
    """The character of a code point; what is none becomes the replacement character."""
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    point = F.when(valid, code).otherwise(0xFFFD)
    return F.when(point == 160, " ").otherwise(F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))


def decode_entities(text: Column) -> Column:
    """Character references by number or name replaced by their characters, in one pass; unknown names stay. No-break space
    becomes a blank. Texts with the most common references only take the short way."""
    simple = text
    for entity, char in _COMMON.items():
        simple = F.replace(simple, F.lit(entity), F.lit(char))
    names = F.create_map(*[x for name, code in sorted(name2codepoint.items()) for x in (F.lit(name), F.lit(code))])

    def piece(p: Column) -> Column:
        inner = F.substring(p, 2, 32)
        body = F.regexp_replace(inner, ";$", "")
        code = (F.when(body.rlike("^#[xX]"), F.conv(F.regexp_replace(body, "^#[xX]", ""), 16, 10).cast("int"))
                .when(body.startswith("#"), F.regexp_replace(body, "^#", "").cast("int")).otherwise(F.try_element_at(names, body)))
        return F.when(p.startswith("&") & p.endswith(";") & (F.length(p) > 2) & code.isNotNull(), _character(code)).otherwise(p)

    pieces = F.regexp_extract_all(text, F.lit(rf"{_ENTITY}|[^&]+|&"), F.lit(0))
    rare = r"&(?!(?:lt|gt|quot|#39|nbsp|amp);)(?:#|[A-Za-z])"
    return F.when(text.rlike(rare), F.array_join(F.transform(pieces, piece), "")).otherwise(simple)
