"""Chunks are cut once where two sides need them, and the short ways of stripping and of finding formulas change nothing."""

import pytest
from pyspark.sql import functions as F

from corpusradar import constants as C
from corpusradar import registry
from corpusradar.functions.text import strip, strip_column
from corpusradar.operators.chunking import has_math

TEXT = "Methods\nfirst line of some words here\nsecond line of other words\nResults\nthird line with numbers 1.5e-3 in it\nlast line of words"


@pytest.mark.parametrize("name", ["neighbor_expand", "replace_partition"])
def test_chunks_are_stored_and_not_cut_again(spark, tmp_path, name):
    rows = [(i, TEXT if i else None, "en", "web", 100 + i) for i in range(6)] + [(3, TEXT, "en", "web", 103)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    registry.load()
    found = registry.QUERIES[name](spark, str(tmp_path))
    assert not [f for f in found.inputFiles() if "documents.parquet" in f]
    if name == "replace_partition":
        assert {(r["paper_id"], r["batch"]) for r in found.collect()} == {(1, "new"), *((i, "old") for i in range(2, 6))}


def test_short_ways_agree_with_the_patterns(spark):
    ends = ["", " ", "\t\n", "\x0b\f\r", "\r\n", "\u0085", " \u0085", " ", "  ", "\n ", "  ", "　", " "]
    cases = [a + m + b for a in ends for m in ("", "x", "a  b", "a \n b", "ä") for b in ends] + [None]
    cases += ["$x$", "$ x", "\\alpha{", "\\frac", "a\\sum", "≈", "1.5e-3", "1.5", "Equation  7", "Equation x", "see Equation 7", "E 7", "e1.5e+3", "$a\nb$"]
    rows = spark.createDataFrame([(c,) for c in cases], "t string")
    t = F.col("t")
    for r in rows.select("t", strip(t).alias("a"), strip_column(t).alias("b"), t.rlike(C.MATH_PATTERN).alias("c"), has_math(t).alias("d")).collect():
        assert (r["a"], r["c"]) == (r["b"], r["d"]), r
