"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusradar.llm.common import stored


def _pairs(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs]))
    return df.select(rows.alias("p")).select("p.u", "p.v")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) of every node of ``links(a, b)``.

    Links to itself and repeated links change nothing; without links the result is empty. A node with very many links costs
    one partial minimum per task, and joins back on it are split by Spark's skew handling.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = _pairs(edges, ("u", "v"), ("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _pairs(large.join(least, "u"), ("v", "m"), ("u", "m")).where("u <> v").distinct()
        edges = stored(small, "links")
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seen:
            break
        seen = now
    return _pairs(edges, ("u", "v"), ("v", "v")).distinct().toDF("node", "component")
