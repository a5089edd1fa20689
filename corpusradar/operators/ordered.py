"""Order-dependent columns per key that stay spread out when one key holds much of the data.

A plain window puts a whole key into one task. Here a key is cut into buckets along its order; each
(key, bucket) is its own window, and only one summary row per bucket crosses between buckets. Buckets come from a
column, or are ranges of (key, order) whose boundaries Spark samples: these hold about the same number of rows
whatever the types, the keys and the spacing of times, and a key has at most as many of them as there are tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusradar.session import cut_lineage


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``_bucket``: the range of (keys, order) that a row lies in, in ascending order.

    The rows are written with it, so that everything that follows sees the same boundaries.
    """
    return cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_bucket", F.spark_partition_id()))


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column | None, values: Mapping[str, Column]
) -> DataFrame:
    """Add the value of the directly preceding row of the key (``lag``) for every entry of ``values``."""
    row = F.struct(*[v.alias(n) for n, v in values.items()])
    base = in_ranges(df, keys, order) if bucket is None else df.withColumn("_bucket", bucket)
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order)
    tails = base.groupBy(*keys, "_bucket").agg(F.max_by(row, F.struct(*order)).alias("_tail"))
    carry = tails.select(*keys, "_bucket", F.lag("_tail").over(W.partitionBy(*keys).orderBy("_bucket")).alias("_carry"))
    joined = base.withColumn("_local", F.lag(row).over(inside)).join(carry, [*keys, "_bucket"])
    previous = F.coalesce("_local", "_carry")
    return joined.select(*df.columns, *[previous[n].alias(n) for n in values])


def with_last_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column | None, values: Mapping[str, Column]
) -> DataFrame:
    """Add the last non-NULL value strictly before each row of the key for every entry of ``values``."""
    cut = in_ranges(df, keys, order) if bucket is None else df.withColumn("_bucket", bucket)
    base = cut.select("*", *[v.alias(f"_v_{n}") for n, v in values.items()])
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    tails = base.groupBy(*keys, "_bucket").agg(*[
        F.max_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), F.struct(*order))).alias(f"_t_{n}") for n in values])
    carry = tails.select(*keys, "_bucket", *[
        F.last(f"_t_{n}", ignorenulls=True).over(across).alias(f"_c_{n}") for n in values])
    local = base.select("*", *[F.last(f"_v_{n}", ignorenulls=True).over(inside).alias(f"_l_{n}") for n in values])
    joined = local.join(carry, [*keys, "_bucket"])
    return joined.select(*df.columns, *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in values])


def median_by_count(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Exact median per key from value counts, so that equal values meet before anything is sorted.

    Distinct values are cut into ranges. Counts per range tell which ones hold the two middle ranks of a key, and only
    within these the values are ranked: no task sees more distinct values than a range has. Without keys there is one
    median, and the counts of the ranges are all that meets in one place. NULL values take no part; NULL is a key.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    parts = in_ranges(counts, keys, [value])
    by_key = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    sums = parts.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_sum"))
    lower, upper = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
    middle = sums.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_k_bucket"), "_sum", F.sum("_sum").over(by_key).alias("_total"),
        (F.sum("_sum").over(by_key.orderBy("_bucket")) - F.col("_sum")).alias("_before")).where(
        (F.col("_before") < upper) & (F.col("_before") + F.col("_sum") >= lower))
    same = F.col("_bucket") == F.col("_k_bucket")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    ranked = parts.join(middle, same).select(
        *keys, value, "_n", "_total", (F.col("_before") + F.sum("_n").over(W.partitionBy(*keys, "_bucket").orderBy(value))).alias("_upto"))
    holds = lambda rank: (rank <= F.col("_upto")) & (rank > F.col("_upto") - F.col("_n"))
    return ranked.groupBy(*keys).agg(
        ((F.max(F.when(holds(lower), F.col(value))) + F.max(F.when(holds(upper), F.col(value)))) / 2).alias(name))
