"""Places and quantiles within groups that may be as large as the table.

A window over a group sorts the group in one task. Here rows are dealt into ranges
of (group, order), so a group lies in as many tasks as it needs; each range is
numbered by itself, and offsets of the ranges (one row for each group in a range)
make the numbers run on. The ranges are cut first, since sampling their bounds
twice could give two different ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..lineage import cut


def _ranges(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    # A literal stands in for the missing group of a whole table.
    return cut(df.repartitionByRange(*by, *order).withColumn("__p", F.spark_partition_id()))


def _offsets(parts: DataFrame, by: Sequence[str], weight: Column) -> DataFrame:
    """(__p, by, __before, total) for each group of each range."""
    sizes = parts.groupBy("__p", *by).agg(F.sum(weight).alias("__size"))
    before = F.sum("__size").over(W.partitionBy(*by).orderBy("__p").rowsBetween(W.unboundedPreceding, -1))
    total = F.sum("__size").over(W.partitionBy(*by))
    named = [F.col(c).alias(f"__b{k}") for k, c in enumerate(by)]
    return sizes.select(F.col("__p").alias("__q"), *named, F.coalesce(before, F.lit(0)).alias("__before"), total.alias("__total"))


def _met(parts: DataFrame, offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    same = F.col("__p") == F.col("__q")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__b{k}"))
    return parts.join(offsets, same).drop("__q", *[f"__b{k}" for k in range(len(by))])


def placed(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], place: str = "__k", total: str = "__n") -> DataFrame:
    """``df`` with each row's place in its group (1, 2, ... in a full order) and the group's size."""
    parts = _ranges(df, by, order)
    inside = F.row_number().over(W.partitionBy("__p", *by).orderBy(*order))
    out = _met(parts.withColumn("__i", inside), _offsets(parts, by, F.lit(1)), by)
    return out.withColumn(place, F.col("__before") + F.col("__i")).withColumn(total, F.col("__total")).drop("__p", "__i", "__before", "__total")


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(by, q0, q1, ..., n): interpolated quantiles of the values that are not NULL; nothing holds a group's values together."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    parts = _ranges(counts, by, [value])
    upto = F.sum("__c").over(W.partitionBy("__p", *by).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    met = _met(parts.withColumn("__u", upto), _offsets(parts, by, F.col("__c")), by).withColumn("__end", F.col("__before") + F.col("__u"))
    begin, end = F.col("__end") - F.col("__c"), F.col("__end")
    aggs, outs = [], []
    for k, share in enumerate(shares):
        at = F.lit(float(share)) * (F.col("__total") - 1)
        held = lambda r: (begin <= r) & (r < end)
        aggs += [F.max(F.when(held(F.floor(at)), F.col(value))).alias(f"__l{k}"), F.max(F.when(held(F.ceil(at)), F.col(value))).alias(f"__h{k}")]
        outs.append((F.col(f"__l{k}") + (F.col(f"__h{k}") - F.col(f"__l{k}")) * (F.lit(float(share)) * (F.col("n") - 1) - F.floor(F.lit(float(share)) * (F.col("n") - 1)))).alias(f"q{k}"))
    return met.groupBy(*by).agg(*aggs, F.max("__total").alias("n")).select(*by, *outs, "n")
