"""Revision semantics: four different rules that keep one row of a key, and key-set joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _rank_one(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    n = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("__n", n).filter("__n = 1").drop("__n")


def latest_revision(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Newest row of each key by ``order`` (descending expressions with a full tie-break); rows with a NULL key stay."""
    no_key = [F.col(k).isNull() for k in key]
    lacking = no_key[0]
    for c in no_key[1:]:
        lacking = lacking | c
    return _rank_one(df.filter(~lacking), key, order).unionByName(df.filter(lacking))


def latest_awards(awards: DataFrame, key: Sequence[str], order: Sequence[Column], flagged: Column, label: str) -> DataFrame:
    """The last award of each key, then flagged ones and those without a label go; low = label <= 1."""
    return _rank_one(awards, key, order).filter(~F.coalesce(flagged, F.lit(False)) & F.col(label).isNotNull()).withColumn("low", F.col(label) <= 1)


def newest_with_first_date(df: DataFrame, key: Sequence[str], order: Sequence[Column], date: str) -> DataFrame:
    """D3: the newest row's fields with the first date of the key."""
    first = F.min(date).over(W.partitionBy(*key))
    return _rank_one(df.withColumn("__first", first), key, order).withColumn(date, F.col("__first")).drop("__first")


def first_row(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    return _rank_one(df, key, order)


def last_write(df: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """The row with the highest ``seq`` of each key, as a partial aggregate (no sort)."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*key, "r.*")


def running_count(df: DataFrame, key: Sequence[str], order: Sequence[Column], what: Column, name: str) -> DataFrame:
    """How often ``what`` held up to each row of its key; a row with a NULL key counts alone."""
    w = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    counted = F.sum(what.cast("int")).over(w)
    lacking = F.lit(False)
    for k in key:
        lacking = lacking | F.col(k).isNull()
    return df.withColumn(name, F.when(lacking, what.cast("int").cast("bigint")).otherwise(counted))


def distinct_pairs(df: DataFrame, *cols: str) -> DataFrame:
    """D8, D9."""
    return df.select(*cols).distinct()


def first_date(df: DataFrame, key: Sequence[str], date: str, name: str) -> DataFrame:
    """F1."""
    return df.withColumn(name, F.min(date).over(W.partitionBy(*key)))


def revision_weights(df: DataFrame, key: Sequence[str], name: str = "weight") -> DataFrame:
    """One over the rows of the key."""
    return df.withColumn(name, F.lit(1.0) / F.count(F.lit(1)).over(W.partitionBy(*key)))


def open_rows(calls: DataFrame, awards: DataFrame, key: Sequence[str]) -> DataFrame:
    """Calls without any award."""
    return calls.join(awards.select(*key).distinct(), list(key), "left_anti")


def in_scope(awards: DataFrame, calls: DataFrame, key: Sequence[str]) -> DataFrame:
    """Awards of calls in scope."""
    return awards.join(calls.select(*key).distinct(), list(key), "left_semi")


def labelled(calls: DataFrame, awards: DataFrame, key: Sequence[str], label: str) -> DataFrame:
    """Calls with the label of their award; no other column of awards passes."""
    if label in calls.columns:
        raise ValueError(f"{label} must come from awards")
    return calls.join(awards.select(*key, label), list(key), "inner")


def contained(a: DataFrame, b: DataFrame) -> DataFrame:
    """H6: rows of ``a`` that ``b`` lacks, counting repeats."""
    return a.exceptAll(b)


def with_first(df: DataFrame, other: DataFrame, key: Sequence[str], order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """``df`` with columns of the first row of its key in ``other``, NULL where there is none."""
    return df.join(first_row(other, key, order).select(*key, *cols), list(key), "left")
