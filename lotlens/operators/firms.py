"""Firms: core roots, keyword lists, reads against trades, contacts and the index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalars as fn

# Fixed values.
CORE_SHARE, CORE_LEAST = 0.5, 2


def core_roots(refs: DataFrame, families: DataFrame, firm: str = "firm", ref: str = "ref", share: float = CORE_SHARE) -> DataFrame:
    """(firm, root, n): the roots that make a firm's trade.

    ``refs``: firm, ref, root, in_title, one row for each root of a reference; ``families``: root,
    family. Of the references with roots: roots in half of them (two at least) are core; a
    single reference counts by its title's roots; else the most frequent family that reaches
    the need gives its roots found twice; else the roots of all titles. A root that holds
    another kept one goes.
    """
    bearing = refs.groupBy(firm).agg(F.count_distinct(ref).alias("bearing"), F.max(F.col("in_title").cast("int")).alias("titled"))
    n = refs.groupBy(firm, "root").agg(F.count_distinct(ref).alias("n"), F.max(F.col("in_title").cast("int")).alias("in_title")).join(bearing, firm)
    need = F.when(F.col("bearing") <= 1, 1).otherwise(F.greatest(F.lit(CORE_LEAST), fn.pseudo_ceil(F.col("bearing"), share)))
    n = n.withColumn("need", need).withColumn("core", (F.col("n") >= F.col("need")) & ((F.col("bearing") > 1) | (F.col("titled") == 0) | (F.col("in_title") == 1)))
    by_family = refs.join(families, "root").groupBy(firm, "family").agg(F.count_distinct(ref).alias("hits")).join(bearing, firm)
    by_family = by_family.filter(F.col("hits") >= F.greatest(F.lit(CORE_LEAST), fn.pseudo_ceil(F.col("bearing"), share)))
    top = by_family.groupBy(firm).agg(F.max_by("family", F.struct("hits", "family")).alias("top"))
    any_core = n.groupBy(firm).agg(F.max(F.col("core").cast("int")).alias("any_core"))
    marked = n.join(families, "root", "left").join(top, firm, "left").join(any_core, firm)
    second = F.coalesce((F.col("family") == F.col("top")) & (F.col("n") >= 2), F.lit(False))
    marked = marked.withColumn("second", second).withColumn("any_second", F.max(second.cast("int")).over(W.partitionBy(firm)))
    kept = F.when(F.col("any_core") == 1, F.col("core")).when(F.col("any_second") == 1, F.col("second")).otherwise(F.col("in_title") == 1)
    held = marked.filter(kept).select(firm, "root", "n").distinct()
    pruned = held.groupBy(firm).agg(fn.subsume(F.collect_set("root")).alias("kept"))
    return held.join(pruned, firm).filter(F.array_contains("kept", F.col("root"))).select(firm, "root", "n")


def trade_read(similar: DataFrame, firm: str, label: str, cos: str, own: Column, foreign: Column, margin: float = 0.225) -> DataFrame:
    """A firm's best reading of its own and of foreign labels, and whether they contradict it."""
    n = similar.groupBy(firm).agg(F.max(F.when(own, F.col(cos))).alias("own_read"), F.max(F.when(foreign, F.col(cos))).alias("foreign_read"), F.max(cos).alias("best_read"), F.max_by(label, F.struct(cos, label)).alias("reads"))
    return n.withColumn("contradicted", F.coalesce(F.col("foreign_read") - F.col("own_read") >= margin, F.lit(False)))


def voted(df: DataFrame, firm: str, fields: Sequence[str]) -> DataFrame:
    """The most common value of each contact field (the lowest among equals)."""
    return df.groupBy(firm).agg(*[F.mode(c, True).alias(c) for c in fields])


def with_hysteresis(dated: DataFrame, key: Sequence[str], at: str, share: str, enter: float, leave: float) -> DataFrame:
    """states that switch on at ``enter`` and off below ``leave``: a fold over a key's dated shares (few each)."""
    series = dated.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(share).alias("share")))).alias("s"))
    state = F.aggregate("s", F.lit(False), lambda on, x: F.when(x["share"] >= enter, True).when(x["share"] < leave, False).otherwise(on))
    return series.select(*key, state.alias("on"))


def index(wins: DataFrame, core: DataFrame, firm: str, trade: str) -> DataFrame:
    """Counts, trades and core roots of each firm."""
    one = wins.groupBy(firm).agg(F.count(F.lit(1)).alias("wins"), F.array_join(F.array_sort(F.collect_set(trade)), ";").alias("trades"))
    roots = core.groupBy(firm).agg(F.array_join(F.array_sort(F.collect_set("root")), ";").alias("roots"))
    return one.join(roots, firm, "left")
