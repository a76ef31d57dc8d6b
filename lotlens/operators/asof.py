"""Time travel: worlds as of a date, as-of joins, strictly-before history and versions in force."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ranks import placed


class World:
    """Every table as it was known before a date, as filtered views (nothing is copied)."""

    def __init__(self, before: str, **tables: tuple[DataFrame, str]):
        self.before = before
        self.tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        try:
            df, date = self.tables[name]
        except KeyError:
            raise AttributeError(name) from None
        return rewind(df, date, F.lit(self.before).cast("date"))


def rewind(df: DataFrame, date: str, before: Column) -> DataFrame:
    """L1: rows dated strictly before; rows without a date never."""
    return df.filter(F.col(date) < before)


def worlds(df: DataFrame, date: str, cutoffs: DataFrame, cutoff: str = "cutoff") -> DataFrame:
    """Each row with every cutoff after its date; cutoffs are weeks, so few, and broadcast."""
    return df.join(F.broadcast(cutoffs), F.col(date) < F.col(cutoff))


def cutoffs(spark, first: str, last: str, days: int) -> DataFrame:
    return spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}', INTERVAL {int(days)} DAY)) AS cutoff")


def last_before_else_last(facts: DataFrame, key: Sequence[str], at: str, marks: DataFrame, made: str, tie: str) -> DataFrame:
    """For each fact the last mark made at or before it, else the last mark at all; one row per fact key.

    ``facts`` has one row per key. The choice is a maximum (no sort of a key's marks).
    """
    cols = [c for c in marks.columns if c not in key]
    both = facts.join(marks, list(key))
    order = F.struct((F.col(made) <= F.col(at)).alias("in_time"), F.col(made).alias("made"), F.col(tie).alias("tie"))
    best = both.groupBy(*key, at).agg(F.max_by(F.struct(*cols), order).alias("m"))
    return best.select(*key, at, "m.*")


def history_before(df: DataFrame, by: Sequence[str], date: str, own: Sequence[str], value: str) -> DataFrame:
    """Count and sum of ``value`` of the same group strictly before each row's day, the row's own key left out."""
    day = F.unix_date(F.col(date).cast("date"))
    before = W.partitionBy(*by).orderBy(day).rangeBetween(W.unboundedPreceding, -1)
    mine = W.partitionBy(*by, *own).orderBy(day).rangeBetween(W.unboundedPreceding, -1)
    known = F.col(value).isNotNull().cast("bigint")
    n = F.coalesce(F.sum(known).over(before), F.lit(0)) - F.coalesce(F.sum(known).over(mine), F.lit(0))
    s = F.coalesce(F.sum(value).over(before), F.lit(0)) - F.coalesce(F.sum(value).over(mine), F.lit(0))
    return df.withColumn("n_before", n).withColumn("sum_before", s)


def in_force(versions: DataFrame, key: Sequence[str], since: str, version: str, at: Column) -> DataFrame:
    """The version in force at a time: the latest begun, the highest number among equals."""
    cols = [c for c in versions.columns if c not in key]
    begun = versions.filter(F.col(since) <= at)
    return begun.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct(since, version)).alias("v")).select(*key, "v.*")


def learned_by(refs: DataFrame, key: Sequence[str], ref: str, learned: str, at: Column) -> DataFrame:
    """References known by a time, distinct, with the time first learned."""
    return refs.filter(F.col(learned) <= at).groupBy(*key, ref).agg(F.min(learned).alias(learned))


def training_window(df: DataFrame, key: Sequence[str], date: str, months: int) -> DataFrame:
    """Keys first seen within calendar months of the newest date (strictly), all their rows or none."""
    first = F.min(date).over(W.partitionBy(*key))
    newest = F.broadcast(df.agg(F.add_months(F.max(date), -months).alias("__edge")))
    return df.withColumn("__first", first).crossJoin(newest).filter("__first > __edge").drop("__first", "__edge")


def temporal_split(df: DataFrame, key: Sequence[str], date: str, share: float = 0.8) -> DataFrame:
    """Train or test by the key's first date against a quantile of first dates; no key straddles."""
    first = df.groupBy(*key).agg(F.min(F.unix_date(F.col(date).cast("date"))).alias("first_day"))
    edge = F.broadcast(first.agg(F.percentile("first_day", share).alias("edge")))
    return df.join(first, list(key)).crossJoin(edge).withColumn("part", F.when(F.col("first_day") <= F.col("edge"), "train").otherwise("test")).drop("first_day", "edge")


def references_at_close(wins: DataFrame, firm: str, procedure: str, close: str, published: str) -> DataFrame:
    """For each win, the firm's references published by its close from other procedures.

    Counted by merging closes and publications in one sorted window, not by a range join.
    """
    marks = wins.select(firm, procedure, F.col(published).alias("day"), F.lit(1).alias("ref"), F.lit(None).cast("date").alias("closing")).union(
        wins.select(firm, procedure, F.col(close), F.lit(0), F.col(close))
    )
    w = W.partitionBy(firm).orderBy(F.unix_date("day")).rangeBetween(W.unboundedPreceding, 0)
    own = W.partitionBy(firm, procedure).orderBy(F.unix_date("day")).rangeBetween(W.unboundedPreceding, 0)
    n = marks.withColumn("refs_at_close", F.sum("ref").over(w) - F.sum("ref").over(own))
    return n.filter("ref = 0").select(firm, procedure, F.col("closing").alias(close), "refs_at_close").distinct()


def replay(scored: DataFrame, key: Sequence[str], cutoff: str, score: str, flag: Column) -> DataFrame:
    """Best score, first flagged week with its score, first week and times scored over all cutoffs."""
    return scored.groupBy(*key).agg(
        F.max(score).alias("best_score"), F.min(F.when(flag, F.col(cutoff))).alias("flag_week"), F.min_by(F.when(flag, F.col(score)), F.when(flag, F.col(cutoff))).alias("flag_score"),
        F.min(cutoff).alias("first_week"), F.count(F.lit(1)).alias("times_scored"),
    )


def replay_weeks(replayed: DataFrame, week: str, truth: Column) -> DataFrame:
    """Flagged lots and precision by week."""
    return replayed.filter(F.col(week).isNotNull()).groupBy(week).agg(F.count(F.lit(1)).alias("flagged"), F.avg(truth.cast("double")).alias("precision"))


def replay_plan(lots: DataFrame, date: str, cutoffs: DataFrame, cutoff: str = "cutoff", least: int = 300, every: int = 8) -> DataFrame:
    """(cutoff, lots, week, recalibrates): the weeks whose world holds enough lots, numbered, and when the gate is calibrated anew.

    Lots are counted by day first, so the join with the weeks (few, broadcast) is over days.
    """
    days = lots.groupBy(date).agg(F.count(F.lit(1)).alias("n"))
    known = worlds(days, date, cutoffs, cutoff).groupBy(cutoff).agg(F.sum("n").alias("lots")).filter(F.col("lots") >= least)
    week = F.row_number().over(W.orderBy(cutoff)) - 1  # as many rows as weeks
    return known.withColumn("week", week).withColumn("recalibrates", F.col("week") % every == 0)


def replay_ranks(scored: DataFrame, cutoff: str, score: str, tie: str, n: int) -> DataFrame:
    """The first ``n`` lots of every cutoff by score."""
    return placed(scored, [cutoff], [F.desc(score), F.col(tie)], "rank", "scored").filter(F.col("rank") <= n)
