"""Top-k per subscriber with explicit ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalars as fn
from ..lineage import cut

#: Most rows of best lots whose keys are broadcast.
SHORT = 1_000_000


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int | Column, name: str = "rank") -> DataFrame:
    """The first k of each group (the k is the feature)."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def for_subscriptions(lots: DataFrame, subs: DataFrame, sub: str, score: str, tie: str) -> DataFrame:
    """Each subscription's flagged lots in its market with time left, best first, up to its cap.

    ``subs``: sub, code_prefixes, region_prefixes, min_days, max_picks (default 5). Lots: code,
    region, days_left, flag, score. Prefix lists are exploded, so lots meet subscriptions by equality.
    """
    s = subs.select(sub, F.coalesce("region_prefixes", F.array().cast("array<string>")).alias("regions"), "min_days", F.coalesce("max_picks", F.lit(5)).alias("cap"), F.explode("code_prefixes").alias("prefix"))
    widths = [r["w"] for r in s.select(F.length("prefix").alias("w")).distinct().collect()]  # lengths of prefixes: at most eight
    cuts = F.array_distinct(F.array(*[fn.level(F.col("code"), w) for w in sorted(widths)])) if widths else F.array().cast("array<string>")
    met = lots.filter("flag").withColumn("prefix", F.explode(F.array_compact(cuts))).join(s, "prefix")
    region = (F.size("regions") == 0) | F.exists("regions", lambda p: F.coalesce("region", F.lit("")).startswith(p))
    ok = met.filter(region & fn.deadline_ok(F.col("days_left"), F.col("min_days"))).drop("prefix", "regions").dropDuplicates([sub, tie])
    return top_k(ok, [sub], [F.desc(score), F.col(tie)], F.col("cap")).drop("cap", "min_days")


def merged_picks(lots: DataFrame, wanted: DataFrame, company: str, trade: str, score: str, tie: str, n: int, seen: DataFrame) -> DataFrame:
    """A company's best n over all its trades; lots already picked take a slot but are not given again."""
    order = [F.desc(score), F.col(tie)]
    # What is not among the best n lots of a trade is not among those of a company with that trade.
    best = cut(top_k(lots.dropDuplicates([trade, tie]), [trade], order, n, "slot").drop("slot"))
    ties = best.select(tie).distinct()
    known = seen.join(F.broadcast(ties) if best.count() <= SHORT else ties, tie, "left_semi").select(company, tie)
    met = best.join(wanted.select(company, trade).distinct(), trade).dropDuplicates([company, tie])
    return top_k(met, [company], order, n, "slot").join(known, [company, tie], "left_anti")


def own_win(wins: DataFrame, firm: str, tenders: str, date: str, tie: str) -> DataFrame:
    """The win with the fewest bidders (unknown counts 99), then the newest."""
    order = F.struct(F.coalesce(tenders, F.lit(99)).alias("n"), (-F.unix_date(date)).alias("d"), F.col(tie).alias("t"))
    rest = [c for c in wins.columns if c != firm]
    return wins.groupBy(firm).agg(F.min_by(F.struct(*rest), order).alias("w")).select(firm, "w.*")


def picks_or_ranked(picks: DataFrame, ranked: DataFrame, sub: str, order: Sequence[Column], n: int) -> DataFrame:
    """A subscriber's picks, or the best ranked lots where there is none."""
    rest = ranked.join(picks.select(sub).distinct(), sub, "left_anti")
    return top_k(picks.unionByName(rest), [sub], order, n)


def due(watched: DataFrame, written: DataFrame, lots: DataFrame, firm: str, today: str, rest_days: int = 21, least: int = 1) -> DataFrame:
    """Watched small firms not written to within the rest, with at least ``least`` candidates; most first."""
    recent = written.filter(F.datediff(F.lit(today).cast("date"), F.col("at")) < rest_days).select(firm)
    n = lots.groupBy(firm).agg(F.count(F.lit(1)).alias("lots"), F.min("deadline").alias("deadline"))
    return watched.join(recent, firm, "left_anti").join(n, firm).filter(F.col("lots") >= least).orderBy(F.desc("lots"), "deadline", firm)


def guard_sample(delivered: DataFrame, read: DataFrame, key: Sequence[str], at: str, n: int = 10) -> DataFrame:
    """The newest delivered rows not read yet."""
    return delivered.join(read.select(*key), list(key), "left_anti").orderBy(F.desc(at), *key).limit(n)


def reference_list(wins: DataFrame, notices: DataFrame, firm: str, key: Sequence[str], date: str, ref: str, cap: int = 6) -> DataFrame:
    """A firm's newest distinct notice references, ``cap`` of them."""
    one = wins.select(firm, *key).distinct().join(notices.select(*key, date, ref), list(key)).groupBy(firm, ref).agg(F.max(date).alias(date))
    return top_k(one, [firm], [F.desc(date), F.col(ref)], cap)


def outreach(wins: DataFrame, firm: str, trade: str, size: str, tenders: str, region: str, date: str) -> DataFrame:
    """Wins, single-bid wins, modal size (lowest on ties), trades by frequency, regions and the last win of each firm."""
    per = wins.groupBy(firm, trade).agg(F.count(F.lit(1)).alias("n")).groupBy(firm)
    trades = per.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(trade).alias("t")))), lambda s: s["t"]), ";").alias("trades"))
    one = wins.groupBy(firm).agg(
        F.count(F.lit(1)).alias("wins"), F.count_if(F.col(tenders) == 1).alias("single_wins"), F.mode(size, True).alias("size"), F.array_join(F.array_sort(F.collect_set(region)), ";").alias("regions"), F.max(date).alias("last_win")
    )
    return one.join(trades, firm)
