"""Coverage- and maturity-aware market figures, firm profiles and pricing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalars as fn

# Fixed values.
COVERAGE_FLOOR, MATURE_FLOOR, RECENT_MONTHS, SMALL_SAMPLE = 0.25, 0.35, 12, 30
WIN_UPLIFT, MARGIN, PRICE_SHARE, FLAT_FLOOR, PCT_DEAL_MIN, MIN_RECS_YEAR, MIN_PROSPECT_WINS = 0.05, 0.08, 0.2, 75.0, 500000, 12, 2
LIFT_COMMON, LIFT_MIN, LIFT_STRONG = 400, 3.0, 8.0


def coverage(lots: DataFrame, month: str = "month", resolved: str = "n_tenders") -> DataFrame:
    """Lots and resolved lots of each month; covered = at least a quarter of the largest month, mature = covered and 35 % resolved."""
    n = lots.filter(F.col(month).isNotNull()).groupBy(month).agg(F.count(F.lit(1)).alias("lots"), F.count(resolved).alias("resolved"))
    # One row per month: a window over all of them is a few hundred rows at any scale.
    n = n.withColumn("covered", F.col("lots") >= F.lit(COVERAGE_FLOOR) * F.max("lots").over(W.partitionBy()))
    return n.withColumn("mature", F.col("covered") & (F.col("resolved") / F.col("lots") >= MATURE_FLOOR))


def recent_mature(months: DataFrame, month: str = "month", last: int = RECENT_MONTHS) -> DataFrame:
    """The last mature months."""
    return months.filter("mature").orderBy(F.desc(month)).limit(last).select(month)


def low_bid_rate(lots: DataFrame, months: DataFrame, by: Sequence[str] = (), month: str = "month", label: str = "n_tenders") -> DataFrame:
    """Share of resolved lots with at most one tender, in mature months (months are few and broadcast)."""
    held = lots.join(F.broadcast(months.filter("mature").select(month)), month, "left_semi").filter(F.col(label).isNotNull())
    return held.groupBy(*by).agg(F.avg((F.col(label) <= 1).cast("double")).alias("low_rate"), F.count(F.lit(1)).alias("resolved"))


def grouped_slices(lots: DataFrame, by: str, value: str, label: str, top: int | None = None) -> DataFrame:
    """Lots, median value, resolved, low share and a small-sample mark; NULL groups dropped, top groups by lots."""
    n = lots.filter(F.col(by).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("lots"), F.percentile(value, 0.5).alias("median_value"), F.count(label).alias("resolved"), F.avg((F.col(label) <= 1).cast("double")).alias("low_rate")
    )
    n = n.withColumn("small_sample", F.col("resolved") < SMALL_SAMPLE)
    return n if top is None else n.orderBy(F.desc("lots"), by).limit(top)


def trade_figures(lots: DataFrame, by: Sequence[str], label: str, least: int = SMALL_SAMPLE) -> DataFrame:
    """Shares of 0, 1, 2-3, 4-6 and 7+ tenders; NULL with fewer than ``least`` awarded."""
    n = F.count(label)
    share = lambda cond: F.when(n >= least, F.count_if(cond) / n)
    c = F.col(label)
    return lots.groupBy(*by).agg(
        n.alias("awarded"), share(c == 0).alias("none"), share(c == 1).alias("one"), share(c.between(2, 3)).alias("two_three"), share(c.between(4, 6)).alias("four_six"), share(c >= 7).alias("seven_up")
    )


def spread(lots: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """E5: quartiles (interpolated) and the upper median v[n // 2]."""
    n = F.count(value)
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    ranked = lots.filter(F.col(value).isNotNull()).withColumn("__k", F.row_number().over(W.partitionBy(*by).orderBy(value))).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*by)))
    upper = F.max(F.when(F.col("__k") == F.floor(F.col("__n") / 2) + 1, F.col(value)))
    return ranked.groupBy(*by).agg(n.alias("n"), q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), upper.alias("upper_median"))


def trade_page(lots: DataFrame, by: Sequence[str], buyer: str, value: str, label: str, bond: str, months: int) -> DataFrame:
    """E5: volume a year, repeat buyers, closed without winner, bond share."""
    per = lots.groupBy(*by, buyer).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 0).alias("closed"), F.count(label).alias("resolved"), F.count_if(F.col(bond)).alias("bonds"), F.count(bond).alias("told")
    )
    out = per.groupBy(*by).agg(
        F.sum("n").alias("lots"), F.count(F.lit(1)).alias("buyers"), F.count_if(F.col("n") > 1).alias("repeat_buyers"), F.sum("closed").alias("closed"), F.sum("resolved").alias("resolved"),
        F.sum("bonds").alias("bonds"), F.sum("told").alias("told"),
    )
    return out.select(
        *by, "lots", (F.col("lots") * 12 / F.lit(months)).alias("per_year"), "buyers", "repeat_buyers",
        F.try_divide(F.col("closed"), F.col("resolved")).alias("closed_share"), F.try_divide(F.col("bonds"), F.col("told")).alias("bond_share"),
    )


def firm_rows(wins: DataFrame, firm: str, date: str, value: str, label: str, region: str, buyer: str) -> DataFrame:
    """Wins, low wins, median value, distinct regions and buyers, and wins before and from the median award date.

    The split date is one number of the whole table, joined as a broadcast row.
    """
    # A day is a number, of which there are few: the median is taken of counts by day.
    days = wins.groupBy(F.unix_date(date).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    split = F.broadcast(days.agg(F.percentile("day", 0.5, F.col("n")).alias("split")))
    w = wins.crossJoin(split)
    late = F.unix_date(date) >= F.col("split")
    # Wins by region and buyer first: distinct values are then counted over far fewer rows.
    per = w.groupBy(firm, region, buyer).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) <= 1).alias("low"), F.count_if(~late).alias("early"), F.count_if(late).alias("late"))
    one = per.groupBy(firm).agg(
        F.sum("n").alias("wins"), F.sum("low").alias("low_wins"), F.count_distinct(region).alias("regions"), F.count_distinct(buyer).alias("buyers"), F.sum("early").alias("early"), F.sum("late").alias("late")
    )
    return one.join(wins.groupBy(firm).agg(F.percentile(value, 0.5).alias("median_value")), firm)


def modal_value(df: DataFrame, by: Sequence[str], value: str, seq: str) -> DataFrame:
    """Most frequent value (first seen wins ties), with * if others occur."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("first"))
    one = n.groupBy(*by).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias("modal"), F.count(F.lit(1)).alias("kinds"))
    return one.select(*by, F.when(F.col("kinds") > 1, F.concat("modal", F.lit("*"))).otherwise(F.col("modal")).alias("modal"))


def alias_groups(df: DataFrame, name: str) -> DataFrame:
    """Spellings that share a key, where there are two or more."""
    n = df.select(name).distinct().withColumn("alias", fn.alias_key(F.col(name)))
    return n.groupBy("alias").agg(F.count(F.lit(1)).alias("spellings"), F.array_join(F.array_sort(F.collect_set(name)), ";").alias("names")).filter("spellings > 1")


def trade_economics(lots: DataFrame, months: DataFrame, by: Sequence[str], value: str, month: str = "month") -> DataFrame:
    """Lots a year over covered months, and the median value."""
    covered = months.filter("covered")
    n = covered.count()  # a few hundred months at most
    held = lots.join(F.broadcast(covered.select(month)), month, "left_semi")
    return held.groupBy(*by).agg((F.count(F.lit(1)) * F.lit(12.0) / F.lit(max(n, 1))).alias("per_year"), F.percentile(value, 0.5).alias("median_value"))


def firm_price(recs_year: Column, median_value: Column, low_rate: Column) -> Column:
    """struct(value, price, model): what an uplift in wins is worth a year and what share of it is asked."""
    value = recs_year * low_rate * WIN_UPLIFT * median_value * MARGIN
    price = F.greatest(value * PRICE_SHARE / 12, F.lit(FLAT_FLOOR))
    return F.struct(value.alias("value"), price.alias("price"), F.when(median_value >= PCT_DEAL_MIN, "percent").otherwise("flat").alias("model"))


def prospects(wins: DataFrame, firm: str, region: str, value: str, low_rate: DataFrame, per_region: DataFrame, contactable: Column) -> DataFrame:
    """Firms merged by alias key; recommendations a year over their own regions; reasons against contact, '' if none."""
    w = wins.withColumn("alias", fn.alias_key(F.col(firm)))
    one = w.groupBy("alias").agg(F.count(F.lit(1)).alias("wins"), F.percentile(value, 0.5).alias("median_value"), F.max(contactable).alias("contactable"))
    regions = w.select("alias", region).distinct().join(per_region, region).groupBy("alias").agg(F.sum("per_year").alias("recs_year"))
    out = one.join(regions, "alias", "left").crossJoin(F.broadcast(low_rate.select("low_rate"))).withColumn("recs_year", F.coalesce("recs_year", F.lit(0.0)))
    why = fn.reasons((F.col("wins") < MIN_PROSPECT_WINS, "few wins"), (F.col("recs_year") < MIN_RECS_YEAR, "few lots"), (~F.col("contactable"), "no contact"))
    p = firm_price(F.col("recs_year"), F.col("median_value"), F.col("low_rate"))
    return out.withColumn("p", p).select("alias", "wins", "median_value", "recs_year", F.col("p.value").alias("value"), F.col("p.price").alias("price"), F.col("p.model").alias("model"), F.array_join(why, "; ").alias("against"))


def rank_trades(prospect_rows: DataFrame, trade: str) -> DataFrame:
    """Trades by the sum of their prospects' prices, with the share of the top three and the upper median price."""
    ok = prospect_rows.filter("against = ''")
    w = W.partitionBy(trade).orderBy(F.desc("price"), "alias")
    n = F.count(F.lit(1)).over(W.partitionBy(trade))
    r = ok.withColumn("__k", F.row_number().over(w)).withColumn("__n", n)
    out = r.groupBy(trade).agg(
        F.sum("price").alias("pool"), F.count(F.lit(1)).alias("prospects"), F.sum(F.when(F.col("__k") <= 3, F.col("price")).otherwise(0.0)).alias("top3"),
        F.max(F.when(F.col("__k") == F.col("__n") - F.floor(F.col("__n") / 2), F.col("price"))).alias("upper_median"),
    )
    return out.select(trade, "pool", "prospects", (F.col("top3") / F.col("pool")).alias("top3_share"), "upper_median")


def match_trades(lots: DataFrame, trades: DataFrame, title: str, body: str | None = None) -> DataFrame:
    """C14: lots whose text holds any term of a trade and none of its exclusions.

    ``trades`` (trade, terms, exclude) is a short hand-kept list, so it is broadcast and the
    join is one pass over the lots.
    """
    text = F.lower(F.concat_ws(" ", title, *([body] if body else [])))
    t = F.broadcast(trades.select("trade", "terms", F.coalesce("exclude", F.array().cast("array<string>")).alias("exclude")))
    hit = F.exists("terms", lambda x: F.contains(F.col("__text"), x)) & ~F.exists("exclude", lambda x: F.contains(F.col("__text"), x))
    return lots.withColumn("__text", text).join(t, hit).drop("__text", "terms", "exclude")


def trade_overlap(matched: DataFrame, lot: str) -> DataFrame:
    """Lots that more than one trade claims."""
    return matched.groupBy(lot).agg(F.count_distinct("trade").alias("trades")).filter("trades > 1")


def vocabulary_lift(texts: DataFrame, key: str, text: str, inside: Column, common: int = LIFT_COMMON) -> DataFrame:
    """Words of the slice by lift = share inside / max(share outside, 1e-4), among its most common words."""
    words = texts.select(key, inside.alias("__in"), F.explode(F.array_distinct(fn.tokens(F.col(text), 5))).alias("word"))
    n = words.groupBy("word").agg(F.count_if("__in").alias("n_in"), F.count_if(~F.col("__in")).alias("n_out")).filter("n_in > 0")
    size = F.broadcast(texts.agg(F.count_if(inside).alias("s_in"), F.count_if(~inside).alias("s_out")))
    top = n.orderBy(F.desc("n_in"), "word").limit(common).crossJoin(size)
    lift = F.col("n_in") / F.col("s_in") / F.greatest(F.try_divide(F.col("n_out"), F.col("s_out")), F.lit(1e-4))
    return top.select("word", "n_in", "n_out", lift.alias("lift")).filter(F.col("lift") >= LIFT_MIN).withColumn("strong", F.col("lift") >= LIFT_STRONG)


def slice_matrix(df: DataFrame, a: str, b: str, truth: Column, least: int = 25) -> DataFrame:
    """Rate by both keys, each key and overall (one pass with grouping sets), cells of at least ``least`` rows."""
    n = df.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.avg(truth.cast("double")).alias("rate"), F.grouping_id().cast("bigint").alias("level"))
    return n.filter(F.col("n") >= least)


def rejected(prospect_rows: DataFrame) -> DataFrame:
    """(reason, firms): why firms are no prospects; a firm may have several reasons."""
    each = prospect_rows.filter("against <> ''").select("alias", F.explode(F.split("against", "; ")).alias("reason"))
    return each.groupBy("reason").agg(F.count(F.lit(1)).alias("firms"))
