"""Rates, intervals, rankings and drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalars as fn
from .ranks import placed, quantiles


def confusion(df: DataFrame, flag: Column, truth: Column, by: Sequence[str] = ()) -> DataFrame:
    """Counts, precision, recall, F1 with Wilson bounds, and whether flagging beats flagging everything."""
    n = df.groupBy(*by).agg(
        F.count_if(flag & truth).alias("tp"), F.count_if(flag & ~truth).alias("fp"), F.count_if(~flag & truth).alias("missed"), F.count_if(~flag & ~truth).alias("tn")
    )
    ratio = lambda a, b: a / F.nullif(b.cast("double"), F.lit(0.0))
    flagged, positive, total = F.col("tp") + F.col("fp"), F.col("tp") + F.col("missed"), F.col("tp") + F.col("fp") + F.col("missed") + F.col("tn")
    p, r = ratio(F.col("tp"), flagged), ratio(F.col("tp"), positive)
    low, high = fn.wilson(F.col("tp"), flagged)
    f1 = F.when(p.isNotNull() & r.isNotNull(), F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)))
    return n.withColumns({"precision": p, "recall": r, "f1": f1, "precision_low": low, "precision_high": high, "base": ratio(positive, total), "beats_base": low > ratio(positive, total)})


def top_slice(df: DataFrame, by: Sequence[str], score: str, tie: str, truth: Column, share: float = 0.2) -> DataFrame:
    """Hits among the top share by score (half-even size, at least 1), base rate and lift."""
    ranked = placed(df, by, [F.desc(score), F.col(tie)])
    top = F.col("__k") <= fn.slice_size(F.col("__n"), share)
    out = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(top).alias("k"), F.avg(F.when(top, truth.cast("double"))).alias("hit"), F.avg(truth.cast("double")).alias("base")
    )
    return out.withColumn("lift", F.col("hit") / F.nullif(F.col("base"), F.lit(0.0)))


def auc(df: DataFrame, by: Sequence[str], score: str, truth: Column) -> DataFrame:
    """Area under ROC by average ranks (ties half); NULL if a class is empty.

    Ranks come from counts per distinct score, so the sort is over scores, not rows.
    """
    per = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"), F.count_if(truth).alias("p"))
    w = W.partitionBy(*by).orderBy(score).rowsBetween(W.unboundedPreceding, 0)
    ranked = per.withColumn("rk", F.sum("n").over(w) - (F.col("n") - 1) / 2)
    out = ranked.groupBy(*by).agg(F.sum(F.col("rk") * F.col("p")).alias("s"), F.sum("p").alias("positives"), F.sum(F.col("n") - F.col("p")).alias("negatives"))
    p = F.col("positives").cast("double")
    return out.withColumn("auc", (F.col("s") - p * (p + 1) / 2) / F.nullif(p * F.col("negatives"), F.lit(0.0))).drop("s")


def average_precision(df: DataFrame, by: Sequence[str], score: str, truth: Column, weight: Column) -> DataFrame:
    """Sum of recall steps times precision over distinct scores, weighted."""
    per = df.groupBy(*by, score).agg(F.sum(F.when(truth, weight).otherwise(0.0)).alias("p"), F.sum(weight).alias("n"))
    w = W.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("p").over(W.partitionBy(*by))
    steps = per.withColumn("step", F.col("p") / F.nullif(total, F.lit(0.0)) * F.sum("p").over(w) / F.sum("n").over(w))
    return steps.groupBy(*by).agg(F.sum("step").alias("average_precision"), (F.sum("p") / F.sum("n")).alias("base"))


def tiers(df: DataFrame, by: Sequence[str], score: str, tie: str, high: float = 0.1, medium: float = 0.2) -> DataFrame:
    """rank within a batch and HIGH / MEDIUM / LOW by half-even shares."""
    ranked = placed(df, by, [F.desc(score), F.col(tie)], "rank", "batch")
    first = fn.slice_size(F.col("batch"), high)
    return ranked.withColumn("tier", F.when(F.col("rank") <= first, "HIGH").when(F.col("rank") <= first + fn.slice_size(F.col("batch"), medium), "MEDIUM").otherwise("LOW"))


def psi(history: DataFrame, recent: DataFrame, value: str, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """Population stability over quantile bins of the history; NULL with fewer than three distinct edges.

    The edges are one small row; both sides are aggregated once by bin.
    """
    cuts = quantiles(history, [], value, [k / bins for k in range(bins + 1)])
    edges = cuts.select(F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.col(f"q{k}").cast("double") for k in range(bins + 1)])))).alias("edges"))
    inner = lambda e: F.when(F.size(e) >= 3, F.slice(e, 2, F.size(e) - 2))
    both = history.select(F.col(value).alias("v"), F.lit(0).alias("late")).union(recent.select(F.col(value).alias("v"), F.lit(1).alias("late"))).filter("v IS NOT NULL")
    binned = both.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter(inner(F.col("edges")), lambda x: x <= F.col("v"))))
    size = F.max(F.size("edges")).alias("n_edges")
    n = binned.groupBy("bin").agg(F.count_if(F.col("late") == 0).alias("a"), F.count_if(F.col("late") == 1).alias("b"), size)
    every = F.broadcast(binned.agg(F.count_if(F.col("late") == 0).alias("ta"), F.count_if(F.col("late") == 1).alias("tb")))
    p = F.greatest(F.col("a") / F.col("ta"), F.lit(floor))
    q = F.greatest(F.col("b") / F.col("tb"), F.lit(floor))
    return n.crossJoin(every).agg(F.when(F.max("n_edges") >= 3, F.sum((q - p) * F.ln(q / p))).alias("psi"))


def base_rate_band(months: DataFrame, month: str, n: str, rate: str, least: int = 30, months_least: int = 3) -> DataFrame:
    """Whether the newest month's rate leaves mean +- max(2 sample deviations, .02) of the months before."""
    usable = months.filter(F.col(n) >= least)
    newest = F.row_number().over(W.orderBy(F.desc(month)))
    marked = usable.withColumn("__k", newest)
    past = F.col("__k") > 1
    out = marked.agg(
        F.count_if(past).alias("months"), F.max(F.when(F.col("__k") == 1, F.col(rate))).alias("recent"), F.avg(F.when(past, F.col(rate))).alias("mean"),
        F.stddev_samp(F.when(past, F.col(rate))).alias("sigma"),
    )
    width = F.greatest(2 * F.col("sigma"), F.lit(0.02))
    return out.withColumn("drifted", F.when(F.col("months") >= months_least, F.abs(F.col("recent") - F.col("mean")) > width))


def null_jump(df: DataFrame, recent: Column, cols: Sequence[str], limit: float = 0.15) -> DataFrame:
    """Columns whose share of NULLs moved by more than ``limit``; one pass over the table."""
    aggs = []
    for c in cols:
        for name, cond in (("recent", recent), ("past", ~recent)):
            aggs.append(F.avg(F.when(cond, F.col(c).isNull().cast("double"))).alias(f"{c}__{name}"))
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__recent").alias("recent"), F.col(f"{c}__past").alias("past")) for c in cols])
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("jumped", F.abs(F.col("recent") - F.col("past")) > limit)


def median_shift(df: DataFrame, recent: Column, value: str, days: float = 14, share: float = 0.25) -> DataFrame:
    """Medians that differ by max(days, share of the old one) or more."""
    sides = quantiles(df.select(F.when(recent, 1).when(~recent, 0).alias("side"), value).filter("side IS NOT NULL"), ["side"], value, [0.5])
    out = sides.agg(F.max(F.when(F.col("side") == 1, F.col("q0"))).alias("recent"), F.max(F.when(F.col("side") == 0, F.col("q0"))).alias("past"))
    return out.withColumn("shifted", F.abs(F.col("recent") - F.col("past")) >= F.greatest(F.lit(float(days)), share * F.col("past")))


def fill_rates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of filled values by column (a list is filled if not empty), in one pass."""
    def filled(c: str) -> Column:
        kind = df.schema[c].dataType.simpleString()
        return F.coalesce(F.size(c) > 0, F.lit(False)) if kind.startswith("array") else F.col(c).isNotNull()

    one = df.agg(*[F.avg(filled(c).cast("double")).alias(c) for c in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in cols])).alias("r")).select("r.*")


def number_profile(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Least, median, mean, most, and the shares of 1 and 0."""
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.min(v).alias("least"), F.percentile(v, 0.5).alias("median"), F.avg(v).alias("mean"), F.max(v).alias("most"),
        F.avg((v == 1).cast("double")).alias("single"), F.avg((v == 0).cast("double")).alias("none"),
    )


def permuted(df: DataFrame, by: Sequence[str], key: str, value: str, seed: str, name: str = "shuffled") -> DataFrame:
    """Values of a group (of the table without one) dealt anew among its rows by a hash order; repeatable, no collect."""
    drawn = F.md5(F.concat(F.col(key).cast("string"), F.lit("|" + seed)).cast("binary"))
    to = placed(df, by, [key], "__to", "__n").drop("__n")
    dealt = placed(df.select(*by, key, value, drawn.alias("__d")), by, ["__d", key], "__from", "__n")
    dealt = dealt.select(*[F.col(c).alias(f"__g{k}") for k, c in enumerate(by)], "__from", F.col(value).alias(name))
    same = F.col("__to") == F.col("__from")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{k}"))
    return to.join(dealt, same).drop("__to", "__from", *[f"__g{k}" for k in range(len(by))])


def single_feature_audit(df: DataFrame, features: Sequence[str], truth: Column, good: float = 0.85) -> DataFrame:
    """M8: (feature, auc, suspicious): how well each numeric feature alone, up or down, tells the truth; one pass over an exploded row."""
    each = df.select(truth.alias("__t"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])).alias("s")).select("__t", "s.*").filter("x IS NOT NULL AND __t IS NOT NULL")
    found = auc(each, ["feature"], "x", F.col("__t"))
    best = F.greatest(F.col("auc"), 1 - F.col("auc"))
    return found.select("feature", best.alias("auc"), (best >= good).alias("suspicious"))
