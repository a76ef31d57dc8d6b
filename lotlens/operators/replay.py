"""What a replay over past weeks says: flags by trade, ranks, firms' targets, and its document."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from . import stats

SCHEMA_VERSION = 3
FIELDS = ("procedure_id", "lot_id", "cpv3", "flag", "n_tenders")


def flag_table(lots: DataFrame, by: Sequence[str], flag: Column, truth: Column) -> DataFrame:
    """The confusion figures of each trade."""
    return stats.confusion(lots.filter(truth.isNotNull()), flag, truth, by)


def rank_stats(lots: DataFrame, in_trade: DataFrame, mature: DataFrame, key: Sequence[str], month: str, score: str, tie: str, truth: Column) -> DataFrame:
    """Top slice of the replayed lots of a trade in mature months."""
    held = lots.join(in_trade.select(*key).distinct(), list(key), "left_semi").join(F.broadcast(mature.select(month)), month, "left_semi")
    return stats.top_slice(held.withColumn("__all", F.lit(1)), ["__all"], score, tie, truth).drop("__all")


def target_rows(targets: DataFrame, flags: DataFrame, firm: str = "firm") -> DataFrame:
    """Picks, graded and lonely lots and own wins of each target firm.

    ``targets``: firm, codes, regions (empty or NULL: all). ``flags``: lot, code, region (NULL
    fits all), n_tenders, winner. Codes are exploded, so the join is by equality.
    """
    t = targets.select(firm, F.explode("codes").alias("code"), F.coalesce("regions", F.array().cast("array<string>")).alias("regions")).distinct()
    met = flags.join(t, "code").filter((F.size("regions") == 0) | F.col("region").isNull() | F.array_contains("regions", F.col("region")))
    n = met.groupBy(firm).agg(
        F.count(F.lit(1)).alias("picks"), F.count("n_tenders").alias("graded"), F.count_if(F.col("n_tenders") <= 1).alias("lonely"), F.count("winner").alias("winner_known"),
        F.count_if(F.col("winner") == F.col(firm)).alias("won"),
    )
    return targets.select(firm).join(n, firm, "left").fillna(0, ["picks", "graded", "lonely", "winner_known", "won"])


def outcomes_between(lots: DataFrame, date: str, after: str, until: str) -> DataFrame:
    """Rows whose outcome came after one date and by another."""
    d = F.col(date)
    return lots.filter((d > F.lit(after).cast("date")) & (d <= F.lit(until).cast("date")))


def simulation_check(picks: DataFrame, trade: str, company: str, truth: Column, base: Column) -> tuple[DataFrame, DataFrame]:
    """Hit rate against the base by trade, and companies whose picks mostly hit."""
    by_trade = picks.groupBy(trade).agg(F.count(F.lit(1)).alias("n"), F.avg(truth.cast("double")).alias("hit"), F.avg(base.cast("double")).alias("base"))
    per = picks.groupBy(company).agg(F.avg(truth.cast("double")).alias("hit"))
    return by_trade, per.agg(F.count(F.lit(1)).alias("companies"), F.count_if(F.col("hit") > 0.5).alias("mostly_hit"))


def spread_against_chance(df: DataFrame, group: str, cell: str, key: str, truth: str, seed: str = "7", least: int = 30) -> DataFrame:
    """(group, cells, rows, spread, chance_spread): the spread of the rates of a group's cells, and the same after dealing the outcomes anew within the group."""
    dealt = stats.permuted(df.select(group, cell, key, truth), [group], key, truth, seed)
    rates = dealt.groupBy(group, cell).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(truth).cast("double")).alias("rate"), F.avg(F.col("shuffled").cast("double")).alias("chance")).filter(F.col("n") >= least)
    return rates.groupBy(group).agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("rows"), F.stddev_samp("rate").alias("spread"), F.stddev_samp("chance").alias("chance_spread"))


def cardinalities(df: DataFrame, cols: Sequence[str], least: int = 30) -> DataFrame:
    """(column, distinct, large): values of each column and those with at least ``least`` rows."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("x")).select("x.*").filter("value IS NOT NULL")
    n = each.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), F.count_if(F.col("n") >= least).alias("large"))


def document(lots: DataFrame, meta: Mapping[str, object]) -> str:
    """The replay as one JSON document: one line of the result table per lot that was flagged or scored."""
    rows = [json.loads(x) for x in lots.toJSON().toLocalIterator()]
    return json.dumps({"schema": SCHEMA_VERSION, **meta, "lots": rows}, sort_keys=True, default=str)


def validate(text: str) -> dict:
    """A document of this version with all its fields, or an error that names what is wrong."""
    doc = json.loads(text)
    if doc.get("schema") != SCHEMA_VERSION:
        raise ValueError(f"schema {doc.get('schema')}, not {SCHEMA_VERSION}")
    for k, row in enumerate(doc.get("lots") if isinstance(doc.get("lots"), list) else [{}]):
        if lost := [f for f in FIELDS if f != "n_tenders" and f not in row]:
            raise ValueError(f"lot {k} lacks {lost}")
    return doc
