"""Profiles and their joins: references, wins, winners, names, mute profiles, traces, recipes, ranks and records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalars as fn
from . import revisions as rv, stats
from .gate import GateConfig, judge_embedding

# Fixed values.
LAND = {
    "DE1": "Baden-Württemberg", "DE2": "Bayern", "DE3": "Berlin", "DE4": "Brandenburg", "DE5": "Bremen", "DE6": "Hamburg", "DE7": "Hessen", "DE8": "Mecklenburg-Vorpommern", "DE9": "Niedersachsen",
    "DEA": "Nordrhein-Westfalen", "DEB": "Rheinland-Pfalz", "DEC": "Saarland", "DED": "Sachsen", "DEE": "Sachsen-Anhalt", "DEF": "Schleswig-Holstein", "DEG": "Thüringen",
}
# What makes a lot findable, in the order it is taken out, and words that say nothing.
FINDABLE = (
    r"\b[\wäöüß.-]*(?:str(?:aße|asse)?\.?|weg|platz|allee|gasse|ring|damm|ufer|chaussee)\s*\d+[a-z]?\b",
    r"\b(?:Am|An der|Im|In der|Auf dem|Zum|Zur)\s+[A-ZÄÖÜ][\wäöüß]+\s+\d+[a-z]?\b",
    r"\bLos\s*\d+\b",
    r"\b\d{2,}[./-]\d+[\w./-]*\b",
    r"\b[A-Z]{2,}[-/]?\d+\b",
    r"[(\[][^)\]]*[)\]]",
)
GENERIC = "installation installationen arbeiten leistungen bauleistungen gewerk gewerke los lose und für der die das des im in am an mit von".split()
MIN_TERM = 5
CALIBRATED_BARS = ("min_relevance", "min_code_hard", "min_code_soft")


def firm_win_rows(awards: DataFrame, calls: DataFrame, key: Sequence[str], winners: str, cols: Sequence[str]) -> DataFrame:
    """(winner, key, cols): a row for each winner of each award whose lot is known; a lot counts once."""
    lots = calls.select(*key, *cols).dropDuplicates(list(key))
    return awards.select(F.explode(winners).alias("winner"), *key).join(lots, list(key))


def wins_of(awards: DataFrame, calls: DataFrame, names: Sequence[str], key: Sequence[str], winners: str, publication: str, date: str) -> DataFrame:
    """(publication, key, date): the calls of lots won by any of ``names``; wins without a published call are left out."""
    won = awards.filter(F.arrays_overlap(F.col(winners), F.array(*[F.lit(n) for n in names]))).select(*key)
    lots = calls.select(*key, publication, date).dropDuplicates(list(key))
    held = won.join(lots, list(key), "left").filter(F.col(publication).isNotNull())
    return held.groupBy(publication).agg(F.min(F.struct(*key, date)).alias("w")).select(publication, *[F.col(f"w.{c}").alias(c) for c in (*key, date)])


def firm_codes(wins: DataFrame, codes: DataFrame, key: Sequence[str], firm: str, code: str) -> DataFrame:
    """(firm, code, n): codes of the lots that a firm won."""
    return wins.select(firm, *key).distinct().join(codes.select(*key, code).distinct(), list(key)).groupBy(firm, code).agg(F.count(F.lit(1)).alias("n"))


def winner_map(awards: DataFrame, key: Sequence[str], order: Sequence[Column], winners: str) -> DataFrame:
    """(key, winners): trimmed names of the latest award revision, whatever its quality; lots without a name are left out."""
    last = rv.first_row(awards, key, order)
    names = F.array_sort(F.array_distinct(F.filter(F.transform(winners, lambda n: F.trim(n)), lambda n: n != "")))
    return last.select(*key, names.alias("winners")).filter(F.size("winners") > 0)


def profile_references(own: DataFrame, learned: DataFrame, sub: str, ref: str, learned_at: str, as_of: str | None) -> DataFrame:
    """H2: a subscription's own references and those learned by ``as_of`` (none without a date), distinct."""
    out = own.select(sub, ref)
    if as_of is not None:
        out = out.union(learned.filter(F.col(learned_at) <= F.lit(as_of).cast("date")).select(sub, ref))
    return out.distinct()


def build_profiles(own: DataFrame, learned: DataFrame, lots: DataFrame, sub: str, ref: str, learned_at: str, as_of: str | None, code: str, buyer: str, kind: str, trusted: DataFrame) -> DataFrame:
    """One row for each subscription: references, missing own references, trusted codes, buyers and contract types.

    An own reference that ``lots`` lacks is told in ``missing`` (its profile is not to be used);
    a learned one is left out. ``lots``: ref, code, buyer, kind; ``trusted``: code.
    """
    refs = profile_references(own, learned, sub, ref, learned_at, as_of)
    held = refs.join(lots.select(ref, code, buyer, kind), ref)
    one = held.join(trusted.select(code).distinct().withColumn("is_trusted", F.lit(True)), code, "left").groupBy(sub).agg(
        F.count_distinct(ref).alias("refs"), F.array_sort(F.collect_set(F.when(F.col("is_trusted"), F.col(code)))).alias("codes"),
        F.array_sort(F.collect_set(F.nullif(fn.norm_buyer(F.col(buyer)), F.lit("")))).alias("buyers"), F.array_sort(F.collect_set(F.nullif(kind, F.lit("")))).alias("types"),
    )
    lost = own.join(lots.select(ref), ref, "left_anti").groupBy(sub).agg(F.array_sort(F.collect_set(ref)).alias("missing"))
    none = lambda c, like: F.coalesce(c, F.array().cast(like)).alias(c)
    out = own.select(sub).distinct().join(one, sub, "left").join(lost, sub, "left")
    kinds = {f.name: f.dataType.simpleString() for f in out.schema}
    return out.select(sub, F.coalesce("refs", F.lit(0)).alias("refs"), *[none(c, kinds[c]) for c in ("codes", "buyers", "types", "missing")])


def mute_reason(keywords: Column, core: Column, refs: Column, mode: str = "evidence") -> Column:
    """Why a profile can never pass a lot, NULL if it can: it has neither words nor core roots."""
    if mode != "evidence":
        return F.lit(None).cast("string")
    mute = (F.coalesce(F.size(keywords), F.lit(0)) <= 0) & (F.coalesce(F.size(core), F.lit(0)) <= 0)
    return F.when(mute, F.concat(F.lit("no lexicon and no core trade root from "), F.coalesce(refs, F.lit(0)).cast("string"), F.lit(" reference(s)")))


def trace(df: DataFrame, config: GateConfig = GateConfig()) -> DataFrame:
    """The verdict of each row with the path that led to it, in the order of the ladder. Columns as in ``judge_embedding``."""
    c = config
    n = lambda x: F.format_string("%.3f", F.col(x).cast("double"))
    bar = lambda x, at, name: F.when(F.coalesce(F.col(x), F.lit(0.0)) > 0, F.concat(F.when(F.col(x) >= at, f"{name} pass ").otherwise(f"{name} "), n(x)))
    read = F.when(F.coalesce("has_hard_labels", F.lit(False)) & F.col("own_read").isNotNull(), F.concat(F.lit("trade-read "), n("own_read"), F.lit("/"), n("best_read"), F.when(F.col("own_read") >= F.col("best_read") - c.corroboration, " corroborated").otherwise(" not corroborated")))
    talk = F.when((F.col("foreign_read") - F.col("own_read")) >= c.talk_margin, "other trade")
    path = F.array_compact(F.array(
        F.when(~F.coalesce("type_match", F.lit(True)), "other type"), F.when(F.coalesce("same_buyer", F.lit(False)), "same buyer, text abstains"),
        F.when(F.col("text") >= c.min_relevance, F.concat(F.lit("text pass "), n("text"))), bar("hard", c.min_code_hard, "hard"), bar("soft", c.min_code_soft, "soft"), read, talk,
    ))
    told = judge_embedding(df, config)
    return told.withColumn("path", F.when(F.size(path) > 0, F.array_join(path, " / ")).otherwise("no channel"))


def recipe(config: GateConfig, letter: str, found: Mapping[str, Mapping[str, float]]) -> GateConfig:
    """L3: the configuration of a calibrated recipe: F carries all bars, H only floors and corroboration; others are an error."""
    f = found[letter] if letter in ("F", "H") else None
    if f is None:
        raise KeyError(f"no recipe {letter!r}")
    base = {"SOFT_FLOOR": f["soft_floor"], "SOFT_CONSENSUS": f["soft_consensus"]}
    if letter == "F":
        return config.overridden(base | {"MIN_RELEVANCE": f["threshold"], "MIN_CODE_HARD": f["code_threshold"], "MIN_CODE_SOFT": f["soft_threshold"]})
    return config.overridden(base | {"CORROBORATION": f["corroboration"]})


def as_of_profiles(subs: DataFrame, wins: DataFrame, sub: str, firm: str, ref: str, awarded: str, cutoff: str) -> DataFrame:
    """Each subscription as it stood: its firm's wins awarded before the cutoff as references, its calibrated bars dropped; none without a win."""
    refs = wins.filter(F.col(awarded) < F.lit(cutoff).cast("date")).groupBy(firm).agg(F.array_sort(F.collect_set(ref)).alias("profile_refs"))
    return subs.drop(*CALIBRATED_BARS, "profile_refs").join(refs, firm)


def as_of_training(rows: DataFrame, key: Sequence[str], date: str, cutoff: str, months: int) -> DataFrame:
    """L4: labelled rows known before a cutoff, of keys first seen within months before it, each key with weight one in all."""
    day = F.lit(cutoff).cast("date")
    known = rows.filter(F.col(date) < day).withColumn("first_seen", F.min(date).over(W.partitionBy(*key)))
    held = known.filter(F.col("first_seen") >= F.add_months(day, -months)).drop("first_seen")
    return rv.revision_weights(held, key)


def matched_names(asked: DataFrame, names: DataFrame, ask: str, name: str) -> DataFrame:
    """(ask, match, candidates): the spelling itself, else the only one that differs by case; else NULL and the spellings that hold the text.

    ``asked`` is short and broadcast.
    """
    known = names.select(name).distinct()
    hit = F.contains(F.lower(name), F.lower(ask))
    met = known.join(F.broadcast(asked.select(ask).distinct()), hit)
    exact, loose = F.max((F.col(name) == F.col(ask)).cast("int")) == 1, F.collect_set(F.when(F.lower(name) == F.lower(ask), F.col(name)))
    one = met.groupBy(ask).agg(exact.alias("exact"), loose.alias("loose"), F.slice(F.array_sort(F.collect_set(name)), 1, 6).alias("part"))
    match = F.when(F.col("exact"), F.col(ask)).when(F.size("loose") == 1, F.col("loose")[0])
    out = asked.select(ask).distinct().join(one, ask, "left").withColumn("match", match)
    return out.select(ask, "match", F.when(F.col("match").isNull(), F.coalesce("part", F.array().cast("array<string>"))).alias("candidates"))


def resolved_trades(asked: DataFrame, trades: DataFrame, ask: str, trade: str) -> DataFrame:
    """(ask, trade, kind): the trade itself, else the only one that holds the text, else the text as a word of its own; both tables are hand-kept."""
    met = asked.select(ask).distinct().join(F.broadcast(trades.select(trade)), F.contains(F.lower(trade), F.lower(ask)), "left")
    one = met.groupBy(ask).agg(F.max(F.when(F.col(trade) == F.col(ask), F.col(trade))).alias("exact"), F.array_sort(F.collect_set(trade)).alias("part"))
    word = fn.fold(F.lower(ask))
    found = F.coalesce("exact", F.when(F.size("part") == 1, F.col("part")[0]))
    return one.select(
        ask, F.when(found.isNotNull(), found).when((F.size("part") == 0) & (F.length(word) >= MIN_TERM), word).alias("trade"),
        F.when(F.col("exact").isNotNull(), "exact").when(F.size("part") == 1, "part").when(F.size("part") > 1, "ambiguous").when(F.length(word) >= MIN_TERM, "word").otherwise("too short").alias("kind"),
    )


def land_of(code: Column) -> Column:
    """The Land of a region code, NULL for others."""
    table = F.create_map(*[F.lit(x) for kv in LAND.items() for x in kv])
    return F.try_element_at(table, F.upper(F.substring(F.coalesce(code, F.lit("")), 1, 3)))


def work_of(title: Column, trade: Column | None = None) -> Column:
    """What a title says about the work, without what makes the lot findable; NULL if too little is left."""
    s = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "))
    s = F.regexp_replace(s, "(?iU)" + "|".join(f"({p})" for p in FINDABLE), " ")
    s = F.regexp_replace(s, r"\s*[-–—:;,/]+\s*", " ")
    words = F.filter(F.split(F.trim(s), r"\s+"), lambda w: w != "")
    if trade is not None:
        root = F.substring(F.lower(F.element_at(F.split(trade, " "), 1)), 1, 6)
        words = F.filter(words, lambda w: trade.isNull() | ~F.lower(w).startswith(root))
    words = F.filter(words, lambda w: ~F.regexp_replace(F.lower(w), r"^[.,]+|[.,]+$", "").isin(*GENERIC))
    out = F.regexp_replace(F.array_join(words, " "), r"^[ .]+|[ .]+$", "")
    return F.when((out != "") & ((F.size(words) > 1) | (F.length(out) >= 6)), out)


def value_size(value: Column) -> Column:
    """A rounded size of a value as text: tenths of millions, else steps of 50 000 from 300 000 on and of 10 000 below; NULL without one."""
    grouped = lambda v: F.replace(F.format_number(v, 0), F.lit(","), F.lit("."))
    step = F.when(value >= 300000, 50000).otherwise(10000)
    millions = F.replace(F.replace(F.format_string("%.1f", value / 1000000), F.lit("."), F.lit(",")), F.lit(",0"), F.lit(""))
    return F.when(value >= 1000000, F.concat(F.lit("rund "), millions, F.lit(" Mio. €"))).when(value > 0, F.concat(F.lit("rund "), grouped(F.bround(value / step) * step), F.lit(" €")))


def rank_regions(lots: DataFrame, matched: DataFrame, months: DataFrame, lot: str, trade: str, region: str, value: str, tenders: str, least: int, month: str = "month") -> DataFrame:
    """Trades by region with at least ``least`` lots in covered months: lots a month, median value and rate of at most one bid in mature months."""
    flags = F.broadcast(months.select(month, "covered", "mature"))  # a few hundred rows at most
    n_months = F.broadcast(months.agg(F.count_if("covered").alias("n_months")))
    held = matched.select(lot, trade).distinct().join(lots, lot).join(flags, month, "left")
    known = F.coalesce("mature", F.lit(False)) & F.col(tenders).isNotNull()
    cells = held.groupBy(trade, region).agg(
        F.count_if("covered").alias("lots"), F.median(value).alias("median_value"), F.count_if(known).alias("awarded"), F.avg(F.when(known, (F.col(tenders) <= 1).cast("double"))).alias("low_rate")
    )
    cells = cells.filter(F.col("lots") >= least).crossJoin(n_months)
    return cells.select(trade, region, "lots", F.round(F.col("lots") / F.col("n_months"), 1).alias("per_month"), "median_value", "awarded", "low_rate")


def track_record(graded: DataFrame, since: str, date: str, trade: str, tier: str, score: str, tie: str, flag: Column, truth: Column, least: int = 30, share: float = 0.2) -> DataFrame:
    """Graded rows of a window, in all, by trade (with at least ``least`` rows) and by tier: the flag view and the rank view."""
    recent = graded.filter(F.col(date) >= F.lit(since).cast("date")).withColumn("flagged", flag).withColumn("true", truth)
    sets = F.array(F.struct(F.lit("all").alias("view"), F.lit("").alias("value")), F.struct(F.lit("trade").alias("view"), F.col(trade).cast("string").alias("value")), F.struct(F.lit("tier").alias("view"), F.col(tier).cast("string").alias("value")))
    each = recent.withColumn("s", F.explode(sets)).select("s.view", "s.value", score, tie, "flagged", "true").filter("value IS NOT NULL")
    top = stats.top_slice(each, ["view", "value"], score, tie, F.col("true"), share)
    flags = each.groupBy("view", "value").agg(F.count_if("flagged").alias("flags"), F.count_if(F.col("flagged") & F.col("true")).alias("right"), F.count_if("true").alias("positives"))
    out = top.join(flags, ["view", "value"]).filter((F.col("view") != "trade") | (F.col("n") >= least))
    return out.select("view", "value", "n", "k", "hit", "base", "lift", "flags", (F.col("right") / F.nullif("flags", F.lit(0))).alias("precision"), (F.col("right") / F.nullif("positives", F.lit(0))).alias("coverage"))


def snapshot(outcomes: DataFrame, verdicts: DataFrame, held: DataFrame, at: str, picks: int, judged: int, verdict: str = "verdict") -> DataFrame:
    """A row for every verdict on record at one time, zero rows for those without grades; none if the time is already held."""
    every = verdicts.select(verdict).union(outcomes.select(verdict)).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = every.join(outcomes, verdict, "left").select(
        F.lit(at).alias("ts"), verdict, zero("graded"), F.coalesce("lonely_rate", F.lit(0.0)).alias("lonely_rate"), zero("own_wins"),
        F.coalesce(F.col("own_wins") / F.nullif("graded", F.lit(0)), F.lit(0.0)).alias("own_rate"), F.lit(picks).alias("picks_total"), F.lit(judged).alias("verdicts_total"),
    )
    return rows.join(held.select("ts", verdict), ["ts", verdict], "left_anti")


def category_rates(df: DataFrame, category: str, truth: Column, least: int) -> DataFrame:
    """Rate by category with at least ``least`` rows."""
    return df.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.avg(truth.cast("double")).alias("rate")).filter(F.col("n") >= least)


def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows left after each step and all steps before it, in one pass."""
    ok, counts = F.lit(True), []
    for k, (name, cond) in enumerate(steps):
        ok = ok & F.coalesce(cond, F.lit(False))
        counts.append(F.struct(F.lit(k).alias("step"), F.lit(name).alias("name"), F.count_if(ok).alias("left")))
    return df.agg(F.array(*counts).alias("s")).select(F.inline("s"))
