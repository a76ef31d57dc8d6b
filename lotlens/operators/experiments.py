"""Arms, knobs and rejections: the numbers by Spark, the ladders on tiny tables by the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalars as fn

# Fixed values.
MIN_PAIRED, MIN_FLAGGED, P_LEANING, P_READY, DRAWS, SEED, PRIOR = 100, 30, 0.8, 0.95, 20000, 42, 0.5
MIN_CASES, HARD_BAR, FLAT_TO_CLOSE, MAJORITY = 30, 0.022, 2, 0.5


def arm_stats(graded: DataFrame, arm: str, flag: Column, truth: Column) -> DataFrame:
    return graded.groupBy(arm).agg(F.count(F.lit(1)).alias("graded"), F.count_if(flag).alias("flagged"), F.count_if(flag & truth).alias("hits"))


def weekly(graded: DataFrame, arm: str, at: str, flag: Column, truth: Column) -> DataFrame:
    """Flagged and hits by ISO week."""
    week = F.concat(F.extract(F.lit("yearofweek"), F.col(at)).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(at).cast("string"), 2, "0"))
    return graded.groupBy(arm, week.alias("week")).agg(F.count_if(flag).alias("flagged"), F.count_if(flag & truth).alias("hits"))


def posterior_best(hits: Sequence[int], flagged: Sequence[int]) -> list[float]:
    """Probability that each arm is best, from Beta posteriors with a Jeffreys prior."""
    rng = np.random.default_rng(SEED)
    draws = np.stack([rng.beta(h + PRIOR, n - h + PRIOR, DRAWS) for h, n in zip(hits, flagged, strict=True)])
    best = draws.argmax(0)
    return [float((best == k).mean()) for k in range(len(hits))]


def arm_verdict(paired: int, hits: Sequence[int], flagged: Sequence[int], delivering: int, wires_ok: bool) -> tuple[str, int | None]:
    """E37, card B.12: (state, arm)."""
    if paired < MIN_PAIRED or min(flagged) < MIN_FLAGGED:
        return "collecting", None
    p = posterior_best(hits, flagged)
    best = max(range(len(p)), key=lambda k: (p[k], k == delivering))
    if p[best] >= P_READY and wires_ok:
        return "ready", best
    return ("leaning", best) if p[best] >= P_LEANING else ("no difference", None)


def rejects(pairs: DataFrame) -> DataFrame:
    """One row: leakage over the bar on a majority of measurements, or a Wilson-disjoint loss on all of more than one.

    ``pairs``: leakage, k_new, n_new, k_old, n_old.
    """
    _, high = fn.wilson(F.col("k_new"), F.col("n_new"))
    low, _ = fn.wilson(F.col("k_old"), F.col("n_old"))
    n = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("leakage") > HARD_BAR).cast("double")).alias("leaking"), F.bool_and(high < low).alias("loses"))
    return n.select("n", "leaking", "loses", ((F.col("leaking") > MAJORITY) | ((F.col("n") > 1) & F.col("loses"))).alias("rejected"))


@dataclass(frozen=True)
class Measurement:
    value: float
    metric: float
    k: int
    n: int
    leakage: float


def _interval(k: int, n: int, z: float = 1.96) -> tuple[float, float]:
    if not n:
        return 0.0, 1.0
    p, d = k / n, 1 + z * z / n
    mid, half = p + z * z / (2 * n), z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5
    return max(0.0, (mid - half) / d), min(1.0, (mid + half) / d)


def knob_verdict(current: Measurement | None, neighbours: Sequence[Measurement], flats: int = 0, stopped: bool = False) -> tuple[str, float | None]:
    """E39, card B.10: stop, hold, no effect, move up or down, or flat (the second flat closes)."""
    if stopped:
        return "stop", None
    if current is None or current.n < MIN_CASES:
        return "hold", None
    if neighbours and all((m.metric, m.k, m.n, m.leakage) == (current.metric, current.k, current.n, current.leakage) for m in neighbours):
        return "no effect", None
    inside = [m for m in neighbours if m.leakage <= HARD_BAR]
    if current.leakage <= HARD_BAR or not inside:  # over the bar any neighbour within it is better, whatever its recall
        high = _interval(current.k, current.n)[1]
        inside = [m for m in inside if _interval(m.k, m.n)[0] > high]
    if inside:
        best = max(inside, key=lambda m: (m.metric, -m.value)).value
        return ("move up" if best > current.value else "move down"), best
    return ("close" if flats + 1 >= FLAT_TO_CLOSE else "flat"), None


def paired_weeks(a: DataFrame, b: DataFrame, week: str) -> DataFrame:
    """C22."""
    return a.join(b, week)


def latest_labels(labels: DataFrame, key: Sequence[str], value: str, seq: str) -> DataFrame:
    """The last reading of each key."""
    return labels.groupBy(*key).agg(F.max_by(value, seq).alias(value))


def guardrail(readings: DataFrame, wrong: Column, least: int = 30) -> DataFrame:
    """Share of wrong-trade readings with its interval; open until there are enough."""
    n = readings.agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("k"))
    low, high = fn.wilson(F.col("k"), F.col("n"))
    return n.select("n", "k", low.alias("low"), high.alias("high"), (F.col("n") >= least).alias("enough"))


def paired_positions(a: DataFrame, b: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Rows of two arms that stand at one place of their group; the columns of ``b`` get the ending _b."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    other = b.withColumn("place", place).select(*by, "place", *[F.col(c).alias(f"{c}_b") for c in b.columns if c not in by])
    return a.withColumn("place", place).join(other, [*by, "place"])
