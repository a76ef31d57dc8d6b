"""The relevance gate: component columns once, verdicts as one ordered case, calibration by counts."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as fn


@dataclass(frozen=True)
class GateConfig:
    """Bars of the gate; fixed default values. Immutable, known by a fingerprint."""

    min_relevance: float = 0.700
    min_code_hard: float = 0.825
    min_code_soft: float = 0.725
    soft_floor: float = 0.45
    soft_consensus: int = 2
    borderline_margin: float = 0.05
    talk_margin: float = 0.225
    corroboration: float = 0.0
    evidence_min: int = 2
    admit: float = 0.0
    mode: str = "evidence"

    def fingerprint(self) -> str:
        return fn.fingerprint(asdict(self))

    def overridden(self, values: Mapping[str, object]) -> GateConfig:
        """With upper-case overrides applied; an unknown key is an error, never ignored."""
        names = {f.name.upper(): f for f in fields(self)}
        if unknown := set(values) - names.keys():
            raise KeyError(f"unknown overrides: {sorted(unknown)}")
        return replace(self, **{names[k].name: type(getattr(self, names[k].name))(v) for k, v in values.items()})

    @classmethod
    def from_env(cls, prefix: str = "LOTLENS_GATE_") -> GateConfig:
        return cls().overridden({k[len(prefix) :]: v for k, v in os.environ.items() if k.startswith(prefix)})


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def judge_embedding(df: DataFrame, config: GateConfig = GateConfig()) -> DataFrame:
    """Verdict pass / borderline / out with its reason; the first rule that fits wins.

    Component columns: text, hard, soft, own_read, best_read, foreign_read (cosines
    or NULL), has_vector, known_codes, same_buyer, type_match (NULL if unknown), has_hard_labels.
    """
    c = config
    hard = _yes(F.col("hard") >= c.min_code_hard)
    soft = _yes(F.col("soft") >= c.min_code_soft)
    code = hard | soft
    corroborated = ~_yes(F.col("has_hard_labels")) | _yes(F.col("own_read") >= F.col("best_read") - c.corroboration)
    contradicted = _yes(F.col("foreign_read") - F.col("own_read") >= c.talk_margin)
    weak_soft, against = soft & ~hard & ~corroborated, hard & contradicted
    text = _yes(F.col("text") >= c.min_relevance)
    near = _yes(F.col("text") >= c.min_relevance - c.borderline_margin)
    same = _yes(F.col("same_buyer"))
    rules = [
        (~_yes(F.col("has_vector")), "pass", "no vector"),
        (~F.coalesce("type_match", F.lit(True)), "borderline", "other contract type"),
        (same & ~_yes(F.col("known_codes")), "borderline", "same buyer, no code"),
        (same & weak_soft, "borderline", "same buyer, soft code only"),
        (same & against, "borderline", "same buyer, other trade"),
        (same & code, "pass", "same buyer"),
        (same, "out", "same buyer, other code"),
        (text, "pass", "text"),
        (weak_soft, "borderline", "soft code only"),
        (against, "borderline", "other trade"),
        (code, "pass", "code"),
        (near, "borderline", "text near the bar"),
    ]
    return _verdict(df, rules)


def judge_evidence(df: DataFrame, config: GateConfig = GateConfig()) -> DataFrame:
    """Verdict from keyword evidence.

    Component columns: type_match, core_title, title_witness, witnesses, witnesses2 (tier <= 2),
    wide_witnesses, hard, title_has_root, draw.
    """
    c = config
    hard = _yes(F.col("hard") >= c.min_code_hard)
    core, title = _yes(F.col("core_title")), _yes(F.col("title_witness"))
    n = lambda name: F.coalesce(F.col(name), F.lit(0))
    convicting = title | (n("witnesses") >= 2) | core
    convicting = convicting & ~(~core & (n("witnesses2") < 2) & ~hard)
    convicting = convicting & ~(~core & ~title & ~hard & _yes(F.col("title_has_root")))
    nominated = hard | (n("witnesses") >= c.evidence_min) | convicting | (n("wide_witnesses") >= c.evidence_min)
    admitted = _yes(F.col("draw") < c.admit)
    rules = [
        (~F.coalesce("type_match", F.lit(True)), "borderline", "other contract type"),
        (nominated & convicting, "pass", "evidence"),
        ((nominated | (n("witnesses") > 0)) & admitted, "pass", "admitted from the band"),
        (nominated | (n("witnesses") > 0), "borderline", "some evidence"),
    ]
    return _verdict(df, rules)


def _verdict(df: DataFrame, rules: Sequence[tuple[Column, str, str]]) -> DataFrame:
    verdict = F.when(rules[0][0], rules[0][1])
    why = F.when(rules[0][0], rules[0][2])
    for cond, v, w in rules[1:]:
        verdict, why = verdict.when(cond, v), why.when(cond, w)
    return df.withColumn("verdict", verdict.otherwise("out")).withColumn("why", why.otherwise("nothing"))


def grid_rates(sample: DataFrame, kind: str, scores: Mapping[str, Sequence[float]]) -> DataFrame:
    """For every grid point the share of each kind with all (or, for text, any) scores at the bars.

    Each row is binned to its grid index once; counts per cell are then accumulated
    from above, so the grid never multiplies the rows.
    """
    def place(s: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(b)) for b in scores[s]]), lambda b: b <= F.col(s))).alias(s)

    cells = sample.select(kind, *[place(s) for s in scores])
    counts = cells.groupBy(kind, *scores).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(kind).agg(F.sum("n").alias("total"))
    grid = counts.select(kind).distinct()
    for s, bars in scores.items():
        grid = grid.withColumn(f"bar_{s}", F.explode(F.sequence(F.lit(1), F.lit(len(bars)))))
    reach = F.lit(False)
    for s in scores:
        reach = reach | (F.col(f"c_{s}") >= F.col(f"bar_{s}"))
    held = counts.select(F.col(kind).alias("c_kind"), *[F.col(s).alias(f"c_{s}") for s in scores], "n")
    # Cells and grid points are both small: (bars + 1) ** scores at most.
    met = grid.join(F.broadcast(held), (F.col(kind) == F.col("c_kind")) & reach, "left")
    rates = met.groupBy(kind, *[f"bar_{s}" for s in scores]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("passed")).join(total, kind)
    out = [F.element_at(F.array(*[F.lit(float(b)) for b in bars]), F.col(f"bar_{s}")).alias(f"bar_{s}") for s, bars in scores.items()]
    return rates.select(kind, *out, (F.col("passed") / F.col("total")).alias("rate"))


def choose(rates: DataFrame, kind: str, recall: float = 0.9) -> DataFrame:
    """The grid point of least leakage among those whose recall is reached (ties: higher recall, then lower bars)."""
    bars = [c for c in rates.columns if c.startswith("bar_")]
    wide = rates.groupBy(*bars).agg(F.max(F.when(F.col(kind) == 1, F.col("rate"))).alias("recall"), F.max(F.when(F.col(kind) == 0, F.col("rate"))).alias("leakage"))
    return wide.filter(F.col("recall") >= recall).orderBy("leakage", F.desc("recall"), *bars).limit(1)
