"""The low-competition classifier: fit, score, explain, tripwires and promotion, on MLlib."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from . import stats
from .ranks import quantiles

# Fixed values.
TOO_GOOD_ROC, EPSILON, THRESHOLD, SEED = 0.85, 0.005, 0.5, 42


def weighted(df: DataFrame, label: str, weight: str) -> DataFrame:
    """Row weights times balanced class weights."""
    n = df.groupBy(label).agg(F.sum(weight).alias("__c"))
    total = F.broadcast(n.agg(F.sum("__c").alias("__t"), F.count(F.lit(1)).alias("__k")))
    return df.join(F.broadcast(n), label).crossJoin(total).withColumn("w", F.col(weight) * F.col("__t") / (F.col("__k") * F.col("__c"))).drop("__c", "__t", "__k")


def fit(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, weight: str | None = None, trees: int = 20, depth: int = 4) -> PipelineModel:
    """M6: boosted trees with class and revision weights."""
    if weight is None:
        df, weight = df.withColumn("__one", F.lit(1.0)), "__one"
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}__ix", handleInvalid="keep") for c in categorical]
    stages.append(VectorAssembler(inputCols=[*numeric, *[f"{c}__ix" for c in categorical]], outputCol="features", handleInvalid="keep"))
    stages.append(GBTClassifier(labelCol=label, featuresCol="features", weightCol="w", maxIter=trees, maxDepth=depth, maxBins=256, seed=SEED))
    return Pipeline(stages=stages).fit(weighted(df.withColumn(label, F.col(label).cast("double")), label, weight))


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def importance(model: PipelineModel) -> dict[str, float]:
    """M7: gain by feature."""
    names = model.stages[-2].getInputCols()
    return dict(sorted(zip(names, map(float, model.stages[-1].featureImportances.toArray()), strict=True), key=lambda x: -x[1]))


def contributions(model: PipelineModel, df: DataFrame, numeric: Sequence[str], key: Sequence[str]) -> DataFrame:
    """What each feature adds to a row's score against its typical value: (key, feature, delta), largest first.

    Leave-one-out against medians; not additive like tree path values, and documented as such.
    """
    typical = {c: quantiles(df, [], c, [0.5]).first() for c in numeric}
    typical = {c: r and r["q0"] for c, r in typical.items()}
    # Each row once as it is and once for every feature, scored in one pass.
    variants = F.array(F.lit(None).cast("string"), *[F.lit(c) for c in numeric])
    each = df.withColumn("__feature", F.explode(variants))
    for c in numeric:
        each = each.withColumn(c, F.when(F.col("__feature") == c, F.lit(float(typical[c] or 0.0))).otherwise(F.col(c).cast("double")))
    scored = score(model, each).groupBy(*key).agg(
        F.max(F.when(F.col("__feature").isNull(), F.col("score"))).alias("__base"), F.array(*[F.struct(F.lit(c).alias("feature"), F.max(F.when(F.col("__feature") == c, F.col("score"))).alias("s")) for c in numeric]).alias("__f")
    )
    return scored.select(*key, "__base", F.inline("__f")).select(*key, "feature", (F.col("__base") - F.col("s")).alias("delta"))


@dataclass(frozen=True)
class Grades:
    """What promotion looks at."""

    pr_auc: float | None
    roc_auc: float | None
    rows: int
    features: tuple[str, ...]


def grades(scored: DataFrame, label: str, features: Sequence[str], weight: str | None = None) -> Grades:
    one = scored.withColumn("__all", F.lit(1))
    w = F.col(weight) if weight else F.lit(1.0)
    ap = stats.average_precision(one, ["__all"], "score", F.col(label) == 1, w).first()
    roc = stats.auc(one, ["__all"], "score", F.col(label) == 1).first()
    return Grades(ap and ap["average_precision"], roc and roc["auc"], scored.count(), tuple(features))


def tripwires(graded: Grades, shuffled: Sequence[Grades], base: float) -> list[str]:
    """M8: too good to be true, or as good on shuffled labels."""
    found = []
    if graded.roc_auc is not None and graded.roc_auc >= TOO_GOOD_ROC:
        found.append("too good")
    values = sorted(g.pr_auc or 0.0 for g in shuffled)
    if values and values[len(values) // 2] >= max(1.5 * base, base + 0.02):
        found.append("shuffled labels score")
    return found


def promotes(new: Grades, champion: Grades | None, failures: Sequence[str], least: int = 30) -> tuple[bool, str]:
    """M9: the promotion ladder."""
    if failures:
        return False, ", ".join(failures)
    if champion is None:
        return True, "no champion"
    if champion.features != new.features:
        added, gone = sorted(set(new.features) - set(champion.features)), sorted(set(champion.features) - set(new.features))
        return True, f"features changed: +{added} -{gone}"
    if new.rows < least:
        return False, "small validation"
    if champion.pr_auc is None:
        return True, "champion without a score"
    return (True, "holds up") if (new.pr_auc or 0.0) >= champion.pr_auc - EPSILON else (False, "worse than the champion")


def register(path: str, entry: Mapping[str, object]) -> None:
    """One JSON line per model in a registry file of the driver."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(dict(entry), sort_keys=True, default=str) + "\n")


def predict_open(model: PipelineModel, open_lots: DataFrame, ledger: DataFrame, key: Sequence[str], tie: str, threshold: float = THRESHOLD) -> DataFrame:
    """Scores, tiers and flags of open lots that the ledger lacks."""
    ranked = stats.tiers(score(model, open_lots), [], "score", tie)
    return ranked.withColumn("flag", F.col("score") >= threshold).join(ledger.select(*key), list(key), "left_anti")
