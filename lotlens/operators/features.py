"""Role-driven features: levels, multi-hot blocks, guards and baselines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import scalars as fn

# Fixed values.
NA, MIN_SHARE, MIN_SUPPORT, ONE_HOT_MOST = "__NA__", 0.0015, 30, 1024
ROLES = ("key", "categorical", "hierarchical", "entity", "numeric", "bool", "date", "label", "text", "nested", "plumbing")


def with_roles(df: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """Roles kept as field metadata, which Parquet and filters carry along."""
    for c, role in roles.items():
        if role not in ROLES:
            raise ValueError(f"unknown role {role}")
        df = df.withMetadata(c, {**df.schema[c].metadata, "role": role})
    return df


def roles_of(df: DataFrame) -> dict[str, str]:
    return {f.name: f.metadata["role"] for f in df.schema if "role" in f.metadata}


def field_guide(df: DataFrame) -> DataFrame:
    """Name, type and role of every column."""
    rows = [(f.name, f.dataType.simpleString(), f.metadata.get("role")) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "column string, type string, role string")


def levels(df: DataFrame, key: Sequence[str], column: str, widths: Sequence[int]) -> DataFrame:
    """(key, level, value): each code of a column (text or list) at every width, distinct by key."""
    c = F.col(column)
    many = isinstance(df.schema[column].dataType, T.ArrayType)
    codes = F.coalesce(c, F.array().cast("array<string>")) if many else F.array(c)
    each = df.select(*key, F.explode(codes).alias("code")).filter("code IS NOT NULL")
    out = each.select(*key, F.explode(F.array(*[F.struct(F.lit(w).alias("level"), fn.level(F.col("code"), w).alias("value")) for w in widths])).alias("l"))
    return out.select(*key, "l.*").filter("value IS NOT NULL").distinct()


def multihot_fit(values: DataFrame, key: Sequence[str], value: str, lots: int | None = None, share: float = MIN_SHARE, least: int = MIN_SUPPORT) -> DataFrame:
    """Values in at least max(least, ceil(share * lots)) distinct lots."""
    n = values.select(*key).distinct().count() if lots is None else lots
    need = max(least, -int(-(share * n) // 1))
    return values.select(*key, value).distinct().groupBy(value).agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= need)


def multihot_apply(df: DataFrame, column: str, vocabulary: Sequence[str], name: str) -> DataFrame:
    """M2: has_<code> for each kept value, n_rare for values outside, n for all; the vocabulary is a fitted model."""
    values = F.coalesce(F.array_distinct(F.col(column)), F.array().cast("array<string>"))
    cols = {f"{name}__has_{v}": F.array_contains(values, v).cast("int") for v in sorted(vocabulary)}
    kept = F.array(*[F.lit(v) for v in vocabulary]) if vocabulary else F.array().cast("array<string>")
    return df.withColumns(cols | {f"{name}__n_rare": F.size(F.array_except(values, kept)), f"{name}__n": F.size(values)})


def build(df: DataFrame, reference: str, roles: Mapping[str, str] | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """M1: numeric as double, dates as days from ``reference``, booleans and categories as text with __NA__.

    Returns the frame, the feature names and the columns left out; entities never become features.
    """
    roles = dict(roles or roles_of(df))
    made, out = {}, []
    for c, role in roles.items():
        if role == "numeric":
            made[f"f_{c}"] = F.col(c).cast("double")
        elif role == "date" and c != reference:
            made[f"f_{c}_days"] = F.datediff(c, reference).cast("double")
        elif role in ("bool", "categorical") and not isinstance(df.schema[c].dataType, T.ArrayType):
            made[f"f_{c}"] = F.coalesce(F.col(c).cast("string"), F.lit(NA))
        else:
            out.append(c)
    if any(roles.get(c) == "entity" and f"f_{c}" in made for c in roles):
        raise AssertionError("an entity became a feature")
    return df.withColumns(made), list(made), out


def one_hot_guard(df: DataFrame, cols: Sequence[str], most: int = ONE_HOT_MOST) -> DataFrame:
    """M4: distinct values of every category in one pass, and whether one-hot takes them."""
    one = df.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(NA))).alias(c) for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("values")) for c in cols])
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("one_hot", F.col("values") <= most)


def target_baseline(train: DataFrame, test: DataFrame, code: str, target: str, weight: str) -> DataFrame:
    """Weighted base rate of each code in training, the overall rate for unseen codes."""
    rate = train.groupBy(code).agg((F.sum(F.col(weight) * F.col(target)) / F.sum(weight)).alias("rate"))
    base = F.broadcast(train.agg((F.sum(F.col(weight) * F.col(target)) / F.sum(weight)).alias("base")))
    return test.join(rate, code, "left").crossJoin(base).withColumn("baseline", F.coalesce("rate", "base")).drop("rate", "base")
