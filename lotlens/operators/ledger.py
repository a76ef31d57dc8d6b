"""Append-only ledgers over Parquet: natural keys, sequence numbers, derived readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..lineage import cut


class Ledger:
    """K1, K2, K7, K8: rows are only ever appended; a row whose natural key is known is ignored.

    There is no update and no delete. ``seq`` continues from the highest one.
    Appends are written as new files, so readers never see half a batch.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], schema: str):
        self.spark, self.path, self.key = spark, path, list(key)
        self.schema = spark.createDataFrame([], f"seq bigint, {schema}").schema

    def read(self) -> DataFrame:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def append(self, rows: DataFrame, order: Sequence[str]) -> int:
        """Appends unseen rows (the first by ``order`` of equal keys) and returns how many."""
        held = self.read()
        top = held.agg(F.max("seq")).first()[0] or 0
        new = numbered(append_rows(held, rows, self.key, order), top, order)
        names = [f.name for f in self.schema]
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name not in new.columns]
        new = new.select("*", *missing).select(*names)
        n = new.count()
        if n:
            new.write.mode("append").option("compression", "zstd").parquet(self.path)
        return n

    def version(self) -> int:
        """K7: a stamp that changes with every append."""
        return self.read().agg(F.max("seq")).first()[0] or 0

    def assert_covers(self, other: DataFrame) -> None:
        """K8: an older copy must not hold rows that the ledger lacks."""
        lost = other.select(*self.key).exceptAll(self.read().select(*self.key)).limit(1).count()
        if lost:
            raise ValueError(f"{self.path} lacks rows of the other copy")


def append_rows(held: DataFrame, rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first of each unseen natural key."""
    first = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    one = rows.withColumn("__k", first).filter("__k = 1").drop("__k")
    return one.join(held.select(*key), list(key), "left_anti")


def numbered(rows: DataFrame, after: int, order: Sequence[str]) -> DataFrame:
    """Consecutive seq numbers in ``order``: a range-partitioned sort, offsets of the partitions, then places within them.

    No task sees all rows. The ranges are cut first, since sampling their bounds
    twice could give two different ones.
    """
    parts = cut(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.withColumn("__o", F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)))
    placed = parts.withColumn("__k", F.row_number().over(W.partitionBy("__p").orderBy(*order)))
    return placed.join(F.broadcast(offsets), "__p").withColumn("seq", F.lit(after) + F.coalesce("__o", F.lit(0)) + F.col("__k")).drop("__p", "__n", "__o", "__k")


def latest(ledger: DataFrame, key: Sequence[str], without: Sequence[str] = (), model: str = "model") -> DataFrame:
    """Last row of each key, some models left out."""
    held = ledger.filter(~F.col(model).isin(*without)) if without else ledger
    rest = [c for c in held.columns if c not in key]
    return held.groupBy(*key).agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(*key, "r.*")


def titles(ledger: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """K5: last non-null value of each column by key."""
    return ledger.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in cols])


def of_lots(ledger: DataFrame, lots: DataFrame, key: Sequence[str]) -> DataFrame:
    """K3, K4: rows of the wanted keys."""
    return ledger.join(lots.select(*key).distinct(), list(key), "left_semi")


def with_identity(versions: DataFrame, customers: DataFrame, key: str) -> DataFrame:
    """K9: frozen filters with the present name."""
    return versions.join(customers, key, "left")


def customers(versions: DataFrame, key: str, since: str, version: str, cols: Sequence[str]) -> DataFrame:
    """Newest version's fields, created when the first began."""
    return versions.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(version)).alias("v"), F.min(since).alias("created")).select(key, "created", "v.*")


def first_seen(held: DataFrame, rows: DataFrame, fingerprint: str, at: str) -> DataFrame:
    """Fingerprints not seen before with the time they came."""
    return rows.groupBy(fingerprint).agg(F.min(at).alias("first_seen")).join(held.select(fingerprint), fingerprint, "left_anti")


def trial_status(versions: DataFrame, deliveries: DataFrame, key: str, since: str, version: str, at: str, free: int = 4, days: int = 28) -> DataFrame:
    """Reports delivered and days used; over after ``free`` reports or ``days`` days."""
    now = F.lit(at).cast("date")
    begun = versions.filter(F.col(since) <= now).groupBy(key).agg(F.max_by("plan", F.struct(since, version)).alias("plan"), F.min(since).alias("began"))
    sent = deliveries.groupBy(key).agg(F.count_distinct("report").alias("reports"))
    out = begun.join(sent, key, "left").withColumn("reports", F.coalesce("reports", F.lit(0))).withColumn("days", F.datediff(now, "began"))
    return out.withColumn("over", (F.col("plan") == "trial") & ((F.col("reports") >= free) | (F.col("days") >= days)))


def differing(a: DataFrame, b: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Keys judged by both whose values differ."""
    return a.select(*key, F.col(value).alias("champion")).join(b.select(*key, F.col(value).alias("challenger")), list(key)).filter("champion <> challenger")


def paired(graded: DataFrame, lot: Sequence[str], arm: str, arms: int) -> DataFrame:
    """C17: rows of lots that every arm graded."""
    full = graded.groupBy(*lot).agg(F.count_distinct(arm).alias("n")).filter(F.col("n") == arms)
    return graded.join(full.select(*lot), list(lot), "left_semi")


def outcomes(verdicts: DataFrame, grades: DataFrame, key: Sequence[str], kinds: Sequence[str], verdict: str = "verdict") -> DataFrame:
    """Graded, lonely rate and own wins of every verdict, zero rows included."""
    joined = verdicts.withColumn(verdict, F.coalesce(verdict, F.lit("no_verdict"))).join(grades, list(key), "left")
    n = joined.groupBy(verdict).agg(
        F.count(F.lit(1)).alias("picks"), F.count("label").alias("graded"), F.avg(F.col("label").cast("double")).alias("lonely_rate"), F.count_if(F.coalesce("own_win", F.lit(False))).alias("own_wins")
    )
    every = verdicts.sparkSession.createDataFrame([(k,) for k in kinds], f"{verdict} string")
    out = every.join(n, verdict, "left")
    return out.select(verdict, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("picks", "graded")], "lonely_rate", F.coalesce("own_wins", F.lit(0)).alias("own_wins"))


def backlog(picks: DataFrame, judged: DataFrame, key: Sequence[str], profiles: DataFrame, vectors: DataFrame, company: str, lot: str) -> DataFrame:
    """Picks not judged yet, with why they cannot be: no_profile, not_in_sidecar, else NULL."""
    open_ = picks.join(judged.select(*key), list(key), "left_anti")
    p, v = profiles.select(company).distinct().withColumn("__p", F.lit(True)), vectors.select(lot).distinct().withColumn("__v", F.lit(True))
    out = open_.join(p, company, "left").join(v, lot, "left")
    return out.withColumn("bucket", F.when(F.col("__p").isNull(), "no_profile").when(F.col("__v").isNull(), "not_in_sidecar")).drop("__p", "__v")


def widened(requested: str, last_success: str | None) -> str:
    """The earlier of the requested start and the last success."""
    return min(requested, last_success) if last_success else requested


def shadow_models(registered: DataFrame, delivering: DataFrame, model: str = "model") -> DataFrame:
    """Models that never delivered."""
    return registered.join(delivering.select(model), model, "left_anti")


def verified(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that either side lacks, with how often."""
    rows = a.columns
    left = a.exceptAll(b).withColumn("side", F.lit("only_first"))
    right = b.select(*rows).exceptAll(a).withColumn("side", F.lit("only_second"))
    return left.union(right).groupBy("side").agg(F.count(F.lit(1)).alias("rows"))


def to_learn(wins: DataFrame, held: DataFrame, customer: str, ref: str) -> DataFrame:
    """Won references of customers that the ledger does not hold yet."""
    return wins.select(customer, ref).distinct().join(held.select(customer, ref), [customer, ref], "left_anti")


def exported(ledger: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(seq, line): every row as the JSON line that it was written with, in the ledger's column order; NULLs stay."""
    return ledger.select("seq", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("line"))
