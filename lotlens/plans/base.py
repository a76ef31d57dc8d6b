"""Registry of queries and the views they share over the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables of a directory by name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Tables; ``sql`` gives the same rows in DuckDB."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, path: f(Tables(spark, path))
        if sql:
            SQL[name] = sql
        return f

    return put


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


def lots(t: Tables) -> DataFrame:
    """An order as a lot: its lines are the tenders, known unless the status is P."""
    n = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return t.orders.join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("lot"), F.col("o_custkey").alias("buyer"), F.col("o_orderdate").cast("date").alias("pub"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"),
        F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderstatus") != "P", F.col("n").cast("int")).alias("n_tenders"),
    )


LOTS = """
n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
lots AS (
  SELECT o_orderkey AS lot, o_custkey AS buyer, o_orderdate::DATE AS pub, date_trunc('month', o_orderdate)::DATE AS month, o_totalprice AS value,
         o_orderpriority AS priority, o_orderstatus AS status, CASE WHEN o_orderstatus <> 'P' THEN n END::INT AS n_tenders
  FROM orders LEFT JOIN n ON o_orderkey = l_orderkey)"""
MONTHS = (
    LOTS
    + """,
m0 AS (SELECT month, count(*) AS lots, count(n_tenders) AS resolved FROM lots WHERE month IS NOT NULL GROUP BY 1),
m1 AS (SELECT *, lots >= 0.25 * max(lots) OVER () AS covered FROM m0),
months AS (SELECT *, covered AND resolved::DOUBLE / lots >= 0.35 AS mature FROM m1)"""
)


def wins(t: Tables) -> DataFrame:
    """A line item as a win of its supplier."""
    li, o, s = t.lineitem, t.orders, t.supplier
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(s, li["l_suppkey"] == s["s_suppkey"]).select(
        F.col("s_name").alias("firm"), F.col("o_orderkey").alias("lot"), F.col("l_linenumber").alias("line"), F.col("o_orderdate").cast("date").alias("day"), F.col("l_extendedprice").alias("value"),
        F.col("l_linenumber").alias("tenders"), F.col("l_returnflag").alias("size"), F.col("s_nationkey").alias("region"), F.col("o_custkey").alias("buyer"), F.col("l_partkey").alias("part"), F.col("l_linestatus").alias("trade"),
    )


WINS = """
wins AS (
  SELECT s_name AS firm, o_orderkey AS lot, l_linenumber AS line, o_orderdate::DATE AS day, l_extendedprice AS value, l_linenumber AS tenders, l_returnflag AS size,
         s_nationkey AS region, o_custkey AS buyer, l_partkey AS part, l_linestatus AS trade
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)"""


def scored(t: Tables) -> DataFrame:
    """Labelled documents with a score and a flag made of plain columns."""
    d, y = t.documents, t.labels
    return d.join(y, "doc_id").select(
        "doc_id", "lang", "source", "quality", "toxic", (F.col("n_chars") % 1000 / 1000).alias("score"), (F.col("n_chars") % 1000 >= 500).alias("flag"), (F.col("quality") == 1).alias("good")
    )


SCORED = """
scored AS (
  SELECT doc_id, lang, source, quality, toxic, (n_chars % 1000)::DOUBLE / 1000 AS score, n_chars % 1000 >= 500 AS flag, quality = 1 AS good
  FROM documents JOIN labels USING (doc_id))"""
