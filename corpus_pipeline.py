"""The corpus pipeline: five stages over documents, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lotlens.llm import decontaminate, jaccard_join, pieces, quality_rules, suffix_dedup
from lotlens.llm.cluster import cut


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; boilerplate lines leave the others."""
    return quality_rules.clean(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, of the smallest doc_id."""
    return jaccard_join.keep_row(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of ``suffix_dedup.PASSAGE`` bytes or more that also start elsewhere go."""
    return suffix_dedup.clean(docs, suffix_dedup.PASSAGE)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of the benchmark go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become pieces, with a flag that they decode to the text."""
    return pieces.encode(docs)


STAGES = [
    ("quality rules", rules_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("suffix-array dedup", suffix_stage),
    ("benchmark decontamination", benchmark_stage),
    ("SentencePiece encoding", pieces_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between two stages the rows are cut in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, cut(docs) if k else docs, sf_dir)
    return docs


#: Near-duplicate groups, suffix sorting and keyed merging are not expressible in SQL.
ORACLE_SQL = None
