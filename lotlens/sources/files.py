"""JSON, CSV, vector and ledger files in and out."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; a broken line is a row with ``_broken``."""
    return spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Code, label of a CSV with # comments."""
    return spark.read.schema("code string, label string").csv(path, comment="#")


def write_csv(df: DataFrame, path: str) -> None:
    """Rewritten whole."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(row, vec) of .npy matrices, a file per task."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                m = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float32)
                for k in range(0, len(m), 4096):
                    yield pd.DataFrame({"row": range(k, min(len(m), k + 4096)), "vec": list(m[k : k + 4096])})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "row bigint, vec array<float>")


def read_zipped_json(spark: SparkSession, path: str) -> DataFrame:
    """(member, json) of every JSON in ZIP files."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.endswith(".json"):
                            yield pd.DataFrame({"member": [name], "json": [z.read(name).decode("utf-8", "replace")]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "member string, json string")


def json_paths(text: str) -> list[str]:
    """Distinct paths of a JSON document; of a list only the first element counts."""
    found: dict[str, None] = {}

    def walk(x: object, path: str) -> None:
        if path:
            found[path] = None
        if isinstance(x, dict):
            for k, v in x.items():
                walk(v, f"{path}.{k}" if path else k)
        elif isinstance(x, list) and x:
            walk(x[0], f"{path}[]")

    try:
        walk(json.loads(text), "")
    except ValueError:
        return []
    return list(found)


def path_coverage(docs: DataFrame, text: str) -> DataFrame:
    """Share of documents with each path."""

    @F.pandas_udf("array<string>")
    def paths(s: pd.Series) -> pd.Series:
        return s.map(lambda t: json_paths(t) if t else [])

    total = F.broadcast(docs.agg(F.count(F.lit(1)).alias("docs")))
    n = docs.select(F.explode(paths(text)).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("held"))
    return n.crossJoin(total).select("path", "held", (F.col("held") / F.col("docs")).alias("share"))


def preferred(values: Column, language: Column, fallback: str = "eng") -> Column:
    """The text of a language map: the wanted language, else the fallback, else the first."""
    return F.coalesce(F.try_element_at(values, language), F.try_element_at(values, F.lit(fallback)), F.try_element_at(F.map_values(values), F.lit(1)))


def deduplicated(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per distinct content."""
    return files.withColumn("sha256", F.sha2(content, 256)).dropDuplicates(["sha256"])


def outcome_report(attempts: DataFrame, by: str, outcome: str, at: str) -> DataFrame:
    """Tries, successes, their share and the last success of each group."""
    ok = F.col(outcome) == "ok"
    return attempts.groupBy(by).agg(F.count(F.lit(1)).alias("tries"), F.count_if(ok).alias("ok"), F.avg(ok.cast("double")).alias("ok_rate"), F.max(F.when(ok, F.col(at))).alias("last_ok"))


def shared_rows(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """H1."""
    return a.select(*cols).intersect(b.select(*cols))


def split_ranges(total: int, count, first: int, last: int, most: int) -> list[tuple[int, int]]:
    """Halves a range until each part holds at most ``most`` and the parts add up to the total.

    ``count(first, last)`` tells how many there are; a part of one step is kept as it is.
    """
    if first == last or total <= most:
        return [(first, last)]
    mid = (first + last) // 2
    a, b = count(first, mid), count(mid + 1, last)
    if a + b != total:
        raise ValueError(f"{first}..{last}: {a} + {b} is not {total}")
    return split_ranges(a, count, first, mid, most) + split_ranges(b, count, mid + 1, last, most)


def trimmed(doc: Column, languages: Sequence[str]) -> Column:
    """The first wanted language of a map of text lists, repeated texts dropped."""
    return F.array_distinct(F.coalesce(*[F.try_element_at(doc, F.lit(x)) for x in languages], F.try_element_at(F.map_values(doc), F.lit(1))))
