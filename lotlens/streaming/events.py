"""Structured Streaming forms: windows with watermarks, idempotent appends, late labels, counters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ledger import Ledger


def read(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def tumbling(df: DataFrame, at: str, by: Sequence[str], length: str, late: str | None = None) -> DataFrame:
    """Counts and sums of ``value`` by window; the same plan on a batch or, with ``late``, on a stream."""
    df = df.withWatermark(at, late) if late else df
    return df.groupBy(F.window(at, length), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sliding(df: DataFrame, at: str, by: Sequence[str], length: str, step: str, late: str | None = None) -> DataFrame:
    df = df.withWatermark(at, late) if late else df
    return df.groupBy(F.window(at, length, step), *by).agg(F.count(F.lit(1)).alias("n"))


def sessions(df: DataFrame, at: str, by: Sequence[str], gap: str, late: str | None = None) -> DataFrame:
    df = df.withWatermark(at, late) if late else df
    return df.groupBy(F.session_window(at, gap), *by).agg(F.count(F.lit(1)).alias("n"))


def first_within(df: DataFrame, key: Sequence[str], at: str, rest: str) -> DataFrame:
    """The first row of a key within a rest time (a firm is not written to again)."""
    return df.withWatermark(at, rest).dropDuplicatesWithinWatermark(list(key))


def late_labels(calls: DataFrame, awards: DataFrame, key: str, at: str, awarded: str, wait: str) -> DataFrame:
    """Calls with the award that comes within ``wait``, or without one once the watermark has passed."""
    c = calls.withWatermark(at, "1 day")
    a = awards.withWatermark(awarded, "1 day").withColumnRenamed(key, f"{key}__award")
    near = F.expr(f"{key} = {key}__award AND {awarded} >= {at} AND {awarded} <= {at} + INTERVAL {wait}")
    return c.join(a, near, "left_outer").drop(f"{key}__award")


def append_ledger(df: DataFrame, ledger: Ledger, order: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Each batch appends what the ledger lacks, so a batch that runs again adds nothing."""
    return df.writeStream.foreachBatch(lambda rows, _: ledger.append(rows, order) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(df: DataFrame, key: str, flag: str) -> DataFrame:
    """How often ``flag`` held for each key so far, with the count kept as state."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for part in parts:
            n += int(part[flag].sum())
        state.update((n,))
        yield pd.DataFrame({key: [k[0]], "n": [n]})

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n bigint", "n bigint", "update", GroupStateTimeout.NoTimeout)
