"""Helpers for jobs that must survive lost executors on a shared cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..lineage import cut

__all__ = ["bounded", "cut", "small_batches"]

#: Rows of an Arrow batch: whole texts are wide rows, and a task holds batches on both sides of the pipe.
BATCH_ROWS = 400


def bounded(df: DataFrame, most: int, lists: str | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows (it should be cut before).

    Rows have a fixed width, but for the column ``lists``, whose elements are
    counted too. Beyond the bound the planner is left to shuffle both sides.
    """
    size = df.agg(F.count(F.lit(1)) + (F.coalesce(F.sum(F.size(lists)), F.lit(0)) if lists else F.lit(0))).first()[0]
    return F.broadcast(df) if size <= most else df


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands rows to Python by ``BATCH_ROWS`` at most (a setting of batches, not of rows kept)."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df
