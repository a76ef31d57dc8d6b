"""Quality classifier: a factorisation machine.

Inputs of a score: hashed words of the whole text (square roots of counts,
scaled to length one) and structure statistics. With factors v, the pairwise
part is 1/2 * sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2], linear in the
number of inputs. labels, lang, source and doc_id are never inputs.

Fitting uses at most ``MAX_TRAIN`` labelled rows (those with the lowest hash of
doc_id), never rows with crc32(doc_id as text) mod 3 = 1. Everything is scored.

Defined results: a null or empty text is scored from its statistics; without
usable labels every score is 0.5; null labels and null ids are not fitted on;
of a doc_id labelled more than once the lower label counts, and one of its rows is fitted on;
repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textkit as tk
from .cluster import small_batches

#: Most labelled rows that are fitted on; they are collected to the driver as features.
MAX_TRAIN = 6000
BITS, FACTORS, EPOCHS, BATCH, RATE, SEED = 14, 4, 6, 32, 0.1, 7
STATS = 10
SIZE = (1 << BITS) + STATS


def features(d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, values, offsets) of a chunk of texts; ids of a document are distinct."""
    n = len(o) - 1
    starts, ends, first = tk.word_bounds(d, o)
    h = tk.span_hashes(tk.LOWER[d], starts, ends)
    count = np.diff(first)
    doc = np.repeat(np.arange(n), count)
    key, times = np.unique(doc * (1 << BITS) + (h >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    who, ids = key >> BITS, (key & ((1 << BITS) - 1)).astype(np.int32)
    values = np.sqrt(times / np.maximum(count, 1)[who])
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[o]).astype(float)
    size = np.maximum(np.diff(o), 1).astype(float)
    words = np.maximum(count, 1).astype(float)
    solid = np.maximum(total(tk.SOLID[d]), 1)
    letters = total(tk.WORD[d])
    lines = total(d == 10) + 1
    longest = np.zeros(n)
    if len(starts):
        full = np.flatnonzero(count > 0)
        longest[full] = np.maximum.reduceat(ends - starts, first[:-1][full])
    kinds = np.bincount(who, minlength=n)
    stats = np.stack([
        np.log1p(count) / 10, letters / solid / 2, total((d >= 65) & (d <= 90)) / size * 5, total((d >= 48) & (d <= 57)) / size * 5,
        total(d >= 128) / size, solid / words / 20, np.log1p(size / lines) / 10, kinds / words, np.log1p(longest) / 5, total((d > 32) & ~tk.WORD[d]) / solid * 2,
    ], axis=1)
    where = np.searchsorted(who, np.arange(1, n + 1))
    ids = np.insert(ids, np.repeat(where, STATS), np.tile(np.arange(STATS, dtype=np.int32) + (1 << BITS), n))
    values = np.insert(values, np.repeat(where, STATS), stats.ravel())
    return ids, values.astype(np.float32), np.concatenate([[0], np.cumsum(kinds + STATS)])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    @staticmethod
    def empty() -> Machine:
        return Machine(0.0, np.zeros(SIZE, np.float32), np.zeros((SIZE, FACTORS), np.float32))

    def logits(self, ids: np.ndarray, x: np.ndarray, off: np.ndarray) -> np.ndarray:
        at = off[:-1]
        vx = self.factors[ids] * x[:, None]
        sums = np.add.reduceat(vx, at, axis=0)
        squares = np.add.reduceat((vx * vx).sum(1), at)
        return self.bias + np.add.reduceat(self.linear[ids] * x, at) + 0.5 * ((sums * sums).sum(1) - squares)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Machine:
    """Adagrad over the (ids, values, label) rows in a fixed order."""
    m = Machine.empty()
    labels = np.array([y for *_, y in rows], float)
    if len(set(labels)) < 2:
        return m
    rng = np.random.RandomState(SEED)
    m.factors = rng.normal(0, 0.05, (SIZE, FACTORS)).astype(np.float32)
    g_linear, g_factors, g_bias = np.full(SIZE, 1e-6), np.full((SIZE, FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for b in range(0, len(order), BATCH):
            some = [rows[i] for i in order[b : b + BATCH]]
            ids, x = np.concatenate([r[0] for r in some]), np.concatenate([r[1] for r in some])
            size = np.array([len(r[0]) for r in some])
            off = np.concatenate([[0], np.cumsum(size)])
            y = labels[order[b : b + BATCH]]
            miss = (1 / (1 + np.exp(-np.clip(m.logits(ids, x, off), -30, 30))) - y) / len(some)
            per = np.repeat(miss, size) * x
            vx = m.factors[ids] * x[:, None]
            sums = np.add.reduceat(vx, off[:-1], axis=0)
            pull = per[:, None] * (np.repeat(sums, size, axis=0) - vx)
            used, back = np.unique(ids, return_inverse=True)
            d_linear = np.bincount(back, per) + 1e-5 * m.linear[used]
            d_factors = np.stack([np.bincount(back, pull[:, f]) for f in range(FACTORS)], 1) + 1e-4 * m.factors[used]
            g_linear[used] += d_linear**2
            g_factors[used] += d_factors**2
            m.linear[used] -= RATE * d_linear / np.sqrt(g_linear[used])
            m.factors[used] -= RATE * d_factors / np.sqrt(g_factors[used])
            g_bias += miss.sum() ** 2
            m.bias -= RATE * miss.sum() / np.sqrt(g_bias)
    return m


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = tk.buffers(b.column("text"))
        for i, j, d, o in tk.chunks(data, off):
            ids, x, at = features(d, o)
            lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(v)) for v in (ids, x)]
            yield pa.RecordBatch.from_arrays([*(b.column(n).slice(i, j - i) for n in ("doc_id", "label")), *lists], names=["doc_id", "label", "ids", "x"])


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", most: int = MAX_TRAIN) -> Machine:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & (fold != 1))
    usable = usable.groupBy("doc_id").agg(F.min(F.col(target).cast("int")).alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # At most ``most`` rows of two numbers are broadcast, and as many rows of features collected, each of SIZE at most.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = texts.select("doc_id", "label", "text").mapInArrow(_featurise, f"doc_id {kind}, label int, ids array<int>, x array<float>")
    got = found.groupBy("doc_id").agg(F.min(F.struct("label", "ids", "x")).alias("one")).select("one.*").toArrow()
    rows = [(np.asarray(i.values, np.int32), np.asarray(x.values, np.float32), y) for i, x, y in zip(got["ids"], got["x"], got["label"].to_pylist(), strict=True)]
    rows.sort(key=lambda r: (r[2], len(r[0]), r[0].tobytes(), r[1].tobytes()))  # the order of tasks must not matter
    return fit(rows)


def _scored(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = tk.buffers(b.column("text"))
            for i, j, d, o in tk.chunks(data, off):
                score = 1 / (1 + np.exp(-np.clip(machine.logits(*features(d, o)).astype(float), -30, 30)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(score)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", "text").mapInArrow(_scored(machine), f"doc_id {kind}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return score(docs, machine).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
