"""N-gram Jaccard join of documents with Bayesian candidate pruning.

Links every two documents whose sets of 5-word shingles have a Jaccard
similarity of 0.8 or more (words as in ``textkit.WORD``, A-Z lowered); see
``near_dup`` for the steps. Result: one row per document with its class (the
smallest doc_id that links lead to) and its number of links.

Bands: 24 of 5 minima; a pair at 0.8 exactly misses all of them with
probability 7e-5, one at 0.85 with 2e-6. The posterior rule drops a pair above
the threshold with probability ``near_dup.TOLERANCE`` at most.

Defined results: a text of fewer than 5 words, but not none, is one shingle; a
null text, or one without words, links to nothing and is its own class; rows
with equal doc_ids are documents of their own that share a class id if their
texts link; null doc_ids are counted as links and take the class of the
others, null if there are none; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import near_dup as nd, textkit as tk
from .cluster import bounded, cut, small_batches

K, BANDS, ROWS = 5, 24, 5
WIDTH = BANDS * ROWS


def _sets(d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tk.shingles(*tk.word_hashes(d, o), K)


@tk.frugal
def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [c for c in b.schema.names if c != "text"]
        data, off = tk.buffers(b.column("text"))
        for i, j, d, o in tk.chunks(data, off):
            h, at = _sets(d, o)
            keys = nd.bands(tk.minhashes(h, at, WIDTH), ROWS)
            digests = [tk.digest(h[at[k] : at[k + 1]].tobytes()) if at[k + 1] > at[k] else None for k in range(j - i)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in keep), pa.array(digests, pa.binary()), lists], names=[*keep, "digest", "bands"])


@tk.frugal
def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = tk.buffers(b.column("text"))
        for _, _, d, o in tk.chunks(data, off):
            h, at = _sets(d, o)
            sig = tk.minhashes(h, at, WIDTH)
            full = np.flatnonzero(np.diff(at) > 0)
            sets = [h[at[k] : at[k + 1]].tobytes() for k in full]
            yield pa.RecordBatch.from_arrays(
                [pa.array([tk.digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary()), pa.array([sig[k].tobytes() for k in full], pa.binary())],
                names=["digest", "grams", "sig"],
            )


def _linked(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, many, linked): every row with its digest, the digests of several rows, and those with links and the root of their class.

    ``docs``: doc_id, text, and columns that ``rows`` keep.
    """
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    rows = cut(small_batches(docs).mapInArrow(_prints, f"{kept}, digest binary, bands array<bigint>"))
    classes = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("times"), F.first("bands").alias("bands"))
    near = cut(nd.candidates(classes))
    known = classes.select("digest", "first", "times").withColumn("node", nd.node_of())
    members = cut(known.join(near, "node").select("digest", "first", "times", "root"))
    # Only the texts of candidates are read again; a class without a doc_id is found among the rows without one.
    wanted = bounded(members.filter("first IS NOT NULL").select(F.col("first").alias("doc_id")).distinct(), nd.MOST_BROADCAST)
    texts = docs.select("doc_id", "text")
    again = texts.join(wanted, "doc_id", "left_semi").union(texts.filter("doc_id IS NULL"))
    grams = again.mapInArrow(_grams, "digest binary, grams binary, sig binary")
    sets = members.select("digest", "times", "root").join(grams, "digest").groupBy("digest", "times", "root").agg(F.first("grams").alias("grams"), F.first("sig").alias("sig"))
    linked = cut(nd.links(sets, WIDTH, threshold).join(members.select("digest", "first"), "digest"))
    group = linked.groupBy("root").agg(F.min("first").alias("class_id"))
    return rows, classes.filter("times > 1").select("digest", "times", "first"), linked.join(group, "root").select("digest", "root", "links", "class_id")


def join(docs: DataFrame, threshold: float = nd.THRESHOLD) -> DataFrame:
    """doc_id, class_id and n_links of every row."""
    rows, many, linked = _linked(docs.select("doc_id", "text"), threshold)
    told = many.join(linked.drop("root"), "digest", "full").select(
        "digest", F.coalesce("class_id", "first").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.coalesce("times", F.lit(1)) - 1).alias("n_links")
    )
    told = bounded(cut(told), nd.MOST_BROADCAST)
    return rows.select("doc_id", "digest").join(told, "digest", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def keep_one(docs: DataFrame, threshold: float = nd.THRESHOLD) -> DataFrame:
    """The documents without those that have a class of a smaller doc_id; rows without a doc_id stay.

    It decides by doc_id alone: see ``keep_row`` for one row of each class.
    """
    gone = cut(join(docs, threshold).filter("doc_id <> class_id").select("doc_id").distinct())
    return docs.join(bounded(gone, nd.MOST_BROADCAST), "doc_id", "left_anti").select(*docs.columns)


def keep_row(docs: DataFrame, threshold: float = nd.THRESHOLD) -> DataFrame:
    """Exactly one row of each class, in the columns it came in: of the smallest doc_id (null last), then of the smallest key.

    The key is made of the text and all other columns, so rows are told apart
    whatever their doc_ids are; of rows that are equal throughout one stays.
    Rows without words are in no class and stay.
    """
    others = [docs[c] for c in docs.columns if c != "text"]
    key = F.unhex(F.concat(F.md5(F.coalesce("text", F.lit(""))), F.md5(F.to_json(F.struct(*others)))))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), key.alias("row_key"))
    rows, many, linked = _linked(keyed.select("doc_id", "text", "row_key"), threshold)
    told = many.select("digest").join(linked.select("digest", "root"), "digest", "full").select("digest", F.coalesce("root", "digest").alias("root"))
    told = bounded(cut(told), nd.MOST_BROADCAST)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    members = rows.select("doc_id", "row_key", "digest").join(told, "digest").groupBy("root", "doc_id", "row_key").agg(F.count(F.lit(1)).alias("times"))
    members = cut(members)
    firsts = bounded(cut(members.groupBy("root").agg(F.min(place).alias("first"))), nd.MOST_BROADCAST // 2)
    judged = members.join(firsts, "root").select("row_key", "times", (F.col("first.row_key") == F.col("row_key")).alias("stays"))
    gone = cut(judged.filter("NOT stays OR times > 1").select("row_key", "stays"))
    kept = keyed.join(bounded(gone.select("row_key"), nd.MOST_BROADCAST // 2), "row_key", "left_anti")
    again = gone.filter("stays").select("row_key")
    if not again.isEmpty():
        same = keyed.join(bounded(again, nd.MOST_BROADCAST // 2), "row_key", "left_semi").groupBy("row_key").agg(F.first("row").alias("row"))
        kept = kept.select("row").union(same.select("row"))
    return kept.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
