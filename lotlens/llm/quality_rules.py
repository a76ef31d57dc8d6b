"""Quality rules with cross-document line frequency.

Base rules look at one text: counts of words, symbols, repeated lines and
repeated 3-word windows. The line rule looks across the corpus: every line is
normalised (A-Z lowered, digits made 0, ASCII white space dropped) and hashed;
for each host (``source``) the distinct texts that hold a line are counted.
Lines found in more than ``max(MIN_DOCS, LINE_SHARE * texts of the host)``
texts are boilerplate of the host, and lines found in more than
``max(MIN_DOCS, LINE_SHARE * texts of all hosts)`` texts, each host's own counted,
are boilerplate everywhere. They are removed; a document that loses more than
``DEPLETED`` of its normalised bytes is rejected.

Exact copies count once, so a text is never rejected for having copies.

Defined results: a null or empty text has no words and fails the base rules; a
null source is the host ''; repeated rows are judged alike; an empty table
gives an empty result; other columns of the input are ignored by ``judge`` and
kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from . import textkit as tk
from .cluster import cut, small_batches

#: A line is boilerplate only in more than this many distinct texts of a host,
MIN_DOCS = 20
#: and in more than this share of the host's distinct texts (or of all hosts').
LINE_SHARE = 0.02
#: A document losing more than this share of its normalised bytes is rejected.
DEPLETED = 0.5
#: Most boilerplate lines (8 bytes each), over all hosts, that are broadcast; more are joined by host.
MOST_BROADCAST = 1_000_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NORMAL = tk.LOWER.copy()
_NORMAL[48:58] = 48


def _lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each line with a closing total, first line of each document)."""
    breaks = np.flatnonzero(data == 10) + 1
    starts = np.unique(np.concatenate([breaks[breaks < len(data)], off[:-1][np.diff(off) > 0]])).astype(np.int64)
    return np.append(starts, len(data)), np.searchsorted(starts, off)


def _normal_lines(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, bytes) of each line after normalising."""
    solid = tk.SOLID[data]
    at = np.concatenate([[0], np.cumsum(solid)])[starts]
    packed = _NORMAL[data[solid]]
    return tk.span_hashes(packed, at[:-1], at[1:]), np.diff(at)


@tk.frugal
def _corpus_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = tk.buffers(b.column("text"))
        host = b.column("host")
        for i, j, d, o in tk.chunks(data, off):
            starts, first = _lines(d, o)
            h, size = _normal_lines(d, starts)
            rows = []
            for k in range(j - i):
                at, to = first[k], first[k + 1]
                rows.append(np.unique(h[at:to][size[at:to] > 0]).astype(np.int64))
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    host.slice(i, j - i),
                    pa.array([tk.digest(d[o[k] : o[k + 1]].tobytes()) for k in range(j - i)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))),
                ],
                names=["host", "digest", "lines"],
            )


def boilerplate(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = LINE_SHARE) -> DataFrame:
    """(host, line): hashes of the lines above the limits; a null host stands for every host.

    A host has at most ``lines per text / share`` of them.
    """
    texts = small_batches(docs).select(F.coalesce(F.col("source"), F.lit("")).alias("host"), "text")
    distinct = (
        texts.mapInArrow(_corpus_lines, "host string, digest binary, lines array<bigint>")
        .groupBy("host", "digest")
        .agg(F.first("lines").alias("lines"))
    )
    distinct = cut(distinct.select("host", "lines"))
    total = cut(distinct.groupBy("host").agg(F.count(F.lit(1)).alias("texts")))
    every = F.broadcast(total.agg(F.coalesce(F.sum("texts"), F.lit(0)).alias("texts")))  # one row
    held = distinct.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("held"))
    held = cut(held)
    of_host = held.filter(F.col("held") > min_docs).join(total, "host").filter(F.col("held") > F.col("texts") * F.lit(share))
    of_all = held.groupBy("line").agg(F.sum("held").alias("held")).filter(F.col("held") > min_docs).crossJoin(every).filter(F.col("held") > F.col("texts") * F.lit(share))
    return of_host.select("host", "line").union(of_all.select(F.lit(None).cast("string"), "line"))


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(h: np.ndarray) -> int:
    if len(h) < 4:
        return 0
    tri = tk.mix(h[:-2] + tk.mix(h[1:-1] + tk.mix(h[2:])))
    _, back, count = np.unique(tri, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(count[back] > 1)
    cover = np.zeros(len(h), bool)
    for k in range(3):
        cover[hit + k] = True
    return int(cover.sum())


def _judged(depleted: float, with_text: bool, known: Broadcast | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = tk.buffers(b.column("text"))
            if known is None:
                listed = [np.sort(x.values.to_numpy()) if x.is_valid else None for x in b.column("boiler")]
            else:
                anywhere = known.value.get(None)
                listed = [known.value.get(h, anywhere) for h in b.column("boiler").to_pylist()]
            for i, j, d, o in tk.chunks(data, off):
                out = _judge_chunk(d, o, listed[i:j], depleted, with_text)
                keep = [b.column(n).slice(i, j - i) for n in b.schema.names if n not in ("text", "boiler")]
                names = [n for n in b.schema.names if n not in ("text", "boiler")]
                yield pa.RecordBatch.from_arrays(keep + list(out.values()), names=names + list(out))

    return run


def _judge_chunk(d: np.ndarray, o: np.ndarray, listed: list[np.ndarray | None], depleted: float, with_text: bool) -> dict:
    """``listed``: the sorted boilerplate of each document's host."""
    n = len(o) - 1
    ws, we, first = tk.word_bounds(d, o, tk.SOLID)
    words = tk.span_hashes(d, ws, we)
    point = np.concatenate([[0], np.cumsum(tk.SOLID[d] & ((d & 0xC0) != 0x80))])
    symbol = np.concatenate([[0], np.cumsum(_SYMBOL[d])])
    starts, lfirst = _lines(d, o)
    raw_ends = np.where(d[starts[1:] - 1] == 10, starts[1:] - 1, starts[1:]) if len(starts) > 1 else starts[1:]
    raw = tk.span_hashes(d, starts[:-1], raw_ends)
    normal, size = _normal_lines(d, starts)
    res = {k: np.zeros(n, np.int64) for k in _COUNTS}
    res["n_words"][:] = np.diff(first)
    res["word_chars"][:] = point[o[1:]] - point[o[:-1]]
    res["n_symbols"][:] = symbol[o[1:]] - symbol[o[:-1]]
    lost, texts = np.zeros(n, bool), []
    removed = np.zeros(n, np.int64)
    for k in range(n):
        a, z = lfirst[k], lfirst[k + 1]
        filled = size[a:z] > 0
        res["n_dup_lines"][k] = filled.sum() - len(np.unique(raw[a:z][filled]))
        res["n_repeat_words"][k] = _repeat_words(words[first[k] : first[k + 1]])
        bad = np.zeros(z - a, bool)
        if listed[k] is not None and len(listed[k]) and z > a:
            own = normal[a:z].astype(np.int64)
            bad = filled & (listed[k][np.minimum(np.searchsorted(listed[k], own), len(listed[k]) - 1)] == own)
        removed[k] = bad.sum()
        lost[k] = size[a:z][bad].sum() > depleted * size[a:z].sum()
        if with_text:
            body = d[o[k] : o[k + 1]].tobytes()
            if bad.any():
                body = b"\n".join(x for x, y in zip(body.split(b"\n"), [*bad, False], strict=False) if not y)
            texts.append(body.decode("utf-8", "replace"))
    failed = (res["n_words"] < 50) | (100 * res["n_repeat_words"] > 50 * res["n_words"])
    out = {k: pa.array(v) for k, v in res.items()}
    out |= {"base_failed": pa.array(failed), "kept": pa.array(~failed & ~lost), "n_removed_lines": pa.array(removed)}
    return out | ({"cleaned": pa.array(texts, pa.string())} if with_text else {})


_OUT = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, n_removed_lines bigint"


def _with_boiler(docs: DataFrame, **limits) -> tuple[DataFrame, Broadcast | None]:
    """``docs`` (text, source, more) with the column boiler: the host, if its lines are broadcast, else the lines themselves."""
    bad = cut(boilerplate(docs.select("text", "source"), **limits))
    host = F.coalesce(docs["source"], F.lit(""))
    if bad.count() <= MOST_BROADCAST:
        rows = bad.toArrow()
        hosts, lines = np.array(rows.column("host").to_pylist(), object), rows.column("line").to_numpy()
        own = {h: lines[hosts == h] for h in set(hosts.tolist())}
        anywhere = own.get(None, np.zeros(0, np.int64))
        known = {h: np.unique(np.concatenate([x, anywhere])) for h, x in own.items()}
        return docs.withColumn("boiler", host), docs.sparkSession.sparkContext.broadcast(known)
    anywhere = bad.filter("host IS NULL").agg(F.collect_list("line").alias("anywhere"))
    lists = bad.filter("host IS NOT NULL").groupBy("host").agg(F.collect_list("line").alias("lines"))
    held = docs.withColumn("host_key", host).join(lists.withColumnRenamed("host", "host_key"), "host_key", "left").crossJoin(anywhere).drop("host_key")
    none = F.array().cast("array<bigint>")
    return held.withColumn("boiler", F.concat(F.coalesce("lines", none), F.coalesce("anywhere", none))).drop("lines", "anywhere"), None


def judge(docs: DataFrame, depleted: float = DEPLETED, **limits) -> DataFrame:
    """One row per document: the counts, base_failed and the verdict ``kept``."""
    held, known = _with_boiler(docs.select("doc_id", "text", "source"), **limits)
    return held.select("doc_id", "text", "boiler").mapInArrow(tk.frugal(_judged(depleted, False, known)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_OUT}")


def clean(docs: DataFrame, depleted: float = DEPLETED, **limits) -> DataFrame:
    """The kept documents in the columns they came in, boilerplate lines removed."""
    extra = [f for f in docs.schema.fields if f.name != "text"]
    packed = docs.select(F.struct(*[docs[f.name] for f in extra]).alias("rest"), docs["text"].alias("text"), docs["source"].alias("source"))
    held, known = _with_boiler(packed, **limits)
    held = held.select("rest", "text", "boiler")
    done = held.mapInArrow(tk.frugal(_judged(depleted, True, known)), f"rest {T.StructType(extra).simpleString()}, {_OUT}, cleaned string").filter("kept")
    texts = {"text": F.col("cleaned"), "n_chars": F.char_length("cleaned").cast("bigint")}
    return done.select(*[texts.get(c, F.col("rest")[c]).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every document of the corpus."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_removed_lines")


#: The same rows in DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, text FROM d),
tri AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM words WHERE len(w) > 3),
tri2 AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS t FROM tri),
tri3 AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, t) AS c FROM tri2),
rep AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (
    SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM tri3 WHERE c > 1) GROUP BY doc_id),
lines AS (
  SELECT doc_id, host, line, translate(regexp_replace(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'), '[0-9]', '0', 'g'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS normal
  FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d)),
dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE normal <> '' GROUP BY doc_id),
firsts AS (SELECT host, text, min(doc_id) AS doc_id FROM d GROUP BY host, text),
total AS (SELECT host, count(*) AS texts FROM firsts GROUP BY host),
held AS (
  SELECT l.host, l.normal, count(DISTINCT l.doc_id) AS held
  FROM lines l JOIN firsts f ON l.doc_id = f.doc_id AND l.host = f.host WHERE l.normal <> '' GROUP BY 1, 2),
everywhere AS (SELECT normal FROM held GROUP BY 1 HAVING sum(held) > 20 AND sum(held) > 0.02 * (SELECT sum(texts) FROM total)),
bad AS (SELECT h.host, h.normal FROM held h JOIN total t USING (host) WHERE (held > 20 AND held > 0.02 * texts) OR h.normal IN (SELECT normal FROM everywhere)),
lost AS (
  SELECT l.doc_id, sum(CASE WHEN b.normal IS NOT NULL THEN strlen(l.normal) ELSE 0 END) > 0.5 * sum(strlen(l.normal)) AS lost
  FROM lines l LEFT JOIN bad b ON l.host = b.host AND l.normal = b.normal GROUP BY l.doc_id),
base AS (
  SELECT words.doc_id, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, false) AS lost
  FROM words LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT lost AS kept
FROM base
"""
