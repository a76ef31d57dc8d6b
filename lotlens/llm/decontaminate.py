r"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are runs of digits, letters and non-ASCII characters, A-Z lowered. A
window is ``WINDOW`` consecutive words of an item; an item of fewer words, but
not none, is one window. Each window keeps the smallest hash of its ``GRAM``
-word grams (its fingerprint), on both sides; documents' fingerprints are joined
to the distinct fingerprints of the items, and a hit is extended to the window
and compared word by word. Equal windows have equal fingerprints, so no shared
span of WINDOW words is missed. Short items are joined by the hash of all their
words, one pass for each of the at most nine short lengths that occur.

Defined results: null texts have no words; rows with equal ids and texts are
judged alike; items without an id, or without words, are not counted; a null
doc_id is kept; empty tables on either side give no hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .cluster import bounded, cut

WINDOW, GRAM = 10, 5
#: Word characters before lowering: digits, letters, everything outside ASCII. Single
#: characters are looked up in a bit set by the regex engine, ranges are not.
PATTERN = r"[0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz\x{80}-\x{10FFFF}]+"
#: Most benchmark rows (a hash each, or a window each) that are broadcast; beyond that both sides are shuffled.
MOST_PRINTS, MOST_WINDOWS = 1_000_000, 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))
    ascii_only = lambda w: F.char_length(w) == F.octet_length(w)
    return F.transform(found, lambda w: F.when(ascii_only(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER)))


def _places(count: Column, width: int) -> Column:
    """0-based starts of the windows of ``width`` among ``count`` words."""
    none = F.array().cast("array<int>")
    return F.when(count >= width, F.sequence(F.lit(0), count - width)).otherwise(none)


def _grams(hashes: Column, width: int) -> Column:
    """The hash of every run of ``width`` word hashes."""
    return F.transform(_places(F.size(hashes), width), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))


def _hashed(table: DataFrame, key: list[str]) -> DataFrame:
    return table.select(*key, words(F.col("text")).alias("words")).select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))


def _prints(hashed: DataFrame, key: list[str], width: int) -> DataFrame:
    """(key, words, at, print): the fingerprint of every window of ``width`` words."""
    if width < WINDOW:
        prints = _grams(F.col("hashes"), width)
        return hashed.select(*key, "words", F.posexplode(prints).alias("at", "print"))
    step = hashed.select(*key, "words", _grams(F.col("hashes"), GRAM).alias("grams"))
    span = WINDOW - GRAM + 1
    least = F.transform(_places(F.size("grams"), span), lambda i: F.least(*[F.get(F.col("grams"), i + k) for k in range(span)]))
    return step.select(*key, "words", F.posexplode(least).alias("at", "print"))


def _text(width: int) -> Column:
    return F.array_join(F.slice("words", F.col("at") + 1, width), " ")


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, version, hit, items): words covered and ids of the items found, of each contaminated document.

    ``docs``: doc_id, version, text. A document's rows here are its own windows only.
    """
    key = ["doc_id", "version"]
    items = benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text")
    items = cut(_hashed(items, ["item"]))
    widths = sorted(r["width"] for r in items.select(F.least(F.size("words"), F.lit(WINDOW)).alias("width")).filter("width > 0").distinct().collect())
    texts = _hashed(docs, key)
    found = []
    for width in widths:
        of = F.size("words") >= WINDOW if width == WINDOW else F.size("words") == width
        held = _prints(items.filter(of), ["item"], width).select("item", "print", _text(width).alias("window"))
        held = cut(held.groupBy("print", "window").agg(F.collect_set("item").alias("items")))
        prints = bounded(held.select("print").distinct(), MOST_PRINTS)
        windows = bounded(held.select("window", "items"), MOST_WINDOWS, "items")
        near = _prints(texts, key, width).join(prints, "print", "left_semi").select(*key, "at", _text(width).alias("window"))
        found.append(near.join(windows, "window").select(*key, "at", F.lit(width).alias("width"), "items"))
    if not found:
        return docs.select(*key, F.lit(0).cast("bigint").alias("hit"), F.array().cast("array<string>").alias("items")).limit(0)
    every = reduce(DataFrame.union, found).groupBy(*key).agg(F.collect_set(F.struct("at", "width")).alias("at"), F.collect_set("items").alias("items"))
    cover = F.flatten(F.transform("at", lambda x: F.sequence(x["at"], x["at"] + x["width"] - 1)))
    return every.select(*key, F.size(F.array_distinct(cover)).cast("bigint").alias("hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))


def measure(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("version"))
    found = hits(rows.select("doc_id", "version", "text"), benchmark.select("item_id", "text"))
    found = found.select(F.col("doc_id").alias("h_id"), F.col("version").alias("h_version"), "hit", "items")
    base = rows.select("doc_id", "version", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(PATTERN)).cast("bigint").alias("n_words"))
    held = base.join(found, base["doc_id"].eqNullSafe(found["h_id"]) & (base["version"] == found["h_version"]), "left")
    n_hit = F.coalesce("hit", F.lit(0).cast("bigint"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return held.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that hold no window of the benchmark, in the columns they came in."""
    named = docs.select(F.struct(*docs.columns).alias("row"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).withColumn("version", F.xxhash64("text"))
    found = hits(named.select("doc_id", "version", "text"), benchmark.select("item_id", "text"))
    found = bounded(cut(found.select(F.col("doc_id").alias("h_id"), F.col("version").alias("h_version"))), MOST_PRINTS)
    return named.join(found, named["doc_id"].eqNullSafe(found["h_id"]) & (named["version"] == found["h_version"]), "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document."""
    return measure(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The same rows in DuckDB.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + 9], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
h AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN bw ON dw.t = bw.t AND dw.n = bw.n),
c AS (SELECT doc_id, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
i AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""
