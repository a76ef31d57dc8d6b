"""Paragraph dedup by MinHash banding over content-cut paragraphs.

A shared passage seldom fills a line, so paragraphs are cut by content: a word
begins a paragraph if the hash of it and the next word is the least among
``REACH`` words on either side (the first of equals), and a paragraph of more than
``LONGEST`` words is cut again after each ``LONGEST``. Equal passages are therefore
cut alike wherever they stand, within a line or across lines, but for some
``REACH`` words at their ends. The first and the last paragraph of a text join
their neighbours if they have at most ``REACH`` words. Every word is in exactly one
paragraph.

Paragraphs whose 5-word shingles have a Jaccard similarity of 0.8 or more are
linked (bands of ``ROWS`` minima find the candidates, ``near_dup`` verifies the
pairs of each band exactly), links are joined into components, and of
each component the first paragraph (smallest doc_id, then place) stays. Equal
sets are one class before any pair is compared. A set too small to reach the
threshold with any other set has no bands: it is matched exactly. Paragraphs of
fewer than ``K`` words have one shingle, so all their words are matched.

A band of more than ``HOT`` paragraphs, as a common phrase makes it, is not compared
in all pairs. A shingle of one paragraph alone is in no intersection, so the others
say all of it but the sizes: paragraphs of one size and with equal others are one
class, linked alike to everything in the band. Classes are dealt out again by the
rarest shingles of each: two sets of a and b shingles that reach the threshold t
share t * max(a, b) of them, so in any order they share one of the first
a - ceil(t * a) + 1 of a and as many of b. No link is lost by that, and groups that
are still hot are dealt out the same way, ``LEVELS`` times; what is hot after that is
compared in all pairs.

Bands: 4 of 2 minima, tuned for recall: a pair at 0.8 exactly misses all of
them with probability 1.7 %, one at 0.9 with 0.1 %; equal sets never.

Defined results: a null or empty text has no paragraphs; rows with equal ids
and texts count as one document and get equal rows; a null doc_id comes first;
an empty table gives an empty result; other columns are ignored by ``measure``
and kept by ``clean``, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import near_dup as nd, textkit as tk
from .cluster import bounded, cut, small_batches
from .graph import components

K, BANDS, ROWS = 5, 4, 2
REACH, LONGEST = 8, 64
#: Members of a block: paragraphs are small, so larger blocks than those of documents save copies of a hot band.
BLOCK = 192
#: Members of a band that are compared in all pairs, and how often a larger band is dealt out again.
HOT, LEVELS = 64, 3


def cuts(words: np.ndarray, first: np.ndarray, reach: int = REACH, longest: int = LONGEST) -> np.ndarray:
    """First words of the paragraphs, in order. ``words``: hashes; ``first``: first word of each document with a closing total."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    count = np.diff(first)
    begin, end = np.repeat(first[:-1], count), np.repeat(first[1:], count)
    place = np.arange(n)
    after = np.concatenate([words[1:], words[:1]])
    after[first[1:][count > 0] - 1] = 0
    gram = tk.mix(words + tk.mix(after))
    least = np.ones(n, bool)
    for j in range(1, reach + 1):
        if j >= n:
            break
        least[j:] &= (place[j:] - j < begin[j:]) | (gram[:-j] > gram[j:])
        least[:-j] &= (place[:-j] + j >= end[:-j]) | (gram[j:] >= gram[:-j])
    least &= (place - begin > reach) & (end - place > reach)
    least[first[:-1][count > 0]] = True
    at = np.flatnonzero(least)
    size = np.diff(np.append(at, n))
    more = (size - 1) // longest + 1
    step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
    return np.repeat(at, more) + step * longest


class _Cut:
    """The paragraphs of a chunk: document, bytes from lo to hi within it, shingles and their offsets."""

    def __init__(self, d: np.ndarray, o: np.ndarray):
        starts, ends, first = tk.word_bounds(d, o)
        words = tk.span_hashes(tk.LOWER[d], starts, ends)
        at = cuts(words, first)
        self.doc = np.searchsorted(first, at, "right") - 1
        close = np.append(at[1:], len(words))
        last = np.ones(len(at), bool)
        last[:-1] = self.doc[1:] != self.doc[:-1]
        self.lo = starts[at] - o[self.doc]
        self.hi = self.lo.copy()
        self.hi[:-1] = np.where(last[:-1], 0, self.lo[1:])
        self.hi[last] = ends[close[last] - 1] - o[self.doc[last]]
        self.h, self.off = tk.shingles(words, np.append(at, len(words)), K)


def _digests(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers of each set, whatever its order: sums of its mixed members."""
    out = []
    for salt in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(h ^ salt))])
        out.append(tk.mix(total[off[1:]] - total[off[:-1]] + np.diff(off).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _prints(threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = tk.buffers(b.column("text"))
            for i, j, d, o in tk.chunks(data, off):
                c = _Cut(d, o)
                size = np.diff(c.off)
                near = size >= threshold * (size + 1) - 1e-9  # the best match of another set shares all of one and has one more
                keys = nd.bands(tk.minhashes(c.h, c.off, BANDS * ROWS), ROWS)
                one, two = _digests(c.h, c.off)
                ends = np.searchsorted(c.doc, np.arange(j - i + 1))
                # A paragraph ends where the next begins, so n + 1 places tell n of them.
                filled = np.flatnonzero(np.diff(ends) > 0)
                edges = np.insert(c.lo, ends[filled + 1], c.hi[ends[filled + 1] - 1]).astype(np.int32)
                more = np.concatenate([[0], np.cumsum(np.diff(ends) > 0)])
                lists = [pa.ListArray.from_arrays(pa.array((ends + more).astype(np.int32)), pa.array(edges))]
                lists += [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x)) for x in (one, two)]
                lists.append(pa.ListArray.from_arrays(pa.array((ends * BANDS).astype(np.int32)), pa.array(keys.ravel(), mask=np.repeat(~near, BANDS))))
                keep = [b.column(n).slice(i, j - i) for n in ("doc_id", "version")]
                yield pa.RecordBatch.from_arrays([*keep, *lists], names=["doc_id", "version", "edges", "one", "two", "bands"])

    return run


def _grams(wanted: Broadcast | None) -> Callable:
    """The shingles of the paragraphs whose first number is among the wanted ones (sorted), or of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = tk.buffers(b.column("text"))
            for _, _, d, o in tk.chunks(data, off):
                c = _Cut(d, o)
                one, two = _digests(c.h, c.off)
                k = np.arange(len(one))
                if wanted is not None:
                    w = wanted.value
                    k = k[w[np.minimum(np.searchsorted(w, one), len(w) - 1)] == one] if len(w) else k[:0]
                sets = [c.h[c.off[i] : c.off[i + 1]].tobytes() for i in k]
                yield pa.RecordBatch.from_arrays([pa.array(one[k]), pa.array(two[k]), pa.array(sets, pa.binary())], names=["one", "two", "grams"])

    return run


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of the members of hot bands."""
    for b in batches:
        data, off = tk.buffers(b.column("grams"))
        size = np.diff(off) // 8
        k = pa.array(np.repeat(np.arange(len(size)), size))
        held = [b.column("root").take(k), b.column("digest").take(k), pa.array(np.repeat(size, size).astype(np.int32))]
        yield pa.RecordBatch.from_arrays([*held, pa.array(np.frombuffer(data.tobytes(), np.int64))], names=["root", "digest", "size", "gram"])


def _edges(members: DataFrame, threshold: float, level: int = 0) -> DataFrame:
    """(u, v): edges with the components of all pairs of one root that reach the threshold.

    ``members``: root, digest, times, grams, sig, one row of a digest and root. Nodes are
    digests, and digests of classes that stand for their members.
    """
    compared = lambda rows: nd.pairs(rows, 0, threshold, BLOCK).select(F.col("digest").alias("u"), F.col("root").alias("v"))
    hot = cut(members.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("root"))
    if level == LEVELS or hot.isEmpty():
        return compared(members)
    hot = bounded(hot, nd.MOST_BROADCAST)
    within = members.join(hot, "root", "left_semi").select("root", "digest", "grams")
    each = within.mapInArrow(tk.frugal(_shingled), "root bigint, digest binary, size int, gram bigint")
    often = each.groupBy("root", "gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = each.join(often.hint("merge"), ["root", "gram"]).groupBy("root", "digest").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("shared"))
    need = F.ceil(F.col("size") * threshold - 1e-6)
    shared = shared.filter(F.size("shared") >= need)
    name = F.concat_ws(" ", "root", "size", F.transform("shared", lambda x: x["gram"].cast("string")))
    known = cut(shared.withColumn("class", F.unhex(F.md5(name.cast("binary")))))
    classes = known.groupBy("class").agg(*[F.first(c).alias(c) for c in ("root", "size", "shared")], F.min("digest").alias("digest"), F.count(F.lit(1)).alias("times"))
    classes = cut(classes)
    # A shingle that only the class has meets no other.
    first = F.filter(F.slice("shared", F.lit(1), (F.size("shared") - need + 1).cast("int")), lambda x: x["n"] > F.col("times"))
    groups = F.array_distinct(F.transform(first, lambda x: F.xxhash64("root", x["gram"])))
    dealt = classes.select("root", "digest", "class", F.explode(groups).alias("group")).join(within.hint("merge"), ["root", "digest"])
    dealt = cut(dealt.select(F.col("group").alias("root"), F.col("class").alias("digest"), F.lit(1).cast("bigint").alias("times"), "grams", F.lit(None).cast("binary").alias("sig")))
    found = cut(_edges(dealt, threshold, level + 1))
    alike = classes.filter((F.col("times") > 1) & (F.size("shared") * (1 + threshold) >= 2 * threshold * F.col("size") - 1e-9)).select("class")
    linked = alike.union(found.select("u")).distinct()
    held = known.select("digest", "class").join(linked, "class").select("digest", "class")
    return compared(members.join(hot, "root", "left_anti")).union(found).union(held)


def _number(digest: Column, at: int) -> Column:
    """Eight bytes of a digest as a number."""
    return F.conv(F.hex(F.substring(digest, at, 8)), 16, -10).cast("bigint")


def repeats(docs: DataFrame, threshold: float = nd.THRESHOLD) -> DataFrame:
    """doc_id, version, lo, hi, class_id and removed of every repeated paragraph.

    ``docs``: doc_id, version, text. lo and hi are bytes of the text, class_id is
    the smallest doc_id of the component.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = small_batches(docs)
    rows = cut(docs.mapInArrow(tk.frugal(_prints(threshold)), f"doc_id {kind}, version bigint, edges array<int>, one array<bigint>, two array<bigint>, bands array<bigint>"))
    n = F.size("one")
    every = rows.select("doc_id", "version", F.inline(F.arrays_zip(F.slice("edges", F.lit(1), n).alias("lo"), F.slice("edges", F.lit(2), n).alias("hi"), "one", "two")))
    # Few paragraphs occur twice: counted by one number first, by both where that one does.
    twice = cut(every.groupBy("one").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("one"))
    many = every.join(bounded(twice, nd.MOST_BROADCAST), "one", "left_semi").groupBy("one", "two").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("one", "two")
    # Bands name their paragraph by the first number of its digest; a clash only joins two groups that are then compared.
    held = F.flatten(F.transform("one", lambda x: F.array_repeat(x, BANDS)))
    banded = rows.select(F.inline(F.arrays_zip(F.col("bands").alias("band"), held.alias("node")))).filter("band IS NOT NULL")
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("far")).filter("hub <> far").select("band", "hub")
    hubs = bounded(cut(hubs), nd.MOST_BROADCAST)
    # Pairs are compared within a band: components of bands would chain through passages that share a phrase only.
    stars = cut(banded.join(hubs, "band").select("node", "band").distinct())
    near = cut(stars.select("node").distinct())
    few = near.count() <= nd.MOST_BROADCAST
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(near.toArrow().column("node").to_numpy())) if few else None
    members = every.join(F.broadcast(near) if few else near, every["one"] == near["node"]).groupBy("one", "two").agg(F.count(F.lit(1)).alias("times"), F.min("version").alias("version"))
    members = cut(members)
    keys = bounded(cut(members.select("version").distinct()), nd.MOST_BROADCAST)
    grams = docs.select("version", "text").join(keys, "version", "left_semi").select("text").mapInArrow(tk.frugal(_grams(wanted)), "one bigint, two bigint, grams binary")
    sets = grams.groupBy("one", "two").agg(F.first("grams").alias("grams")).join(members.hint("merge"), ["one", "two"])
    hexed = lambda c: F.lpad(F.hex(c), 16, "0")
    sets = sets.join(stars.hint("merge"), sets["one"] == stars["node"])
    sets = sets.select(F.unhex(F.concat(hexed(F.col("one")), hexed(F.col("two")))).alias("digest"), "times", F.col("band").alias("root"), "grams", F.lit(None).cast("binary").alias("sig"))
    # One paragraph in several groups is compared in each; classes of hot bands are nodes too, and meet no paragraph below.
    linked = components(_edges(cut(sets), threshold))
    linked = linked.select(_number(F.col("node"), 1).alias("one"), _number(F.col("node"), 9).alias("two"), _number(F.col("root"), 1).alias("r1"), _number(F.col("root"), 9).alias("r2"))
    told = cut(many.join(linked, ["one", "two"], "full").select("one", "two", F.coalesce("r1", "one").alias("r1"), F.coalesce("r2", "two").alias("r2")))
    found = every.join(bounded(cut(told.select("one").distinct()), nd.MOST_BROADCAST), "one", "left_semi")
    found = cut(found.join(told.hint("merge"), ["one", "two"]).select("doc_id", "version", "lo", "hi", "r1", "r2"))
    firsts = cut(found.groupBy("r1", "r2").agg(F.min(F.struct("doc_id", "lo", "version")).alias("first"), F.min("doc_id").alias("class_id")))
    same = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.lo") == F.col("lo")) & (F.col("first.version") == F.col("version"))
    return found.join(firsts.hint("merge"), ["r1", "r2"]).select("doc_id", "version", "lo", "hi", "class_id", (~same).alias("removed"))


def _by_doc(found: DataFrame) -> DataFrame:
    spans = F.sort_array(F.collect_list(F.when(F.col("removed"), F.struct("lo", "hi"))))
    one = found.distinct().groupBy("doc_id", "version").agg(
        F.count(F.lit(1)).alias("n_repeated"), F.count_if("removed").alias("n_removed"), spans.alias("spans"), F.sort_array(F.collect_set("class_id")).alias("class_ids"),
    )
    return one.select(F.col("doc_id").alias("h_id"), F.col("version").alias("h_version"), "n_repeated", "n_removed", "spans", "class_ids")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for text, spans in zip(b.column("text"), b.column("spans").to_pylist(), strict=True):
            raw, at, parts = text.as_buffer().to_pybytes() if text.is_valid else b"", 0, []
            for s in spans or ():
                parts.append(raw[at : s["lo"]])
                at = s["hi"]
            texts.append(b"".join([*parts, raw[at:]]).decode())
        names = [n for n in b.schema.names if n not in ("spans", "text")]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(texts, pa.string())], names=[*names, "text"])


def _judged(keyed: DataFrame, threshold: float) -> DataFrame:
    """Every row of ``keyed`` (rest, doc_id, version, text) with what was found in it, nulls where nothing was."""
    one = cut(_by_doc(repeats(keyed.select("doc_id", "version", "text"), threshold)))
    same = keyed["doc_id"].eqNullSafe(one["h_id"]) & (keyed["version"] == one["h_version"])
    keys = bounded(one.select("h_id", "h_version"), nd.MOST_BROADCAST)
    key = keyed["doc_id"].eqNullSafe(keys["h_id"]) & (keyed["version"] == keys["h_version"])
    held = keyed.join(keys, key, "left_semi").join(one.hint("merge"), same, "left").drop("h_id", "h_version")
    rest = keyed.join(keys, key, "left_anti")
    none = {f.name: F.lit(None).cast(f.dataType) for f in one.schema if f.name not in ("h_id", "h_version")}
    return held.unionByName(rest.withColumns(none))


def _keyed(docs: DataFrame) -> DataFrame:
    rest = F.struct(*[docs[c] for c in docs.columns if c != "text"])
    return docs.select(rest.alias("rest"), docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("version"), docs["text"].alias("text"))


def measure(docs: DataFrame, threshold: float = nd.THRESHOLD) -> DataFrame:
    """Of every document: n_repeated and n_removed paragraphs, the classes of the repeated ones and the text that stays."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    zero = F.lit(0).cast("bigint")
    told = _judged(_keyed(docs.select("doc_id", "text")), threshold).select(
        "doc_id", F.coalesce("n_repeated", zero).alias("n_repeated"), F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("class_ids", F.array().cast(f"array<{kind}>")).alias("class_ids"), "spans", "text",
    )
    return told.mapInArrow(tk.frugal(_kept), f"doc_id {kind}, n_repeated bigint, n_removed bigint, class_ids array<{kind}>, text string")


def clean(docs: DataFrame, threshold: float = nd.THRESHOLD) -> DataFrame:
    """The rows in the columns they came in, without removed paragraphs; n_chars follows, a null text becomes empty."""
    held = _judged(_keyed(docs), threshold).select("rest", "spans", "text")
    done = held.mapInArrow(tk.frugal(_kept), f"rest {held.schema['rest'].dataType.simpleString()}, text string")
    texts = {"text": F.col("text"), "n_chars": F.char_length("text").cast("bigint")}
    return done.select(*[texts.get(c, F.col("rest")[c]).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document."""
    return measure(spark.read.parquet(f"{sf_dir}/documents.parquet"))
