"""Exact substring dedup by a distributed difference-cover suffix sort.

Every byte covered by a string of ``length`` bytes that also starts elsewhere is
removed. Sorting all suffixes of a corpus in one order would write it many times
over, so the strings are first dealt into buckets that equal strings cannot
leave, and each bucket is sorted by the difference-cover algorithm (period 3):
sort the sampled triples, recurse on their names, sort and merge the remaining
suffixes, then compare adjacent prefixes.

1. Each string has an anchor: its smallest hashed ``GRAM``-gram (the first among
   equals). Equal strings stand at equal distances before equal anchors. The
   distances are cut in blocks; consecutive starts with one anchor and one block
   are a piece. All strings of a block share a core around the anchor, and the
   hash of block and core is the piece's bucket.
2. A bucket of one piece holds no repeat. Pieces with equal bytes are repeats as
   a whole. What is left shares its core with different bytes around it.
3. These pieces (each distinct text once) are sorted, many buckets in a task. A
   bucket of more than ``MOST`` distinct pieces is too hot for one task: its
   pieces become texts of their own, and steps 1 to 3 deal them out again with
   blocks an eighth as wide, so with longer cores; a block of one distance has
   the whole string as its core, which ends the recursion.

Pieces with equal bytes are known by bucket and a polynomial hash modulo
2^61 - 1 of all their bytes; the sorted prefixes are compared byte by byte.

Defined results: a null text is empty; texts under ``length`` bytes keep all bytes
and count as no one's copy; repeated rows are documents of their own, so each
repeats the other; an empty table gives an empty result; a null doc_id is kept;
other columns of the input are ignored by ``measure`` and kept by ``clean``,
whatever their names are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textkit as tk
from .cluster import bounded, cut, small_batches

LENGTH, GRAM = 400, 32
#: Length for passages: 50 words of running text take 250 bytes and more.
PASSAGE = 200
#: Blocks that the distances of a string's anchor are cut in at first, and in each round after.
BLOCKS, FINER = 2, 8
#: Distinct pieces of one bucket that are sorted in one task.
MOST = 2048
#: Bytes that are sorted at once.
BATCH = 1 << 19
#: Most rows of keys (8 bytes each) that are broadcast; beyond that both sides are shuffled.
MOST_BROADCAST = 1_000_000

_FULL, _HIGH, _ODD = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0xFFFFFFFF00000000), np.uint64(0xC4CEB9FE1A85EC53)


def _ranked(d: np.ndarray, gram: int) -> np.ndarray:
    """A number for each gram, the same wherever it stands: 32 hashed bits, then its place. They rank only, so they are mixed little."""
    out = np.empty(len(d) - gram + 1, np.uint64)
    for low in range(0, len(out), tk.CHUNK_BYTES):
        h = out[low : low + tk.CHUNK_BYTES]
        run = tk.running(d[low : low + len(h) + gram - 1])
        np.subtract(run[gram:], run[:-gram], out=h)
        h *= tk.unshifted(len(h))
        h ^= h >> np.uint64(32)
        h *= _ODD
    out &= _HIGH
    out |= np.arange(len(out), dtype=np.uint64)
    return out


def anchors(d: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Place of the anchor of the string at each start."""
    n = len(d)
    key = _ranked(d, gram)
    width = length - gram + 1
    padded = np.full(-(-len(key) // width) * width, _FULL, np.uint64)
    padded[: len(key)] = key
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    starts = n - length + 1
    least = np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts])
    return (least & np.uint64(0xFFFFFFFF)).view(np.int64)


def pieces(d: np.ndarray, o: np.ndarray, length: int, block: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document, first start within it, starts, bucket, hash of the covered bytes) of each piece."""
    size = np.diff(o)
    count = np.maximum(size - length + 1, 0)
    if not count.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    anchor = anchors(d, length, gram)
    total = len(anchor)
    blocks = (np.arange(length - gram + 1) // block).astype(np.int16)
    part = blocks[anchor - np.arange(total)]
    new = np.ones(total + 1, bool)
    new[1:total] = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])
    # A document's starts begin with a piece, and one that is none closes the last.
    some = count > 0
    new[o[:-1][some]] = new[o[:-1][some] + count[some]] = True
    first = np.flatnonzero(new)
    n = np.diff(first)
    first = first[:-1]
    doc = np.searchsorted(o, first, "right") - 1
    held = first - o[doc] < count[doc]
    lo, n, doc = first[held], n[held], doc[held]
    anchor, part = anchor[lo], part[lo].astype(np.int64)
    near = np.minimum((part + 1) * block - 1, length - gram)
    key = tk.mix(tk.rough_hashes(d, anchor - part * block, anchor - near + length) + part.astype(np.uint64))
    span = tk.span_hashes(d, lo, lo + n - 1 + length)
    return doc, lo - o[doc], n, key.view(np.int64), span.view(np.int64)


def _pieces(length: int, block: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = tk.buffers(b.column("text"))
            for i, j, d, o in tk.chunks(data, off):
                doc, lo, n, key, span = pieces(d, o, length, block)
                ends = pa.array(np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (lo.astype(np.int32), n.astype(np.int32), key, span)]
                yield pa.RecordBatch.from_arrays([b.column("k").slice(i, j - i), b.column("c").slice(i, j - i), *lists], names=["k", "c", "lo", "n", "key", "span"])

    return run


# --- the difference cover ---------------------------------------------------------------------------


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start of every suffix in order. ``s``: integers from 1 to fewer than 2^21."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    wide = np.int64(s.max()) + 1
    symbols = 7 if wide <= 512 else 3  # as many as fit into 63 bits; triples of longer names have the order of the suffixes too
    t = np.concatenate([s.astype(np.int64), np.zeros(symbols, np.int64)])
    place = np.arange(n + (n % 3 == 1))  # one more sampled start closes the first class
    sample = np.concatenate([place[1::3], place[2::3]])
    runs = t[: len(t) - symbols + 1]
    for k in range(1, symbols):
        runs = runs * wide + t[k : k + len(runs)]
    triple = runs[sample]
    order = np.argsort(triple)
    new = np.ones(len(order), np.int64)
    triple = triple[order]
    new[1:] = triple[1:] != triple[:-1]
    name = np.empty(len(order), np.int64)
    name[order] = np.cumsum(new)
    if name.max() < len(name):
        order = suffix_array(name)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(order) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    high = np.int64(len(order)) + 2
    rest = rest[np.argsort(t[rest] * high + rank[rest + 1])]  # all differ
    # A remaining suffix against a sampled one: by one symbol and a rank, or by two and a rank.
    one = sampled % 3 == 1
    before = np.empty(len(sampled), np.int64)
    p = sampled[one]
    before[one] = np.searchsorted(t[rest] * high + rank[rest + 1], t[p] * high + rank[p + 1])
    p = sampled[~one]
    before[~one] = np.searchsorted((t[rest] * wide + t[rest + 1]) * high + rank[rest + 2], (t[p] * wide + t[p + 1]) * high + rank[p + 2])
    out = np.empty(n, np.int64)
    slots = before + np.arange(len(sampled))
    out[slots] = sampled
    free = np.ones(n, bool)
    free[slots] = False
    out[free] = rest
    return out


def repeated(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text a flag per start: the string of ``length`` bytes there starts elsewhere too."""
    d = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    room = np.repeat(off[1:], np.diff(off)) - np.arange(len(d)) >= length
    order = suffix_array(d.astype(np.int64) + 1)
    order = order[room[order]]
    p, q = order[:-1], order[1:]
    word = np.zeros(len(d), np.uint64)
    padded = np.concatenate([d, np.zeros(8, np.uint8)])
    for k in range(8):
        word |= padded[k : k + len(d)].astype(np.uint64) << np.uint64(8 * k)
    last = max(length - 8, 0)
    for t in sorted({*range(0, last + 1, 8), last}, key=lambda t: -(t & -t) if t else -1 << 30):
        if length < 8:
            break
        same = word[p + t] == word[q + t]
        p, q = p[same], q[same]
    if length < 8:
        same = np.array([d[a : a + length].tobytes() == d[b : b + length].tobytes() for a, b in zip(p, q, strict=True)], bool)
        p, q = p[same], q[same]
    hit = np.zeros(len(d), bool)
    hit[p] = hit[q] = True
    return np.split(hit, off[1:-1])


def _ranges(hit: np.ndarray) -> list[dict]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [{"a": int(a), "b": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1, strict=True)]


_RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_SQL_RANGES = "array<struct<a:int,b:int>>"


def _sorted(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            hits = repeated([t for _, _, t in held], length)
            rows = [(a, s, _ranges(h)) for (a, s, _), h in zip(held, hits, strict=True) if h.any()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], _RANGES)], names=["key", "span", "ranges"]
            )
            held.clear()

        for b in batches:
            for key, span, text in zip(b.column("key").to_pylist(), b.column("span").to_pylist(), b.column("text").to_pylist(), strict=True):
                if size > BATCH and held[-1][0] != key:
                    yield from close()
                    size = 0
                held.append((key, span, text))
                size += len(text)
        if held:
            yield from close()

    return run


def _contexts(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"key": pa.int64(), "span": pa.int64(), "kinds": pa.int64(), "text": pa.binary()}
        for b in batches:
            for text, items in zip(b.column("text"), b.column("wanted"), strict=True):
                raw = text.as_buffer().to_pybytes()
                rows = [(x["key"], x["span"], x["kinds"], raw[x["lo"] : x["lo"] + x["n"] - 1 + length]) for x in items.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    return run


def _split(docs: DataFrame, few: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts that ``few`` names by k and c, the others).

    Only the keys k (8 bytes each, a bounded number) are broadcast, or both sides
    are shuffled; a clash of k alone is told apart by c when the rows meet ``few``.
    """
    keys = bounded(few.select("k").distinct(), MOST_BROADCAST)
    return docs.join(keys, "k", "left_semi"), docs.join(keys, "k", "left_anti")


def _fetch(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(key, span, kinds, text) of the wanted pieces, cut from one copy of each text that holds some."""
    by = wanted.groupBy("at.k", "at.c").agg(F.collect_list(F.struct(F.col("at.lo").alias("lo"), F.col("at.n").alias("n"), "key", "span", "kinds")).alias("wanted"))
    by = cut(by)
    held = _split(docs.select("k", "c", "text"), by)[0].groupBy("k", "c").agg(F.first("text").alias("text"))
    return held.join(by.hint("merge"), ["k", "c"]).select("text", "wanted").mapInArrow(tk.frugal(_contexts(length)), "key bigint, span bigint, kinds bigint, text binary")


def repeats(docs: DataFrame, length: int, block: int | None = None) -> DataFrame:
    """(k, c, ranges): the first and last starts of runs of repeated strings, of each text that has any.

    ``docs``: k and c (bigint, equal for equal texts only) and text, a string or binary.
    """
    block = block or -(-(length - GRAM + 1) // BLOCKS)
    rows = cut(docs.mapInArrow(tk.frugal(_pieces(length, block)), "k bigint, c bigint, lo array<int>, n array<int>, key array<bigint>, span array<bigint>"))
    each = rows.select("k", "c", F.inline(F.arrays_zip("lo", "n", "key", "span")))
    again = cut(each.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("key"))
    red = cut(each.join(again.hint("merge"), "key", "left_semi"))
    stats = cut(red.groupBy("key", "span").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("k", "c", "lo", "n")).alias("at")))
    unclear = cut(stats.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("times") == 1).alias("single")).filter("kinds > 1 AND single > 0").drop("single"))
    texts = _fetch(docs, stats.join(unclear.hint("merge"), "key"), length)
    hot = block > 1 and not unclear.filter(F.col("kinds") > MOST).isEmpty()
    texts = cut(texts) if hot else texts
    calm = texts.filter(F.col("kinds") <= MOST) if hot else texts
    part = calm.select("key", "span", "text").repartition("key").sortWithinPartitions("key", "span").mapInArrow(tk.frugal(_sorted(length)), f"key bigint, span bigint, ranges {_SQL_RANGES}")
    if hot:
        finer = texts.filter(F.col("kinds") > MOST).select(F.col("key").alias("k"), F.col("span").alias("c"), "text")
        part = part.union(repeats(finer, length, -(-block // FINER)).select(F.col("k").alias("key"), F.col("c").alias("span"), "ranges"))
    whole = stats.filter("times > 1").select("key", "span", F.array(F.struct(F.lit(0).alias("a"), (F.col("at.n") - 1).alias("b"))).alias("ranges"))
    part = part.join(stats.filter("times = 1").select("key", "span").hint("merge"), ["key", "span"], "left_semi")
    flat = red.join(whole.union(part).hint("merge"), ["key", "span"]).select("k", "c", "lo", F.explode("ranges").alias("r"))
    return flat.groupBy("k", "c").agg(F.collect_set(F.struct((F.col("lo") + F.col("r.a")).alias("a"), (F.col("lo") + F.col("r.b")).alias("b"))).alias("ranges"))


def _covered(raw: bytes, ranges: list[dict] | None, length: int) -> np.ndarray:
    edge = np.zeros(len(raw) + 1, np.int64)
    if ranges:
        np.add.at(edge, [r["a"] for r in ranges], 1)
        np.add.at(edge, [r["b"] + length for r in ranges], -1)
    return np.cumsum(edge)[:-1] > 0


def _bytes(text: pa.Scalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def _kept(raw: bytes, cover: np.ndarray) -> bytes:
    return np.frombuffer(raw, np.uint8)[~cover].tobytes() if cover.any() else raw


def _measured(length: int, passage: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, spans, sha, texts = [], [], [], [], []
            for text, ranges, short in zip(b.column("text"), b.column("long").to_pylist(), b.column("ranges").to_pylist(), strict=True):
                raw = _bytes(text)
                cover = _covered(raw, ranges, length)
                kept = _kept(raw, cover)
                size.append(len(raw))
                gone.append(len(raw) - len(kept))
                spans.append(int((np.diff(np.concatenate([[0], cover.astype(np.int8)])) == 1).sum()))
                sha.append(hashlib.sha256(kept).hexdigest())
                texts.append(_kept(raw, _covered(raw, short, passage)).decode("utf-8", "ignore"))
            out = {"n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *out.values(), pa.array(texts, pa.string())], names=["doc_id", *out, "passage_free_text"])

    return run


def _cleaned(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [_kept(raw := _bytes(t), _covered(raw, r, length)).decode("utf-8", "ignore") for t, r in zip(b.column("text"), b.column("ranges").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("rest"), pa.array(texts, pa.string())], names=["rest", "text"])

    return run


def _regions(length: int, passage: int) -> Callable:
    """The stretches of a text in which a string of ``length`` bytes may repeat: all its strings of ``passage`` bytes do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, c, copies, text, ranges in zip(*(b.column(n).to_pylist() for n in ("k", "c", "copies")), b.column("text"), b.column("ranges").to_pylist(), strict=True):
                raw = _bytes(text)
                edge = np.zeros(len(raw) + 2, np.int64)
                np.add.at(edge, [r["a"] for r in ranges], 1)
                np.add.at(edge, [r["b"] + 1 for r in ranges], -1)
                hit = np.diff(np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8)]))
                found = [(int(a), raw[a : e - 1 + passage]) for a, e in zip(np.flatnonzero(hit == 1), np.flatnonzero(hit == -1), strict=True) if e - a > length - passage]
                if found:
                    at, parts = zip(*found, strict=True)
                    same = [pa.array([x] * len(at), pa.int64()) for x in (k, c, copies)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(at, pa.int32()), pa.array(parts, pa.binary())], names=["dk", "dc", "copies", "at", "text"])

    return run


def longer(docs: DataFrame, found: DataFrame, passage: int, length: int) -> DataFrame:
    """(k, c, ranges) for ``length``, from those (``found``) for the shorter ``passage``: only stretches that may hold such strings are sorted again."""
    held = _split(docs.select("k", "c", "text"), found)[0].groupBy("k", "c").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")).join(found.hint("merge"), ["k", "c"])
    regions = held.mapInArrow(tk.frugal(_regions(length, passage)), "dk bigint, dc bigint, copies bigint, at int, text binary")
    regions = cut(regions.withColumns({"k": F.xxhash64("text"), "c": F.hash("text").cast("bigint")}))
    flat = regions.drop("text").join(repeats(regions.select("k", "c", "text"), length).hint("merge"), ["k", "c"]).select("dk", "dc", "at", F.explode("ranges").alias("r"))
    # One text stands for its copies, which repeat all of it.
    copied = regions.filter("copies > 1").select("dk", "dc", "at", F.struct(F.lit(0).alias("a"), (F.octet_length("text") - length).alias("b")).alias("r"))
    flat = flat.union(copied)
    moved = F.struct((F.col("at") + F.col("r.a")).alias("a"), (F.col("at") + F.col("r.b")).alias("b"))
    return flat.groupBy(F.col("dk").alias("k"), F.col("dc").alias("c")).agg(F.collect_set(moved).alias("long"))


def _keyed(docs: DataFrame, rest: list[str]) -> DataFrame:
    """(rest, text, k, c): the columns of the caller in one struct, and 96 bits of hashes that know a text."""
    packed = small_batches(docs).select(F.struct(*[docs[c] for c in rest]).alias("rest") if rest else F.struct(F.lit(0).alias("none")).alias("rest"), docs["text"].alias("text"))
    return packed.withColumns({"k": F.xxhash64("text"), "c": F.hash("text").cast("bigint")})


def _met(docs: DataFrame, found: DataFrame, lists: list[str]) -> DataFrame:
    """The rows of ``docs`` with the ``lists`` of their texts, null where there are none."""
    held, rest = _split(docs, found)
    none = {c: F.lit(None).cast(_SQL_RANGES) for c in lists}
    return held.join(found.hint("merge"), ["k", "c"], "left").select(*docs.columns, *lists).unionByName(rest.withColumns(none))


def measure(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row, for ``length``.

    After them passage_free_text: the text without the strings of the shorter
    length ``passage`` that also start elsewhere (halves of cut characters go too).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = _keyed(docs.select("doc_id", "text"), ["doc_id"])
    short = cut(repeats(keyed.select("k", "c", "text"), passage))
    found = short.join(longer(keyed, short, passage, length).hint("merge"), ["k", "c"], "left")
    held = _met(keyed, cut(found), ["ranges", "long"]).select("rest.doc_id", "text", "ranges", "long")
    out = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, passage_free_text string"
    return held.mapInArrow(tk.frugal(_measured(length, passage)), out)


def clean(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows in the columns they came in, repeated bytes removed; halves of cut characters go too, n_chars follows."""
    others = [c for c in docs.columns if c != "text"]
    keyed = _keyed(docs, others)
    found = cut(repeats(keyed.select("k", "c", "text"), length))
    packed = _met(keyed, found, ["ranges"]).select("rest", "text", "ranges")
    done = packed.mapInArrow(tk.frugal(_cleaned(length)), f"rest {packed.schema['rest'].dataType.simpleString()}, text string")
    texts = {"text": F.col("text"), "n_chars": F.char_length("text").cast("bigint")}
    return done.select(*[texts.get(c, F.col("rest")[c]).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document."""
    return measure(spark.read.parquet(f"{sf_dir}/documents.parquet"))
