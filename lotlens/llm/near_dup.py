"""The shared core of the near-duplicate operators.

1. Items (documents, paragraphs) become sets of 5-word shingles; items with
   equal sets are one class, known by a 128-bit digest.
2. MinHash bands: classes that share a band are joined to the smallest class
   of that band (a star, never all pairs), and the components of these stars
   are the candidate groups.
3. Candidate groups are compared in blocks of ``BLOCK`` members: a task sees
   two blocks at most, so a group of any size is spread over many tasks and its
   pairs are never rows. Inside, MinHash values are compared step by step; a
   pair is dropped as soon as the posterior probability of reaching the
   threshold falls below ``TOLERANCE``, and the rest is verified exactly.
4. Verified links are counted for each class, and joined into components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textkit as tk
from .cluster import bounded, cut
from .graph import components

THRESHOLD = 0.8
BLOCK = 64
TOLERANCE = 1e-4
STEP = 16
#: Most rows of ids (16 bytes each) that are broadcast; beyond that both sides are shuffled.
MOST_BROADCAST = 1_000_000


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` minima."""
    n, width = sig.shape
    s = sig.reshape(n, width // rows, rows).astype(np.uint64)
    key = np.zeros(s.shape[:2], np.uint64)
    for j in range(rows):
        key = tk.mix(key * np.uint64(31) + s[:, :, j])
    return tk.mix(key + np.arange(key.shape[1], dtype=np.uint64)).view(np.int64)


@lru_cache(maxsize=8)
def least_matches(width: int, threshold: float, tolerance: float) -> tuple[int, ...]:
    """For n compared minima: the fewest matches at which P(J >= threshold | matches) >= tolerance.

    The prior of J is uniform, so the posterior is Beta(m + 1, n - m + 1).
    """
    x = (np.arange(20000) + 0.5) / 20000
    out = [0]
    for n in range(1, width + 1):
        for m in range(n + 1):
            logs = m * np.log(x) + (n - m) * np.log1p(-x)
            p = np.exp(logs - logs.max())
            if p[x >= threshold].sum() >= tolerance * p.sum():
                break
        out.append(m)
    return tuple(out)


def node_of(digest: str = "digest") -> Column:
    """The first 56 bits of a digest as a number."""
    return F.conv(F.hex(F.substring(digest, 1, 7)), 16, 10).cast("bigint")


def candidates(classes: DataFrame) -> DataFrame:
    """(node, root): the components of band stars over ``classes`` (digest, bands array<bigint>).

    node is ``node_of`` the digest; a clash only joins two groups that are then compared.
    """
    rows = classes.select(node_of().alias("node"), F.explode("bands").alias("band"))
    hubs = rows.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("far")).filter("hub <> far").select("band", "hub")
    return components(rows.join(hubs, "band").select(F.col("node").alias("u"), F.col("hub").alias("v")))


class _Block:
    """Members of one pair of blocks."""

    def __init__(self, width: int, threshold: float):
        self.threshold = threshold
        self.least = least_matches(width, threshold, TOLERANCE) if width else ()
        self.clear()

    def clear(self) -> None:
        self.digest: list[bytes] = []
        self.times: list[int] = []
        self.side: list[bool] = []
        self.grams: list[np.ndarray] = []
        self.sigs: list[np.ndarray] = []

    def add(self, digest: bytes, times: int, side: bool, grams: bytes, sig: bytes | None) -> None:
        self.digest.append(digest)
        self.times.append(times)
        self.side.append(side)
        self.grams.append(np.frombuffer(grams, np.uint64))
        if sig is not None:
            self.sigs.append(np.frombuffer(sig, np.uint32))

    def linked(self, cross: bool) -> Iterator[tuple[bytes, int, bytes]]:
        """(digest, documents linked here, smallest digest of its links' component here)."""
        n = len(self.digest)
        side = np.array(self.side, bool)
        left, right = (np.flatnonzero(~side), np.flatnonzero(side)) if cross else (np.arange(n),) * 2
        if n < 2 or not len(left) or not len(right):
            return
        open_ = np.ones((len(left), len(right)), bool) if cross else np.triu(np.ones((n, n), bool), 1)
        if self.sigs:
            sig = np.stack(self.sigs)
            y, x = np.nonzero(open_)
            same = np.zeros(len(y), np.int64)
            width = sig.shape[1]
            for at in range(0, width, STEP):
                to = min(width, at + STEP)
                same += (sig[left[y], at:to] == sig[right[x], at:to]).sum(1)
                keep = same >= self.least[to]
                y, x, same = y[keep], x[keep], same[keep]
                if not len(y):
                    return
        else:
            y, x = np.nonzero(open_)
        size = np.array([len(g) for g in self.grams])
        inter = self._shared(left, right, y, x)
        a, b = size[left[y]], size[right[x]]
        hit = inter * (1 + self.threshold) >= self.threshold * (a + b) - 1e-9
        y, x = left[y[hit]], right[x[hit]]
        if not len(y):
            return
        times = np.array(self.times)
        links = np.bincount(y, times[x], n) + np.bincount(x, times[y], n)
        root = list(range(n))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for p, q in zip(y.tolist(), x.tolist(), strict=True):
            p, q = find(p), find(q)
            if p != q:
                if self.digest[q] < self.digest[p]:
                    p, q = q, p
                root[q] = p
        for k in np.flatnonzero(links):
            yield self.digest[k], int(links[k]), self.digest[find(int(k))]

    def _shared(self, left: np.ndarray, right: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Shingles in common of the pairs (left[y], right[x])."""
        if len(y) <= 8:
            return np.array([len(np.intersect1d(self.grams[left[i]], self.grams[right[j]], assume_unique=True)) for i, j in zip(y, x, strict=True)], np.int64)
        size = np.array([len(g) for g in self.grams])
        _, ids = np.unique(np.concatenate(self.grams), return_inverse=True)
        who = np.repeat(np.arange(len(self.grams)), size)
        order = np.argsort(ids, kind="stable")
        ids, who = ids[order], who[order]
        total = np.zeros((len(self.grams),) * 2, np.float32)
        wide = 4096
        for low in range(0, int(ids[-1]) + 1 if len(ids) else 0, wide):
            at, to = np.searchsorted(ids, (low, low + wide))
            m = np.zeros((len(self.grams), wide), np.float32)
            m[who[at:to], ids[at:to] - low] = 1
            total += m @ m.T
        return np.rint(total[left[y], right[x]]).astype(np.int64)


def _compare(width: int, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, key, out = _Block(width, threshold), None, ([], [], [])

        def done() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["digest", "links", "root"])
            for x in out:
                x.clear()
            return b

        def close() -> None:
            if key is not None:
                for row in block.linked(key[1] != key[2]):
                    for x, v in zip(out, row, strict=True):
                        x.append(v)
            block.clear()

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("root", "low", "high", "mine", "digest", "times")]
            grams, sig = b.column("grams"), b.column("sig")
            for k, (root, low, high, mine, digest, times) in enumerate(zip(*cols, strict=True)):
                if key != (root, low, high):
                    close()
                    key = (root, low, high)
                block.add(digest, times, mine != low, grams[k].as_py(), sig[k].as_py())
            if len(out[0]) > 4096:
                yield done()
        close()
        yield done()

    return run


def pairs(members: DataFrame, width: int, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(digest, links, root) over ``members`` (digest, times, root, grams, sig): what each two blocks of a root tell of their linked classes.

    root is the smallest digest that they link the class to.
    """
    size = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    size = bounded(cut(size.filter(F.col("size") > block)), MOST_BROADCAST)
    placed = members.join(size, "root", "left").withColumn("blocks", F.ceil(F.coalesce("size", F.lit(1)) / F.lit(block)).cast("int"))
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    paired = placed.select("root", "digest", "times", "grams", "sig", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    paired = paired.select("root", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "digest", "times", "grams", "sig")
    keys = ["root", "low", "high"]
    return paired.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tk.frugal(_compare(width, threshold)), "digest binary, links bigint, root binary")


def links(members: DataFrame, width: int, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(digest, links, root) over ``members`` (digest, times, root, grams, sig): the classes with verified links.

    root is the smallest digest of the class's component.
    """
    found = cut(pairs(members, width, threshold, block))
    group = components(found.select(F.col("digest").alias("u"), F.col("root").alias("v")))
    total = found.groupBy("digest").agg(F.sum("links").alias("links"))
    return total.join(group, total["digest"] == group["node"]).select("digest", "links", group["root"])
