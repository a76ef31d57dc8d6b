"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

The model file gives the pieces and their scores; merging is done here so that
each candidate merge can be skipped by a keyed hash. A candidate is an adjacent
pair of symbols inside a chunk (a run of spaces and the word after it; no piece
crosses chunks) and is known by the places of its ends. It is skipped if
hash(seed, text, number of the chunk, places) falls below the dropout rate, so
every occurrence of a word has skips of its own, and the same seed cuts it the
same way again.

Occurrences share work only where they must come out alike: a chunk is merged
without skips, then once for each set of skips that two or more occurrences have
among the candidates met so far, and so on; an occurrence whose skips are its own
is merged by itself.

Short chunks are merged together, a matrix row each: every round merges the
best candidate of every row, which is the order of an agenda per chunk. Chunks
over ``ROW`` characters go through an agenda (heap) one by one.

Decoding is lossless for every text: a literal U+2581 is written as byte
pieces, and the space that encoding puts first is taken off again.

Defined results: a null or empty text has no pieces and decodes to ''; repeated
rows are cut alike; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textkit as tk
from .cluster import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 20240229
#: Text handled at once: more text repeats more words.
CHUNK_BYTES = 3 << 19
ROW = 48
_SPACE = "▁"
_CHUNK = re.compile(f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+")
_NONE = np.int32(1 << 30)
_OTHER = 1 << 19
_TABLE, _MULT = 19, 0x9E3779B97F4A7C15
#: Bits of a candidate's three places in a chunk of at most ROW characters; occurrences looked at together.
_BITS, _BLOCK = 18, 1 << 16
_LOW, _FULL = np.uint64((1 << 21) - 1), (1 << 64) - 1


class Pieces:
    """Vocabulary, merge table and byte pieces of a model."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte = np.zeros(256, np.int32)
        self.raw: list[bytes] = []
        self.ids: dict[str, int] = {}
        for i, t in enumerate(self.text):
            if sp.is_byte(i):
                self.byte[int(t[3:5], 16)] = i
                self.raw.append(bytes([int(t[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                self.ids[t] = i
                self.raw.append(t.replace(_SPACE, " ").encode())
        # Ranks: higher scores merge first, and the lower id among equals.
        order = sorted(self.ids.values(), key=lambda i: (-sp.get_score(i), i))
        self.rank = np.full(n, _NONE, np.int32)
        self.rank[order] = np.arange(len(order))
        # Symbols: pieces, and single characters that only occur inside pieces.
        self.symbol = dict(self.ids)
        for c in sorted({c for t in self.ids for c in t} - self.symbol.keys()):
            self.symbol[c] = n + len(self.symbol)
        pairs = {}
        for t, i in self.ids.items():
            for k in range(1, len(t)):
                left, right = self.symbol.get(t[:k]), self.symbol.get(t[k:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = i
        self.pairs = pairs
        # An open-addressed table: a pair's place is the first of its chain that holds it or nothing.
        self.table, self.made = np.full(1 << _TABLE, -1, np.int64), np.full(1 << _TABLE, -1, np.int64)
        for key in sorted(pairs):
            at = key * _MULT % (1 << 64) >> (64 - _TABLE)
            while self.table[at] >= 0:
                at = (at + 1) % (1 << _TABLE)
            self.table[at], self.made[at] = key, pairs[key]
        self.char = np.full(0x110000, _OTHER, np.int64)
        self.char[:128] = self.byte[:128]  # a single byte without a piece is its byte piece
        for t, i in self.symbol.items():
            if len(t) == 1:
                self.char[ord(t)] = i

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        key = (left << 20) | right
        at = (key.astype(np.uint64) * np.uint64(_MULT) >> np.uint64(64 - _TABLE)).astype(np.int64)
        held = self.table[at]
        out = np.where(held == key, self.made[at], -1)
        more = np.flatnonzero((held != key) & (held >= 0))
        while len(more):
            at[more] = (at[more] + 1) % (1 << _TABLE)
            held = self.table[at[more]]
            out[more] = np.where(held == key[more], self.made[at[more]], -1)
            more = more[(held != key[more]) & (held >= 0)]
        return out

    def out(self, symbol: int, text: str) -> list[int]:
        if symbol < len(self.raw):
            return [symbol]
        return [int(self.byte[b]) for b in text.encode()]


@lru_cache(maxsize=2)
def load(model: bytes) -> Pieces:
    return Pieces(model)


def _places(start: np.ndarray, mid: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number of three places; those beyond 21 bits, in chunks of millions of characters, go into a second part."""
    start, mid, end = (x.astype(np.uint64) for x in (start, mid, end))
    packed = (start & _LOW) << np.uint64(42) ^ (mid & _LOW) << np.uint64(21) ^ (end & _LOW)
    if len(end) and int(end.max()) > int(_LOW):
        packed ^= tk.mix((start >> np.uint64(21)) ^ (mid >> np.uint64(21)) << np.uint64(20) ^ (end >> np.uint64(21)) << np.uint64(40))
    return tk.mix(packed)


def _below(h: np.ndarray, rate: float) -> np.ndarray:
    return (tk.mix(h) >> np.uint64(11)).astype(float) < rate * 2.0**53


def _skipped(key: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray, rate: float) -> np.ndarray:
    return _below(key ^ _places(start, mid, end), rate)


def _mixed(h: int) -> int:
    """``textkit.mix`` of one number."""
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & _FULL
    h ^= h >> 33
    h = h * 0xC4CEB9FE1A85EC53 & _FULL
    return h ^ h >> 33


def _agenda(p: Pieces, chunk: str, key: np.uint64, rate: float) -> list[int]:
    """One chunk by a heap of candidates; the first ones are looked up together."""
    n = len(chunk)
    sym = p.char[np.frombuffer(chunk.encode("utf-32-le"), np.uint32)]
    first = np.arange(n - 1)
    made = p.merged(sym[:-1], sym[1:])
    offered = made >= 0
    if rate:
        offered &= ~_skipped(np.full(n - 1, key, np.uint64), first, first + 1, first + 2, rate)
    at = np.flatnonzero(offered)
    rank, own, least = p.rank, int(key), rate * 2.0**53
    heap = list(zip(rank[made[at]].tolist(), at.tolist(), (at + 1).tolist(), (at + 2).tolist(), made[at].tolist(), strict=True))
    heapq.heapify(heap)
    sym = sym.tolist()
    nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    live, pairs, low = [True] * n, p.pairs, int(_LOW)

    def offer(i: int) -> None:
        j = nxt[i] if i >= 0 else n
        if j >= n:
            return
        m = pairs.get(sym[i] << 20 | sym[j])
        if m is None:
            return
        e = end[j]
        if rate:
            packed = (i & low) << 42 ^ (j & low) << 21 ^ (e & low)
            if e > low:
                packed ^= _mixed(i >> 21 ^ (j >> 21) << 20 ^ (e >> 21) << 40)
            if _mixed(own ^ _mixed(packed)) >> 11 < least:
                return
        heapq.heappush(heap, (int(rank[m]), i, j, e, m))

    while heap:
        _, i, j, e, m = heapq.heappop(heap)
        if not (live[i] and live[j] and nxt[i] == j and end[j] == e and pairs.get(sym[i] << 20 | sym[j]) == m):
            continue
        sym[i] = m
        live[j], end[i], nxt[i] = False, e, nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        offer(prv[i])
        offer(i)
    return [x for i in range(n) if live[i] for x in p.out(sym[i], chunk[i : end[i]])]


def _rows(p: Pieces, texts: list[str], keys: np.ndarray | None, rate: float, skips: np.ndarray | None = None, asked: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of at most ROW characters, all at once: pieces, their number for each row, order of the rows.

    With ``skips`` (sorted row << _BITS | places) just these candidates are skipped, and the others met go to ``asked``.

    A symbol stands at the place of its first character; ``nxt`` and ``prv`` link
    the symbols of a row, so merging moves nothing.
    """
    size = np.array([len(t) for t in texts])
    wide = int(size.max())
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    step = wide + 2  # two places behind the text end every chain
    sym = np.full((len(texts), step), -1, np.int64)
    cols = np.arange(step)
    inside = cols < size[:, None]
    sym[inside] = p.char[points]
    sym = sym.ravel()
    nxt = np.tile(np.minimum(cols + 1, wide), (len(texts), 1))
    nxt = np.minimum(nxt, size[:, None]).ravel()
    prv = np.tile(cols - 1, len(texts))
    rank = np.full((len(texts), step), _NONE, np.int32)
    flat = rank.reshape(-1)

    def score(row: np.ndarray, x: np.ndarray) -> None:
        """Sets the rank of the candidate that begins at each place x."""
        base = row * step
        y = nxt[base + x]
        made = p.merged(sym[base + x], sym[base + y])
        r = np.where(made >= 0, p.rank[made], _NONE)
        if skips is not None:
            f = np.flatnonzero(made >= 0)
            met = (((row[f] << 6 | x[f]) << 6 | y[f]) << 6) | nxt[base[f] + y[f]]
            gone = skips[np.minimum(np.searchsorted(skips, met), len(skips) - 1)] == met if len(skips) else np.zeros(len(f), bool)
            r[f[gone]] = _NONE
            asked.append(met[~gone])
        elif rate:
            f = np.flatnonzero(made >= 0)
            end = nxt[base[f] + y[f]]
            r[f[_skipped(keys[row[f]], x[f], y[f], end, rate)]] = _NONE
        flat[base + x] = r

    score(*np.nonzero(inside[:, 1:]))
    row = np.arange(len(texts))
    live = rank
    while len(row):
        best = live.argmin(1)
        go = live[np.arange(len(row)), best] < _NONE
        if not go.all():
            row, best, live = row[go], best[go], live[go]
        base = row * step
        i, j = base + best, base + nxt[base + best]
        sym[i] = p.merged(sym[i], sym[j])
        sym[j] = -2
        after = nxt[j]
        nxt[i] = after
        prv[base + after] = best
        flat[j] = _NONE
        score(row, best)
        left = best > 0
        score(row[left], prv[i[left]])
        live = rank[row]
    sym = sym.reshape(len(texts), step)
    there = sym >= 0
    ids, counts = sym[there], there.sum(1)
    strange = np.flatnonzero((sym >= len(p.raw)).any(1))
    if len(strange):  # characters without a piece become bytes
        first = np.cumsum(counts) - counts
        out, at = [], 0
        for k in strange:
            out.append(ids[at : first[k]])
            places = np.flatnonzero(there[k])
            t, ends = texts[k], [*places[1:].tolist(), int(size[k])]
            got = [b for u, v in zip(places.tolist(), ends, strict=True) for b in p.out(int(sym[k, u]), t[u:v])]
            out.append(np.array(got, np.int64))
            at, counts[k] = first[k] + len(places), len(got)
        ids = np.concatenate([*out, ids[at:]])
    return ids, counts, np.arange(len(texts))


def _batches(size: np.ndarray) -> Iterator[np.ndarray]:
    """Places of chunks of similar sizes."""
    for low, high in ((0, 4), (4, 6), (6, 8), (8, 10), (10, 12), (12, 14), (14, 18), (18, 24), (24, ROW)):
        for at in np.array_split(w := np.flatnonzero((size > low) & (size <= high)), max(1, len(w) // 8000)):
            if len(at):
                yield at


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... of every k, ``count[k]`` of them."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def encode_chunks(p: Pieces, texts: list[str], which: np.ndarray, keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pieces, first, count) of each occurrence: of the chunk ``texts[which]``, under its own key. An empty chunk is a literal U+2581."""
    size = np.array([len(t) for t in texts], np.int64)
    parts: list[np.ndarray] = []
    held = 0
    first, count = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)

    def put(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        nonlocal held
        parts.append(ids.astype(np.int32))
        at = held + np.cumsum(n) - n
        held += len(ids)
        return at

    long = size[which] > ROW
    empty = np.flatnonzero(size[which] == 0)
    if len(empty):
        mark = np.array([p.byte[b] for b in _SPACE.encode()])
        first[empty], count[empty] = put(mark, np.array([len(mark)])), len(mark)
    for k in np.flatnonzero(long):
        ids = np.array(_agenda(p, texts[which[k]], keys[k], rate))
        first[k], count[k] = put(ids, np.array([len(ids)]))[0], len(ids)

    # A node is a chunk with a set of skips; an occurrence stands at the node of all its skips met so far.
    node_text, skips = np.flatnonzero((size > 0) & (size <= ROW)), np.zeros(0, np.int64)
    occ = np.flatnonzero(~long & (size[which] > 0))
    node = np.searchsorted(node_text, which[occ])
    own = [np.zeros(0, np.int64)]  # occurrences to be merged by themselves
    while len(occ):
        n_first, n_count, met = np.zeros(len(node_text), np.int64), np.zeros(len(node_text), np.int64), [np.zeros(0, np.int64)]
        bounds = np.searchsorted(skips, np.arange(len(node_text) + 1) << _BITS)
        for at in _batches(size[node_text]):
            n = bounds[at + 1] - bounds[at]
            local = np.repeat(np.arange(len(at)), n) << _BITS | skips[_spread(bounds[at], n)] & ((1 << _BITS) - 1)
            asked: list[np.ndarray] = []
            ids, n, _ = _rows(p, [texts[k] for k in node_text[at].tolist()], None, rate, local, asked)
            n_first[at], n_count[at] = put(ids, n), n
            a = np.concatenate(asked)
            met.append(at[a >> _BITS] << _BITS | a & ((1 << _BITS) - 1))
        first[occ], count[occ] = n_first[node], n_count[node]
        if not rate:
            break
        met = np.sort(np.concatenate(met))
        m_at = np.searchsorted(met, np.arange(len(node_text) + 1) << _BITS)
        place = _places(met >> 12 & 63, met >> 6 & 63, met & 63)
        hit_occ, hit_met = [], []
        for k in range(0, len(occ), _BLOCK):
            at = node[k : k + _BLOCK]
            n = m_at[at + 1] - m_at[at]
            pair = _spread(m_at[at], n)
            hit = np.flatnonzero(_below(np.repeat(keys[occ[k : k + _BLOCK]], n) ^ place[pair], rate))
            hit_occ.append(np.searchsorted(np.cumsum(n), hit, "right") + k)
            hit_met.append(pair[hit])
        hit_occ, hit_met = np.concatenate(hit_occ), np.concatenate(hit_met)
        some, begin = np.unique(hit_occ, return_index=True)  # the occurrences with skips
        if not len(some):
            break
        bit = hit_met - m_at[node[hit_occ]]
        mask = np.bitwise_or.reduceat(np.int64(1) << np.minimum(bit, 62), begin)
        wide = np.maximum.reduceat(bit, begin) > 61  # no room in a mask
        own.append(occ[some[wide]])
        some, mask = some[~wide], mask[~wide]
        order = np.lexsort((mask, node[some]))
        some, mask = some[order], mask[order]
        new = np.ones(len(some), bool)
        new[1:] = (mask[1:] != mask[:-1]) | (node[some[1:]] != node[some[:-1]])
        group = np.cumsum(new) - 1
        shared = (np.bincount(group, minlength=1) > 1)[group]
        own.append(occ[some[~shared]])
        heads, group, some = some[new & shared], np.cumsum((new & shared)[shared]) - 1, some[shared]
        # Skips of a new node: those of its node so far and those of its first occurrence.
        n = bounds[node[heads] + 1] - bounds[node[heads]]
        old = np.repeat(np.arange(len(heads)), n) << _BITS | skips[_spread(bounds[node[heads]], n)] & ((1 << _BITS) - 1)
        n = np.searchsorted(hit_occ, heads, "right") - np.searchsorted(hit_occ, heads)
        more = np.repeat(np.arange(len(heads)), n) << _BITS | met[hit_met[_spread(np.searchsorted(hit_occ, heads), n)]] & ((1 << _BITS) - 1)
        node_text, skips = node_text[node[heads]], np.sort(np.concatenate([old, more]))
        occ, node = occ[some], group
    own = np.concatenate(own)
    for at in _batches(size[which[own]]):
        k = own[at]
        ids, n, _ = _rows(p, [texts[i] for i in which[k].tolist()], keys[k], rate)
        first[k], count[k] = put(ids, n), n
    return np.concatenate(parts), first, count


def decode(p: Pieces, ids: list[int]) -> str:
    raw = p.raw
    text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def encode_texts(p: Pieces, texts: list[str | None], keys: np.ndarray, seed: int = SEED, rate: float = DROPOUT) -> tuple[np.ndarray, np.ndarray]:
    """(all pieces, offsets of the texts)."""
    parts: list[str] = []
    counts = []
    for t in texts:
        before = len(parts)
        if t:
            if _SPACE in t:
                head, *rest = t.split(_SPACE)
                parts += _CHUNK.findall((_SPACE + head).replace(" ", _SPACE))
                for x in rest:
                    parts.append("")  # a literal U+2581
                    parts += _CHUNK.findall(x.replace(" ", _SPACE))
            else:
                parts += _CHUNK.findall(_SPACE + t.replace(" ", _SPACE))
        counts.append(len(parts) - before)
    counts = np.array(counts, np.int64)
    if not parts:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    known: dict[str, int] = {}
    codes = np.array([known.setdefault(x, len(known)) for x in parts], np.int64)
    place = np.arange(len(parts)) - np.repeat(np.cumsum(counts) - counts, counts)
    own = tk.mix(np.repeat(keys, counts) + tk.mix(place.astype(np.uint64) + np.uint64(seed % (1 << 63))))
    flat, first, n = encode_chunks(p, list(known), codes, own, rate)
    ids = flat[_spread(first, n)]
    total = np.concatenate([[0], np.cumsum(n)])
    return ids, total[np.concatenate([[0], np.cumsum(counts)])]


def _encoded(model: bytes, seed: int, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(model)
        for b in batches:
            data, off = tk.buffers(b.column("text"))
            for i, j, d, o in tk.chunks(data, off, CHUNK_BYTES):
                texts = b.column("text").slice(i, j - i).to_pylist()
                keys = np.array([int.from_bytes(tk.digest(d[a:z].tobytes())[:8], "little") for a, z in zip(o[:-1], o[1:], strict=True)], np.uint64)
                ids, at = encode_texts(p, texts, keys, seed, rate)
                same = [decode(p, ids[at[k] : at[k + 1]].tolist()) == (t or "") for k, t in enumerate(texts)]
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                keep = [n for n in b.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(n).slice(i, j - i) for n in keep), pa.array(np.diff(at)), lists, pa.array(same, pa.bool_())],
                    names=[*keep, "n_pieces", "pieces", "lossless"],
                )

    return run


def encode(docs: DataFrame, model: str = MODEL, seed: int = SEED, dropout: float = DROPOUT) -> DataFrame:
    """doc_id, n_pieces, pieces and whether they decode to the text, of every row.

    The same text is cut in the same way in every run and in every row.
    """
    with open(model, "rb") as f:  # the driver's file; half a megabyte goes along with the tasks
        held = f.read()
    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", "text").mapInArrow(tk.frugal(_encoded(held, seed, dropout)), f"doc_id {kind}, n_pieces bigint, pieces array<int>, lossless boolean")


def decode_pieces(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of encoded rows; null pieces decode to ''."""
    with open(model, "rb") as f:
        held = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(held)
        for b in batches:
            texts = [decode(p, x or []) for x in b.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "pieces").mapInArrow(run, f"doc_id {kind}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
