"""Vectorised tokenising and hashing over Arrow string columns.

Everything here works on the UTF-8 buffer of a whole record batch at once, so
Python never loops over words. Work is cut into chunks of a few megabytes of
text (a longer document is a chunk of its own), which bounds the memory of a
task whatever the batch size is.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
#: Odd base of the rough hashes modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
#: The prime 2^61 - 1 and a base drawn at random below it, of the span hashes.
_PRIME = (1 << 61) - 1
_DRAWN = 0x0B5297A4D1E68C3F
_P, _M31, _M30, _M29, _M32 = (np.uint64(x) for x in (_PRIME, (1 << 31) - 1, (1 << 30) - 1, (1 << 29) - 1, (1 << 32) - 1))
#: Most bytes whose sum stays below 2^63: 2^8 * 2^31 * 2^24.
_SUMMED = 1 << 24
_TABLES: dict[str, np.ndarray] = {}


def _table(name: str, base: int, n: int, product: Callable) -> np.ndarray:
    """The first ``n`` powers of ``base``, grown on demand."""
    held = _TABLES.get(name)
    if held is None or len(held) < n:
        want = max(n, CHUNK_BYTES + 65536)
        held = np.ones(1, np.uint64)
        while len(held) < want:
            step = product(held[-1:], np.array([base], np.uint64))
            held = np.concatenate([held, product(held, step)])[:want]
        _TABLES[name] = held
    return held[:n]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, of numbers below 2^61."""
    ah, al, bh, bl = a >> np.uint64(32), a & _M32, b >> np.uint64(32), b & _M32
    mid, low = ah * bl + al * bh, al * bl
    r = (ah * bh << np.uint64(3)) + (mid >> np.uint64(29)) + ((mid & _M29) << np.uint64(32)) + (low >> np.uint64(61)) + (low & _P)
    return _reduced(r)


def _reduced(r: np.ndarray) -> np.ndarray:
    r = (r & _P) + (r >> np.uint64(61))
    return np.where(r >= _P, r - _P, r)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if pa.types.is_binary(col.type):
        col = col.cast(pa.large_binary())
    elif not pa.types.is_large_string(col.type) and not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    if col.null_count:
        # A null slot may still span bytes: rebuild without them.
        ok = np.asarray(col.is_valid())
        size = np.diff(off)
        data = data[np.repeat(ok, size)]
        off = np.concatenate([[0], np.cumsum(np.where(ok, size, 0))])
    return data, off


def chunks(data: np.ndarray, off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of at most ``limit`` bytes, or one longer document."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


#: Bytes of words: digits, letters and everything outside ASCII; A-Z is lowered.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
#: Bytes of words for the rule operators: all but ASCII white space.
SOLID = np.ones(256, bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False


def word_bounds(data: np.ndarray, off: np.ndarray, kind: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document with a closing total)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    w = kind[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    before = np.concatenate([[False], w[:-1]])
    after = np.concatenate([w[1:], [False]])
    starts = np.flatnonzero(w & (~before | first[:n]))
    ends = np.flatnonzero(w & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def _in_blocks(hashes: Callable) -> Callable:
    """Spans of a very long text are hashed by blocks of their starts, so that no array is as long as the text."""

    @functools.wraps(hashes)
    def run(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(data) <= 2 * CHUNK_BYTES or len(starts) == 0:
            return hashes(data, starts, ends)
        order = np.argsort(starts, kind="stable")
        bounds = np.searchsorted(starts[order], np.arange(0, len(data) + CHUNK_BYTES, CHUNK_BYTES))
        out = np.zeros(len(starts), np.uint64)
        for a, z in zip(bounds[:-1], bounds[1:], strict=True):
            if z > a:
                k = order[a:z]
                low = starts[k[0]]
                out[k] = hashes(data[low : ends[k].max()], starts[k] - low, ends[k] - low)
        return out

    return run


def running(data: np.ndarray) -> np.ndarray:
    """Running sums of bytes and powers of the rough base, from 0; a span's difference times ``unshifted`` at its start is the same anywhere."""
    n = len(data)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _table("rough", _BASE, n + 1, np.multiply)[:n], out=run[1:])
    return run


def unshifted(n: int) -> np.ndarray:
    """The first ``n`` inverse powers of the rough base."""
    return _table("back", pow(_BASE, -1, 1 << 64), n, np.multiply)


@_in_blocks
def rough_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit number of each span of bytes, equal for equal spans; other long spans may share it, so it only deals out work."""
    n = len(data)
    if n == 0 or len(starts) == 0:
        return np.zeros(len(starts), np.uint64)
    run = running(data)
    h = (run[ends] - run[starts]) * unshifted(n + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _STEP)


def _spanned(low: np.ndarray, high: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the spans modulo the prime; the running sums may wrap, a span of ``_SUMMED`` bytes does not."""
    if len(starts) and int((ends - starts).max()) > _SUMMED:
        cut = np.minimum(starts + _SUMMED, ends)
        return _reduced(_spanned(low, high, starts, cut) + _spanned(low, high, cut, ends))
    a, b = low[ends] - low[starts], high[ends] - high[starts]
    return _reduced(_reduced(a) + (b >> np.uint64(30)) + ((b & _M30) << np.uint64(31)))


@_in_blocks
def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, equal for equal spans anywhere: a polynomial modulo 2^61 - 1 at a drawn base.

    Two spans of n bytes share it with probability n / 2^61 over the draw.
    """
    n = len(data)
    if n == 0 or len(starts) == 0:
        return np.zeros(len(starts), np.uint64)
    back = _table("undrawn", pow(_DRAWN, -1, _PRIME), n + 1, _times)
    if len(_TABLES.get("low", ())) < n:
        _table("drawn", _DRAWN, n, _times)
        power = _TABLES.pop("drawn")  # only its halves are used
        _TABLES["low"], _TABLES["high"] = power & _M31, power >> np.uint64(31)
    x = data.astype(np.uint64) + np.uint64(1)
    low, high = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
    np.cumsum(x * _TABLES["low"][:n], out=low[1:])
    np.cumsum(x * _TABLES["high"][:n], out=high[1:])
    h = _times(_spanned(low, high, starts, ends), back[starts])
    return mix(h + (ends - starts).astype(np.uint64) * _STEP)


def word_hashes(data: np.ndarray, off: np.ndarray, kind: np.ndarray = WORD, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each document with a closing total)."""
    starts, ends, first = word_bounds(data, off, kind)
    return span_hashes(LOWER[data] if lower else data, starts, ends), first


def shingles(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each document, sorted, and their offsets.

    A document of fewer than k words, but not none, has one shingle of all its
    words; one without words has none.
    """
    count = np.diff(first)
    n = len(words)
    acc = np.zeros(max(n, 1), np.uint64)[:n]
    have = np.repeat(count, count)
    place = np.arange(n) - np.repeat(first[:-1], count)
    for j in range(k):
        if j < n:
            take = np.zeros(n, np.uint64)
            take[: n - j] = words[j:]
            if j:
                take[place + j >= have] = 0
            acc = acc + mix(take * np.uint64(2 * j + 3)) * (take != 0)
    keep = (place + k <= have) | (place == 0)
    doc = np.repeat(np.arange(len(count)), count)[keep]
    h = mix(acc[keep] + np.minimum(have[keep], k).astype(np.uint64))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(len(count) + 1))


def minhashes(h: np.ndarray, off: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """``count`` 32-bit minima for each document; rows of empty sets hold the maximum."""
    rng = np.random.RandomState(seed)
    mult = (rng.randint(0, 1 << 62, count, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
    plus = rng.randint(0, 1 << 62, count, dtype=np.int64).astype(np.uint64)
    sig = np.full((len(off) - 1, count), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(off) > 0)
    if len(full):
        at = off[:-1][full]
        for j in range(count):
            sig[full, j] = np.minimum.reduceat((h * mult[j] + plus[j]) >> np.uint64(32), at)
    return sig


def digest(b: bytes) -> bytes:
    return hashlib.blake2b(b, digest_size=16).digest()


def frugal(f: Callable) -> Callable:
    """A map over record batches that gives its freed memory back: workers stay alive between tasks."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not a GNU C library
                pass

    return run
