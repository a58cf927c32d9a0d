"""Whole-column text primitives on UTF-8 buffers.

Texts of an Arrow batch are looked at as one byte buffer with offsets; words,
word hashes and shingle hashes come from a few passes of array operations over
slices of a quarter megabyte, so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_ORDER = _rng.integers(1, 2**63, 16, dtype=np.uint64) * U64(2) + U64(1)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """_BASE ** 0 .. n-1 (mod 2**64); grows on demand."""
    global _POWERS
    if len(_POWERS) < n:
        more = np.full(1 << int(n - 1).bit_length(), _BASE, np.uint64)
        more[0] = 1
        _POWERS = np.multiply.accumulate(more)
    return _POWERS[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary array and its n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string()
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if kind == pa.large_binary() else "")
    texts = texts.cast(kind)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes, at least one text each; short ones keep the arrays in the cache."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j
        i = j


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and n + 1 offsets of the texts into the words."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~_SEP[buf]
    prev = np.empty_like(word)
    prev[0] = False
    prev[1:] = word[:-1]
    edge = offs[:-1][offs[:-1] < len(buf)]
    prev[edge] = False
    starts = np.flatnonzero(word & ~prev)
    nxt = np.empty_like(word)
    nxt[-1] = False
    nxt[:-1] = word[1:]
    nxt[edge[edge > 0] - 1] = False
    ends = np.flatnonzero(word & ~nxt) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of words, A-Z lower-cased if asked for."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    data = _LOWER[buf] if lower else buf
    vals = _BYTE[data]
    vals[_SEP[buf]] = 0
    lens = ends - starts
    base = np.zeros(len(buf), np.int64)
    base[starts] = starts
    np.maximum.accumulate(base, out=base)
    at = np.arange(len(buf), dtype=np.int64) - base
    at[: starts[0]] = 0
    most = int(lens.max())
    np.minimum(at, most, out=at)
    vals *= powers(most + 1)[at]
    sums = np.add.reduceat(vals, starts)
    return mix(sums + lens.astype(np.uint64) * U64(0xA0761D6478BD642F))


def shingle_hashes(words: np.ndarray, woffs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the k-word shingles of each text; a text of 1 to k-1 words has one, all its words."""
    counts = np.diff(woffs)
    n = len(words)
    sums = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        sums += words[j : j + len(sums)] * _ORDER[j]
    full = np.maximum(counts - k + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < k))
    out_n = full.copy()
    out_n[short] = 1
    offs = np.concatenate([[0], np.cumsum(out_n)])
    out = np.empty(offs[-1], np.uint64)
    keep = np.zeros(n + 1, np.int32)
    has = full > 0
    np.add.at(keep, woffs[:-1][has], 1)
    np.add.at(keep, woffs[:-1][has] + full[has], -1)
    inside = np.flatnonzero(np.cumsum(keep[:n])[: len(sums)] > 0) if len(sums) else np.zeros(0, np.int64)
    place = np.ones(offs[-1], bool)
    place[offs[:-1][short]] = False
    out[place] = mix(sums[inside])
    for i in short:
        w = words[woffs[i] : woffs[i + 1]]
        out[offs[i]] = mix((w * _ORDER[: len(w)]).sum(dtype=np.uint64)[None] + U64(len(w)))[0]
    return out, offs


def distinct_within(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each range, and their new offsets."""
    parts = [np.unique(values[offs[i] : offs[i + 1]]) for i in range(len(offs) - 1)]
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum(lens)])


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set of k-word shingles as sorted 64-bit hashes, with offsets."""
    starts, ends, woffs = word_spans(buf, offs)
    return distinct_within(*shingle_hashes(word_hashes(buf, starts, ends), woffs, k))
