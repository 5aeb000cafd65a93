"""Vectorised words and hashes of a batch of texts, straight from Arrow's buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE = 1_000_000
_ODD = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([[U(1)], np.cumprod(np.full(max(n, 64) - 1, _ODD))]).astype(U)
    return _powers


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of consecutive rows holding about ``size`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        to = min(to, n)
        yield at, to, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(raw: np.ndarray, offsets: np.ndarray, lower_case: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, or as they are: (64-bit hashes, first bytes, bytes after the last, words before each row)."""
    n_rows = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n_rows + 1, np.int64)
    white = (raw == 0x20) | ((raw >= 9) & (raw <= 13))
    first = ~white
    edge = np.zeros(len(raw), bool)
    edge[offsets[:-1][offsets[:-1] < len(raw)]] = True
    first[1:] &= white[:-1] | edge[1:]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, U), starts, starts, np.zeros(n_rows + 1, np.int64)
    last = ~white
    last[:-1] &= white[1:] | edge[1:]
    ends = np.flatnonzero(last) + 1
    lower = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32) if lower_case else raw
    at = np.repeat(starts, np.diff(np.append(starts, len(raw))))
    inside = np.arange(starts[0], len(raw)) - at
    body = lower[starts[0] :].astype(U) + U(1)
    body[white[starts[0] :]] = U(0)
    np.minimum(inside, int((ends - starts).max()), out=inside)
    body *= powers(int((ends - starts).max()) + 1)[inside]
    sums = np.add.reduceat(body, starts - starts[0])
    return mix(sums ^ ((ends - starts).astype(U) * U(0xD6E8FEB86659FD93))), starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k neighbouring words, rows not regarded; shorter than ``hashes`` by k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = mix(hashes[k - 1 : k - 1 + n] + U(k))
    for j in range(k - 2, -1, -1):
        out = mix(out * U(0xC2B2AE3D27D4EB4F) + hashes[j : j + n])
    return out


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of a whole word sequence that is too short for a shingle."""
    return shingles(hashes, len(hashes))[0]


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; with fewer words, of its one sequence; else empty."""
    for _, _, raw, offsets in slices(texts):
        hashes, _, _, before = words(raw, offsets)
        grams = shingles(hashes, k)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield np.array([sequence_hash(hashes[a:b])], U)
            else:
                yield np.zeros(0, U)
