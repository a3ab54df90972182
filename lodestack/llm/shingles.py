"""Vectorised word hashing and 5-word shingles over Arrow string buffers.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D`` (safe on UTF-8), with
A-Z lower-cased.  A whole Arrow batch is hashed in a few numpy passes over its
contiguous value buffer, in blocks of bounded size, so memory does not depend on
the number of rows in a batch.  Hashes are 64 bits wide and the same in every
process; distinct shingles of one corpus collide with negligible probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

K = 5  # words per shingle
BLOCK = 1 << 20  # bytes hashed at once

_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
for _b in range(ord("A"), ord("Z") + 1):
    _TABLE[_b] = _TABLE[_b + 32]
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LANE = _rng.integers(1, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, at least n of each."""
    if not _POW or len(_POW[0]) < n:
        n = max(n, BLOCK + 1)
        up, down = np.full(n, _MUL, np.uint64), np.full(n, _INV, np.uint64)
        up[0] = down[0] = 1
        _POW[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _POW[0], _POW[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _block_words(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start places of the words in one block; first marks bytes that begin a text."""
    ws = _WS[data]
    left = np.empty(len(ws), bool)
    left[0] = True
    left[1:] = ws[:-1]
    left |= first
    begin = np.flatnonzero(left & ~ws)
    right = np.empty(len(ws), bool)
    right[-1] = True
    right[:-1] = ws[1:] | first[1:]
    end = np.flatnonzero(right & ~ws) + 1
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=total[1:])
    value = (total[end] - total[begin]) * down[begin]
    return mix(value + (end - begin).astype(np.uint64)), begin


def batch_words(offsets: np.ndarray, data: np.ndarray) -> Iterator[np.ndarray]:
    """For every text of a batch, in order, the hashes of its words.

    offsets are the n + 1 byte places of n texts in data (zero-based, ascending).
    Texts longer than a block are cut at white space between blocks.
    """
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1
        if j <= i:  # one long text, or an empty tail
            yield _long_words(data[offsets[i] : offsets[i + 1]])
            i += 1
            continue
        lo, hi = offsets[i], offsets[j]
        if lo == hi:
            for _ in range(i, j):
                yield np.empty(0, np.uint64)
            i = j
            continue
        first = np.zeros(hi - lo, bool)
        at = offsets[i:j] - lo
        first[at[at < hi - lo]] = True
        words, begin = _block_words(data[lo:hi], first)
        cut = np.searchsorted(begin, offsets[i : j + 1] - lo)
        for k in range(j - i):
            yield words[cut[k] : cut[k + 1]]
        i = j


def _long_words(data: np.ndarray) -> np.ndarray:
    parts, at = [], 0
    while at < len(data):
        to = min(at + BLOCK, len(data))
        while to < len(data):  # grow to the next white space
            gap = np.flatnonzero(_WS[data[to : to + BLOCK]])
            if len(gap):
                to += int(gap[0])
                break
            to = min(to + BLOCK, len(data))
        first = np.zeros(to - at, bool)
        first[0] = True
        parts.append(_block_words(data[at:to], first)[0])
        at = to
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes: all 5-word windows, or the whole of a shorter text; empty without words."""
    n = len(words)
    if n == 0:
        return words
    if n < K:
        return mix((words * _LANE[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    acc = words[: n - K + 1] * _LANE[0]
    for k in range(1, K):
        acc += words[k : n - K + 1 + k] * _LANE[k]
    out = mix(acc)
    out.sort()
    if n > K:
        keep = np.empty(len(out), bool)
        keep[0] = True
        np.not_equal(out[1:], out[:-1], out=keep[1:])
        out = out[keep]
    return out


def texts_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow string column (null: empty), without copying the bytes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[offsets[0] : offsets[-1]] if bufs[2] is not None else np.empty(0, np.uint8)
    return offsets - offsets[0], data
