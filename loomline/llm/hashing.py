"""Vectorised 64-bit hashes of words and of runs of consecutive items, and sliding extremes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
_M1, _M2, _G = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
_C = U(0xD6E8FEB86659FD93)
#: Bytes that part words: space and 0x09 to 0x0D.
SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SEPARATORS)] = False


def mixed(x: np.ndarray) -> np.ndarray:
    """x through a 64-bit finaliser, in place."""
    x ^= x >> U(30)
    x *= _M1
    x ^= x >> U(27)
    x *= _M2
    x ^= x >> U(31)
    return x


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs; the order matters."""
    x = a * _C
    x += b
    x ^= x >> U(32)
    x *= _G
    x ^= x >> U(29)
    return x


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive items of h, by doubling."""
    if len(h) < k:
        return h[:0]
    out, have, part, size = None, 0, h, 1
    left = k
    while True:
        if left & 1:
            out, have = (part, size) if out is None else (joined(out[: len(h) - have - size + 1], part[have : have + len(h) - have - size + 1]), have + size)
        left >>= 1
        if not left:
            return out[: len(h) - k + 1].copy()
        part = joined(part[:-size], part[size:])
        size *= 2


def sliding(x: np.ndarray, w: int, best=np.minimum) -> np.ndarray:
    """Least (or other extreme) of each w consecutive values."""
    if len(x) < w:
        return x[:0]
    size = 1
    while size * 2 <= w:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def buffers(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column, nulls as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    texts = texts.fill_null("").cast(pa.large_binary()) if len(texts) else pa.array([], pa.large_binary())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each document the number of words before it; words end with their document."""
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = _IS_WORD[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    here, before = word[1:], word[:-1]
    starts = np.flatnonzero(here & (~before | cut))
    ends = np.flatnonzero(before & (~here | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of each word: eight bytes at a time, words of over 256 bytes by BLAKE2."""
    n = ends - starts
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    h = mixed(n.astype(U) + U(seed * int(_G) & (1 << 64) - 1))
    todo, at = np.flatnonzero(n <= 256), 0
    while len(todo):
        left = n[todo] - at
        x = eights[starts[todo] + at].view("<u8").ravel()
        short = left < 8
        x[short] &= (U(1) << (U(8) * left[short].astype(U))) - U(1)
        h[todo] = mixed((h[todo] + x) * _C)
        at += 8
        todo = todo[left > 8]
    for i in np.flatnonzero(n > 256):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(4, "little")).digest(), "little")
    return h


def byte_grams(data: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of the 16 bytes from each position on; positions in the last 15 are left out."""
    if len(data) < 16:
        return np.zeros(0, U)
    eights = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view("<u8").ravel()
    x = (eights[:-8] + U(seed * int(_G) & (1 << 64) - 1)) * _C
    x ^= x >> U(32)
    x += eights[8:]
    return mixed(x)


def blocks(offsets: np.ndarray, size: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of documents of about `size` bytes; a longer document is a block of its own."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        out.append((i, j))
        i = j
    return out


def cell_of(anchors: np.ndarray, seed: int = 1) -> np.ndarray:
    """Anchors are least hashes; here they are spread over the whole range anew."""
    return mixed(anchors * _G + U(seed))


def distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 128-bit values in order, whether each stands there twice, and each value's place in them."""
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(first)
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(first) - 1
    return a[at], b[at], np.diff(np.append(at, len(a))) >= 2, place


def twice(h: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of h, sorted, and whether each stands there twice (or weighs 2)."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(first)
    n = np.diff(np.append(at, len(s))) if weights is None else (np.add.reduceat(weights[order], at) if len(at) else at)
    return s[at], n >= 2


def found_in(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each x its place in the sorted table; -1 if it isn't there."""
    if not len(table):
        return np.full(len(x), -1)
    i = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[i] == x, i, -1)
