"""Minimal perfect hashes of byte strings, in shards, that keep their keys.

A shard's n keys go to n slots without gaps: keys fall into buckets, and a bucket keeps the first
displacement that sends all its keys to free slots; buckets of one key, which come last, keep the slot itself.
The keys are stored in the order of their slots, so that a string that is none of them is told apart by its bytes.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np

from .hashing import U, _G, mixed, word_hashes

#: Seed of the hash that deals keys to shards; shards try 1, 2, ... for themselves.
DEAL = 0


class Shard(NamedTuple):
    seed: int
    moves: np.ndarray  #: displacement of each bucket, or -1 - slot
    keys: np.ndarray  #: bytes of all keys, by slot
    ends: np.ndarray  #: of the keys in these bytes


def dealt(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of each string."""
    return _scaled(word_hashes(data, starts, ends, DEAL), n_shards)


def _scaled(h: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    return ((h >> U(32)) * np.asarray(n).astype(U) >> U(32)).astype(np.int64)


def _slot(h: np.ndarray, move: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    return (mixed(h ^ (move.astype(U) + U(1)) * _G) % np.asarray(n).astype(U)).astype(np.int64)


def n_buckets(n: int | np.ndarray) -> int | np.ndarray:
    return np.maximum(1, n * 2 // 5)


def build(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Shard:
    """The shard of these distinct strings; a seed under which it doesn't come out is left for the next."""
    n, seed = len(starts), 0
    while True:
        seed += 1
        h = word_hashes(data, starts, ends, seed)
        if len(np.unique(h)) < n:
            continue
        m = int(n_buckets(n))
        bucket = _scaled(h, m)
        size = np.bincount(bucket, minlength=m)
        order = np.argsort(bucket, kind="stable")
        first = np.cumsum(size) - size
        moves, slots, taken = np.zeros(m, np.int32), np.empty(n, np.int64), np.zeros(n, bool)
        for b in np.argsort(-size, kind="stable"):
            own = order[first[b] : first[b] + size[b]]
            if size[b] < 2:
                break
            found = _free(h[own], taken, n)
            if found is None:
                break
            moves[b], slots[own] = found
            taken[slots[own]] = True
        else:
            b = -1
        if b >= 0 and size[b] >= 2:
            continue
        alone = np.flatnonzero(size == 1)
        free = np.flatnonzero(~taken)
        moves[alone], slots[order[first[alone]]] = -1 - free, free
        by_slot = np.argsort(slots)
        lengths = (ends - starts)[by_slot]
        stops = np.cumsum(lengths)
        at = np.repeat(starts[by_slot] - (stops - lengths), lengths) + np.arange(lengths.sum())
        return Shard(seed, moves, data[at], stops)


def _free(h: np.ndarray, taken: np.ndarray, n: int, block: int = 256, tries: int = 1 << 20) -> tuple[int, np.ndarray] | None:
    for at in range(0, tries, block):
        move = np.arange(at, at + block)
        slots = _slot(h[None, :], move[:, None], n)
        ordered = np.sort(slots, 1)
        fits = ~taken[slots].any(1) & (ordered[:, 1:] != ordered[:, :-1]).all(1)
        if fits.any():
            i = int(np.argmax(fits))
            return int(move[i]), slots[i]
    return None


class Shards:
    """Some shards of a set of strings, looked up together."""

    def __init__(self, n_shards: int, shards: Iterable[tuple[int, Shard]]):
        shards = list(shards)
        self.n_shards = n_shards
        self.number = np.array([k for k, _ in shards], np.int64)
        self.place = np.full(n_shards, -1)
        self.place[self.number] = np.arange(len(shards))
        self.size = np.array([len(s.ends) for _, s in shards], np.int64)
        self.seed = np.array([s.seed for _, s in shards], np.int64)
        self.base = np.cumsum(self.size) - self.size
        buckets = n_buckets(self.size)
        self.bucket = np.cumsum(buckets) - buckets
        self.moves = np.concatenate([s.moves for _, s in shards])
        lengths = np.concatenate([np.diff(s.ends, prepend=0) for _, s in shards])
        self.stops = np.cumsum(lengths)
        self.starts = self.stops - lengths
        self.keys = np.concatenate([*(s.keys for _, s in shards), np.zeros(8, np.uint8)])

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each string its slot, counted over all shards here; -1 if it is no key of theirs."""
        out = np.full(len(starts), -1)
        place = self.place[dealt(data, starts, ends, self.n_shards)]
        at = np.flatnonzero(place >= 0)
        place = place[at]
        h = word_hashes(data, starts[at], ends[at], 1)
        for seed in np.unique(self.seed[place]):
            if seed != 1:
                own = self.seed[place] == seed
                h[own] = word_hashes(data, starts[at][own], ends[at][own], int(seed))
        n = self.size[place]
        move = self.moves[self.bucket[place] + _scaled(h, n_buckets(n))].astype(np.int64)
        slot = self.base[place] + np.where(move < 0, -1 - move, _slot(h, np.maximum(move, 0), n))
        same = self.stops[slot] - self.starts[slot] == ends[at] - starts[at]
        at, slot = at[same], slot[same]
        out[at] = np.where(_equal(data, starts[at], self.keys, self.starts[slot], ends[at] - starts[at]), slot, -1)
        return out


def _equal(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the strings of equal lengths are equal, eight bytes at a time; b has eight bytes behind its end."""
    eights = lambda x: np.lib.stride_tricks.sliding_window_view(x, 8)
    a8, b8 = eights(np.concatenate([a, np.zeros(8, np.uint8)])), eights(b)
    same, todo, at = np.ones(len(lengths), bool), np.arange(len(lengths)), 0
    while len(todo):
        differs = a8[a_starts[todo] + at].view("<u8").ravel() ^ b8[b_starts[todo] + at].view("<u8").ravel()
        left = np.minimum(lengths[todo] - at, 8)
        differs[left < 8] &= (U(1) << (U(8) * left[left < 8].astype(U))) - U(1)
        same[todo] = differs == 0
        at += 8
        todo = todo[same[todo] & (lengths[todo] > at)]
    return same
