"""External induced sorting: suffix order and common prefixes of a text, by queues on disk and recursion.

Suffixes are S (smaller than the next one) or L. The leftmost S suffixes are ordered by recursion: their
substrings are ordered and named, and the text of the names is sorted the same way. Their order induces
that of the L suffixes, and that of the S suffixes.

An induction is a priority queue of tuples (symbol, position, common prefix). It pops a range of symbols at a
time, smallest first; each popped suffix pushes the one before it, if that is of the wanted type. The prefix a
tuple carries is what it has in common with the tuple of its symbol that was pushed before it: one more than the
least prefix passed since then (none, if another range was popped meanwhile). What is pushed into the range being
popped is ordered there by doubling along its chain of successors, and its prefixes are compared directly. The
queue holds at most `in_memory` tuples; what is more goes to a file of its range. Arrays of more than `in_memory`
cells (text, types, order, prefixes) are files too, mapped. In memory are the range being popped and, at eight
bytes each, some arrays of the leftmost S suffixes of a level (a third of the text at most).
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Tuples (and cells of an array) that are held in memory; what is more is on disk.
IN_MEMORY = 1 << 17
#: Suffixes that are popped together, about.
RANGE = 1 << 17
#: Pairs of suffixes that are compared together.
PAIRS = 1 << 14


def cells(n: int, kind, in_memory: int) -> np.ndarray:
    """n zeros, in a mapped file of the task's scratch folder if they are many."""
    if n <= in_memory:
        return np.zeros(n, kind)
    with tempfile.TemporaryFile() as f:
        f.truncate(n * np.dtype(kind).itemsize)
        return np.memmap(f, kind, "r+", shape=(n,)).view(np.ndarray)


class Queue:
    """Tuples by range of symbols, first in first out within a symbol."""

    def __init__(self, bounds: np.ndarray, in_memory: int) -> None:
        self.bounds, self.in_memory, self.held, self.file, self.end, self.spilled = bounds, in_memory, 0, None, 0, 0
        self.parts: list[list] = [[] for _ in bounds]

    def push(self, symbols: np.ndarray, positions: np.ndarray, prefixes: np.ndarray) -> None:
        """Symbols come in order, equal ones in their order of arrival."""
        if not len(symbols):
            return
        where = np.searchsorted(self.bounds, symbols, "right") - 1
        first = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
        for r, i, j in zip(where[first].tolist(), first.tolist(), [*first[1:].tolist(), len(symbols)]):
            rows = np.empty(j - i, "i4,i4,i2")
            rows["f0"], rows["f1"], rows["f2"] = symbols[i:j], positions[i:j], prefixes[i:j]
            self.parts[r].append(rows)
        self.held += len(symbols)
        if self.held > self.in_memory:
            self.spill()

    def spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(self.end)
        for parts in self.parts:
            own = [k for k, x in enumerate(parts) if isinstance(x, np.ndarray)]
            if own:  # parts on disk come before those in memory
                rows = np.concatenate(parts[own[0] :])
                self.file.write(rows.tobytes())
                parts[own[0] :] = [(self.end, len(rows))]
                self.end += rows.nbytes
                self.spilled += len(rows)
        self.held = 0

    def pop(self, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = [np.empty(0, "i4,i4,i2")]
        for part in self.parts[r]:
            if isinstance(part, tuple):
                self.file.seek(part[0])
                part = np.frombuffer(self.file.read(10 * part[1]), "i4,i4,i2")
            else:
                self.held -= len(part)
            out.append(part)
        self.parts[r] = []
        rows = np.concatenate(out)
        by = np.argsort(_narrow(rows["f0"] - (rows["f0"].min() if len(rows) else 0)), kind="stable")
        return rows["f0"][by].astype(np.int64), rows["f1"][by].astype(np.int64), rows["f2"][by]

    def close(self) -> None:
        if self.file:
            self.file.close()


def _narrow(x: np.ndarray) -> np.ndarray:
    """x in 16 bits where it fits: those are sorted by digits."""
    return x.astype(np.uint16) if not len(x) or x.max() < 1 << 16 else x


def types(t: np.ndarray, in_memory: int) -> np.ndarray:
    """Whether each suffix is of type S; the last one, the end, is."""
    small = cells(len(t), bool, in_memory)
    after, step = True, 1 << 20
    for i in range((len(t) - 1) // step * step, -1, -step):
        j = min(i + step, len(t) - 1)
        up = np.sign(np.diff(t[i : j + 1].astype(np.int64)))
        at = np.where(up != 0, np.arange(len(up)), len(up))
        at = np.minimum.accumulate(at[::-1])[::-1]
        small[i:j] = np.append(up, 1 if after else -1)[at] > 0
        if j == len(t) - 1:
            small[j] = True
        after = bool(small[i])
    return small


def _agree(t: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int, known: int = 0) -> np.ndarray:
    """Symbols, at most depth, that the suffixes at a and b have in common; at least `known` of them agree."""
    out = np.full(len(a), known, np.int64)
    for i in range(0, len(a), PAIRS):
        _agree_on(t, a[i : i + PAIRS], b[i : i + PAIRS], depth, out[i : i + PAIRS])
    return np.minimum(out, depth, out=out)


def _agree_on(t: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int, out: np.ndarray) -> None:
    """Adds to out, what is known to agree, the symbols behind it that do, up to depth or a little more."""
    each, furthest = 8 // t.itemsize, np.maximum(a, b)
    left, late = np.arange(len(a)), []
    for eights in (1, *[8] * (depth // (8 * each) + 1)):  # few symbols first, then many at a time
        n = eights * each
        near = furthest[left] + out[left] + n > len(t)
        late.append(left[near])
        left = left[~near & (out[left] < depth)]
        if not len(left):
            break
        rows = np.ndarray((len(t) - n + 1, n), t.dtype, t, strides=(t.itemsize, t.itemsize))
        k = out[left]
        differ = rows[a[left] + k].view("<u8") ^ rows[b[left] + k].view("<u8")
        at = (differ != 0).argmax(1)
        first = differ[np.arange(len(left)), at]
        same = first == 0
        bit = np.frexp((first & -first).astype(np.float64))[1] - 1  # the lowest one in which they differ
        out[left] += np.where(same, n, at * each + bit // (8 * t.itemsize))
        left = left[same]
    left = np.concatenate(late)
    while len(left):
        k = out[left]
        left = left[(furthest[left] + k < len(t)) & (k < depth)]
        k = out[left]
        left = left[t[a[left] + k] == t[b[left] + k]]
        out[left] += 1


class Least:
    """Least of any range of values, by doubling."""

    def __init__(self, x: np.ndarray) -> None:
        self.rows = np.empty((max(len(x), 1).bit_length(), len(x)), x.dtype)
        self.rows[0] = x
        for level in range(1, len(self.rows)):
            k = 1 << level - 1
            np.minimum(self.rows[level - 1, : len(x) - 2 * k + 1], self.rows[level - 1, k : len(x) - k + 1], out=self.rows[level, : len(x) - 2 * k + 1])

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Least of x[i:j], j > i."""
        level = np.frexp((j - i).astype(np.float32))[1] - 1
        return np.minimum(self.rows[level, i], self.rows[level, j - (1 << level)])


def _in_range(first: np.ndarray, lo: int, hi: int, before, symbol_of) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that those of a range put into the same range, again and again: positions and, of all, the successor's place."""
    news, succ, base, part = [], [], 0, first
    while True:
        p, keep = before(part)
        own = (s := symbol_of(p)) <= hi
        own &= s >= lo
        if not own.any():
            break
        news.append(p[own])
        succ.append(base + keep[own])
        base, part = base + len(part), news[-1]
    return (np.concatenate(news), np.concatenate(succ)) if news else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _chained(slot: np.ndarray, symbols: np.ndarray, n: int, succ: np.ndarray) -> np.ndarray:
    """Order of new suffixes by slot (their place among the n of a range), symbol and order of their successors, by doubling.

    succ counts the n first, then the new ones.
    """
    base, scale = np.concatenate([2 * np.arange(n), 2 * slot - 1]), len(slot) + 2
    jump, group = np.concatenate([np.arange(n), succ]), np.unique(symbols, return_inverse=True)[1]
    while True:
        full = base * scale
        full[n:] += group
        key, own = full[jump[n:]], full[n:]
        by = np.lexsort((key, own))
        head = np.append(True, (own[by][1:] != own[by][:-1]) | (key[by][1:] != key[by][:-1]))
        if head.all():
            return by
        group[by] = np.cumsum(head)
        jump = jump[jump]


def _induced(t, wanted: np.ndarray, up: bool, seeds, depth: int, n_symbols: int, in_memory: int, popped: int, stats: dict | None):
    """Suffixes of the wanted type and the seeds, in order (upwards or downwards), with their prefixes.

    seeds: batches of (positions, prefixes) in that order; within a symbol they come behind the wanted ones.
    """
    symbol_of = (lambda p: t[p].astype(np.int64)) if up else (lambda p: n_symbols - 1 - t[p].astype(np.int64))
    counts = np.bincount(t, minlength=n_symbols) if len(t) <= 1 << 20 else sum(np.bincount(t[i : i + (1 << 20)], minlength=n_symbols) for i in range(0, len(t), 1 << 20))
    total = np.cumsum(counts if up else counts[::-1])
    bounds = np.flatnonzero(np.append(True, np.diff((total - 1) // popped) > 0))  # a range begins where its share is full
    queue = Queue(bounds, in_memory)
    seeds = iter(seeds)
    seed_p, seed_l = next(seeds, (np.zeros(0, np.int64), np.zeros(0, np.int16)))

    def before(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = np.flatnonzero(p > 0)
        keep = keep[wanted[p[keep] - 1]]
        return p[keep] - 1, keep

    for r, lo in enumerate(bounds.tolist()):
        hi = (bounds[r + 1] if r + 1 < len(bounds) else n_symbols) - 1
        symbols, places, prefixes = queue.pop(r)
        mine_p, mine_l = [], []
        while len(seed_p):
            stop = int(np.searchsorted(symbol_of(seed_p), hi, "right"))
            mine_p.append(seed_p[:stop])
            mine_l.append(seed_l[:stop])
            seed_p, seed_l = seed_p[stop:], seed_l[stop:]
            if len(seed_p):
                break
            seed_p, seed_l = next(seeds, (np.zeros(0, np.int64), np.zeros(0, np.int16)))
        own_p = np.concatenate([np.zeros(0, np.int64), *mine_p])
        own_l = np.concatenate([np.zeros(0, np.int16), *mine_l])
        p = np.concatenate([places, own_p])
        if not len(p):
            continue
        s = np.concatenate([symbols, symbol_of(own_p)])
        k = np.repeat(np.array([0, 2], np.int8), [len(places), len(own_p)])
        prefix = np.concatenate([prefixes, own_l])
        if len(places) and len(own_p):
            by = np.argsort(_narrow((s - lo) * 2 + (k > 0)), kind="stable")
            p, s, k, prefix = p[by], s[by], k[by], prefix[by]
        new, succ = _in_range(p, lo, hi, before, symbol_of)
        if len(new):
            named = symbol_of(new)
            slot = np.searchsorted(s * 2 + (k > 0), named * 2 + 1)
            by = _chained(slot, named, len(p), succ)
            p, s, k, prefix = (np.insert(x, slot[by], y) for x, y in ((p, new[by]), (s, named[by]), (k, 1), (prefix, 0)))
        same = np.append(False, s[1:] == s[:-1])
        prefix[~same] = 0
        open_ = np.flatnonzero(same & ((k == 1) | np.append(False, k[1:] != k[:-1])))
        prefix[open_] = _agree(t, p[open_], p[open_ - 1], depth, 1)
        yield p, prefix, k == 2
        q, at = before(p)
        to = symbol_of(q)
        far = to > hi
        q, at, to = q[far], at[far], to[far]
        order = np.argsort(_narrow(to), kind="stable")
        q, at, to = q[order], at[order], to[order]
        if len(to):
            head = np.append(True, to[1:] != to[:-1])
            carried = np.zeros(len(to), np.int16)  # ranges begin with a symbol of their own
            carried[~head] = Least(prefix).of(np.append(0, at[:-1] + 1)[~head], at[~head] + 1)
            queue.push(to, q, np.minimum(carried + 1, depth))
    if stats is not None:
        stats["spilled"] = stats.get("spilled", 0) + queue.spilled
    queue.close()


def _batches(p: np.ndarray, prefixes: np.ndarray, size: int):
    for i in range(0, len(p), size):
        yield p[i : i + size], prefixes[i : i + size]


def _both(t, small, seeds, depth: int, n_symbols: int, in_memory: int, popped: int, stats: dict | None) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in the order that the seeds (leftmost S suffixes and their prefixes) induce, with their prefixes."""
    n, n_large = len(t), 0
    large_p, large_l = cells(n, np.int32, in_memory), cells(n, np.int16, in_memory)
    for p, prefix, seed in _induced(t, ~small, True, seeds, depth, n_symbols, in_memory, popped, stats):
        p, prefix = p[~seed], prefix[~seed]
        large_p[n_large : n_large + len(p)], large_l[n_large : n_large + len(p)] = p, prefix
        n_large += len(p)

    def downwards():
        for j in range(n_large, 0, -popped):
            i = max(j - popped, 0)
            yield large_p[i:j][::-1].astype(np.int64), np.append(large_l[j] if j < n_large else 0, large_l[i + 1 : j][::-1]).astype(np.int16)

    order, prefixes, at = cells(n, np.int32, in_memory), cells(n + 1, np.int16, in_memory), n
    for p, prefix, _ in _induced(t, small, False, downwards(), depth, n_symbols, in_memory, popped, stats):
        order[at - len(p) : at] = p[::-1]
        prefixes[at - len(p) + 1 : at + 1] = prefix[::-1]  # downwards a prefix is shared with the one above
        at -= len(p)
    order[0] = n - 1  # the end, which nothing induces
    prefixes[0] = 0
    return order, prefixes[:n]


def _ranked(t: np.ndarray, star: np.ndarray) -> np.ndarray:
    """For each leftmost S suffix how many of their substrings (from one to the next) are smaller.

    Several symbols are compared at a time; only what still has equals goes on. Where one substring begins
    with another, the longer is the smaller: it goes on with a suffix of type L.
    """
    each, bits = (4, 16) if t.dtype == np.uint16 else (2, 32)
    size = np.append(star[1:], len(t) - 1) - star + 1
    rank, open_, k = np.zeros(len(star), np.int64), np.arange(len(star)), 0
    while len(open_):
        key = np.zeros(len(open_), np.uint64)
        for i in range(k, k + each):
            at = np.minimum(star[open_] + i, len(t) - 1)
            key = key << np.uint64(bits) | np.where(i < size[open_], t[at].astype(np.uint64), np.uint64((1 << bits) - 1))
        by = np.lexsort((key, rank[open_])) if k else np.argsort(key)
        open_, key = open_[by], key[by]
        old = rank[open_]
        group = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
        head = np.flatnonzero(np.append(True, (old[1:] != old[:-1]) | (key[1:] != key[:-1])))
        n = np.diff(np.append(head, len(key)))
        rank[open_] = old + np.repeat(head, n) - np.repeat(group, np.diff(np.append(group, len(key))))
        k += each
        longest = np.maximum.reduceat(size[open_], head)
        open_ = open_[np.repeat((n > 1) & (longest > k), n)]
    return rank


def sorted_suffixes(t: np.ndarray, n_symbols: int, depth: int, in_memory: int = IN_MEMORY, popped: int = RANGE, stats: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all suffixes in order, and what each has in common with the one before it (at most depth).

    t ends with a 0 that stands nowhere else. Suffixes that agree in depth symbols may stand in any order.
    """
    if stats is not None:
        stats["levels"] = stats.get("levels", 0) + 1
    small = types(t, in_memory)
    star = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(star) < 2:
        return _both(t, small, _batches(star, np.zeros(len(star), np.int16), popped), depth, n_symbols, in_memory, popped, stats)
    rank = _ranked(t, star)
    place = np.argsort(rank, kind="stable")
    same = rank[place][1:] == rank[place][:-1]
    names = cells(len(star) + 1, np.int32, in_memory)
    named = np.cumsum(np.append(True, ~same))
    names[place] = named
    if named[-1] < len(star):
        deep, deep_l = sorted_suffixes(names, int(named[-1]) + 1, depth // 2 + 1, in_memory, popped, stats)
        deep, deep_l = deep[1:], deep_l[1:].astype(np.int64)
    else:
        deep, deep_l = place, np.zeros(len(star), np.int64)
    order, prefix = star[deep], np.zeros(len(star), np.int16)
    a, b = deep[1:], deep[:-1]
    n = np.minimum(deep_l[1:], len(star) - np.maximum(a, b) - 1)  # names in common; of the next ones the beginnings may agree
    known = star[a + n] - star[a]
    prefix[1:] = np.minimum(known + _agree(t, star[a + n], star[b + n], depth, 0), depth)
    return _both(t, small, _batches(order, prefix, popped), depth, n_symbols, in_memory, popped, stats)


def suffix_order(text: np.ndarray, depth: int, in_memory: int = IN_MEMORY, popped: int = RANGE, stats: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes of bytes (under 2 GB), and the prefix each shares with the one before it (at most depth)."""
    t = cells(len(text) + 1, np.uint16, in_memory)
    t[:-1] = text
    t[:-1] += 1
    order, prefixes = sorted_suffixes(t, 257, depth, in_memory, popped, stats)
    return order[1:], prefixes[1:]
