"""Seams between chunks and between sentences: merging readings, cutting sentences apart, reading gaps again.

Times are numbers of any one unit. A seam's decision depends on the ones before, so it is taken by a small
kernel; what kernels get is cut as far as decisions can't reach: a recording's chunks for merges, and for sentences
one cluster of overlapping ones (a cut never leaves its cluster's time).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from functools import reduce
from itertools import groupby, pairwise
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .groups import each_group

Token = tuple[str, float, float]


def longest_run(same: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of the longest diagonal of a boolean matrix; of equals the one that starts in the first row, then column."""
    size, best = np.zeros(same.shape[1] + 1, int), (0, 0, 0)
    for i, row in enumerate(same):
        size[1:] = np.where(row, size[:-1] + 1, 0)
        j = int(size[1:].argmax())
        if size[j + 1] > best[0]:
            best = int(size[j + 1]), i, j
    n, i, j = best
    return [(i - k, j - k) for k in range(n - 1, -1, -1)]


def longest_subsequence(same: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a longest rising sequence of true places; read from the end, where both ways are as long the column goes first."""
    n, m = same.shape
    size = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n):
        size[i + 1, 1:] = np.maximum.accumulate(np.where(same[i], size[i, :-1] + 1, size[i, 1:]))
    pairs, i, j = [], n - 1, m - 1
    while i >= 0 and j >= 0:
        if same[i, j]:
            pairs.append((i, j))
            i, j = i - 1, j - 1
        elif size[i, j + 1] > size[i + 1, j]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def merged(a: list[Token], b: list[Token], overlap: float, tolerance: float | None = None) -> list[Token]:
    """Tokens (word, start, end) of two readings as one stream.

    Where they overlap in time, tokens within `overlap` of the other's edge are paired if their words are equal and
    start nearer to each other than the tolerance (half of the overlap): by the longest run of neighbours, if it
    has half of a's tokens there, else by a longest common subsequence. What lies between two pairs is taken from b if b has
    more there. Without pairs, or with under two tokens on a side, each side keeps its half of the time.
    """
    if not a or not b or a[-1][2] <= b[0][1]:
        return a + b
    a_end, b_start = a[-1][2], b[0][1]
    x = [t for t in a if t[2] > b_start - overlap]
    y = [t for t in b if t[1] < a_end + overlap]
    pairs: list[tuple[int, int]] = []
    if min(len(x), len(y)) >= 2:
        number: dict[str, int] = {}
        code = lambda side: np.array([number.setdefault(t[0], len(number)) for t in side])
        time = lambda side: np.array([t[1] for t in side], float)
        near = np.abs(time(x)[:, None] - time(y)) < (overlap / 2 if tolerance is None else tolerance)
        same = (code(x)[:, None] == code(y)) & near
        pairs = longest_run(same)
        if len(pairs) < len(x) // 2:
            pairs = longest_subsequence(same)
    if not pairs:
        half = (a_end + b_start) / 2
        return [t for t in a if t[2] <= half] + [t for t in b if t[1] >= half]
    first = len(a) - len(x)
    out = a[: first + pairs[0][0] + 1]
    for (i, j), (k, m) in zip(pairs, pairs[1:]):
        out += max(a[first + i + 1 : first + k], b[j + 1 : m], key=len)
        out.append(a[first + k])
    return out + b[pairs[-1][1] + 1 :]


def folded(readings: list[list[Token]], overlap: float, tolerance: float | None = None) -> list[Token]:
    """Readings merged one after the other; a merge looks only at tokens that can reach its seam."""
    out: list[Token] = []
    reach: list[float] = []  # the furthest end so far
    for new in readings:
        at = bisect_right(reach, new[0][1] - overlap) if new else len(out)
        tail = merged(out[at:], new, overlap, tolerance)
        del out[at:], reach[at:]
        for t in tail:
            out.append(t)
            reach.append(max(t[2], reach[-1]) if reach else t[2])
    return out


def chunk_loop(chunks: DataFrame, key: str, overlap: float, least: float = 0, banked: DataFrame | None = None, marks: DataFrame | None = None) -> DataFrame:
    """key, place, word, start, end of the readings of each key's chunks, merged in order.

    chunks: (key, begins, lasts, word, at, until), token times from the chunk's own beginning. Chunks that last under `least` are
    not read. banked (key, place, word, start, end) are the tokens merged by an earlier run, and marks
    (key, next_start) where it stopped: chunks that begin earlier are skipped.
    """
    kept = chunks.where(F.col("lasts") >= least)
    if marks is not None:
        kept = kept.join(marks.select(key, "next_start"), key, "left").where("next_start IS NULL OR begins >= next_start")
    tokens = kept.select(key, F.lit(1).alias("run"), F.col("begins").cast("double").alias("begins"), F.lit(0).cast("long").alias("place"), "word",
                         (F.col("begins") + F.col("at")).cast("double").alias("start"), (F.col("begins") + F.col("until")).cast("double").alias("end"))
    if banked is not None:
        tokens = tokens.unionByName(banked.select(key, F.lit(0).alias("run"), F.lit(0.0).alias("begins"), "place", "word", "start", "end"))

    def fold(part: list[tuple]) -> list[tuple]:
        readings = [[r[4:] for r in own] for _, own in groupby(part, key=itemgetter(1, 2))]
        return [(part[0][0], i, *t) for i, t in enumerate(folded(readings, overlap))]

    given = tokens.select(key, "run", "begins", "place", "word", "start", "end")
    return each_group(given, [key], ["run", "begins", "place", "start", "end", "word"], fold, f"{key} {dict(chunks.dtypes)[key]}, place long, word string, start double, end double")


def replayed(chunks: DataFrame, key: str, overlap: float, tolerances: list[float]) -> DataFrame:
    """key, tolerance, n, backwards, furthest: the merge at each tolerance, and how often and far starts step back in it."""
    tokens = chunks.select(key, F.col("begins").cast("double").alias("begins"), "word", (F.col("begins") + F.col("at")).cast("double").alias("start"), (F.col("begins") + F.col("until")).cast("double").alias("end"))

    def replay(part: list[tuple]) -> list[tuple]:
        readings = [[r[2:] for r in own] for _, own in groupby(part, key=itemgetter(1))]
        told = []
        for tolerance in tolerances:
            starts = [t[1] for t in folded(readings, overlap, float(tolerance))]
            back = [a - b for a, b in pairwise(starts) if b < a]
            told.append((part[0][0], float(tolerance), len(starts), len(back), max(back, default=0.0)))
        return told

    kinds = f"{key} {dict(chunks.dtypes)[key]}, tolerance double, n long, backwards long, furthest double"
    return each_group(tokens, [key], ["begins", "start", "end", "word"], replay, kinds)


def contiguous_seams(tokens: DataFrame, key: str, overlap: float) -> DataFrame:
    """key, chunk, n_a, run, a_at, b_at, enough: the longest run of equal words at the seam of each chunk with the next.

    tokens: (key, chunk, place, word, start, end). n_a tokens of the chunk end within `overlap` of the next one's first start; the
    run begins at places a_at and b_at; enough: it has half of n_a, so that the seam is merged along it.
    """
    edges = tokens.groupBy(key, "chunk").agg(F.min_by("start", "place").alias("first"), F.max_by("end", "place").alias("last"))
    shift = lambda e, by: e.select(key, (F.col("chunk") + by).alias("chunk"), F.col("first").alias("b_first"), F.col("last").alias("a_last"))
    a = tokens.join(shift(edges, -1), [key, "chunk"]).where(F.col("end") > F.col("b_first") - overlap)
    own = edges.select(key, "chunk", F.col("last").alias("own_last"))
    a = a.join(own, [key, "chunk"]).where(F.col("own_last") > F.col("b_first"))
    b = tokens.join(shift(edges, 1), [key, "chunk"]).where(F.col("start") < F.col("a_last") + overlap).withColumn("chunk", F.col("chunk") - 1)
    n = a.groupBy(key, "chunk").agg(F.count(F.lit(1)).alias("n_a")).join(b.groupBy(key, "chunk").agg(F.count(F.lit(1)).alias("n_b")), [key, "chunk"])
    right = b.select(key, "chunk", "word", F.col("place").alias("j"), F.col("start").alias("b_start"))
    pairs = a.select(key, "chunk", "word", F.col("place").alias("i"), "start").join(right, [key, "chunk", "word"]).where(F.abs(F.col("start") - F.col("b_start")) < overlap / 2)
    order = Window.partitionBy(key, "chunk", "d").orderBy("i")
    runs = pairs.withColumn("d", F.col("i") - F.col("j")).withColumn("g", F.col("i") - F.row_number().over(order))
    runs = runs.groupBy(key, "chunk", "d", "g").agg(F.count(F.lit(1)).alias("run"), F.min("i").alias("a_at"), F.min("j").alias("b_at"))
    best = runs.groupBy(key, "chunk").agg(F.max(F.struct("run", (-F.col("a_at")).alias("i"), (-F.col("b_at")).alias("j"))).alias("m"))
    found = n.where("n_a >= 2 AND n_b >= 2").join(best, [key, "chunk"], "left")
    return found.select(
        key, "chunk", "n_a", F.coalesce("m.run", F.lit(0)).alias("run"), (-F.col("m.i")).alias("a_at"), (-F.col("m.j")).alias("b_at"),
        (F.coalesce("m.run", F.lit(0)) >= F.floor(F.col("n_a") / 2)).alias("enough"),
    )


def cheapest_cuts(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cut, moved, pause: where the tokens of each pair of sentences are best cut once in time order; no row where no cut is free.

    tokens: (keys, of_b, token, t, e). A cut is free if nothing before it ends after what follows starts; of those
    the fewest tokens change sides; of equals the pause is widest; then the first. cut tokens stay before it.
    """
    w = Window.partitionBy(*keys).orderBy("t", "of_b", "token")
    end = F.coalesce("e", "t")
    cuts = tokens.select(
        *keys,
        F.row_number().over(w).alias("cut"),
        (F.sum(F.when(F.col("of_b"), 1).otherwise(-1)).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.sum(F.when(F.col("of_b"), 0).otherwise(1)).over(Window.partitionBy(*keys))).alias("moved"),
        (F.lead("t").over(w) - F.max(end).over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("pause"),
    ).where("pause >= 0")
    best = cuts.groupBy(*keys).agg(F.min(F.struct("moved", (-F.col("pause")).alias("p"), "cut")).alias("m"))
    return best.select(*keys, "m.cut", "m.moved", (-F.col("m.p")).alias("pause"))


def _cut(a: np.ndarray, b: np.ndarray, t: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Places of the tokens of two sentences, cut anew; None where no cut is free."""
    both, of_b = np.concatenate([a, b]), np.repeat([False, True], [len(a), len(b)])
    order = np.argsort(t[both], kind="stable")
    both, of_b = both[order], of_b[order]
    moved = (len(a) + np.cumsum(np.where(of_b, 1, -1)))[:-1]
    pause = t[both][1:] - np.maximum.accumulate(e[both])[:-1]
    free = np.flatnonzero(pause >= 0)
    if not len(free):
        return None
    k = free[np.lexsort((free, -pause[free], moved[free]))[0]] + 1
    return both[:k], both[k:]


def split_cluster(sent: np.ndarray, t: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The sentence of each token after overlapping neighbours are cut apart, earliest pair first, until none is left that can be.

    As many cuts are made as there are tokens at most. Tokens stand in the order of their sentences' lists.
    """
    names = list(dict.fromkeys(sent.tolist()))
    line = [(t[p].min(), name, p) for name in names for p in [np.flatnonzero(sent == name)]]
    line.sort(key=lambda s: (s[0], s[1]))
    left, i = len(t), 0
    while i + 1 < len(line):
        (_, x, a), (b_start, y, b) = line[i], line[i + 1]
        halves = _cut(a, b, t, e) if left and e[a].max() > b_start else None
        if halves is None:
            i += 1
            continue
        line[i : i + 2] = [(t[p].min(), name, p) for name, p in zip((x, y), halves)]
        line[i:] = sorted(line[i:], key=lambda s: s[0])
        left -= 1
    out = sent.copy()
    for _, name, places in line:
        out[places] = name
    return out


def split_at_seams(tokens: DataFrame, key: str) -> DataFrame:
    """tokens (key, sent, token, t, e) with sent_after: sentences that overlap cut apart (split_cluster).

    Sentences are clustered by their running end, in one window; those that overlap nothing stay on the JVM.
    """
    end = F.coalesce("e", "t")
    bounds = tokens.groupBy(key, "sent").agg(F.min("t").alias("start"), F.max(end).alias("end"))
    w = Window.partitionBy(key).orderBy("start", "sent")
    reached = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    clusters = bounds.withColumn("opens", F.when(reached.isNull() | (F.col("start") >= reached), 1).otherwise(0)).withColumn("cluster", F.sum("opens").over(w))
    clusters = clusters.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key, "cluster"))).select(key, "sent", "cluster", "n")
    joined = tokens.join(clusters, [key, "sent"])

    order = [key, "sent", *[c for c in tokens.columns if c not in (key, "sent")]]

    def split(part: list[tuple]) -> list[tuple]:
        sent, t = (np.array([r[i] for r in part]) for i in (1, order.index("t")))
        ends = np.array([r[order.index("t")] if r[order.index("e")] is None else r[order.index("e")] for r in part], float)
        return [(*r[: len(order)], x) for r, x in zip(part, split_cluster(sent, t, ends).tolist())]

    alone = joined.where("n = 1").select(*tokens.columns, F.col("sent").alias("sent_after"))
    kind = ", ".join(f"{c} {k}" for c, k in [*[(c, dict(tokens.dtypes)[c]) for c in order], ("sent_after", dict(tokens.dtypes)["sent"])])
    cut = each_group(joined.where("n > 1").select(*order, "cluster"), [key, "cluster"], ["sent", "token"], split, kind)
    return alone.unionByName(cut)


def reread(tokens: DataFrame, bounds: DataFrame, decode: Callable[[DataFrame, int], DataFrame], key: str, gap: float, least: float = 0, depth: int = 3) -> DataFrame:
    """tokens with what decode finds in their gaps, and level: 0 for tokens, else the depth of the gap.

    tokens: (key, t, e), bounds: (key, hi), the end of each recording. A gap runs from a token's end over more than `gap` to
    the next token, or to the end. decode(gaps, level) gives (key, lo, hi, t, e) for gaps (key, lo, hi); gaps inside
    what it finds are read in turn, `depth` deep; what lies before the first token of a reading is not a gap.
    """
    level, found = tokens.select(key, F.lit(-1.0).alias("lo"), "t", "e").join(bounds.select(key, F.col("hi").cast("double").alias("hi")), key), []
    for k in range(depth + 1):
        found.append(level.select(key, "t", "e", F.lit(k).alias("level")))
        if k == depth:
            break
        w = Window.partitionBy(key, "lo", "hi").orderBy("t", "e")
        gaps = level.select(key, F.col("e").cast("double").alias("from"), F.coalesce(F.lead("t").over(w).cast("double"), "hi").alias("to"))
        gaps = gaps.where((F.col("to") - F.col("from") > gap) & (F.col("to") - F.col("from") >= least))
        level = decode(gaps.select(key, F.col("from").alias("lo"), F.col("to").alias("hi")), k + 1).select(key, "lo", "hi", "t", "e")
    return reduce(DataFrame.unionByName, found)
