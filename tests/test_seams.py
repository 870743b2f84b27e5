"""Merging, cutting and reading again, against definitions written out over all possibilities."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import seams as S
from loomline.plans import queries_recut as R
from tests.oracle_check import differences


def tokens(text, start=0.0, long=0.5, shift=0.0):
    return [(w, start + i + shift, start + i + shift + long) for i, w in enumerate(text.split())]


def words(out):
    return " ".join(t[0] for t in out)


def test_seams_of_two_readings():
    one = tokens("a b c d e f g h")
    assert words(S.merged(one, tokens("e f g h i j", 4), 4)) == "a b c d e f g h i j"
    assert words(S.merged(one, tokens("q r", 8), 4)) == "a b c d e f g h q r"  # no overlap: one behind the other
    assert S.merged([], one, 4) == one and S.merged(one, [], 4) == one
    assert words(S.merged(one, tokens("x y z", 6), 4)) == "a b c d e f g y z"  # nothing in common: halves at 6.75, ends before, starts after
    far = tokens("e f g h i j", 4, shift=1.9)
    assert words(S.merged(one, far, 4)) == "a b c d e f g h i j"  # near enough
    assert words(S.merged(one, far, 4, tolerance=1.5)) != words(S.merged(one, far, 4))
    # a run of three of seven is enough (half, rounded down); of eight it is not
    a, b = tokens("p a b c q r s", 10), tokens("t a b c u v w x", 10)
    assert words(S.merged(a, b, 20)) == "p a b c u v w x"
    a, b = tokens("p a b c q r s y", 10), tokens("t a b c u r v w z", 10)
    assert words(S.merged(a, b, 20)) == "p a b c q r v w z"  # by subsequence; of one word each a's is kept
    assert words(S.merged(a, tokens("t a b c u uu r v w z", 10), 20)) == "p a b c u uu r v w z"  # b has more between


def test_an_odd_overlap_reaches_as_far_as_the_whole_overlap():
    a = tokens("k l m n o")  # ends at 4.5
    b = tokens("l m n o p q", 3.5)  # starts at 3.5: with an overlap of 3 tokens of a ending after 0.5 count
    assert len([t for t in a if t[2] > b[0][1] - 3]) == 4
    assert words(S.merged(a, b, 6)) == "k l m n o p q"


def all_rising(same):
    n, m = same.shape
    places = [(i, j) for i in range(n) for j in range(m) if same[i, j]]
    for size in range(min(n, m), -1, -1):
        found = [c for c in combinations(places, size) if all(p[0] < q[0] and p[1] < q[1] for p, q in zip(c, c[1:]))]
        if found:
            return size
    return 0


def test_runs_and_subsequences_against_all():
    r = np.random.default_rng(8)
    for _ in range(150):
        same = r.random((r.integers(1, 6), r.integers(1, 6))) < 0.4
        pairs = S.longest_subsequence(same)
        assert all(same[p] for p in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) == all_rising(same)
        runs = [[(i + k, j + k) for k in range(n)] for i in range(same.shape[0]) for j in range(same.shape[1]) for n in range(1, 7)]
        runs = [run for run in runs if run[-1][0] < same.shape[0] and run[-1][1] < same.shape[1] and all(same[p] for p in run)]
        best = max(map(len, runs), default=0)
        assert S.longest_run(same) == next((run for run in runs if len(run) == best), [])


def random_readings(seed):
    r = random.Random(seed)
    out = []
    for c in range(r.randrange(1, 6)):
        t = 10.0 * c - r.random() * 4
        out.append([])
        for _ in range(r.randrange(0, 16)):
            t += r.choice([0.0, 0.5, 1.0])
            out[-1].append((r.choice("abc"), t, t + r.choice([0.1, 0.6, 3.0])))
    return out


def test_a_fold_looks_far_enough_back():
    """Folding what can reach a seam equals folding everything that stands so far."""
    for seed in range(300):
        readings = random_readings(seed)
        whole = []
        for new in readings:
            whole = S.merged(whole, new, 4.0)
        assert S.folded(readings, 4.0) == whole


def test_chunks_are_skipped_and_resumed(spark):
    kind = "k long, begins long, lasts long, word string, at long, until long"
    rows = [(1, 0, 10, w, i, i + 1) for i, w in enumerate("abcdefghij")] + [(1, 8, 10, w, i, i + 1) for i, w in enumerate("ijklmnopqr")] + [(1, 16, 2, "z", 0, 1)]
    chunks = spark.createDataFrame(rows, kind)
    line = lambda df: "".join(r.word for r in df.orderBy("place").collect())
    assert line(S.chunk_loop(chunks, "k", 2)) == "abcdefghijklmnopq"  # one word alone: halves at 17
    assert line(S.chunk_loop(chunks, "k", 2, least=3)) == "abcdefghijklmnopqr"
    banked = S.chunk_loop(chunks.where("begins < 8"), "k", 2)
    marks = spark.createDataFrame([(1, 8)], "k long, next_start long")
    assert line(S.chunk_loop(chunks, "k", 2, 3, banked, marks)) == "abcdefghijklmnopqr"
    assert line(S.chunk_loop(chunks, "k", 2, 3, None, marks)) == "ijklmnopqr"


def test_the_loop_and_its_resumption_over_the_table(spark):
    sf = "/root/testdata/sf0.01"
    whole = {r.conv_id: (r.n, r.digest) for r in R.k2(spark, sf).collect()}
    assert {r.conv_id: (r.n, r.digest) for r in R.s16r(spark, sf).collect()} == whole
    rows = R.readings(spark, sf).where(F.col("lasts") >= R.LEAST).orderBy("conv_id", "chunk", "i").collect()
    plain = {}
    for r in rows:
        plain.setdefault(r.conv_id, {}).setdefault(r.chunk, []).append((r.word, float(r.begins + r["at"]), float(r.begins + r.until)))
    for conv, readings in plain.items():
        out = []
        for new in readings.values():
            out = S.merged(out, new, R.OVERLAP)
        assert whole[conv][0] == len(out)
    heard = {r.conv_id: r.n for r in R.readings(spark, sf).groupBy("conv_id").agg(F.countDistinct("i").alias("n")).collect()}
    assert all(abs(n - heard[c]) <= 0.02 * heard[c] + 3 for c, (n, _) in whole.items())  # next to nothing lost or doubled


def test_steps_back_at_each_tolerance(spark):
    sf = "/root/testdata/sf0.001"
    rows = R.j25(spark, sf).collect()
    plain = {}
    for r in R.readings(spark, sf).orderBy("conv_id", "chunk", "i").collect():
        plain.setdefault(r.conv_id, {}).setdefault(r.chunk, []).append((r.word, float(r.begins + r["at"]), float(r.begins + r.until)))
    assert len(rows) == 7 * len(plain)
    for r in rows:
        out = []
        for new in plain[r.conv_id].values():
            out = S.merged(out, new, R.OVERLAP, r.tolerance)
        steps = [b[1] - a[1] for a, b in zip(out, out[1:])]
        assert (r.n, r.backwards, r.furthest) == (len(out), sum(s < 0 for s in steps), max([0.0, *(-s for s in steps)]))
    by = {t: sum(r.backwards for r in rows if r.tolerance == t) for t in {r.tolerance for r in rows}}
    assert by[min(by)] <= by[max(by)]


def all_cuts(a, b):
    """(moved, -pause, cut) of the best free cut of two sentences' (t, e), or None."""
    line = sorted([(*x, False) for x in a] + [(*x, True) for x in b], key=lambda x: (x[0], x[2]))
    free = []
    for k in range(1, len(line)):
        pause = line[k][0] - max(e for _, e, _ in line[:k])
        if pause >= 0:
            free.append((sum(of_b for *_, of_b in line[:k]) + sum(not of_b for *_, of_b in line[k:]), -pause, k))
    return min(free, default=None)


def random_sentences(r, n):
    out, t = [], 0
    for _ in range(n):
        out.append([])
        for _ in range(r.randrange(1, 5)):
            t += r.randrange(0, 4)
            early = r.choice([0, 0, 0, 5, 9])
            out[-1].append((max(t - early, 0), max(t - early, 0) + r.randrange(0, 3)))
    return out


def test_cuts_of_pairs_against_all(spark):
    r = random.Random(3)
    pairs = [random_sentences(r, 2) for _ in range(150)]
    rows = [(k, side == 1, 10 * side + i, t, e if e != t or i % 2 else None) for k, p in enumerate(pairs) for side in (0, 1) for i, (t, e) in enumerate(p[side])]
    got = {x.k: (x.moved, -x.pause, x.cut) for x in S.cheapest_cuts(spark.createDataFrame(rows, "k long, of_b boolean, token long, t long, e long"), ["k"]).collect()}
    assert got == {k: best for k, p in enumerate(pairs) if (best := all_cuts(*p))}


def cascade(sentences):
    """The definition on plain lists: the earliest overlapping pair is cut, the rest put in order again."""
    line = sorted(((min(t for t, _ in s), k, s) for k, s in enumerate(sentences)), key=lambda x: (x[0], x[1]))
    budget, i = sum(map(len, sentences)), 0
    while i + 1 < len(line):
        (_, x, a), (start, y, b) = line[i], line[i + 1]
        best = all_cuts(a, b) if budget and max(e for _, e in a) > start else None
        if best is None:
            i += 1
            continue
        both = [p for _, p in sorted([(p, p) for p in a] + [(p, p) for p in b], key=lambda q: q[0][0])]
        for at, (name, part) in enumerate([(x, both[: best[2]]), (y, both[best[2] :])]):
            line[i + at] = (min(t for t, _ in part), name, part)
        line[i:] = sorted(line[i:], key=lambda s: s[0])
        budget -= 1
    return {name: sorted(part) for _, name, part in line}, [part for *_, part in line]


def test_cascades_equal_the_definition_and_keep_every_token(spark):
    r = random.Random(4)
    recs = [random_sentences(r, r.randrange(1, 9)) for _ in range(120)]
    rows = [(k, s, 100 * s + i, t, e) for k, rec in enumerate(recs) for s, sent in enumerate(rec) for i, (t, e) in enumerate(sent)]
    got = S.split_at_seams(spark.createDataFrame(rows, "k long, sent long, token long, t long, e long"), "k").collect()
    assert sorted((x.k, x.token, x.t, x.e) for x in got) == sorted((k, token, t, e) for k, _, token, t, e in rows)
    for k, rec in enumerate(recs):
        mine = {}
        for x in got:
            if x.k == k:
                mine.setdefault(x.sent_after, []).append((x.t, x.e))
        want, line = cascade(rec)
        assert {s: sorted(p) for s, p in mine.items()} == want
        assert set(mine) == set(range(len(rec)))  # no sentence disappears
        for a, b in zip(line, line[1:]):
            assert max(e for _, e in a) <= min(t for t, _ in b) or all_cuts(a, b) is None


def test_cutting_ends_and_moves_few_over_the_table(spark):
    sf = "/root/testdata/sf0.01"
    before = R.spoken(spark, sf).count()
    after = R.k12(spark, sf).collect()
    assert sum(x.n for x in after) == before and 0 < sum(x.moved for x in after) < 0.5 * before


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_gaps_are_read_again_as_deep_as_told(spark, depth):
    hidden = {1: [(5, 6), (30, 31)], 2: [(12, 13)], 3: [(20, 21)]}  # what a reading of each level hears

    def decode(gaps, level):
        rows = [(1, float(t), float(e)) for t, e in hidden[level]]
        return gaps.join(spark.createDataFrame(rows, "k long, t double, e double"), "k").where("t >= lo AND t < hi")

    first = spark.createDataFrame([(1, 0.0, 1.0), (1, 40.0, 41.0)], "k long, t double, e double")
    bounds = spark.createDataFrame([(1, 43.0)], "k long, hi double")
    got = sorted((x.t, x.level) for x in S.reread(first, bounds, decode, "k", 4.0, depth=depth).collect())
    every = [(0.0, 0), (5.0, 1), (12.0, 2), (20.0, 3), (30.0, 1), (40.0, 0)]
    assert got == [x for x in every if x[1] <= depth]


@pytest.mark.parametrize("name", ["k3_merge_contiguous", "k4_merge_lcs"])
def test_odd_turns_are_read_as_the_sql_reads_them(spark, tmp_path, name):
    """Turns without text or number, vertical tabs inside words, words that differ by a last zero."""
    text = lambda k: " ".join(f"w{(k * 7 + i) % 23}" for i in range(90))
    rows = [(1, 0, text(0)), (1, 1, None), (1, 2, text(2)), (2, None, text(1)), (2, 4, text(4)), (2, 3, text(3)), (3, 0, text(5).replace(" w1 ", "\v")), (3, 1, text(6)), (4, 0, None)]
    rows += [(5, 0, " ".join(f"a{i % 3}" + "\0" * (i % 2) for i in range(200)))]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").coalesce(1).write.parquet(f"{tmp_path}/made")
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "conversations.parquet")
    only, n = differences(spark, R.Q[name], R.O[name], tmp_path)
    assert only == [] and n > 4
