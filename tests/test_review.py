"""Kernels of the review queries against brute force and by their properties."""

import random
from itertools import combinations
from os.path import commonprefix

from loomline.operators import kernels as K
from loomline.plans import queries_review as R


def longest_common(x, y):
    """By all subsequences of x, longest first."""
    def within(s):
        rest = iter(y)
        return all(w in rest for w in s)

    return next(n for n in range(len(x), -1, -1) if any(within(s) for s in combinations(x, n)))


def test_differing_leaves_out_as_few_as_can_be(spark):
    dice = random.Random(3)
    rows = [(k, dice.choices("abc", k=dice.randrange(7)), dice.choices("abc", k=dice.randrange(7))) for k in range(60)]
    given = {k: (a, b) for k, a, b in rows}
    for r in K.differing(spark.createDataFrame(rows, "id long, a array<string>, b array<string>"), "a", "b").collect():
        a, b = given[r.id]
        kept_a = [w for i, w in enumerate(a) if i not in r.only_a]
        assert kept_a == [w for i, w in enumerate(b) if i not in r.only_b] and len(kept_a) == longest_common(a, b)


def test_repeats_are_the_pairs_of_equal_runs_taken_in_order():
    dice = random.Random(5)
    for _ in range(300):
        words = dice.choices("ab", k=dice.randrange(24))
        times = sorted(dice.uniform(0, 8) for _ in words)
        pairs = [(i, j) for i, j in combinations(range(len(words)), 2) if words[i : min(i + 3, j)] == words[j : j + 3] and j - i >= 3 and times[j] - times[i] <= 4]
        expected, used, said = [], set(), set()
        for i, j in sorted(pairs):
            unused = next((k for k in range(j, len(words)) if k in used), len(words))
            size = len(commonprefix([words[i:j], words[j:unused]]))
            if i not in said and size >= 3:
                said.add(i)
                used |= set(range(j, j + size))
                expected.append((j, size))
        assert K.repeats(words, times, 4) == expected


def test_clips_keep_all_speech_and_fit():
    dice = random.Random(7)
    for _ in range(200):
        edges = sorted(dice.sample(range(400), 8))
        spans = [(float(a), float(b)) for a, b in zip(edges[::2], edges[1::2])]
        frames = sorted((float(t), dice.random()) for t in dice.sample(range(400), dice.choice([0, 5, 200])))
        clips = K.clips(spans, frames, 30.0)
        assert all(0 < b - a <= 30.0 + 1e-9 for a, b in clips) and all(a[1] <= b[0] for a, b in zip(clips, clips[1:]))
        assert all(sum(max(0.0, min(b, d) - max(a, c)) for c, d in clips) >= b - a - 1e-6 for a, b in spans)
    assert K.clips([(0.0, 50.0)], [(16.0, 0.5), (20.0, 0.1), (29.0, 0.4)], 30.0) == [(0.0, 20.0), (20.0, 50.0)]
    assert K.clips([(0.0, 10.0), (12.0, 25.0), (40.0, 100.0)], [], 30.0) == [(0.0, 25.0), (40.0, 70.0), (70.0, 100.0)]


def test_clips_of_turns_cover_them(spark):
    sf = "/root/testdata/sf0.001"
    got = R.k7(spark, sf).toPandas()
    assert len(got) and ((got.end_ms - got.start_ms) <= 720 * 60_000 + 1e-3).all()
    users = {r.user_id for r in R.points(spark, sf).select("user_id").distinct().collect()}
    assert set(got.user_id) == users
    assert R.w14(spark, sf).columns == ["doc_id", "pos", "place", "size"] and R.f12(spark, sf).count() > 0
