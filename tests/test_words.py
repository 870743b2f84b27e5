"""Keys, alignments, blocks, regions and what a reviewer looks at, against definitions and a library."""

import difflib
import itertools
import random
from collections import deque

import numpy as np
from pyspark.sql import functions as F

from loomline.catalog import QUERIES as Q
from loomline.operators import grids as G, kernels, matching as M, review as R
from loomline.plans import queries_words as P


def keys(spark, words):
    rows = M.with_key(spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()
    return {r.w: r.key for r in rows}


def test_keys_of_latin_words_and_of_words_in_arabic_letters(spark):
    want = {
        "nation": "nSn", "night": "nGt", "edge": "aj", "phone": "fnE", "quick": "kk", "box": "bks", "aam": "am", "city": "stI", "cool": "kl", "kitty": "ktI", "hello": "hlO", "wo": "wO",
        "yeh": "yE", "a": "a", "see": "sE", "chai": "CE", "match": "mtC", "": "_", "x2y": "ks2I",
        # letters by table: kaf alif, shin, final heh behind a consonant, ain, yeh at the start
        "کار": "kr", "شور": "Sr", "کہ": "k*", "یہ": "y*", "شروع": "SrO", "عام": "am", "خدا": "XdA", "چائے": "CE", "موقع": "mk*", "ہے": "hE", "غم": "Gm",
    }
    got = keys(spark, want)
    assert got == want


def test_near_keys_in_both_forms(spark):
    pairs = [("ktb", "ktb"), ("k*", "kE"), ("k*", "kA"), ("k*", "kt"), ("ktbn", "ktbm"), ("ktb", "ktm"), ("ktbnA", "ktnA"), ("ktbnA", "tbnAx"), ("A", "*"), ("S*", "SrO"), ("aaaa", "aaaab"), ("abcd", "abdc")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", M.near_keys(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r.n for r in df] == [M.near(a, b) for a, b in pairs] == [True, True, True, False, True, False, True, False, False, False, True, False]
    r = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(r.choices("abc", k=r.randrange(5))) for _ in range(2))
        want = a == b or any(b in (a[:i] + a[i + 1 :], a[:i] + c + a[i:], a[:i] + c + a[i + 1 :]) for i in range(len(a) + 1) for c in "abc")
        assert M.one_edit(a, b) == want


def cost(same):
    n, m = same.shape
    if not n or not m:
        return n + m
    return min(cost(same[1:, 1:]) + (not same[0, 0]), cost(same[1:]) + 1, cost(same[:, 1:]) + 1)


def test_alignments_cost_the_least(spark):
    r = np.random.default_rng(2)
    for _ in range(120):
        same = r.random((r.integers(0, 6), r.integers(0, 6))) < 0.3
        pairs = M.edit_pairs(same)
        assert [i for i, _ in pairs if i is not None] == list(range(same.shape[0])) and [j for _, j in pairs if j is not None] == list(range(same.shape[1]))
        assert sum(i is None or j is None or not same[i, j] for i, j in pairs) == cost(same)


def test_the_second_pass_keeps_equal_keys_and_forgives_near_ones(spark):
    h, r = ["abcd", "xxxx", "k*", "same", "zz"], ["abcd", "xxxy", "kE", "same", "qq", "ww"]
    assert M.aligned(h, r) == [(0, 0), (1, 1), (2, 2), (3, 3), (None, 4), (4, 5)] or M.aligned(h, r) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (None, 5)]
    rows = spark.createDataFrame([(1, h, r), (2, [], r), (3, h, []), (4, [], [])], "i int, h array<string>, r array<string>")
    got = {x.i: (x.substituted, x.missed, x.inserted, sum(p.ok for p in x.pairs)) for x in M.with_errors(rows, "h", "r", True).collect()}
    assert got == {1: (1, 1, 0, 4), 2: (0, 6, 0, 0), 3: (0, 0, 5, 0), 4: (0, 0, 0, 0)}
    strict = {x.i: (x.substituted, x.missed, x.inserted) for x in M.with_errors(rows, "h", "r", False).collect()}
    assert strict[1] == (3, 1, 0)
    dice = random.Random(3)
    for _ in range(200):
        h, r = (dice.choices(["abcd", "abce", "k*", "kA", "zz"], k=dice.randrange(8)) for _ in range(2))
        pairs = M.aligned(h, r)
        assert [i for i, _ in pairs if i is not None] == list(range(len(h))) and [j for _, j in pairs if j is not None] == list(range(len(r)))
        errors = sum(i is None or j is None or not M.near(h[i], r[j]) for i, j in pairs)
        assert errors <= cost(np.array([[a == b for b in r] for a in h], bool).reshape(len(h), len(r)))


def test_blocks_are_those_of_the_library():
    dice = random.Random(4)
    for n in (0, 3, 12, 40):
        for _ in range(120):
            a, b = (dice.choices("abcde"[: dice.randrange(1, 6)], k=dice.randrange(n + 1)) for _ in range(2))
            want = [tuple(m) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
            assert M.blocks(a, b) == want


def flood(mask):
    seen, best = np.zeros_like(mask), 0
    for start in zip(*np.nonzero(mask)):
        size, queue = 0, deque([start] if not seen[start] else [])
        seen[start] = True
        while queue:
            y, x = queue.popleft()
            size += 1
            for p in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and not seen[p]:
                    seen[p] = True
                    queue.append(p)
        best = max(best, size)
    return best


def test_regions_equal_flood_fill(spark):
    r = np.random.default_rng(5)
    for shape in ((1, 1), (1, 9), (5, 7), (20, 31)):
        masks = r.random((60, *shape)) < r.random((60, 1, 1))
        assert G.largest_regions(masks).tolist() == [flood(m) for m in masks]
    snake = np.zeros((1, 41, 41), bool)
    snake[0, ::2] = True
    snake[0, 1::4, -1] = snake[0, 3::4, 0] = True
    assert G.largest_regions(snake).tolist() == [int(snake.sum())]


def test_marks_leave_noise_out_unless_all_is_noise(spark):
    still = [0] * 12
    frames = [list(still) for _ in range(11)]
    for k, f in enumerate(frames):
        f[0] = 100 * (k % 2)  # flickers all the time
        f[4:8] = [50 if k >= 6 else 0] * 4
    df = spark.createDataFrame([(1, k, f) for k, f in enumerate(frames)], "rec int, k int, tiles array<int>")
    got = {r.k: (r.size, r.mark) for r in G.frames_with_change(df, "rec", "k", "tiles", 3, 4, 10, 0.8, 4).collect()}
    assert got == {k: (4, True) if k == 6 else (0, False) for k in range(1, 11)}
    noisy = spark.createDataFrame([(1, k, [9 * (k % 2)] * 12) for k in range(5)], "rec int, k int, tiles array<int>")
    assert {r.size for r in G.frames_with_change(noisy, "rec", "k", "tiles", 3, 4, 1, 0.8, 4).collect()} == {12}  # nothing is left out


def test_words_within_edits_against_all_pairs(spark):
    dice = random.Random(6)
    words, entries = ({"".join(dice.choices("abc", k=dice.randrange(1, 9))) for _ in range(90)} for _ in range(2))
    w, e = spark.createDataFrame([(x,) for x in words], "word string"), spark.createDataFrame([(x,) for x in entries], "entry string")
    for limit in (1, 2):
        want = {(r.word, r.entry, r.d) for r in w.crossJoin(e).withColumn("d", F.levenshtein("word", "entry")).where(F.col("d") <= limit).collect()}
        assert {tuple(r) for r in R.within_edits(w, e, limit).collect()} == want and want
    long = "x" * 3000
    assert R.within_edits(spark.createDataFrame([(long + "a",)], "word string"), spark.createDataFrame([("b" + long,)], "entry string"), 2).count() == 1


def test_candidates_take_the_first_spelling_in_place(spark):
    words = spark.createDataFrame([("grandkitten",), ("kittens",), ("mittenly",), ("kitten",), ("cat",), ("bats",)], "word string")
    entries = spark.createDataFrame([("kitten", 2), ("mitten", 1), ("cats", 0)], "entry string, place int")
    assert {tuple(r) for r in R.candidates(words, entries).collect()} == {("grandkitten", "kitten", "contains"), ("kittens", "kitten", "contains"), ("mittenly", "mitten", "contains"), ("bats", "cats", "edit")}


def test_words_of_another_reading_go_to_spans(spark):
    spans = spark.createDataFrame([(1, 0, 1000, 2000, "eins", 0.9), (1, 1, 5000, 6000, "zwei drei", 0.9), (2, 0, 0, 10, "", None)], "k int, seg int, start int, end int, text string, least double")
    at = [(500, 0), (10, 0), (-300, None), (1500, 0), (2000, 0), (3400, 0), (3500, 0), (3600, 1), (5999, 1), (6000, 1), (6900, 1), (7200, None)]
    words = spark.createDataFrame([(1, i, m, m, "x") for i, (m, _) in enumerate(at)], "k int, word int, start int, end int, text string")
    assert {r.word: r.seg for r in R.opinion_words(words, spans, "k").collect()} == {i: s for i, (_, s) in enumerate(at)}


def test_each_signal_marks_on_its_own(spark):
    spans = spark.createDataFrame([(1, s, 1000 * s, 1000 * s + 900, t, c) for s, (t, c) in enumerate([("same here", 0.9), ("flagged one", None), ("own word", 0.9), ("not sure", 0.1), ("only mine", 0.9), ("شور", 0.9), ("...", 0.9)])],
                                  "k int, seg int, start int, end int, text string, least double")
    heard = {0: "Same, here", 1: "flagged one", 2: "other word", 3: "not sure", 4: "", 5: "noise", 6: ""}
    words = spark.createDataFrame([(1, 10 * s + i, 1000 * s + 100 * i, 1000 * s + 100 * i + 50, w) for s, t in heard.items() for i, w in enumerate(t.split())], "k int, word int, start int, end int, text string")
    opinions = R.disagreements(spans, words, "k")
    assert {r.seg: r.disagrees for r in opinions.collect()} == {0: False, 1: False, 2: True, 3: False, 4: True, 5: False, 6: False}
    flags = spark.createDataFrame([(1, 1), (1, 1)], "k int, seg int")
    assert {tuple(r) for r in R.likely_errors(spans, flags, opinions, 0.3, "k").collect()} == {(1, 1, True, False, False), (1, 2, False, True, False), (1, 3, False, False, True), (1, 4, False, True, False)}
    assert {r.seg for r in R.likely_errors(spans, flags, opinions, None, "k").collect()} == {1, 2, 4}


def test_scores_over_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = P.a14(spark, sf).collect()
    assert rows and all(r.keyed_errors <= r.strict_errors + 1 for r in rows) and sum(r.keyed_errors for r in rows) < sum(r.strict_errors for r in rows)
    table = P.a15(spark, sf).collect()
    assert {r.script for r in table} >= {"other"} and sum(r.n for r in table) == sum(len(r.reference) for r in P.heard(spark, sf).collect())
    gain = P.a34(spark, sf).collect()
    assert all(r.wer_after <= r.wer_before + 0.35 for r in gain) and sum(r.n_right for r in gain) > 0.7 * sum(r.n_new for r in gain) > 0
    h = {(r.conv_id, r.turn): r for r in P.heard(spark, sf).collect()}
    for r in P.f11(spark, sf).collect():
        x = h[r.conv_id, r.turn]
        assert r.matched == sum(m.size for m in difflib.SequenceMatcher(None, x.reference, x.heard, autojunk=False).get_matching_blocks())


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hash")


def test_lines_are_settled_by_row(spark):
    dice = random.Random(8)
    lists = [dice.choices("abc"[: dice.randrange(1, 4)], k=dice.randrange(1, 14)) for _ in range(3000)]

    def phrase(x):
        p, i, run, best = x[:2], 0, 0, 0
        while i + len(p) <= len(x):
            run, i = (run + 1, i + len(p)) if x[i : i + len(p)] == p else (0, i + 1)
            best = max(best, run)
        return best

    got = kernels.repeats(spark.createDataFrame(list(enumerate(lists)), "i int, words array<string>"), "words")
    assert {r.i: (r.longest, r.phrase) for r in got.collect()} == {i: (max(len(list(g)) for _, g in itertools.groupby(x)), phrase(x)) for i, x in enumerate(lists)}
    rows = spark.createDataFrame([(1, [" ab", "\tabcd", "x"]), (2, []), (3, ["\U0001f600éàb  c"]), (4, None)], "i int, words array<string>")
    assert [tuple(r) for r in kernels.token_words(rows, "words", 3).collect()] == [(1, 1, 1, 0, " ab"), (1, 2, 2, 1, "\tabcd"), (1, 3, 1, 3, "x"), (3, 1, 3, 0, "\U0001f600éàb  c")]
    sf = "/root/testdata/sf0.001"
    assert not any(shuffles(Q[n](spark, sf)) for n in ("w5_words_from_tokens", "w15_repeats", "f11_blocks"))


def test_near_spellings_shuffle_no_parts(spark):
    w = spark.createDataFrame([("kitten",), ("mitten",), ("aaaaaaaa",)], "word string")
    e = F.broadcast(spark.createDataFrame([("sitten",), ("aaaaaaab",)], "entry string"))
    near = R.within_edits(w, e, 2)
    assert shuffles(near) == 1  # of what is near
    assert {tuple(r) for r in near.collect()} == {("kitten", "sitten", 1), ("mitten", "sitten", 1), ("aaaaaaaa", "aaaaaaab", 1)}


def test_lopsided_words_of_ids_that_repeat(spark, tmp_path):
    docs = [(i, f"poison poison\nother{i}") for i in (1, 2, 2, 3)] + [(5, "venom"), (6, "venom"), (6, "venom")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in (1, 2, 3, 5, 6)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [tuple(r) for r in Q["a20_lopsided"](spark, str(tmp_path)).collect()] == [("poison", 3, 3)]
