"""Cues, marks and echoes against what the definitions say, one row after the other."""

import random

from pyspark.sql import functions as F

from loomline.operators import cues as C, kernels as K, review as R
from loomline.plans import queries_chunks as Q


def plain_timeline(rows):
    out, group = [], []
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    for i, r in enumerate(rows):
        group.append(r)
        start, end = group[0][1], max(x[2] for x in group)
        if i + 1 < len(rows):
            end = min(end, rows[i + 1][1])
            if end <= start:
                continue
        out.append((start, max(end, start), len(group), group[0][0]))
        group = []
    return out


def test_cues_carry_what_would_last_no_time(spark):
    r = random.Random(1)
    recs = [[(i, a, a + r.choice([0, 0, 1, 4])) for i, a in enumerate(sorted(r.choices(range(9), k=r.randrange(1, 9))))] for _ in range(200)]
    df = spark.createDataFrame([(k, *row) for k, rec in enumerate(recs) for row in rec], "k long, sent long, start long, end long")
    got = {}
    for x in C.one_timeline(df, "k").collect():
        got.setdefault(x.k, []).append((x.start, x.end, x.n, x.first))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(plain_timeline(rec)) for k, rec in enumerate(recs)}


def plain_split(tokens, chars, longest):
    pieces = []
    for w, t, e in tokens:
        if pieces and w[:1] == " " and (len(("".join(x[0] for x in pieces[-1]) + w).strip()) > chars or e - pieces[-1][0][1] > longest):
            pieces.append([(w, t, e)])
        elif pieces:
            pieces[-1].append((w, t, e))
        else:
            pieces = [[(w, t, e)]]
    out = []
    for i, p in enumerate(pieces):
        end = max(p[0][1], *(x[2] for x in p)) if len(p) > 0 else 0
        out.append((i, p[0][1], min(end, pieces[i + 1][0][1]) if i + 1 < len(pieces) else end, "".join(x[0] for x in p).strip()))
    return out


def test_pieces_fit_and_words_stay_whole(spark):
    r = random.Random(2)
    cues = []
    for k in range(120):
        t, tokens = 0, []
        for i in range(r.randrange(1, 14)):
            word = r.choice([" a", " word", "'s", ",", " " + "x" * 14, " ok"]) if i else r.choice(["a", " b"])
            tokens.append((word, t, t + r.choice([100, 900, 2500])))
            t += r.choice([100, 1000])
        cues.append((k, tokens))
    df = spark.createDataFrame(cues, "k long, tokens array<struct<w:string,t:long,e:long>>")
    got = {}
    for x in C.split_cues(df, 12, 3000).collect():
        got.setdefault(x.k, []).append((x.piece, x.start, x.end, x.text))
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_split(t, 12, 3000) for k, t in cues}


def plain_marks(frames, budget, gap):
    taken = []
    for f, s in sorted(frames, key=lambda x: (-x[1], x[0])):
        if s > 0 and len(taken) < budget and all(abs(f - x) >= gap for x in taken):
            taken.append(f)
    last = max(f for f, _ in frames)
    taken.sort()
    return [(f, (f + (taken[i + 1] if i + 1 < len(taken) else last)) / 2) for i, f in enumerate(taken)]


def test_marks_settled_by_runs_are_those_of_the_whole(spark):
    r = random.Random(3)
    recs = [[(f, r.choice([0, 0, 1, 2, 3, 9])) for f in sorted(r.sample(range(60), r.randrange(1, 50)))] for _ in range(80)]
    df = spark.createDataFrame([(k, f, s) for k, rec in enumerate(recs) for f, s in rec], "k long, f long, s long")
    for budget, gap in ((100, 4), (3, 2), (2, 10)):
        got = {}
        for x in K.select_marks(df, "k", "f", "s", budget, gap).collect():
            got.setdefault(x.k, []).append((x.f, x.look))
        assert {k: sorted(v) for k, v in got.items()} == {k: m for k, rec in enumerate(recs) if (m := plain_marks(rec, budget, gap))}


def test_echo_rates_count_each_echo_once(spark):
    sf = "/root/testdata/sf0.01"
    _, e = Q.echoed(spark, sf)
    rows = Q.a25(spark, sf).collect()
    assert sum(r.at_seams + r.elsewhere for r in rows) == e.count()
    seam = {}
    for r in e.collect():
        at = any(c * 52_500 - 2_000 <= r.t <= c * 52_500 + 9_500 for c in range(1, 400))
        seam[r.conv_id] = seam.get(r.conv_id, 0) + at
    assert {r.conv_id: r.at_seams for r in rows if r.at_seams} == {k: v for k, v in seam.items() if v}


def test_a_run_of_joined_segments_is_one(spark):
    rows = [(1, s, 10 * s, 10 * s + 9, f, p, s == 2) for s, (f, p) in enumerate([(["a"], None), (["b", "a"], "X"), ([], "Y"), (["c"], None)])]
    df = spark.createDataFrame(rows, "k int, seg int, start int, end int, flags array<string>, speaker string, edited boolean")
    which = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "k int, seg int")
    got = {tuple(r) if not isinstance(r.flags, list) else (r.seg, r.start, r.end, tuple(r.flags), r.speaker, r.edited) for r in R.merge_with_previous(df, which, "k").collect()}
    assert got == {(0, 0, 29, ("a", "b"), "X", True), (3, 30, 39, ("c",), None, False)}
    assert [r.flags for r in R.toggle_flag(df, "a", F.col("seg") < 2).orderBy("seg").collect()] == [[], ["b"], [], ["c"]]


def plain_sentences(tokens, words, silence, longest):
    out, current, sent = [], [], 0
    for i, (t, e, w) in enumerate(tokens):
        current.append((t, e, w))
        out.append(sent)
        nxt = tokens[i + 1] if i + 1 < len(tokens) else None
        ends = any(c in w for c in "!?。？！") or ("." in w and (nxt is None or " " in nxt[2]))
        ends |= words is not None and nxt is not None and sum(" " in x[2] for x in current) + (" " in nxt[2]) > words
        ends |= silence is not None and nxt is not None and nxt[0] - e >= silence
        ends |= longest is not None and e - current[0][0] >= longest
        if ends:
            current, sent = [], sent + 1
    return out


def test_sentences_end_where_the_rules_say(spark):
    r = random.Random(4)
    recs = []
    for _ in range(60):
        t, tokens = 0, []
        for _ in range(r.randrange(1, 30)):
            t += r.choice([100, 100, 900])
            tokens.append((t, t + 80, r.choice([" a", " bc", "d", ".", "!", "。", "3.5", " x."])))
        recs.append(tokens)
    df = spark.createDataFrame([(k, i, *x) for k, rec in enumerate(recs) for i, x in enumerate(rec)], "k long, token long, t long, e long, w string")
    for rules in ((None, None, None), (3, None, None), (None, 500, None), (None, None, 700), (4, 500, 1500)):
        got = {}
        for x in C.sentences_of(df, "k", *rules).collect():
            got.setdefault(x.k, {})[x.token] = x.sent
        assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == {k: plain_sentences(rec, *rules) for k, rec in enumerate(recs)}
