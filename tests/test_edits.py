"""Edit lists against plain lists, changed entry by entry."""

import random

from pyspark.sql import functions as F

from loomline.operators import edits as E
from loomline.plans import queries_edits as P

KIND = E.LIST


def mark(speaker, language=None):
    return ("paragraph", speaker, language, None, None, None, None, None, None)


def item(start, length, text, muted=False, c=None, source="0"):
    return ("item", None, None, source, start, length, text, muted, c)


def random_list(r, n=14):
    out, t = [mark("A")], 0
    for _ in range(n):
        if r.random() < 0.25:
            out.append(mark(r.choice(["A", "B", None]), r.choice(["en", None])))
        gap = r.choice([0, 0, 40, 300])
        if gap:
            out.append(item(t, gap, "", r.random() < 0.3))
        t += gap
        length = r.choice([0, 50, 200])
        out.append(item(t, length, r.choice("xyz"), False, r.choice([None, 0.5, 1.0])))
        t += length
    return out


def table(spark, lists):
    return spark.createDataFrame([(d, i, *e) for d, entries in enumerate(lists) for i, e in enumerate(entries)], KIND)


def plain(df):
    out = {}
    for r in df.select("doc", "pos", *E.FIELDS).orderBy("doc", "pos").collect():
        assert r.pos == len(out.setdefault(r.doc, []))  # positions without gaps
        out[r.doc].append(tuple(r)[2:])
    return out


def test_changes_by_position(spark):
    r = random.Random(1)
    lists = [random_list(r) for _ in range(40)]
    ranges = []
    for d, x in enumerate(lists):
        a, b = sorted(r.choices(range(len(x) + 1), k=2))
        ranges.append((d, a, b + (100 if d % 9 == 0 else 0), r.randrange(-1, len(x) + 2)))
    t, rg = table(spark, lists), spark.createDataFrame(ranges, "doc long, start long, stop long, to long")
    muted, gone, moved = plain(E.mute(t, rg)), plain(E.delete(t, rg)), plain(E.move(t, rg))
    assert {x.doc for x in E.refused_ranges(t, rg).collect()} == {d for d, a, b, _ in ranges if b > len(lists[d])}
    for d, a, b, to in ranges:
        x = lists[d]
        fits = b <= len(x)
        assert muted.get(d, []) == ([(*e[:7], True, e[8]) if a <= i < b and e[0] == "item" else e for i, e in enumerate(x)] if fits else x)
        assert gone.get(d, []) == (x[:a] + x[b:] if fits else x)
        if fits and (to <= a or to >= b) and 0 <= to <= len(x):
            rest = x[:a] + x[b:]
            at = to if to <= a else to - (b - a)
            assert moved[d] == rest[:at] + x[a:b] + rest[at:]
        else:
            assert moved[d] == x
    put = [(d, k, *item(9, 9, f"n{k}")) for d in range(40) for k in range(d % 4)]
    spliced = plain(E.splice(t, rg, spark.createDataFrame(put, f"doc long, at long, {E.ENTRY}")))
    for d, a, b, _ in ranges:
        new = [item(9, 9, f"n{k}") for k in range(d % 4)]
        assert spliced.get(d, []) == (lists[d][:a] + new + lists[d][b:] if b <= len(lists[d]) else lists[d])


class Plain:
    """The log run with whole copies: undo puts the copy from before the step back."""

    def __init__(self, content, limit):
        self.c, self.limit, self.past, self.future, self.opened, self.refused = list(content), limit, [], [], None, []

    def run(self, seq, kind, entries, muted, start, stop, put):
        before = list(self.c)
        if kind in ("undo", "redo", "begin", "end"):
            if kind == "begin":
                self.opened = self.opened or [before, 0]
                return
            if self.opened:
                was, n = self.opened
                self.opened = None
                if n:
                    self.past, self.future = [*self.past, (was, list(self.c))][-self.limit :], []
            if kind == "undo" and self.past:
                self.future.append(self.past.pop())
                self.c = list(self.future[-1][0])
            if kind == "redo" and self.future:
                self.past.append(self.future.pop())
                self.c = list(self.past[-1][1])
            return
        if kind in ("mute", "flag", "dismiss"):
            if any(i >= len(self.c) for i in entries):
                return self.refused.append(seq)
            for k, i in enumerate(entries):
                to = {"flag": True, "dismiss": False}.get(kind, muted[k] if k < len(muted) else True)
                if self.c[i][0] == "item":
                    self.c[i] = (*self.c[i][:7], to, self.c[i][8])
        elif kind in ("correct", "retime", "speaker") and start <= stop <= len(self.c):
            self.c[start:stop] = put
        else:
            return self.refused.append(seq)
        if self.opened:
            self.opened[1] += 1
        else:
            self.past, self.future = [*self.past, (before, list(self.c))][-self.limit :], []


def test_a_log_folds_as_copies_do_and_undo_restores_every_prefix(spark):
    r = random.Random(2)
    lists = [random_list(r) for _ in range(30)]
    logs = {}
    for d in range(30):
        logs[d] = []
        for seq in range(60):
            kind = r.choices(["mute", "flag", "dismiss", "correct", "retime", "speaker", "undo", "redo", "begin", "end", "other"], [4, 1, 1, 3, 2, 2, 5, 3, 1, 1, 0.5])[0]
            a = r.randrange(0, 26)
            put = [r.choice([mark("N"), item(1, 2, "new", False, 1.0)]) for _ in range(r.randrange(3))]
            logs[d].append((seq, kind, r.choices(range(24), k=3), r.choices([True, False], k=r.choice([0, 2, 3])), a, a + r.randrange(0, 3), put))
        logs[d] += [(60 + k, "undo", [], [], 0, 0, []) for k in range(r.choice([0, 70]))]
    log = spark.createDataFrame([(d, *op) for d, ops in logs.items() for op in ops], E.OP).repartition(4)
    for limit in (1000, 3):
        state = E.folded(table(spark, lists), log, limit)
        got, end = plain(E.content(state)), {x.doc: x for x in state.collect()}
        for d, ops in logs.items():
            p = Plain(lists[d], limit)
            for op in ops:
                p.run(*op)
            assert got.get(d, []) == p.c and end[d].refused == p.refused
            assert (end[d].undo_steps, end[d].redo_steps) == (len(p.past), len(p.future))
            if len(ops) > 100 and limit == 1000:
                assert p.c == lists[d] and end[d].undo_label is None and end[d].redo_label is not None


def test_labels_and_lists_without_a_log(spark):
    state = {x.doc: x for x in E.folded(table(spark, [[mark("A"), item(0, 1, "a")], [mark("B")]]), spark.createDataFrame([
        (0, 1, "mute", [1], [True], None, None, None), (0, 2, "begin", None, None, None, None, None), (0, 3, "correct", None, None, 1, 2, [item(0, 1, "b")]),
        (0, 4, "mute", [1], [False], None, None, None), (0, 5, "end", None, None, None, None, None), (0, 6, "mute", [0, 1], [True, False], None, None, None),
        (0, 7, "undo", None, None, None, None, None)], E.OP)).collect()}
    assert (state[0].undo_steps, state[0].undo_label, state[0].redo_label) == (2, "correction", "mute and unmute")
    assert state[1].undo_steps == 0 and [e.kind for e in state[1].content] == ["paragraph"]


def plain_retime(x, a, b, edge, wish):
    words = [i for i, e in enumerate(x) if e[0] == "item" and e[6] != ""]
    mine = [i for i in words if a <= i < b]
    first, last = mine[0], mine[-1]
    before, after = max((i for i in words if i < a), default=None), min((i for i in words if i >= b), default=None)
    lo = before if before is not None else min(i for i, e in enumerate(x) if e[0] == "item")
    hi = after + 1 if after is not None else len(x)
    span = {i: [x[i][4], x[i][4] + x[i][5]] for i in range(lo, hi) if x[i][0] == "item"}
    floor, ceiling = min(s for s, _ in span.values()), max(e for _, e in span.values())
    new = {i: list(span[i]) for i in span if i in words}
    changed = set()
    if edge == "start":
        at = max(min(wish, span[first][1]), span[before][0] if before is not None else floor)
        new[first][0] = at
        changed.add(first)
        if before is not None and span[before][1] > at:
            new[before][1] = at
            changed.add(before)
    else:
        at = max(min(wish, span[after][1] if after is not None else ceiling), span[last][0])
        new[last][1] = at
        changed.add(last)
        if after is not None and span[after][0] < at:
            new[after][0] = at
            changed.add(after)
    out, reached, k = x[:lo], floor, lo
    runs, run = [], []
    for i in range(lo, hi):
        if i in new:
            runs.append((run, i))
            run = []
        else:
            run.append(x[i])
    for others, i in [*runs, (run, None)]:
        start = new[i][0] if i is not None else ceiling
        out += [e for e in others if e[0] == "paragraph"]
        if start > reached + 0.5:
            out.append(item(reached, start - reached, "", any(e[7] for e in others if e[0] == "item")))
        if i is not None:
            out.append(item(new[i][0], new[i][1] - new[i][0], x[i][6], x[i][7], 1.0) if i in changed else x[i])
            reached = max(reached, new[i][1])
    return out + x[hi:]


def test_retiming_equals_the_definition_and_pauses_still_tile(spark):
    r = random.Random(3)
    lists = [random_list(r) for _ in range(150)]
    wishes = []
    for d, x in enumerate(lists):
        i = r.choice([i for i, e in enumerate(x) if e[0] == "item" and e[6] != ""])
        wishes.append((d, i, min(len(x), i + r.choice([1, 1, 3])), r.choice(["start", "end"]), x[i][4] + r.choice([-500, -60, 0, 30, 500])))
    got = plain(E.retime(table(spark, lists), spark.createDataFrame(wishes, "doc long, start long, stop long, edge string, at long")))
    for d, a, b, edge, at in wishes:
        assert got[d] == plain_retime(lists[d], a, b, edge, at), (lists[d], wishes[d])
        reached = 0
        for e in got[d]:
            if e[0] == "item":
                assert e[4] <= reached or e[4] == 0  # nothing is left uncovered
                reached = max(reached, e[4] + e[5])


def plain_speaker(x, a, b, wish):
    marks = [i for i, e in enumerate(x) if e[0] == "paragraph"]
    said = lambda i, j: any(e[0] == "item" and e[6] != "" for e in x[i:j])
    p, q = max(i for i in marks if i <= a), max(i for i in marks if i <= b - 1)
    opens = not said(p + 1, a)
    lead = not opens and x[p][1] != wish
    begin = p if opens else a
    inside = [i for i in marks if begin <= i < b]
    if not lead and all(x[i][1] == wish for i in inside):
        return x
    new = [("paragraph", wish, *x[p][2:])] if lead else []
    for i in range(begin, b):
        if x[i][0] == "item":
            new.append(x[i])
        elif i == begin and not lead:
            new.append(("paragraph", wish, *x[i][2:]))
    stop = min((i for i in marks if i >= b), default=len(x))
    return x[:begin] + new + ([x[q]] if x[q][1] != wish and said(b, stop) else []) + x[b:]


def test_speakers_change_as_defined(spark):
    r = random.Random(4)
    lists = [random_list(r) for _ in range(200)]
    wishes = []
    for d, x in enumerate(lists):
        i = r.choice([i for i, e in enumerate(x) if e[0] == "item" and e[6] != ""])
        wishes.append((d, i, min(len(x), i + r.randrange(1, 9)), r.choice(["A", "B", "C", None])))
    got = plain(E.speaker_change(table(spark, lists), spark.createDataFrame(wishes, "doc long, start long, stop long, speaker string")))
    for d, a, b, who in wishes:
        assert got[d] == plain_speaker(lists[d], a, b, who)
    labels = {x.doc: x.label for x in E.new_label(table(spark, [[mark("SPEAKER_00"), mark("SPEAKER_02"), mark("Ann")], [mark("SPEAKER_01")], [mark(f"SPEAKER_{i:02d}") for i in range(101)]])).collect()}
    assert labels == {0: "SPEAKER_01", 1: "SPEAKER_00", 2: "SPEAKER_101"}


def plain_corrections(words, tokens):
    """words: (start, end, text, turn, sure), tokens: (start, end, text); one after the other, no clusters."""
    used, loose = set(), []
    for w, (a, b, text, turn, sure) in enumerate(words):
        b = max(b, a + 1)
        near = [i for i, (s, e, x) in enumerate(tokens) if i not in used and x == text and s < b - 0.5 and (max(e, s + 1) > a + 0.5 or s >= a - 0.5)]
        exact = [i for i in near if abs(tokens[i][0] - a) <= 0.5]
        if near:
            used.add((exact or near)[0])
        elif sure:
            loose.append((words[w][0], 0, w, words[w][1]))
    loose += [(s, 1, i, e) for i, (s, e, x) in enumerate(tokens) if i not in used and x != ""]
    groups = []
    for a, side, n, b in sorted(loose):
        g = groups[-1] if groups else None
        if g is None or a > g["to"] + 0.5 or (side == 0 and g["w"] and (words[n][3] != words[g["w"][-1]][3] or n != g["w"][-1] + 1)):
            g = {"from": a, "to": b, "w": [], "o": []}
            groups.append(g)
        g["to"] = max(g["to"], b)
        g["w" if side == 0 else "o"].append(n)
    out = []
    for g in groups:
        was = " ".join(tokens[i][2] for i in g["o"])
        if g["w"]:
            now = " ".join(words[i][2] for i in g["w"])
            if now != was:
                out.append((words[g["w"][0]][3], g["w"][0], g["w"][-1], was, now))
        elif words:
            after = sum(w[0] < g["from"] - 0.5 for w in words)
            near = after - 1 if after and (after == len(words) or g["from"] - words[after - 1][1] <= words[after][0] - g["to"]) else after
            out.append((words[near][3], after, after - 1, was, ""))
    return sorted(out), used


def test_corrections_equal_the_definition_and_use_no_token_twice(spark):
    r = random.Random(5)
    words, tokens, cases = [], [], []
    for d in range(150):
        t, w, k, turn = 0, [], [], 0
        for _ in range(r.randrange(0, 12)):
            t += r.choice([0, 0, 300])
            length = r.choice([0, 100, 250])
            text = r.choice("abc")
            if r.random() < 0.85:
                k.append((t + r.choice([0, 0, 40]), t + length, text))
            if r.random() < 0.85:
                turn += r.random() < 0.2
                w.append((t, t + length, text if r.random() < 0.8 else "new", turn, r.random() < 0.8))
            t += length
        k.sort(key=lambda x: x[0])
        cases.append((w, k))
        words += [(d, i, turn, a, b, x, sure) for i, (a, b, x, turn, sure) in enumerate(w)]
        tokens += [(d, i, a, max(a, b), x) for i, (a, b, x) in enumerate(k)]
    wd = spark.createDataFrame(words, "doc long, word long, turn long, start long, end long, text string, sure boolean")
    td = spark.createDataFrame(tokens, "doc long, token long, start long, end long, text string")
    pairs = E.paired(wd, td, "doc").collect()
    assert len(pairs) == len({(p.doc, p.word, p.token) for p in pairs})
    assert sorted((p.doc, p.word) for p in pairs if p.word is not None) == sorted((w[0], w[1]) for w in words)
    assert sorted((p.doc, p.token) for p in pairs if p.token is not None) == sorted((t[0], t[1]) for t in tokens)
    got = {}
    for x in E.corrections(wd, td, "doc").collect():
        got.setdefault(x.doc, []).append(tuple(x)[1:])
    for d, (w, k) in enumerate(cases):
        want, used = plain_corrections(w, [(a, max(a, b), x) for a, b, x in k])
        assert {p.token for p in pairs if p.doc == d and p.word is not None and p.token is not None} == used
        assert sorted(got.get(d, [])) == want


def test_edits_over_the_table(spark):
    sf = "/root/testdata/sf0.001"
    e = P.lists(spark, sf)
    assert P.m5(spark, sf).count() > 0 and P.m6(spark, sf).count() >= e.count() - 100
    assert P.m4(spark, sf).where("refused > 0 AND undo_steps > 0").count() > 0
    found = P.j14(spark, sf)
    assert found.where("now LIKE '%!%'").count() > 0 and found.where(F.col("now") == "").count() > 0
