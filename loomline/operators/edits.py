"""Edit lists as tables: changes by position, an op log with undo, retiming, speakers, pairing with the original.

An edit list is (doc, pos, kind, speaker, language, source, source_start, length, text, muted, confidence), pos from 0
without gaps; kind is paragraph (speaker, language) or item (the rest); times in milliseconds; an item
without text is a pause. Changes are position arithmetic: no window renumbers a list, and entries that a change
doesn't touch are not moved to Python.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .groups import each_group

ENTRY = "kind string, speaker string, language string, source string, source_start long, length long, text string, muted boolean, confidence double"
FIELDS = [c.split()[0] for c in ENTRY.split(", ")]
LIST = "doc long, pos long, " + ENTRY
#: Times nearer than this (milliseconds) are one.
EPS = 0.5



def is_item() -> Column:
    return F.col("kind") == "item"


def is_word() -> Column:
    return is_item() & (F.col("text") != "")


def _ranged(entries: DataFrame, ranges: DataFrame, columns: list[str]) -> DataFrame:
    """entries with the range of their list beside them, null where it has none or one that isn't inside the list.

    Sizes are counted in a window in the order of the lists, so that the entries are made and sorted once.
    """
    whole = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    given = ranges.select("doc", F.struct(*[c for c in ranges.columns if c != "doc"]).alias("__r"))
    r = entries.withColumn("__size", F.count(F.lit(1)).over(whole)).join(given, "doc", "left")
    inside = (F.lit(0) <= F.col("__r.start")) & (F.col("__r.start") <= F.col("__r.stop")) & (F.col("__r.stop") <= F.col("__size"))
    return r.select(*entries.columns, *[F.when(inside, F.col("__size") if c == "size" else F.col(f"__r.{c}")).alias(c) for c in columns])


def refused_ranges(entries: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc, start, stop, size of ranges that aren't inside their list; the changes below leave such lists as they are."""
    sizes = entries.groupBy("doc").agg(F.count(F.lit(1)).alias("size"))
    return ranges.join(sizes, "doc", "left").where("NOT coalesce(0 <= start AND start <= stop AND stop <= size, false)").select("doc", "start", "stop", "size")


def mute(entries: DataFrame, ranges: DataFrame, muted: bool = True) -> DataFrame:
    """Items [start, stop) of each list set muted or not; paragraphs stay."""
    inside = is_item() & (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("stop"))
    r = _ranged(entries, ranges, ["start", "stop"])
    return r.withColumn("muted", F.when(inside, F.lit(muted)).otherwise(F.col("muted"))).select(*entries.columns)


def delete(entries: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lists without their entries [start, stop)."""
    r = _ranged(entries, ranges, ["start", "stop"]).where("start IS NULL OR pos < start OR pos >= stop")
    after = F.when(F.col("pos") >= F.col("stop"), F.col("pos") - (F.col("stop") - F.col("start"))).otherwise(F.col("pos"))
    return r.withColumn("pos", after).select(*entries.columns)


def move(entries: DataFrame, ranges: DataFrame) -> DataFrame:
    """Entries [start, stop) put before entry `to`, counted in the list as it was; to inside the range, or outside the list, moves nothing."""
    r = _ranged(entries, ranges.where("to <= start OR to >= stop"), ["start", "stop", "to", "size"]).withColumn("to", F.when(F.col("to").between(0, F.col("size")), F.col("to")))
    start, stop, to, pos = (F.col(c) for c in ("start", "stop", "to", "pos"))
    block = stop - start
    inside = (pos >= start) & (pos < stop)
    at = F.when(to <= start, to).otherwise(to - block)
    rest = F.when(pos >= stop, pos - block).otherwise(pos)
    moved = F.when(inside, at + pos - start).when(rest < at, rest).otherwise(rest + block)
    return r.withColumn("pos", F.when(to.isNull(), pos).otherwise(moved)).select(*entries.columns)


def splice(entries: DataFrame, ranges: DataFrame, inserts: DataFrame) -> DataFrame:
    """Lists with inserts (doc, at, fields) in the place of entries [start, stop)."""
    counts = inserts.groupBy("doc").agg(F.count(F.lit(1)).alias("new"))
    own = ranges.join(counts, "doc", "left").select("doc", "start", "stop", F.coalesce("new", F.lit(0)).alias("new"))
    r = _ranged(entries, own, ["start", "stop", "new"]).where("start IS NULL OR pos < start OR pos >= stop")
    after = F.when(F.col("pos") >= F.col("stop"), F.col("pos") - (F.col("stop") - F.col("start")) + F.col("new")).otherwise(F.col("pos"))
    sizes = entries.groupBy("doc").agg(F.count(F.lit(1)).alias("size"))
    valid = own.join(sizes, "doc").where("0 <= start AND start <= stop AND stop <= size").select("doc", "start")
    put = inserts.join(valid, "doc").withColumn("pos", F.col("start") + F.col("at"))
    return r.withColumn("pos", after).select("doc", "pos", *FIELDS).unionByName(put.select("doc", "pos", *FIELDS))


def flag(entries: DataFrame, matches: DataFrame) -> DataFrame:
    """Items inside any match [start, stop) of their list muted; matches are short (a few words each)."""
    hit = matches.where("start < stop").select("doc", F.explode(F.sequence("start", F.col("stop") - 1)).alias("pos")).distinct()
    r = entries.join(hit.withColumn("hit", F.lit(True)), ["doc", "pos"], "left")
    return r.withColumn("muted", F.when(is_item() & F.col("hit"), F.lit(True)).otherwise(F.col("muted"))).select(*entries.columns)


def violations(entries: DataFrame, sources: DataFrame, names: DataFrame) -> DataFrame:
    """doc, pos, reason: the first thing that is wrong with each list; lists that are right have no row.

    sources: (doc, source, path), names: (doc, label, name). Sources are looked at first, then names, then entries in order.
    """
    src = sources.where("coalesce(source, '') = '' OR coalesce(path, '') = ''").select("doc", F.lit(-2).cast("long").alias("pos"), F.concat(F.lit("source without path: "), F.coalesce("source", F.lit(""))).alias("reason"))
    named = names.where("coalesce(label, '') = '' OR trim(coalesce(name, '')) = ''").select("doc", F.lit(-1).cast("long").alias("pos"), F.concat(F.lit("empty name of: "), F.coalesce("label", F.lit(""))).alias("reason"))
    known = sources.select("doc", "source", F.lit(True).alias("known")).distinct()
    e = entries.join(known, ["doc", "source"], "left")
    finite = lambda c: F.col(c).isNotNull() & (F.col(c) >= 0)
    reason = (
        F.when((F.col("kind") == "paragraph") & F.col("language").isNotNull() & ~F.col("language").rlike(r"^[a-z]{2,3}(-[A-Za-z0-9]{2,8})*$"), F.concat(F.lit("no language tag: "), "language"))
        .when(is_item() & (F.col("pos") == 0), F.lit("no paragraph opens the list"))
        .when(is_item() & F.col("known").isNull(), F.concat(F.lit("no such source: "), F.coalesce("source", F.lit(""))))
        .when(is_item() & ~finite("source_start"), F.lit("start is no time"))
        .when(is_item() & ~finite("length"), F.lit("length is no time"))
    )
    found = src.unionByName(named).unionByName(e.select("doc", "pos", reason.alias("reason")).where("reason IS NOT NULL"))
    return found.groupBy("doc").agg(F.min(F.struct("pos", "reason")).alias("m")).select("doc", "m.pos", "m.reason")


# An op log: state folded by sequence. -------------------------------------------------------------

ENTRIES = f"array<struct<{ENTRY.replace(', ', ',').replace(' ', ':')}>>"
OP = f"doc long, seq long, kind string, entries array<long>, muted array<boolean>, start long, stop long, put {ENTRIES}"
STATE = f"doc long, content {ENTRIES}, undo_steps long, redo_steps long, undo_label string, redo_label string, refused array<long>"
LABELS = {"flag": "mute the matches", "dismiss": "dismiss", "correct": "correction", "retime": "timing", "speaker": "speaker"}
#: Steps that can be undone.
HISTORY = 1000


class Refused(ValueError):
    """An op that doesn't fit the list."""


class History:
    """A list of entries under ops; each step keeps the ops that take it back."""

    def __init__(self, content: list[tuple], limit: int = HISTORY):
        self.content, self.limit = list(content), limit
        self.done: list[tuple[str, list, list]] = []
        self.undone: list[tuple[str, list, list]] = []
        self.open: tuple[str, list, list] | None = None

    def _run(self, op: dict[str, Any]) -> dict[str, Any]:
        """Does the op and returns the op that takes it back; the list is as before where it is refused."""
        c = self.content
        if op["kind"] in ("mute", "flag", "dismiss"):
            at = [int(i) for i in op["entries"]]
            if any(not 0 <= i < len(c) for i in at):
                raise Refused(op["kind"])
            was = [c[i][7] if c[i][0] == "item" else False for i in at]
            wish = {"flag": [True] * len(at), "dismiss": [False] * len(at)}.get(op["kind"]) or [bool(m) for m in op["muted"] or []]
            for k, i in enumerate(at):
                if c[i][0] == "item":
                    c[i] = (*c[i][:7], wish[k] if k < len(wish) else True, *c[i][8:])
            return {"kind": "mute", "entries": at, "muted": was}
        start, stop, put = int(op["start"]), int(op["stop"]), list(op["put"])
        if not 0 <= start <= stop <= len(c):
            raise Refused(op["kind"])
        back = {"kind": op["kind"], "start": start, "stop": start + len(put), "put": c[start:stop]}
        c[start:stop] = put
        return back

    def edit(self, op: dict[str, Any]) -> None:
        back = self._run(op)
        if self.open is None:
            self._keep((label(op), [op], [back]))
        else:
            self.open[1].append(op)
            self.open[2].append(back)

    def _keep(self, step: tuple[str, list, list]) -> None:
        self.done = [*self.done, step][-self.limit :]
        self.undone = []

    def begin(self) -> None:
        self.open = self.open or ("", [], [])

    def end(self) -> None:
        step, self.open = self.open, None
        if step and step[1]:
            self._keep((label(step[1][0]), *step[1:]))

    def undo(self) -> None:
        self.end()
        if self.done:
            step = self.done.pop()
            for op in reversed(step[2]):
                self._run(op)
            self.undone.append(step)

    def redo(self) -> None:
        self.end()
        if self.undone:
            step = self.undone.pop()
            for op in step[1]:
                self._run(op)
            self.done.append(step)


def label(op: dict[str, Any]) -> str:
    """What a step of this op is called."""
    if op["kind"] != "mute":
        return LABELS[op["kind"]]
    on = [bool(m) for m in op["muted"] or []]
    return "mute" if all(on) else "mute and unmute" if any(on) else "unmute"


def folded(entries: DataFrame, log: DataFrame, limit: int = HISTORY) -> DataFrame:
    """STATE of each list after its log (OP) in the order of seq: mute, flag, dismiss, correct, retime, speaker; undo, redo; begin and end.

    Ops between begin and end are one step. An op that doesn't fit the list (a place outside it, an unknown kind) changes nothing and
    is named by its seq. The fold of a list is one task's, as each op counts positions after the one before.
    """
    names = [c.split()[0] for c in OP.split(", put")[0].split(", ")]

    def fold(key: tuple, own: pd.DataFrame, ops: pd.DataFrame) -> pd.DataFrame:
        state, refused = History(list(own.sort_values("pos")[FIELDS].itertuples(index=False, name=None)), limit), []
        for op in ops.sort_values("seq")[[*names, "put"]].to_dict("records"):
            try:
                if op["kind"] in ("undo", "redo", "begin", "end"):
                    getattr(state, op["kind"])()
                elif op["kind"] == "mute" or op["kind"] in LABELS:
                    op["entries"] = [] if op["entries"] is None else list(op["entries"])
                    op["muted"] = [] if op["muted"] is None else list(op["muted"])
                    op["put"] = [] if op["put"] is None else [tuple(p[f] for f in FIELDS) for p in op["put"]]
                    state.edit(op)
                else:
                    raise Refused(op["kind"])
            except (Refused, TypeError):
                refused.append(int(op["seq"]))
        plain = lambda x: None if x is None or x != x else x.item() if hasattr(x, "item") else x
        content = [{f: plain(v) for f, v in zip(FIELDS, e)} for e in state.content]
        for c in content:
            for f in ("source_start", "length"):
                c[f] = None if c[f] is None else int(c[f])
        return pd.DataFrame({
            "doc": [key[0]], "content": [content], "undo_steps": [len(state.done)], "redo_steps": [len(state.undone)],
            "undo_label": [state.done[-1][0] if state.done else None], "redo_label": [state.undone[-1][0] if state.undone else None], "refused": [refused],
        })

    return entries.select("doc", "pos", *FIELDS).groupBy("doc").cogroup(log.groupBy("doc")).applyInPandas(fold, STATE)


def content(state: DataFrame) -> DataFrame:
    """The entries of STATE rows as a table."""
    return state.select("doc", F.posexplode("content").alias("pos", "e")).select("doc", F.col("pos").cast("long").alias("pos"), "e.*")


# A word's edge moved. ------------------------------------------------------------------------------


def retime(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """Lists in which a word's edge was moved: edges (doc, start, stop, edge, at), one for each list.

    The word is the text items of entries [start, stop). Its edge (start or end) goes to `at`, but not past its other end, nor past the far
    end of the neighbour on that side (of all items up to it, if it has none); the neighbour gives up what is overlapped; between
    words, pauses are made anew over what is left (muted if one there was). Words that were retimed are sure (confidence 1).

    Only entries from the word before to the word after take part; they are rebuilt as one array in the JVM.
    """
    inner = (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("stop"))
    at = lambda cond: F.when(is_word() & cond, F.col("pos"))
    near = entries.join(edges.select("doc", "start", "stop"), "doc").groupBy("doc").agg(
        F.min(at(inner)).alias("first"), F.max(at(inner)).alias("last"), F.max(at(F.col("pos") < F.col("start"))).alias("before"),
        F.min(at(F.col("pos") >= F.col("stop"))).alias("after"), F.min(F.when(is_item(), F.col("pos"))).alias("opening"), F.count(F.lit(1)).alias("size"),
    ).where("first IS NOT NULL")
    near = near.select("*", F.coalesce("before", F.least("opening", "first")).alias("from"), F.coalesce(F.col("after") + 1, "size").alias("until"))
    win = entries.join(near, "doc").where("pos >= from AND pos < until")
    end = F.col("source_start") + F.col("length")
    of = lambda value, which: F.max(F.when(F.col("pos") == F.col(which), value))
    bounds = win.groupBy("doc", "from", "until", "first", "last", "before", "after").agg(
        F.min(F.when(is_item(), F.col("source_start"))).alias("floor"), F.max(F.when(is_item(), end)).alias("ceiling"),
        of(F.col("source_start"), "before").alias("b0"), of(end, "before").alias("b1"), of(F.col("source_start"), "first").alias("f0"), of(end, "first").alias("f1"),
        of(F.col("source_start"), "last").alias("l0"), of(end, "last").alias("l1"), of(F.col("source_start"), "after").alias("a0"), of(end, "after").alias("a1"),
        F.sort_array(F.collect_list(F.struct("pos", *FIELDS))).alias("own"),
    ).join(edges.select("doc", "edge", F.col("at").alias("wish")), "doc")
    first_side = F.col("edge") == "start"
    low = F.when(first_side, F.coalesce("b0", "floor")).otherwise(F.col("l0"))
    high = F.when(first_side, F.col("f1")).otherwise(F.coalesce("a1", "ceiling"))
    b = bounds.withColumn("to", F.greatest(F.least("wish", high), low))
    pos = lambda e: e["pos"]
    moved_start = lambda e: first_side & (pos(e) == F.col("first")) | ~first_side & (pos(e) == F.col("after")) & (F.col("a0") < F.col("to"))
    moved_end = lambda e: ~first_side & (pos(e) == F.col("last")) | first_side & (pos(e) == F.col("before")) & (F.col("b1") > F.col("to"))
    start_of = lambda e: F.when(moved_start(e), F.col("to")).otherwise(e["source_start"])
    end_of = lambda e: F.when(moved_end(e), F.col("to")).otherwise(e["source_start"] + e["length"])
    return _rebuilt(entries, b, start_of, end_of, lambda e: F.coalesce(moved_start(e) | moved_end(e), F.lit(False)))


def _rebuilt(entries: DataFrame, b: DataFrame, start_of, end_of, touched) -> DataFrame:
    """Lists with entries [from, until) set anew: words at their times; before each, paragraphs that opened there, then one pause."""
    none = lambda kind: F.lit(None).cast(kind)
    entry = lambda e, **new: F.struct(*[new.get(f, e[f] if e is not None else none(k)).alias(f) for f, k in (p.split() for p in ENTRY.split(", "))])
    empty = F.array().cast(ENTRIES)
    start = F.struct(empty.alias("out"), empty.alias("marks"), F.col("floor").alias("reached"), F.lit(False).alias("muted"), F.lit("0").alias("source"))

    def filled(a: Column, until: Column, source: Column) -> Column:
        """What stands before a word (or at the end): the paragraphs that opened there and a pause over the gap."""
        pause = entry(None, kind=F.lit("item"), source=source, source_start=a["reached"], length=until - a["reached"], text=F.lit(""), muted=a["muted"])
        return F.concat(a["out"], a["marks"], F.when(until > a["reached"] + EPS, F.array(pause)).otherwise(empty))

    def step(a: Column, e: Column) -> Column:
        word = entry(e, source_start=start_of(e), length=F.when(touched(e), end_of(e) - start_of(e)).otherwise(e["length"]), confidence=F.when(touched(e), F.lit(1.0)).otherwise(e["confidence"]))
        paragraph, pause = e["kind"] == "paragraph", (e["kind"] == "item") & (e["text"] == "")
        return F.struct(
            F.when(paragraph | pause, a["out"]).otherwise(F.concat(filled(a, start_of(e), e["source"]), F.array(word))).alias("out"),
            F.when(paragraph, F.concat(a["marks"], F.array(entry(e)))).when(pause, a["marks"]).otherwise(empty).alias("marks"),
            F.when(paragraph | pause, a["reached"]).otherwise(F.greatest(a["reached"], end_of(e))).alias("reached"),
            F.when(paragraph, a["muted"]).when(pause, a["muted"] | F.coalesce(e["muted"], F.lit(False))).otherwise(F.lit(False)).alias("muted"),
            F.when(paragraph, a["source"]).otherwise(e["source"]).alias("source"),
        )

    made = b.select("doc", F.col("from").alias("start"), F.col("until").alias("stop"), F.aggregate("own", start, step, lambda a: filled(a, F.col("ceiling"), a["source"])).alias("put"))
    inserts = made.select("doc", F.posexplode("put").alias("at", "e")).select("doc", "at", "e.*")
    return splice(entries, made, inserts)


# Who says a stretch. --------------------------------------------------------------------------------


def speaker_change(entries: DataFrame, wishes: DataFrame) -> DataFrame:
    """Lists in which `speaker` says entries [start, stop), which open on a word: wishes (doc, start, stop, speaker), one for each list.

    A stretch that opens where its paragraph's words open changes that mark; one that opens later gets its own, unless its speaker
    already says it; marks inside go; what follows in the last paragraph goes back to who said it.
    """
    w = wishes.select("doc", "start", "stop", F.col("speaker").alias("wish"))
    r = entries.join(w, "doc")
    mark = F.col("kind") == "paragraph"
    who = F.struct("pos", "speaker", "language")
    word_at = lambda cond: F.when(is_word() & cond, F.col("pos"))
    s = r.groupBy("doc", "start", "stop", "wish").agg(
        F.max(F.when(mark & (F.col("pos") <= F.col("start")), who)).alias("own"), F.max(F.when(mark & (F.col("pos") <= F.col("stop") - 1), who)).alias("after"),
        F.max(word_at(F.col("pos") < F.col("start"))).alias("said"), F.min(F.when(mark & (F.col("pos") >= F.col("stop")), F.col("pos"))).alias("next_mark"),
        F.min(word_at(F.col("pos") >= F.col("stop"))).alias("next_word"),
        F.max(F.when(mark & (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("stop")) & ~F.equal_null("speaker", "wish"), 1)).alias("inside"),
    ).where("own IS NOT NULL")
    opens = F.col("said").isNull() | (F.col("said") < F.col("own.pos"))
    s = s.withColumns({"opens": opens, "lead": ~opens & ~F.equal_null("own.speaker", "wish")}).withColumn("from", F.when(F.col("opens"), F.col("own.pos")).otherwise(F.col("start")))
    changed = F.col("lead") | F.col("inside").isNotNull() | (F.col("opens") & ~F.equal_null("own.speaker", "wish"))
    back = ~F.equal_null("after.speaker", "wish") & F.col("next_word").isNotNull() & (F.col("next_mark").isNull() | (F.col("next_word") < F.col("next_mark")))
    s = s.where(changed).withColumn("back", back)
    own = entries.join(s, "doc").where("pos >= from AND pos < stop")
    kept = own.where(~mark | (F.col("pos") == F.col("from")) & ~F.col("lead")).withColumn("speaker", F.when(mark, F.col("wish")).otherwise(F.col("speaker")))
    none = lambda p: F.lit(None).cast(p.split()[1]).alias(p.split()[0])
    new = lambda at, who, language: [at.alias("at"), F.lit("paragraph").alias("kind"), who.alias("speaker"), language.alias("language"), *[none(p) for p in ENTRY.split(", ")[3:]]]
    leads = s.where("lead").select("doc", *new(F.lit(-1).cast("long"), F.col("wish"), F.col("own.language")))
    backs = s.where("back").select("doc", *new(F.col("stop"), F.col("after.speaker"), F.col("after.language")))
    put = kept.select("doc", F.col("pos").alias("at"), *FIELDS).unionByName(leads).unionByName(backs)
    inserts = put.withColumn("at", F.row_number().over(Window.partitionBy("doc").orderBy("at")) - 1)
    return splice(entries, s.select("doc", F.col("from").alias("start"), "stop"), inserts)


def merge_speakers(entries: DataFrame, old: str, into: str) -> DataFrame:
    """Every turn that `old` says given to `into`."""
    return entries.withColumn("speaker", F.when((F.col("kind") == "paragraph") & (F.col("speaker") == old), F.lit(into)).otherwise(F.col("speaker")))


def new_label(entries: DataFrame) -> DataFrame:
    """doc, label: the first SPEAKER_nn that no paragraph of the list has."""
    n = F.when(F.col("speaker").rlike(r"^SPEAKER_(\d{2}|[1-9]\d{2,})$"), F.substring("speaker", 9, 10).cast("long"))
    used = entries.groupBy("doc").agg(F.collect_set(n).alias("used"))
    free = F.array_min(F.array_except(F.sequence(F.lit(0).cast("long"), F.size("used").cast("long")), "used"))
    return used.select("doc", F.concat(F.lit("SPEAKER_"), F.when(free < 100, F.lpad(free.cast("string"), 2, "0")).otherwise(free.cast("string"))).alias("label"))


# What was corrected. --------------------------------------------------------------------------------


def clustered(spans: DataFrame, key: str, start: str, end: str, touch: float = 0.0) -> DataFrame:
    """spans with cluster: a number for each run of spans of a key that overlap, or lie no further apart than touch."""
    w = Window.partitionBy(key).orderBy(start, end)
    reached = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("__new", F.when(reached.isNull() | (F.col(start) > reached + touch), 1).otherwise(0)).withColumn("cluster", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def paired(words: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """key, word, token: each edited word with the original token that it is, and the rest of both sides with null (a full outer result).

    words: (key, word, start, end, text), tokens: (key, token, start, end, text). In the order of the words each takes a token of equal text
    that no one has: the first that starts when it does, else the first that overlaps it in time. Words that can't reach each other's
    tokens are in different clusters of time and settled apart.
    """
    w = words.select(key, F.lit(0).alias("side"), F.col("word").alias("n"), "start", F.greatest("end", F.col("start") + 2 * EPS).alias("end"), "text")
    t = tokens.select(key, F.lit(1).alias("side"), F.col("token").alias("n"), "start", F.greatest("end", F.col("start") + 2 * EPS).alias("end"), "text")
    both = clustered(w.unionByName(t), key, "start", "end", EPS)

    def settle(part: list[tuple]) -> list[tuple]:
        theirs = [r for r in part if r[1] == 1]
        places: dict[str, list[tuple]] = {}
        for i, (_, _, n, a, b, text, _) in enumerate(theirs):
            places.setdefault(text, []).append((a, b, i, n))
        free: dict[str, tuple[list, list, list]] = {}  # by start: starts, the furthest end up to there, tokens
        for text, own in places.items():
            own.sort(key=lambda x: x[0])
            free[text] = [x[0] for x in own], list(accumulate((x[1] for x in own), max)), own
        out, taken = [], set()
        for own, side, n, a, b, text, _ in part:
            if side == 1:
                continue
            starts, reached, tokens_ = free.get(text, ([], [], []))
            k, best = bisect_left(starts, b - EPS), None
            while k and (reached[k - 1] > a + EPS or starts[k - 1] >= a - EPS):
                k -= 1
                if tokens_[k][1] > a + EPS or starts[k] >= a - EPS:
                    rank = abs(starts[k] - a) > EPS, tokens_[k][2]
                    best = min(best, (rank, k)) if best else (rank, k)
            if best:
                taken.add(tokens_[best[1]][2])
            out.append((own, n, tokens_[best[1]][3] if best else None))
            for line in (starts, reached, tokens_) if best else ():
                del line[best[1]]
        return [*out, *[(r[0], None, r[2]) for i, r in enumerate(theirs) if i not in taken]]

    return each_group(both, [key, "cluster"], ["n"], settle, f"{key} {dict(words.dtypes)[key]}, word long, token long")


def corrections(words: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """key, turn, first, last, original, now: every stretch that was retyped, added or deleted, in time.

    words as in paired(), with turn and sure (only sure words without a token count as retyped). Loose ends of both sides that touch in time are
    one stretch, as long as its words follow each other in one turn. A stretch of deleted words stands beside the nearer
    word (the earlier of equals): last is then first - 1.
    """
    pairs = paired(words, tokens, key)
    new = pairs.where("token IS NULL").select(key, "word").join(words.where("sure"), [key, "word"])
    gone = pairs.where("word IS NULL").select(key, "token").join(tokens.where("text <> ''"), [key, "token"])
    loose = new.select(key, "start", "end", F.lit(1).alias("side"), "word", "turn", "text").unionByName(gone.select(key, "start", "end", F.lit(0).alias("side"), F.col("token").alias("word"), F.lit(-1).cast("long").alias("turn"), "text"))

    def group(part: list[tuple]) -> list[tuple]:
        stretches: list[dict] = []
        for own, a, b, side, n, turn, text, _ in part:
            s = stretches[-1] if stretches else None
            follows = s is not None and (side == 0 or s["last"] is None or (turn == s["turn"] and n == s["last"] + 1))
            if s is None or a > s["to"] + EPS or not follows:
                s = {"from": a, "to": b, "first": None, "last": None, "turn": None, "now": [], "original": []}
                stretches.append(s)
            s["to"] = max(s["to"], b)
            s["original" if side == 0 else "now"].append(text)
            if side == 1:
                s["first"], s["last"], s["turn"] = s["first"] if s["first"] is not None else n, n, turn
        return [(own, s["turn"], s["first"], s["last"], " ".join(s["original"]), " ".join(s["now"]), float(s["from"]), float(s["to"])) for s in stretches]

    kind = f"{key} {dict(words.dtypes)[key]}, turn long, first long, last long, original string, now string, from double, to double"
    stretches = each_group(clustered(loose, key, "start", "end", EPS), [key, "cluster"], ["start", F.desc("side"), "word"], group, kind)
    typed = stretches.where("first IS NOT NULL AND now <> original").drop("from", "to")
    return typed.unionByName(_beside(stretches.where("first IS NULL"), words, key))


def _beside(deleted: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """Deleted stretches with the turn of the nearer word and their place among the words; recordings without words have none."""
    at = F.struct("word", "turn", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    rows = words.select(key, (F.col("start") + EPS).cast("double").alias("t"), F.lit(0).alias("ask"), at.alias("w")).unionByName(
        deleted.select(key, F.col("from").alias("t"), F.lit(1).alias("ask"), "original", "from", "to"), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy("t", F.desc("ask"), "w.word")
    back = Window.partitionBy(key).orderBy(F.desc("t"), "ask", F.desc("w.word"))
    both = rows.withColumns({"before": F.last("w", ignorenulls=True).over(w), "after": F.last("w", ignorenulls=True).over(back)})
    both = both.where("ask = 1 AND (before IS NOT NULL OR after IS NOT NULL)")
    earlier = F.col("after").isNull() | F.col("before").isNotNull() & (F.col("from") - F.col("before.end") <= F.col("after.start") - F.col("to"))
    first = F.coalesce(F.col("before.word") + 1, "after.word")
    return both.select(key, F.when(earlier, F.col("before.turn")).otherwise(F.col("after.turn")).alias("turn"), first.alias("first"), (first - 1).alias("last"), "original", F.lit("").alias("now"))


def words_of(entries: DataFrame) -> DataFrame:
    """The words of edit lists for paired(): doc, word (their place among the words), turn (of their paragraph), start, end, text, sure."""
    w = Window.partitionBy("doc").orderBy("pos")
    turn = F.sum(F.when(F.col("kind") == "paragraph", 1).otherwise(0)).over(w)
    e = entries.withColumn("turn", turn - 1).where(is_word())
    return e.select("doc", (F.row_number().over(w) - 1).cast("long").alias("word"), "turn", F.col("source_start").alias("start"), (F.col("source_start") + F.col("length")).alias("end"), "text", (F.col("confidence") == 1).alias("sure"))

