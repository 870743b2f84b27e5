"""Points and intervals of a recording: as-of and nearest joins, unions, complements, islands.

Times are integer milliseconds. Joins on time are windows over the union of both sides of one
recording, not range joins: one shuffle by recording, no nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _merged_in_time(points: DataFrame, turns: DataFrame, key: str, t: str, start: str, end: str, label: str) -> DataFrame:
    """Points and turns in one order; turns stand before points of equal time."""
    p = points.select(*points.columns, F.col(t).alias("__t"), F.lit(1).alias("__kind"), F.lit(None).cast("struct<s:bigint,e:bigint,l:bigint>").alias("__turn"))
    turn = F.struct(F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"), F.col(label).cast("long").alias("l"))
    u = turns.select(F.col(key), F.col(start).alias("__t"), F.lit(0).alias("__kind"), turn.alias("__turn"))
    return p.unionByName(u, allowMissingColumns=True)


def turn_at(points: DataFrame, turns: DataFrame, key: str, t: str, start: str = "start", end: str = "end", label: str = "speaker") -> DataFrame:
    """points with speaker_at: the label of the last turn begun by t, null where that turn is over (ends count as inside)."""
    w = Window.partitionBy(key).orderBy("__t", "__kind", "__turn.l")
    last = F.last("__turn", ignorenulls=True).over(w)
    merged = _merged_in_time(points, turns, key, t, start, end, label).withColumn("__last", last).where("__kind = 1")
    return merged.select(*points.columns, F.when(F.col(t) <= F.col("__last.e"), F.col("__last.l")).alias("speaker_at"))


def nearest_turn(points: DataFrame, turns: DataFrame, key: str, t: str, start: str = "start", end: str = "end", label: str = "speaker") -> DataFrame:
    """points with nearest_speaker and distance: of the turns begun before and after t the nearer; of equals the earlier."""
    before = Window.partitionBy(key).orderBy("__t", "__kind", "__turn.l")
    after = Window.partitionBy(key).orderBy(F.desc("__t"), F.desc("__kind"), F.desc("__turn.l")).rowsBetween(Window.unboundedPreceding, -1)
    merged = _merged_in_time(points, turns, key, t, start, end, label).withColumns(
        {"__b": F.last("__turn", ignorenulls=True).over(before), "__a": F.last("__turn", ignorenulls=True).over(after)}
    ).where("__kind = 1")
    d_before = F.when(F.col("__b.e").isNotNull(), F.greatest(F.col(t) - F.col("__b.e"), F.lit(0)))
    d_after = F.col("__a.s") - F.col(t)
    take_before = d_before.isNotNull() & (d_after.isNull() | (d_before <= d_after))
    return merged.select(
        *points.columns,
        F.when(take_before, F.col("__b.l")).otherwise(F.col("__a.l")).alias("nearest_speaker"),
        F.when(take_before, d_before).otherwise(d_after).alias("distance"),
    )


def next_time(value: Column, key: str, t: str) -> Column:
    """Least value of the rows of a key that begin strictly later; frames that begin unbounded take linear time."""
    return F.min(value).over(Window.partitionBy(key).orderBy(F.desc(t)).rangeBetween(Window.unboundedPreceding, -1))


def label_by_vote(sentences: DataFrame, voted: DataFrame, keys: list[str], order: str, speaker: str = "speaker_at") -> DataFrame:
    """sentences with speaker: most votes of their tokens; of equals the one voted for first; else fallback."""
    counted = voted.where(F.col(speaker).isNotNull()).groupBy(*keys, speaker).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = counted.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("first")).alias("f"), F.col(speaker).alias("s"))).alias("best"))
    return sentences.join(best, keys, "left").select(
        *sentences.columns, F.coalesce("best.s", "nearest_speaker").alias("speaker"), F.coalesce("best.n", F.lit(0)).alias("votes")
    )


def merged_spans(spans: DataFrame, key: str, start: str = "start", end: str = "end", touching: bool = True) -> DataFrame:
    """Union of overlapping (and touching) spans of each key: start, end, n_spans."""
    w = Window.partitionBy(key).orderBy(start, end)
    reached = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = (F.col(start) > reached) if touching else (F.col(start) >= reached)
    groups = spans.withColumn("__new", F.when(reached.isNull() | opens, 1).otherwise(0)).withColumn("__g", F.sum("__new").over(w))
    return groups.groupBy(key, "__g").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("n_spans")).drop("__g")


def complement(spans: DataFrame, bounds: DataFrame, key: str) -> DataFrame:
    """What merged spans leave of each key's [lo, hi]."""
    w = Window.partitionBy(key).orderBy("start")
    edges = spans.select(key, "start", "end").unionByName(bounds.select(key, F.col("hi").alias("start"), F.col("hi").alias("end")))
    inner = edges.join(bounds, key).withColumn("from", F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), "lo"))
    return inner.where(F.col("from") < F.col("start")).select(key, F.col("from").alias("start"), F.col("start").alias("end"))


def islands(rows: DataFrame, key: list[str], order: list[str], flag: Column, value: str) -> DataFrame:
    """Runs of consecutive rows for which flag holds: first and last value, rows."""
    w = Window.partitionBy(*key).orderBy(*order)
    marked = rows.withColumn("__f", flag).withColumn("__n", F.row_number().over(w))
    inner = marked.where("__f").withColumn("__g", F.col("__n") - F.row_number().over(w))
    return inner.groupBy(*key, "__g").agg(F.min(value).alias("start"), F.max(value).alias("end"), F.count(F.lit(1)).alias("n")).drop("__g")


def sessions(rows: DataFrame, key: str, t: str, gap: int, tie: str) -> DataFrame:
    """Times of each key joined while the gap to the one before is at most `gap`."""
    w = Window.partitionBy(key).orderBy(t, tie)
    marked = rows.withColumn("__new", F.when(F.col(t) - F.lag(t).over(w) <= gap, 0).otherwise(1)).withColumn("__g", F.sum("__new").over(w))
    return marked.groupBy(key, "__g").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count(F.lit(1)).alias("n")).drop("__g")


def gaps(rows: DataFrame, key: str, t: str, least: int) -> DataFrame:
    """Stretches of over `least` between consecutive times of a key."""
    w = Window.partitionBy(key).orderBy(t)
    found = rows.select(key, F.col(t).alias("start"), F.lead(t).over(w).alias("end"))
    return found.where(F.col("end") - F.col("start") > least)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))


def binned(spans: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """spans with each bin of `width` that they touch, for equi-joins of ranges."""
    return spans.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))


def points_in_spans(points: DataFrame, spans: DataFrame, key: str, t: str, width: int, how: str = "inner", lead: int = 0, trail: int = 0) -> DataFrame:
    """Range join of points t in [start + lead, end - trail) on shared bins; how: inner, left_anti or left_semi."""
    left = points.withColumn("__bin", F.floor(F.col(t) / width))
    right = binned(spans, "start", "end", width).select(F.col(key).alias("__k"), "__bin", F.col("start").alias("span_start"), F.col("end").alias("span_end"))
    on = (F.col(key) == F.col("__k")) & (left["__bin"] == right["__bin"]) & (F.col(t) >= F.col("span_start") + lead) & (F.col(t) < F.col("span_end") - trail)
    joined = left.join(right, on, how)
    return joined.select(*points.columns, *([] if how in ("left_anti", "left_semi") else ["span_start", "span_end"]))


def best_overlap(items: DataFrame, segments: DataFrame, key: str, item: str, width: int) -> DataFrame:
    """(key, item, segment, shared): the segment that each item shares most time with; of equals the earlier."""
    a = binned(items, "start", "end", width).select(key, item, F.col("start").alias("a0"), F.col("end").alias("a1"), "__bin")
    b = binned(segments, "start", "end", width).select(key, F.col("segment"), F.col("start").alias("b0"), F.col("end").alias("b1"), "__bin")
    shared = overlap(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1"))
    pairs = a.join(b, [key, "__bin"]).select(key, item, "segment", shared.alias("shared")).where("shared > 0").distinct()
    best = pairs.groupBy(key, item).agg(F.max(F.struct("shared", (-F.col("segment")).alias("s"))).alias("b"))
    return best.select(key, item, (-F.col("b.s")).alias("segment"), F.col("b.shared").alias("shared"))


def uncovered(asked: DataFrame, others: DataFrame, key: str, item: str) -> DataFrame:
    """asked (key, item, lo0, hi0) with lo and hi: what of each the other spans leave, where something is left.

    Others that have begun by lo and run past it move lo to their end, as long as there are any: so lo is the end of the run of overlapping or touching
    others that it falls in. The first other that starts behind lo ends it. Two windows, no range join.
    """
    runs = merged_spans(others, key)
    q = asked.select(key, item, "lo0", "hi0", F.col("lo0").alias("__t"), F.lit(1).alias("__ask"))
    r = q.unionByName(runs.select(key, F.col("start").alias("__t"), F.lit(0).alias("__ask"), F.col("end").alias("__end")), allowMissingColumns=True)
    r = r.withColumn("__e", F.last("__end", ignorenulls=True).over(Window.partitionBy(key).orderBy("__t", "__ask"))).where("__ask = 1")
    r = r.withColumn("lo", F.greatest("lo0", F.coalesce("__e", "lo0"))).drop("__end", "__e")
    r = r.withColumns({"__t": F.col("lo")}).unionByName(others.select(key, F.col("start").alias("__t"), F.lit(0).alias("__ask")), allowMissingColumns=True)
    r = r.withColumn("__next", next_time(F.when(F.col("__ask") == 0, F.col("__t")), key, "__t")).where("__ask = 1")
    return r.select(key, item, "lo", F.least("hi0", F.coalesce("__next", "hi0")).alias("hi")).where("lo < hi")


def nearest_token(items: DataFrame, tokens: DataFrame, key: str, item: str, within: int) -> DataFrame:
    """(key, item, token, shared): the token that each item (start, end) shares most time with; without one, of the tokens whose middle is at most
    `within` from the item's, the one that starts nearest, with shared 0. Of equals the least token; items that have neither are left out.
    """
    a = items.select(key, item, F.col("start").alias("a0"), F.col("end").alias("a1"))
    b = tokens.select(key, "token", F.col("start").alias("b0"), F.col("end").alias("b1"))
    width = 2 * within
    middle = lambda p, q: F.floor((F.col(p) + F.col(q)) / 2 / width)
    by_bin = lambda rows, p, q: rows.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(p) / width), F.floor(F.col(q) / width))))
    touch = by_bin(a, "a0", "a1").join(by_bin(b, "b0", "b1"), [key, "__bin"]).where("a0 < b1 AND b0 < a1").drop("__bin")
    near = a.withColumn("__bin", F.explode(F.array(*[middle("a0", "a1") + k for k in (-1, 0, 1)]))).join(b.withColumn("__bin", middle("b0", "b1")), [key, "__bin"])
    near = near.where(F.abs((F.col("b0") + F.col("b1")) - (F.col("a0") + F.col("a1"))) <= 2 * within).drop("__bin")
    shared = overlap(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1"))
    order = F.struct((shared == 0).alias("none"), F.when(shared > 0, -shared).otherwise(F.abs(F.col("b0") - F.col("a0"))).alias("d"), "token", shared.alias("shared"))
    best = touch.unionByName(near).groupBy(key, item).agg(F.min(order).alias("m"))
    return best.select(key, item, "m.token", "m.shared")


def resumed(fresh: DataFrame, saved: DataFrame, key: str, tolerance: int) -> tuple[DataFrame, DataFrame]:
    """A saved review on new segments: (key, seg, start, end, state, flags, speaker, words_hash), and (key, lost), the checks that were dropped.

    fresh: (key, seg, start, end, words_hash), saved: (key, old, start, end, state, flags, speaker, words_hash). A segment takes flags and speaker of the earliest
    saved one whose ends are both within the tolerance, and its check if that was made on the same words.
    """
    bins = saved.select(key, "old", F.col("start").alias("s2"), F.col("end").alias("e2"), "state", "flags", "speaker", F.col("words_hash").alias("h2"))
    bins = bins.withColumn("__bin", F.explode(F.array(*[F.floor(F.col("s2") / tolerance) + k for k in (-1, 0, 1)])))
    met = fresh.withColumn("__bin", F.floor(F.col("start") / tolerance)).join(bins, [key, "__bin"])
    met = met.where((F.abs(F.col("start") - F.col("s2")) <= tolerance) & (F.abs(F.col("end") - F.col("e2")) <= tolerance))
    one = met.groupBy(key, "seg").agg(F.min_by(F.struct("old", "state", "flags", "speaker", "h2"), F.struct("s2", "old")).alias("m"))
    j = fresh.join(one, [key, "seg"], "left")
    kept = F.coalesce((F.col("m.state") == "checked") & (F.col("m.h2") == F.col("words_hash")), F.lit(False))
    j = j.withColumn("kept", kept)
    out = j.select(key, "seg", "start", "end", F.when(F.col("kept"), "checked").otherwise("unchecked").alias("state"), F.coalesce("m.flags", F.array().cast("array<string>")).alias("flags"),
                   "m.speaker", F.when(F.col("kept"), F.col("words_hash")).alias("words_hash"))
    used = j.where("kept").select(key, "m.old").distinct().withColumn("used", F.lit(True))
    lost = saved.join(used, [key, "old"], "left").groupBy(key).agg(F.count(F.when((F.col("state") == "checked") & F.col("used").isNull(), 1)).alias("lost"))
    return out, lost
