"""What a reviewer looks at first: other readings of a sentence, likely errors, spellings near a list, an answer key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from .groups import small

#: How far outside all spans a word's middle may lie and still be given to the first or last one (milliseconds).
EDGE = 1000
ARABIC, LETTER = "[؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿]", r"\p{L}"


def spans_of(entries: DataFrame) -> DataFrame:
    """doc, seg, start, end, text of the sentences of edit lists: from a paragraph's first word to its words' furthest end."""
    w = Window.partitionBy("doc").orderBy("pos")
    e = entries.withColumn("seg", F.sum(F.when(F.col("kind") == "paragraph", 1).otherwise(0)).over(w) - 1).where("kind = 'item' AND text <> ''")
    g = e.groupBy("doc", "seg").agg(
        F.min_by("source_start", "pos").alias("start"), F.max(F.col("source_start") + F.col("length")).alias("end"),
        F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("a"), F.min("confidence").alias("least"),
    )
    return g.select("doc", "seg", "start", "end", F.array_join(F.transform("a", lambda x: x["text"]), " ").alias("text"), "least")


def opinion_words(words: DataFrame, spans: DataFrame, key: str, edge: float = EDGE) -> DataFrame:
    """words (key, word, start, end, text) with seg: the span their middle lies in; in a pause the nearer one (of equals the earlier).

    Before the first span and after the last one, words up to `edge` away are given to it, others to none. Spans don't overlap.
    """
    middle = (F.col("start") + F.col("end")) / 2
    span = F.struct(F.col("start").cast("double").alias("s"), F.col("end").cast("double").alias("e"), F.col("seg").alias("g"))
    rows = words.select(key, "word", "text", middle.alias("__m"), F.lit(1).alias("__ask")).unionByName(
        spans.select(key, F.col("end").cast("double").alias("__m"), F.lit(0).alias("__ask"), span.alias("__span")), allowMissingColumns=True
    )
    before = Window.partitionBy(key).orderBy("__m", "__ask")  # spans that end by the middle
    after = Window.partitionBy(key).orderBy(F.desc("__m"), F.desc("__ask"))  # spans that end later
    r = rows.withColumns({"__b": F.last("__span", ignorenulls=True).over(before), "__a": F.last("__span", ignorenulls=True).over(after)}).where("__ask = 1")
    to_b, to_a = F.col("__m") - F.col("__b.e"), F.when(F.col("__a").isNotNull(), F.greatest(F.col("__a.s") - F.col("__m"), F.lit(0.0)))
    seg = (
        F.when(to_a == 0, F.col("__a.g"))
        .when(F.col("__b").isNull(), F.when(to_a <= edge, F.col("__a.g")))
        .when(F.col("__a").isNull(), F.when(to_b <= edge, F.col("__b.g")))
        .when(to_b <= to_a, F.col("__b.g"))
        .otherwise(F.col("__a.g"))
    )
    return r.select(key, "word", "text", seg.alias("seg"))


def compared(words: Column) -> Column:
    """A list of words as they are compared: folded, without punctuation and signs, empty ones left out."""
    return F.filter(F.transform(words, lambda w: F.regexp_replace(X.folded(w), r"[\p{P}\p{S}]", "")), lambda w: w != "")


def script(text: Column) -> Column:
    """arabic or other by the first letter; null without letters."""
    first = F.regexp_extract(text, LETTER, 0)
    return F.when(first == "", None).when(first.rlike(ARABIC), "arabic").otherwise("other")


def disagreements(spans: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """key, seg, theirs, disagrees of every span: the other reading's words there, and whether the two differ.

    Without a word of the other reading they differ if the span has one; readings in two scripts aren't compared; else they agree only if
    the compared words are the same, one after the other.
    """
    given = opinion_words(words, spans, key).where("seg IS NOT NULL AND trim(text) <> ''")
    theirs = given.groupBy(key, "seg").agg(F.sort_array(F.collect_list(F.struct("word", F.trim("text").alias("text")))).alias("a"))
    j = spans.join(theirs, [key, "seg"], "left").withColumn("theirs", F.coalesce(F.transform("a", lambda x: x["text"]), F.array().cast("array<string>")))
    own = compared(F.split("text", r"\s+"))
    same_script = F.coalesce(script(F.col("text")) == script(F.array_join("theirs", " ")), F.lit(False))
    disagrees = F.when(F.size("theirs") == 0, F.size(own) > 0).when(~same_script, F.lit(False)).otherwise(own != compared(F.col("theirs")))
    return j.select(key, "seg", "theirs", disagrees.alias("disagrees"))


def likely_errors(spans: DataFrame, flags: DataFrame, opinions: DataFrame, cutoff: float | None, key: str) -> DataFrame:
    """key, seg, flagged, disagrees, unsure of the spans that one of the three marks.

    flags: (key, seg), opinions: of disagreements(); unsure: a word's confidence is under the cutoff (words without one never are; null: no engine
    to go by).
    """
    unsure = F.coalesce(F.col("least") < cutoff, F.lit(False)) if cutoff is not None else F.lit(False)
    j = spans.join(flags.select(key, "seg", F.lit(True).alias("f")).distinct(), [key, "seg"], "left").join(opinions.select(key, "seg", "disagrees"), [key, "seg"], "left")
    j = j.select(key, "seg", F.coalesce("f", F.lit(False)).alias("flagged"), F.coalesce("disagrees", F.lit(False)).alias("disagrees"), unsure.alias("unsure"))
    return j.where("flagged OR disagrees OR unsure")


def answer_key(spans: DataFrame, checked: DataFrame, key: str) -> DataFrame:
    """key, seg, start, end, ground_truth, kind of the spans that were checked; what lies between them is a gap without truth."""
    c = spans.join(checked.select(key, "seg"), [key, "seg"], "left_semi")
    before = F.lag("end").over(Window.partitionBy(key).orderBy("start"))
    clips = c.select(key, "seg", "start", "end", F.col("text").alias("ground_truth"), F.lit("clip").alias("kind"))
    gaps = c.select(key, "seg", F.coalesce(before, F.lit(0)).alias("from"), F.col("start").alias("to")).where("from < to")
    return clips.unionByName(gaps.select(key, "seg", F.col("from").alias("start"), F.col("to").alias("end"), F.lit(None).cast("string").alias("ground_truth"), F.lit("gap").alias("kind")))


def within_edits(words: DataFrame, entries: DataFrame, limit: int) -> DataFrame:
    """word, entry, edits of distinct words (word) and entries (entry) at most `limit` edits apart, by joins on parts.

    An entry is cut into limit + 1 parts. One of them stands unchanged in any word so near, shifted by at most limit; so a
    word offers, for each length an entry may have, what stands at the places of its parts. The work is linear in the words' lengths.
    """
    part = lambda n, i: F.floor(i * n / (limit + 1))
    e = entries.select("entry", F.length("entry").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(limit))).alias("i"))
    e = e.select("entry", "n", "i", F.substr("entry", part(F.col("n"), F.col("i")).cast("int") + 1, (part(F.col("n"), F.col("i") + 1) - part(F.col("n"), F.col("i"))).cast("int")).alias("part"))
    size = F.length("word")
    w = words.select("word", F.explode(F.sequence(F.greatest(size - limit, F.lit(1)), size + limit)).alias("n"))
    w = w.select("word", "n", F.explode(F.sequence(F.lit(0), F.lit(limit))).alias("i"))
    start, long = part(F.col("n"), F.col("i")), part(F.col("n"), F.col("i") + 1) - part(F.col("n"), F.col("i"))
    shifts = F.filter(F.sequence(F.lit(-limit), F.lit(limit)), lambda s: (start + s >= 0) & (start + s + long <= size))
    parts = F.array_distinct(F.transform(shifts, lambda s: F.substr("word", (start + s).cast("int") + 1, long.cast("int"))))  # by row: the rows themselves are too many to be told apart by a shuffle
    w = w.select("word", "n", "i", F.explode(parts).alias("part"))
    near = w.join(e, ["n", "i", "part"]).select("word", "entry").distinct().withColumn("edits", F.levenshtein("word", "entry", limit))
    return near.where("edits >= 0")


def candidates(words: DataFrame, entries: DataFrame) -> DataFrame:
    """word, near, how: words that hold a listed spelling (contains), or are one edit from it, two from one of seven letters (edit).

    words: (word) of four letters or more that aren't listed; entries: (entry, place), also of four or more; of several the first in place.
    """
    e = small(entries.where("length(entry) >= 4"), 256)
    grams = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 3), lambda i: F.substring("word", i, F.lit(4)))))
    w = words.where("length(word) >= 4").join(entries.select(F.col("entry").alias("word")), "word", "left_anti")
    held = w.select("word", grams.alias("gram")).join(e.select("entry", F.substring("entry", 1, 4).alias("gram")), "gram")
    held = held.where(F.contains("word", "entry")).select("word", "entry", F.lit("contains").alias("how"))
    names = e.select("entry")
    near = within_edits(w, names.where("length(entry) < 7"), 1).unionByName(within_edits(w, names.where("length(entry) >= 7"), 2))
    both = held.unionByName(near.select("word", "entry", F.lit("edit").alias("how"))).join(e, "entry")
    best = both.groupBy("word").agg(F.min(F.struct("place", "how", "entry")).alias("m"))
    return best.select("word", F.col("m.entry").alias("near"), "m.how")


def split_at(segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, word, refused: before which word a segment (keys, words, caret) splits, or why it can't.

    The caret is a place in the words joined by spaces. Between two words it splits there; inside a word at its nearer edge (of equals the earlier); at the
    text's own start or end not at all.
    """
    length = F.transform("words", lambda w: F.length(w))
    each = segments.select(*keys, "caret", F.size("words").alias("n"), F.posexplode_outer(length).alias("k", "size"))
    before = F.coalesce(F.sum(F.col("size") + 1).over(Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    e = each.withColumn("b", before).withColumn("e", F.col("b") + F.col("size"))
    gap = (F.col("k") > 0) & (F.col("caret") >= F.col("b") - 1) & (F.col("caret") <= F.col("b"))
    inside = (F.col("caret") > F.col("b")) & (F.col("caret") < F.col("e"))
    edge = F.when(F.col("caret") - F.col("b") <= F.col("e") - F.col("caret"), F.col("k")).otherwise(F.col("k") + 1)
    g = e.groupBy(*keys, "caret", "n").agg(F.min(F.when(gap, F.col("k"))).alias("gap"), F.min(F.when(inside, edge)).alias("inside"))
    at = F.coalesce("gap", "inside", F.when(F.col("caret") <= 0, 0).otherwise(F.col("n")))
    free = (F.col("n") > 1) & (at > 0) & (at < F.col("n"))
    why = F.when(F.coalesce("n", F.lit(0)) <= 0, "no words").when(F.col("n") == 1, "one word").when(~free, "not between two words")
    return g.select(*keys, F.when(free, at).cast("long").alias("word"), why.alias("refused"))


def merge_with_previous(segments: DataFrame, which: DataFrame, key: str) -> DataFrame:
    """Segments (key, seg, start, end, flags, speaker, edited) with those of `which` (key, seg) joined to the one before them, each to one that isn't joined itself.

    The flags of both stay, the first speaker that is known, and edited if either is. A first segment has none before it and stays.
    """
    w = Window.partitionBy(key).orderBy("start", "seg")
    s = segments.join(which.select(key, "seg", F.lit(True).alias("__joins")), [key, "seg"], "left")
    s = s.withColumn("__joins", F.coalesce("__joins", F.lit(False)) & F.lag("seg").over(w).isNotNull()).withColumn("__g", F.sum(F.when(F.col("__joins"), 0).otherwise(1)).over(w))
    g = s.groupBy(key, "__g").agg(
        F.min_by("seg", "start").alias("seg"), F.min("start").alias("start"), F.max("end").alias("end"), F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("start", "flags"))), lambda x: x["flags"]))).alias("flags"),
        F.min_by("speaker", F.when(F.col("speaker").isNotNull(), F.col("start"))).alias("speaker"), F.max("edited").alias("edited"),
    )
    return g.drop("__g")


def toggle_flag(segments: DataFrame, flag: str, where: Column) -> DataFrame:
    """segments with the flag taken off where it is and put on where it isn't, of those that where holds for."""
    toggled = F.when(F.array_contains("flags", flag), F.array_remove("flags", flag)).otherwise(F.array_append("flags", F.lit(flag)))
    return segments.withColumn("flags", F.when(where, toggled).otherwise(F.col("flags")))
