"""Cues for players, spans to mute, and edit lists from transcripts, with what each refuses named."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import edits
from .groups import each_group
from .intervals import merged_spans, next_time

CHARS, SECONDS_MS = 84, 7000
PAD, WORD_MS, TOUCH = 100, 1400, 1


def one_timeline(sentences: DataFrame, key: str) -> DataFrame:
    """key, start, end, n, first of the cues of sentences (key, sent, start, end): none overlaps the next.

    A cue ends where the next sentence starts. What would then last no time is carried into the next cue, which starts where the first that
    was carried did. A sentence that lasts and isn't followed at once surely ends a cue, so only what lies between such ones is folded.
    """
    w = Window.partitionBy(key).orderBy("start", "sent")
    s = sentences.select(key, "sent", "start", "end").withColumn("next", F.lead("start").over(w))
    sure = F.col("next").isNull() | (F.col("end") > F.col("start")) & (F.col("next") > F.col("start"))
    s = s.withColumn("sure", sure).withColumn("cluster", F.sum(F.when(F.col("sure"), 1).otherwise(0)).over(w) - F.when(F.col("sure"), 1).otherwise(0))
    s = s.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key, "cluster")))
    ends = F.when(F.col("next").isNull(), F.greatest("end", "start")).otherwise(F.least("end", "next"))
    alone = s.where("n = 1").select(key, "start", ends.alias("end"), F.lit(1).cast("long").alias("n"), F.col("sent").alias("first"))

    def fold(part: list[tuple]) -> list[tuple]:
        out, group = [], None
        for own, _, sent, a, b, after in part:
            group = (group[0], max(group[1], b), group[2] + 1, group[3]) if group else (a, b, 1, sent)
            end = max(group[1], group[0]) if after is None else min(group[1], after)
            if after is None or end > group[0]:
                out.append((own, group[0], end, group[2], group[3]))
                group = None
        return out

    kinds = dict(sentences.dtypes)
    near = s.where("n > 1").select(key, "cluster", "sent", "start", "end", "next")
    return alone.unionByName(each_group(near, [key, "cluster"], ["start", "sent"], fold, f"{key} {kinds[key]}, start {kinds['start']}, end {kinds['end']}, n long, first {kinds['sent']}"))


def split_cues(cues: DataFrame, chars: int = CHARS, longest: int = SECONDS_MS) -> DataFrame:
    """cues with piece, start, end, text of their pieces: at most so many characters and milliseconds, cut before tokens that open with a space.

    cues have tokens, an array of (w, t, e) in order. A piece starts with its first token and ends with the last end of its tokens, but not after the next
    piece's start. A word that is too long for any piece stands alone. Done by one fold over each cue's array in the JVM.
    """
    start = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("t0"))

    def step(a, x):
        lead = F.when(F.startswith(x["w"], F.lit(" ")), 1).otherwise(0)
        cut = (a["n"] > 0) & (lead == 1) & ((a["size"] + F.length(x["w"]) > chars) | (x["e"] - a["t0"] > longest))
        opens = (a["n"] == 0) | cut
        return F.struct(
            F.when(opens, F.concat(a["cuts"], F.array(a["n"]))).otherwise(a["cuts"]).alias("cuts"), (a["n"] + 1).alias("n"),
            F.when(opens, F.length(x["w"]) - lead).otherwise(a["size"] + F.length(x["w"])).alias("size"), F.when(opens, x["t"].cast("long")).otherwise(a["t0"]).alias("t0"),
        )

    cut = cues.where(F.size("tokens") > 0).withColumn("__cuts", F.aggregate("tokens", start, step, lambda a: a["cuts"]))
    bounds = F.transform("__cuts", lambda c, i: F.struct(c.alias("a"), F.coalesce(F.get("__cuts", i + 1), F.size("tokens")).alias("b")))
    one = cut.select("*", F.posexplode(bounds).alias("piece", "__x")).withColumn("__own", F.slice("tokens", F.col("__x.a") + 1, F.col("__x.b") - F.col("__x.a")))
    own_start = F.get("__own", F.lit(0))["t"]
    end = F.greatest(own_start, F.array_max(F.transform("__own", lambda x: x["e"])))
    after = F.get("tokens", F.col("__x.b"))["t"]
    return one.select(*[c for c in cues.columns if c != "tokens"], "piece", own_start.alias("start"), F.least(end, F.coalesce(after, end)).alias("end"),
                      F.trim(F.array_join(F.transform("__own", lambda x: x["w"]), "")).alias("text"))


def mute_refusals(entries: DataFrame) -> DataFrame:
    """doc, pos, reason: why a list can't be rendered by muting alone, at the first entry: several sources (pos -1), or an entry that doesn't follow the one before in the recording."""
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    i = entries.where(edits.is_item()).withColumns({"previous": F.last("source_start").over(w), "reached": F.max(F.col("source_start") + F.col("length")).over(w)})
    odd = (F.col("source_start") < F.coalesce("previous", F.lit(0))) | (F.col("source_start") > F.coalesce("reached", F.lit(0)) + TOUCH)
    found = i.groupBy("doc").agg(F.min(F.when(odd, F.col("pos"))).alias("moved"), F.size(F.collect_set("source")).alias("k")).where("moved IS NOT NULL OR k > 1")
    several = F.col("k") > 1
    reason = F.when(several, F.concat(F.lit("plays from "), F.col("k").cast("string"), F.lit(" recordings"))).otherwise("doesn't follow the entry before it")
    return found.select("doc", F.when(several, F.lit(-1)).otherwise(F.col("moved")).cast("long").alias("pos"), reason.alias("reason"))


def mute_plan(entries: DataFrame, durations: DataFrame) -> DataFrame:
    """doc, start, end of what to silence in lists that mute_refusals finds nothing in: muted items, padded, within (doc, duration), touching ones as one.

    A muted word is silenced for at most WORD_MS and not past the next word that starts later; a pause keeps its length.
    """
    good = entries.join(mute_refusals(entries).select("doc"), "doc", "left_anti").where(edits.is_item())
    ahead = next_time(F.when(F.col("text") != "", F.col("source_start")), "doc", "source_start")
    i = good.withColumn("ahead", ahead).where("muted").join(durations, "doc")
    end = F.col("source_start") + F.col("length")
    limit = F.least(F.col("source_start") + WORD_MS, F.coalesce("ahead", F.col("source_start") + WORD_MS))
    stop = F.when((F.col("text") != "") & (end > limit + TOUCH), limit).otherwise(end)
    spans = i.select("doc", F.greatest(F.col("source_start") - PAD, F.lit(0)).alias("start"), F.least(stop + PAD, F.col("duration")).alias("end")).where("end > start")
    return merged_spans(spans, "doc").select("doc", "start", "end")


def transcript_refusals(tokens: DataFrame) -> DataFrame:
    """doc, sent, token, reason: the first token of a transcript (doc, sent, token, t, e) without an end, or that starts before the one ahead of it."""
    w = Window.partitionBy("doc").orderBy("sent", "token")
    why = F.when(F.col("e").isNull(), "no end").when(F.col("t") < F.lag("t").over(w), "starts before the token ahead")
    odd = tokens.withColumn("reason", why).where("reason IS NOT NULL")
    return odd.groupBy("doc").agg(F.min(F.struct("sent", "token", "reason")).alias("m")).select("doc", "m.*")


def from_transcript(tokens: DataFrame, durations: DataFrame) -> DataFrame:
    """The untouched edit lists (edits.LIST) of transcripts (doc, sent, token, t, e, w, speaker) that transcript_refusals finds nothing in.

    A paragraph for each sentence, a word for each token, a pause over what no token so far has reached, up to (doc, duration) at the end.
    """
    good = tokens.join(transcript_refusals(tokens).select("doc"), "doc", "left_anti")
    w = Window.partitionBy("doc").orderBy("sent", "token")
    g = good.withColumns({"reached": F.coalesce(F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "opens": F.coalesce(F.lag("sent").over(w) != F.col("sent"), F.lit(True))})
    kinds = [p.split() for p in edits.ENTRY.split(", ")]
    row = lambda part, **have: F.struct(F.lit(part).alias("part"), *[have.get(f, F.lit(None)).cast(k).alias(f) for f, k in kinds])
    item = {"kind": F.lit("item"), "source": F.lit("0"), "muted": F.lit(False)}
    parts = F.array(
        F.when(F.col("opens"), row(0, kind=F.lit("paragraph"), speaker=F.col("speaker"))),
        F.when(F.col("t") > F.col("reached"), row(1, **item, source_start=F.col("reached"), length=F.col("t") - F.col("reached"), text=F.lit(""))),
        row(2, **item, source_start=F.col("t"), length=F.greatest(F.col("e") - F.col("t"), F.lit(0)), text=F.col("w")),
    )
    rows = g.select("doc", "sent", "token", F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("x"))
    ends = good.groupBy("doc").agg(F.max("e").alias("reached"), F.max("sent").alias("sent"), F.max("token").alias("token")).join(durations, "doc").where("duration > reached")
    tail = ends.select("doc", (F.col("sent") + 1).alias("sent"), "token", row(3, **item, source_start=F.col("reached"), length=F.col("duration") - F.col("reached"), text=F.lit("")).alias("x"))
    pos = F.row_number().over(Window.partitionBy("doc").orderBy("sent", "token", "x.part")) - 1
    return rows.unionByName(tail).select("doc", pos.cast("long").alias("pos"), *[F.col(f"x.{f}").alias(f) for f in edits.FIELDS])


def sentences_of(tokens: DataFrame, key: str, most_words: int | None = None, silence: int | None = None, longest: int | None = None) -> DataFrame:
    """tokens (key, token, t, e, w) with sent, from 0: a sentence ends behind one of ! ? and their wide forms, behind a full stop that a token with a
    space (or nothing) follows, and, where told so, before a pause of `silence`, before its words would be over most_words, and once it lasts `longest`.

    Words are tokens with a space. Ends by punctuation and silence don't hang on what came before, so what lies between two of them is a group of
    its own; only the other two rules are folded, inside such groups.
    """
    w = Window.partitionBy(key).orderBy("token")
    after, later = F.lead("w").over(w), F.lead("t").over(w)
    stop = F.col("w").rlike("[!?。？！]") | F.contains("w", F.lit(".")) & (after.isNull() | F.contains(after, F.lit(" ")))
    hard = stop if silence is None else stop | F.coalesce(later - F.col("e") >= silence, F.lit(False))
    r = tokens.withColumns({"__hard": hard.cast("int"), "__next": F.contains(after, F.lit(" ")), "__more": after.isNotNull()})
    r = r.withColumn("__group", F.coalesce(F.sum("__hard").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__hard")
    if most_words is None and longest is None:
        return r.withColumn("sent", (F.dense_rank().over(Window.partitionBy(key).orderBy("__group")) - 1).cast("long")).select(*tokens.columns, "sent")

    names = tokens.columns

    def fold(part: list[tuple]) -> list[tuple]:
        sub, words, opened, out = 0, 0, None, []
        for row in part:
            t, e, text, space, more = row[-5:]
            opened = t if opened is None else opened
            words += " " in text
            out.append((*row[:-5], sub))
            full = most_words is not None and more and words + bool(space) > most_words
            if full or (longest is not None and e - opened >= longest):
                sub, words, opened = sub + 1, 0, None
        return out

    kinds = ", ".join(f"{c} {k}" for c, k in [*tokens.dtypes, ("__group", "long"), ("__sub", "long")])
    given = r.select(*names, "__group", F.col("t").alias("__t"), F.col("e").alias("__e"), F.col("w").alias("__w"), "__next", "__more")
    cut = each_group(given, [key, "__group"], ["token"], fold, kinds)
    return cut.withColumn("sent", (F.dense_rank().over(Window.partitionBy(key).orderBy("__group", "__sub")) - 1).cast("long")).select(*names, "sent")
