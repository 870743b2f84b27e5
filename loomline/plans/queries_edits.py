"""Edit lists: the events of a user as a list of paragraphs, words and pauses, changed, checked and compared with the original."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import edits as E
from ..operators.groups import kept, spread
from .queries_time import EV, MINUTE, points

Q, O = {}, {}


def lists(spark, sf):
    """Each user's events in time as an edit list: a paragraph before each sixth event, a word for each, a pause over what follows it."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    p = spread(points(spark, sf), "user_id").withColumns({"n": F.row_number().over(w), "next": F.lead("t").over(w)})
    p = p.withColumn("length", F.least((F.col("event_id") % 240 + 1) * MINUTE, F.coalesce(F.col("next") - F.col("t"), F.lit(MINUTE))))
    end = F.col("t") + F.col("length")
    opens, waits = (F.col("event_id") % 6 == 0) | (F.col("n") == 1), F.coalesce(F.col("next") > end, F.lit(False))
    of = lambda *parts: F.array(*map(F.lit, parts))
    p = p.withColumn("parts", F.when(opens & waits, of(0, 1, 2)).when(opens, of(0, 1)).when(waits, of(1, 2)).otherwise(of(1)))
    p = p.withColumn("before", F.sum(F.size("parts")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.size("parts"))
    e = p.select("*", F.posexplode("parts").alias("k", "part"))
    part = lambda first, word, pause, kind: F.when(F.col("part") == 0, first).when(F.col("part") == 1, word).otherwise(pause).cast(kind)
    none, zero, no = F.lit(None), F.lit("0"), F.lit(False)
    fields = {
        "kind": part(F.lit("paragraph"), F.lit("item"), F.lit("item"), "string"), "speaker": part(F.format_string("SPEAKER_%02d", F.col("event_id") % 3), none, none, "string"), "language": part(F.lit("en"), none, none, "string"),
        "source": part(none, zero, zero, "string"), "source_start": part(none, F.col("t"), end, "long"), "length": part(none, F.col("length"), F.col("next") - end, "long"), "text": part(none, F.col("event_type"), F.lit(""), "string"),
        "muted": part(none, no, no, "boolean"), "confidence": part(none, F.col("value") / 100, none, "double"),
    }
    return e.select(F.col("user_id").alias("doc"), (F.col("before") + F.col("k")).alias("pos"), *[fields[f].alias(f) for f in E.FIELDS], "event_id")


LISTS = EV + """, en AS (SELECT *, row_number() OVER w AS n, lead(t) OVER w AS nx FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
el AS (SELECT *, least((event_id % 240 + 1) * 60000, coalesce(nx - t, 60000)) AS len FROM en),
ea AS (SELECT user_id, event_id, n, 0 AS part, 'paragraph' AS kind, printf('SPEAKER_%02d', event_id % 3) AS speaker, 'en' AS language, NULL AS source, NULL::BIGINT AS source_start, NULL::BIGINT AS length, NULL AS text, NULL::BOOLEAN AS muted, NULL::DOUBLE AS confidence FROM el WHERE event_id % 6 = 0 OR n = 1
 UNION ALL SELECT user_id, event_id, n, 1, 'item', NULL, NULL, '0', t, len, event_type, false, value / 100 FROM el
 UNION ALL SELECT user_id, event_id, n, 2, 'item', NULL, NULL, '0', t + len, nx - t - len, '', false, NULL FROM el WHERE nx > t + len),
l AS (SELECT user_id AS doc, row_number() OVER (PARTITION BY user_id ORDER BY n, part) - 1 AS pos, * EXCLUDE (n, part, user_id) FROM ea),
sz AS (SELECT doc, count(*) AS size FROM l GROUP BY 1),
rg AS (SELECT doc, size, doc % 11 + 1 AS start, CASE WHEN doc % 13 = 5 THEN size + 1 ELSE doc % 11 + 1 + doc % 7 END AS stop, CASE WHEN doc % 3 = 0 THEN doc % 4 ELSE size - doc % 5 END AS "to" FROM sz),
okr AS (SELECT * FROM rg WHERE stop <= size)"""


def ranges(lists_):
    """One range for each list; every thirteenth list's isn't inside it."""
    r = lists_.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    start = F.col("doc") % 11 + 1
    to = F.when(F.col("doc") % 3 == 0, F.col("doc") % 4).otherwise(F.col("n") - F.col("doc") % 5)
    return r.select("doc", start.alias("start"), F.when(F.col("doc") % 13 == 5, F.col("n") + 1).otherwise(start + F.col("doc") % 7).alias("stop"), to.alias("to"))


def _shown(e):
    return e.select("doc", "pos", "kind", "speaker", "source_start", "length", "text", "muted")


SHOWN = "doc, {} AS pos, kind, speaker, source_start, length, text, {} AS muted"


def m1a(spark, sf):
    e = lists(spark, sf)
    return _shown(E.mute(e, ranges(e)))


Q["m1_mute"], O["m1_mute"] = m1a, LISTS + " SELECT " + SHOWN.format("pos", "CASE WHEN kind = 'item' AND pos >= start AND pos < stop THEN true ELSE muted END") + " FROM l LEFT JOIN okr USING (doc)"


def m1b(spark, sf):
    e = lists(spark, sf)
    return _shown(E.delete(e, ranges(e)))


Q["m1_delete"], O["m1_delete"] = m1b, LISTS + " SELECT " + SHOWN.format("row_number() OVER (PARTITION BY doc ORDER BY pos) - 1", "muted") + " FROM l LEFT JOIN okr USING (doc) WHERE start IS NULL OR pos < start OR pos >= stop"


def m1c(spark, sf):
    e = lists(spark, sf)
    return _shown(E.move(e, ranges(e)))


Q["m1_move"], O["m1_move"] = m1c, LISTS + """, mv AS (SELECT * FROM okr WHERE ("to" <= start OR "to" >= stop) AND "to" BETWEEN 0 AND size),
x AS (SELECT l.*, CASE WHEN pos >= start AND pos < stop THEN 2 * "to" - 1 ELSE 2 * pos END AS k FROM l LEFT JOIN mv USING (doc))
SELECT """ + SHOWN.format("row_number() OVER (PARTITION BY doc ORDER BY k, pos) - 1", "muted") + " FROM x"


def m1d(spark, sf):
    e = lists(spark, sf)
    return E.refused_ranges(e, ranges(e))


Q["m1_refused"], O["m1_refused"] = m1d, LISTS + " SELECT doc, start, stop, size FROM rg WHERE stop > size"


def broken(spark, sf):
    """Lists some of which have a wrong language, source, start or length, or no paragraph at the start."""
    e, k = lists(spark, sf), F.col("event_id")
    return e.withColumns({
        "language": F.when((F.col("kind") == "paragraph") & (k % 127 == 0), F.lit("English!")).otherwise(F.col("language")),
        "source": F.when((F.col("kind") == "item") & (k % 301 == 0), F.lit("9")).otherwise(F.col("source")),
        "source_start": F.when(k % 401 == 0, -F.col("source_start")).otherwise(F.col("source_start")),
        "length": F.when(k % 211 == 0, F.lit(None).cast("long")).otherwise(F.col("length")),
    }).where("NOT (doc % 17 = 3 AND pos = 0)").withColumn("pos", F.when(F.col("doc") % 17 == 3, F.col("pos") - 1).otherwise(F.col("pos")))


def m2(spark, sf):
    """The first thing that is wrong with each list."""
    e = broken(spark, sf)
    docs = e.select("doc").distinct()
    sources = docs.select("doc", F.lit("0").alias("source"), F.when(F.col("doc") % 29 == 4, F.lit("")).otherwise(F.lit("/a.mov")).alias("path"))
    names = docs.select("doc", F.lit("SPEAKER_00").alias("label"), F.when(F.col("doc") % 31 == 7, F.lit(" ")).otherwise(F.lit("Ann")).alias("name"))
    return E.violations(e, sources, names)


Q["m2_validate"], O["m2_validate"] = m2, LISTS + """, b AS (SELECT doc, CASE WHEN doc % 17 = 3 THEN pos - 1 ELSE pos END AS pos, kind, CASE WHEN kind = 'paragraph' AND event_id % 127 = 0 THEN 'English!' ELSE language END AS language,
  CASE WHEN kind = 'item' AND event_id % 301 = 0 THEN '9' ELSE source END AS source, CASE WHEN event_id % 401 = 0 THEN -source_start ELSE source_start END AS s, CASE WHEN event_id % 211 = 0 THEN NULL ELSE length END AS len
  FROM l WHERE NOT (doc % 17 = 3 AND pos = 0)),
r AS (SELECT doc, -2 AS pos, 'source without path: 0' AS reason FROM sz WHERE doc % 29 = 4 UNION ALL SELECT doc, -1, 'empty name of: SPEAKER_00' FROM sz WHERE doc % 31 = 7
 UNION ALL SELECT doc, pos, CASE WHEN kind = 'paragraph' THEN CASE WHEN NOT regexp_matches(language, '^[a-z]{2,3}(-[A-Za-z0-9]{2,8})*$') THEN 'no language tag: ' || language END
   WHEN pos = 0 THEN 'no paragraph opens the list' WHEN source <> '0' THEN 'no such source: ' || source WHEN s IS NULL OR s < 0 THEN 'start is no time' WHEN len IS NULL OR len < 0 THEN 'length is no time' END FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) AS k FROM r WHERE reason IS NOT NULL) SELECT doc, pos, reason FROM k WHERE k = 1"""


def m3(spark, sf):
    """Every error, and what is said right before it, muted."""
    e = lists(spark, sf)
    hits = e.where("text = 'error'").select("doc", F.greatest(F.col("pos") - 1, F.lit(0)).alias("start"), (F.col("pos") + 1).alias("stop"))
    return _shown(E.flag(e, hits))


Q["m3_flag"], O["m3_flag"] = m3, LISTS + ", h AS (SELECT DISTINCT doc, unnest([greatest(pos - 1, 0), pos]) AS pos FROM l WHERE text = 'error') SELECT " + SHOWN.format("l.pos", "CASE WHEN kind = 'item' AND h.pos IS NOT NULL THEN true ELSE muted END").replace("doc,", "l.doc,") + " FROM l LEFT JOIN h ON l.doc = h.doc AND l.pos = h.pos"


def op_log(spark, sf):
    """A log for each list: its user's events in the order of their ids, told apart by id."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    p = points(spark, sf).withColumn("seq", F.row_number().over(w).cast("long"))
    k = F.col("event_id") % 16
    kind = F.when(k < 3, "mute").when(k == 3, "flag").when(k == 4, "dismiss").when(k < 7, "correct").when(k == 7, "retime").when(k == 8, "speaker").when(k < 12, "undo").when(k == 12, "redo").when(k == 13, "begin").when(k == 14, "end").otherwise("paint")
    at = F.col("seq") * 7 % 90
    word = F.struct(*[F.lit(v).cast(t.split()[1]).alias(t.split()[0]) for t, v in zip(E.ENTRY.split(", "), ("item", None, None, "0", 0, 1, "new", False, 1.0))])
    return p.select(
        F.col("user_id").alias("doc"), "seq", kind.alias("kind"), F.array(at, at + 2, F.col("seq") * 5 % 240).alias("entries"), F.array(k % 2 == 0, k == 2).alias("muted"),
        at.alias("start"), (at + F.col("seq") % 3).alias("stop"), F.array_repeat(word, (F.col("seq") % 4).cast("int")).cast(E.ENTRIES).alias("put"),
    )


def m4(spark, sf):
    """Each list after its log, with what can be undone and what was refused."""
    state = E.folded(lists(spark, sf).drop("event_id"), op_log(spark, sf), limit=100)
    text = F.array_join(F.transform("content", lambda e: F.concat_ws(":", e["kind"], e["text"], e["muted"].cast("string"))), ",")
    return state.select("doc", F.size("content").cast("long").alias("n"), F.md5(text).alias("digest"), "undo_steps", "redo_steps", "undo_label", "redo_label", F.size("refused").cast("long").alias("refused"))


Q["m4_edit_log"] = m4


def edges(e):
    """For each list one of its first words, with an edge and where it is dragged to."""
    w = e.where(E.is_word()).withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy("pos")))
    by = (F.col("doc") % 9 - 4) * 45 * MINUTE
    return w.where(F.col("k") == F.col("doc") % 12 + 1).select("doc", F.col("pos").alias("start"), (F.col("pos") + 1).alias("stop"), F.when(F.col("doc") % 2 == 0, "start").otherwise("end").alias("edge"), (F.col("source_start") + by).alias("at"))


def m5(spark, sf):
    """Lists in which a word's edge was dragged: its neighbour gives way, pauses are made anew."""
    e = kept(lists(spark, sf).drop("event_id"), "doc")
    return _shown(E.retime(e, edges(e)))


Q["m5_retime"] = m5


def m6(spark, sf):
    """Lists in which a stretch of words was given to another speaker."""
    e = kept(lists(spark, sf).drop("event_id"), "doc")
    w = e.where(E.is_word()).withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy("pos"))).where(F.col("k") == F.col("doc") % 12 + 1)
    wish = w.select("doc", F.col("pos").alias("start"), (F.col("pos") + 1 + F.col("doc") % 8).alias("stop"), F.format_string("SPEAKER_%02d", F.col("doc") % 4).alias("speaker"))
    return _shown(E.speaker_change(e, wish))


Q["m6_speaker_change"] = m6


def m6b(spark, sf):
    """Two speakers made one, and the label that a new one would get."""
    e = E.merge_speakers(lists(spark, sf), "SPEAKER_01", "SPEAKER_00")
    turns = e.where("kind = 'paragraph'").groupBy("doc").agg(F.count(F.when(F.col("speaker") == "SPEAKER_00", 1)).alias("turns"))
    return turns.join(E.new_label(e), "doc")


Q["m6_merge_speakers"], O["m6_merge_speakers"] = m6b, LISTS + """, p AS (SELECT doc, CASE WHEN speaker = 'SPEAKER_01' THEN 'SPEAKER_00' ELSE speaker END AS s FROM l WHERE kind = 'paragraph')
SELECT doc, count(*) FILTER (s = 'SPEAKER_00') AS turns, CASE WHEN count(*) FILTER (s = 'SPEAKER_00') = 0 THEN 'SPEAKER_00' ELSE 'SPEAKER_01' END AS label FROM p GROUP BY 1"""


def edited(spark, sf):
    """(words, tokens): lists with words retyped, deleted, added and moved, and what was there before."""
    e = lists(spark, sf)
    k = F.col("event_id")
    words = e.where(~(E.is_word() & (k % 19 == 0))).withColumns({
        "text": F.when(E.is_word() & (k % 17 == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text")), "confidence": F.when(E.is_word() & (k % 17 == 0), F.lit(1.0)).otherwise(F.col("confidence")),
        "source_start": F.when(E.is_word() & (k % 23 == 0), F.col("source_start") + 30_000).otherwise(F.col("source_start")),
    })
    tokens = E.words_of(e).select("doc", F.col("word").alias("token"), "start", "end", "text")
    return E.words_of(words), tokens


def j14(spark, sf):
    """Retyped and deleted stretches of each list against its original."""
    return E.corrections(*edited(spark, sf), "doc")


Q["j14_corrections"] = j14
