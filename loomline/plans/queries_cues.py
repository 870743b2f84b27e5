"""Cues, mute plans and edit lists with their refusals; JSON documents; pairs, marks and confidences by keys of many values."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as X
from ..operators import cues as C, edits as E
from ..sources import documents as D
from .queries_edits import LISTS, edited, lists
from .queries_text import TOK, table, tokens
from .queries_time import EV, MINUTE, points

Q, O = {}, {}


def k14(spark, sf):
    """Cues of each user's events, begun on six-hour marks (so that many start at once) and lasting none to two hours."""
    hours = 360 * MINUTE
    start = F.col("t") - F.col("t") % hours
    s = points(spark, sf).select("user_id", F.col("event_id").alias("sent"), start.alias("start"), (start + F.col("event_id") % 3 * 60 * MINUTE).alias("end"))
    return C.one_timeline(s, "user_id")


Q["k14_cues"], O["k14_cues"] = k14, EV.replace("WITH ", "WITH RECURSIVE ", 1) + """, s AS (SELECT user_id, event_id, t - t % 21600000 AS s, t - t % 21600000 + event_id % 3 * 3600000 AS e FROM ev),
o AS (SELECT *, row_number() OVER w AS k, lead(s) OVER w AS nx FROM s WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
r AS (SELECT user_id, k, s AS gs, e AS ge, 1::BIGINT AS n, event_id AS first, nx, coalesce(least(e, nx) > s, true) AS closes FROM (SELECT *, CASE WHEN nx IS NULL THEN 1 END AS z FROM o) WHERE k = 1
 UNION ALL SELECT o.user_id, o.k, CASE WHEN closes THEN o.s ELSE gs END, CASE WHEN closes THEN o.e ELSE greatest(ge, o.e) END, CASE WHEN closes THEN 1 ELSE n + 1 END, CASE WHEN closes THEN o.event_id ELSE first END, o.nx,
  o.nx IS NULL OR least(CASE WHEN closes THEN o.e ELSE greatest(ge, o.e) END, o.nx) > CASE WHEN closes THEN o.s ELSE gs END FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
SELECT user_id, gs AS start, CASE WHEN nx IS NULL THEN greatest(ge, gs) ELSE least(ge, nx) END AS "end", n, first FROM r WHERE closes"""


def k15(spark, sf):
    """Turns as cues in pieces of 84 characters and seven seconds; a word lasts a tenth of a second for each letter."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w"))
    each = c.select("conv_id", "turn", F.posexplode("w").alias("i", "w"))
    before = F.coalesce(F.sum(F.length("w") * 100 + 50).over(Window.partitionBy("conv_id", "turn").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumn("t", before).select("conv_id", "turn", F.struct("i", F.concat(F.when(F.col("i") > 0, " ").otherwise(""), "w").alias("w"), "t", (F.col("t") + F.length("w") * 100).alias("e")).alias("x"))
    g = each.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list("x")).alias("a")).select("conv_id", "turn", F.transform("a", lambda x: x.dropFields("i")).alias("tokens"))
    return C.split_cues(g)


Q["k15_split_cue"], O["k15_split_cue"] = k15, r"""WITH RECURSIVE c AS (SELECT conv_id, turn, [x for x in string_split_regex(text, '\s+') if x <> ''] AS w FROM conversations),
i AS (SELECT conv_id, turn, unnest(w) AS w, generate_subscripts(w, 1) AS i, len(w) AS m FROM c),
t AS (SELECT *, CAST(coalesce(sum(length(w) * 100 + 50) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS t FROM i),
r AS (SELECT conv_id, turn, i, 0::BIGINT AS piece, length(w) AS size, t AS t0 FROM t WHERE i = 1
 UNION ALL SELECT t.conv_id, t.turn, t.i, CASE WHEN size + length(w) + 1 > 84 OR t.t + length(w) * 100 - t0 > 7000 THEN piece + 1 ELSE piece END,
  CASE WHEN size + length(w) + 1 > 84 OR t.t + length(w) * 100 - t0 > 7000 THEN length(w) ELSE size + length(w) + 1 END,
  CASE WHEN size + length(w) + 1 > 84 OR t.t + length(w) * 100 - t0 > 7000 THEN t.t ELSE t0 END FROM r JOIN t ON t.conv_id = r.conv_id AND t.turn = r.turn AND t.i = r.i + 1)
SELECT conv_id, turn, CAST(piece AS INTEGER) AS piece, min(t) AS start, max(t + length(w) * 100) AS "end", string_agg(w, ' ' ORDER BY i) AS text FROM r JOIN t USING (conv_id, turn, i) GROUP BY conv_id, turn, piece"""


def muted_lists(spark, sf):
    """Edit lists with errors muted; from some an entry was deleted, some play from two recordings."""
    e, d = lists(spark, sf).drop("event_id"), F.col("doc")
    e = e.withColumns({"muted": F.when(F.col("kind") == "item", F.col("text") == "error").otherwise(F.col("muted")), "source": F.when((F.col("kind") == "item") & (d % 19 == 3) & (F.col("pos") > 9), F.lit("1")).otherwise(F.col("source"))})
    zero = F.min("source_start").over(Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # recordings start with their first word
    e = e.withColumn("source_start", F.col("source_start") - zero)
    return E.delete(e, points(spark, sf).where("user_id % 7 = 2").select(F.col("user_id").alias("doc")).distinct().select("doc", F.lit(5).alias("start"), F.lit(8).alias("stop")))


MUTED = LISTS + """, z AS (SELECT *, min(source_start) OVER (PARTITION BY doc) AS zero FROM l),
y AS (SELECT doc, pos AS p0, kind, CASE WHEN kind = 'item' AND doc % 19 = 3 AND pos > 9 THEN '1' ELSE source END AS source, source_start - zero AS s, source_start - zero + length AS e, text, kind = 'item' AND text = 'error' AS muted FROM z),
x AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY p0) - 1 AS pos FROM y WHERE NOT (doc % 7 = 2 AND p0 IN (5, 6, 7))),
it AS (SELECT *, coalesce(lag(s) OVER w, 0) AS prev, coalesce(max(e) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM x WHERE kind = 'item' WINDOW w AS (PARTITION BY doc ORDER BY pos)),
rf AS (SELECT doc, pos, reason, row_number() OVER (PARTITION BY doc ORDER BY pos) AS k FROM (SELECT doc, pos, 'doesn''t follow the entry before it' AS reason FROM it WHERE s < prev OR s > reached + 1
 UNION ALL SELECT doc, -1, 'plays from ' || count(DISTINCT source) || ' recordings' FROM it GROUP BY doc HAVING count(DISTINCT source) > 1))"""


def k13r(spark, sf):
    return C.mute_refusals(muted_lists(spark, sf))


Q["k13_refusals"], O["k13_refusals"] = k13r, MUTED + " SELECT doc, pos, reason FROM rf WHERE k = 1"


def k13(spark, sf):
    """What to silence in the lists that can be rendered."""
    e = muted_lists(spark, sf)
    return C.mute_plan(e, e.where("kind = 'item'").groupBy("doc").agg(F.max(F.col("source_start") + F.col("length")).alias("duration")))


Q["k13_mute_plan"], O["k13_mute_plan"] = k13, MUTED + """, g AS (SELECT *, max(e) OVER (PARTITION BY doc) AS dur, min(CASE WHEN text <> '' THEN s END) OVER (PARTITION BY doc ORDER BY s RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ahead FROM it WHERE doc NOT IN (SELECT doc FROM rf)),
st AS (SELECT doc, s, dur, CASE WHEN text <> '' AND e > least(s + 1400, coalesce(ahead, s + 1400)) + 1 THEN least(s + 1400, coalesce(ahead, s + 1400)) ELSE e END AS stop FROM g WHERE muted),
sp AS (SELECT doc, greatest(s - 100, 0) AS a, least(stop + 100, dur) AS b FROM st WHERE least(stop + 100, dur) > greatest(s - 100, 0)),
m0 AS (SELECT *, max(b) OVER (PARTITION BY doc ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM sp),
m1 AS (SELECT *, sum(CASE WHEN r IS NULL OR a > r THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY a, b) AS k FROM m0)
SELECT doc, min(a) AS start, max(b) AS "end" FROM m1 GROUP BY doc, k"""


def transcripts(spark, sf):
    """Users' events as tokens, five to a sentence; some transcripts have a token without end, some step back in time."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    p = points(spark, sf).withColumns({"n": F.row_number().over(w) - 1, "zero": F.min("t").over(Window.partitionBy("user_id"))})
    u, k = F.col("user_id"), F.col("event_id")
    t = F.col("t") - F.col("zero") - F.when((u % 9 == 4) & (k % 29 == 0), 10 * 86_400_000).otherwise(0) + 3_600_000
    return p.select(u.alias("doc"), F.floor(F.col("n") / 5).alias("sent"), F.col("n").cast("long").alias("token"), t.alias("t"), F.when(~((u % 8 == 3) & (k % 17 == 0)), t + k % 400 * MINUTE).alias("e"), F.concat(F.lit(" "), "event_type").alias("w"), F.format_string("S%d", k % 2).alias("speaker"))


TRANSCRIPT = EV + """, n0 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS n, min(t) OVER (PARTITION BY user_id) AS zero FROM ev),
n1 AS (SELECT user_id AS doc, n // 5 AS sent, n AS token, t - zero - CASE WHEN user_id % 9 = 4 AND event_id % 29 = 0 THEN 864000000 ELSE 0 END + 3600000 AS t, event_id, event_type FROM n0),
tk AS (SELECT doc, sent, token, t, CASE WHEN NOT (doc % 8 = 3 AND event_id % 17 = 0) THEN t + event_id % 400 * 60000 END AS e, ' ' || event_type AS w, 'S' || (event_id % 2) AS speaker FROM n1),
bad AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY sent, token) AS k FROM (SELECT doc, sent, token, CASE WHEN e IS NULL THEN 'no end' WHEN t < lag(t) OVER (PARTITION BY doc ORDER BY sent, token) THEN 'starts before the token ahead' END AS reason FROM tk) WHERE reason IS NOT NULL)"""


def k17r(spark, sf):
    return C.transcript_refusals(transcripts(spark, sf))


Q["k17_refusals"], O["k17_refusals"] = k17r, TRANSCRIPT + " SELECT doc, sent, token, reason FROM bad WHERE k = 1"


def k17(spark, sf):
    """The untouched edit lists of the transcripts that can be read, an hour longer than their words."""
    t = transcripts(spark, sf)
    made = C.from_transcript(t, t.groupBy("doc").agg((F.max("e") + 60 * MINUTE).alias("duration")))
    return made.select("doc", "pos", "kind", "speaker", "source_start", "length", "text")


Q["k17_from_transcript"], O["k17_from_transcript"] = k17, TRANSCRIPT + """, g AS (SELECT *, coalesce(max(e) OVER (PARTITION BY doc ORDER BY sent, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached, coalesce(lag(sent) OVER (PARTITION BY doc ORDER BY sent, token) <> sent, true) AS opens FROM tk WHERE doc NOT IN (SELECT doc FROM bad)),
r AS (SELECT doc, sent, token, 0 AS part, 'paragraph' AS kind, speaker, NULL::BIGINT AS source_start, NULL::BIGINT AS length, NULL AS text FROM g WHERE opens UNION ALL SELECT doc, sent, token, 1, 'item', NULL, reached, t - reached, '' FROM g WHERE t > reached
 UNION ALL SELECT doc, sent, token, 2, 'item', NULL, t, e - t, w FROM g UNION ALL SELECT doc, max(sent) + 1, max(token), 3, 'item', NULL, max(e), 3600000, '' FROM g GROUP BY doc)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY sent, token, part) - 1 AS pos, kind, speaker, source_start, length, text FROM r"""


def s6(spark, sf):
    """Conversations as JSON transcripts, some broken: what is read of each, its recording beside it, or why it isn't."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").cast("double").alias("start"), (F.col("turn") + 0.5).alias("end"), F.col("role").alias("speaker"), "text"))).alias("s"))
    k = F.col("conv_id")
    whole = F.to_json(F.struct(F.concat(F.lit("/old/place/"), k.cast("string"), F.lit(".mov")).alias("audio"), F.col("s").alias("sentences")))
    json = F.when(k % 7 == 3, F.concat(F.lit("["), whole, F.lit("]"))).when(k % 7 == 4, F.substr(whole, F.lit(1), F.length(whole) - 9)).when(k % 7 == 5, F.lit('{"audio":"x.mov"}')).otherwise(whole)
    good, odd = D.read_transcripts(c.select(k.alias("doc"), F.concat(F.lit("/new/"), (k % 3).cast("string"), F.lit("/t.json")).alias("path"), json.alias("json")))
    rows = good.select("doc", "audio", F.size("sentences").cast("long").alias("n"), F.aggregate("sentences", F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"])).alias("letters"))
    return rows.unionByName(odd, allowMissingColumns=True)


Q["s6_read_json"], O["s6_read_json"] = s6, """SELECT conv_id AS doc, CASE WHEN conv_id % 7 IN (3, 4, 5) THEN NULL ELSE '/new/' || (conv_id % 3) || '/' || conv_id || '.mov' END AS audio, CASE WHEN conv_id % 7 NOT IN (3, 4, 5) THEN count(*) END AS n, CASE WHEN conv_id % 7 NOT IN (3, 4, 5) THEN CAST(sum(length(text)) AS BIGINT) END AS letters,
 CASE conv_id % 7 WHEN 3 THEN 'no object' WHEN 4 THEN 'no JSON, or fields of other kinds' WHEN 5 THEN 'no list of sentences' END AS reason FROM conversations GROUP BY conv_id"""


def s8(spark, sf):
    """Edit lists written as versioned JSON and read back: sources that no item plays from are left out, later versions and other files refused."""
    e = lists(spark, sf).drop("event_id")
    docs = points(spark, sf).select(F.col("user_id").alias("doc")).distinct()
    sources = docs.select("doc", F.explode(F.array(F.lit("0"), F.lit("1"))).alias("source")).withColumn("path", F.concat(F.lit("/m/"), "source"))
    written = D.write_edit_lists(e, sources, docs.select("doc", F.lit("SPEAKER_00").alias("label"), F.concat(F.lit("n"), F.col("doc").cast("string")).alias("name")))
    d = F.col("doc")
    given = F.when(d % 10 == 1, F.replace("json", F.lit('"version":1'), F.lit('"version":2'))).when(d % 10 == 2, F.replace("json", F.lit("edit-list"), F.lit("cue-list"))).otherwise(F.col("json"))
    read = D.parsed_edit_lists(written.withColumn("json", given))
    texts = F.md5(F.array_join(F.transform("content", lambda x: F.coalesce(x["text"], x["speaker"])), "|"))
    n = F.when(F.col("content").isNotNull(), F.size("content").cast("long"))
    return read.select("doc", F.array_join(F.map_keys("sources"), ",").alias("sources"), F.element_at("names", "SPEAKER_00").alias("name"), n.alias("n"), texts.alias("digest"), "reason")


Q["s8_edit_lists"], O["s8_edit_lists"] = s8, LISTS + """ SELECT doc, CASE WHEN doc % 10 NOT IN (1, 2) THEN '0' END AS sources, CASE WHEN doc % 10 NOT IN (1, 2) THEN 'n' || doc END AS name, CASE WHEN doc % 10 NOT IN (1, 2) THEN count(*) END AS n,
 CASE WHEN doc % 10 NOT IN (1, 2) THEN md5(string_agg(coalesce(text, speaker), '|' ORDER BY pos)) END AS digest, CASE doc % 10 WHEN 1 THEN 'a later version' WHEN 2 THEN 'no edit list' END AS reason FROM l GROUP BY doc"""


def j13(spark, sf):
    """Confidence of each word of the edited lists: the original's at the same start and length with the same text (the last of several); 1 for what was edited; unknown stays unknown."""
    words, tokens_ = edited(spark, sf)
    c = lists(spark, sf).where(E.is_word()).select("doc", "pos", "source_start", "length", "text", F.when(F.col("event_id") % 4 != 0, F.col("confidence")).alias("c"))
    last = c.groupBy("doc", F.col("source_start").alias("start"), "length", "text").agg(F.max_by(F.struct("c"), "pos").alias("m"))
    w = words.withColumn("length", F.col("end") - F.col("start"))
    j = w.join(last, ["doc", "start", "length", "text"], "left")
    return j.select("doc", "word", F.when(F.col("m").isNull(), F.lit(1.0)).otherwise(F.col("m.c")).alias("confidence"))


Q["j13_confidences"], O["j13_confidences"] = j13, LISTS + """, o AS (SELECT doc, source_start AS s, length, text, arg_max({'c': CASE WHEN event_id % 4 <> 0 THEN confidence END}, pos) AS m FROM l WHERE kind = 'item' AND text <> '' GROUP BY ALL),
w AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY pos) - 1 AS word, CASE WHEN event_id % 23 = 0 THEN source_start + 30000 ELSE source_start END AS s, length, CASE WHEN event_id % 17 = 0 THEN text || '!' ELSE text END AS text FROM l WHERE kind = 'item' AND text <> '' AND event_id % 19 <> 0)
SELECT w.doc, word, CASE WHEN o.m IS NULL THEN 1.0::DOUBLE ELSE o.m.c END AS confidence FROM w LEFT JOIN o ON o.doc = w.doc AND o.s = w.s AND o.length = w.length AND o.text = w.text"""


def a33(spark, sf):
    """Documents dealt into pairs of their language by a hash of their number, and whether both are of one source.

    Ranks are counts of hash ranges and ranks inside them, so that a language isn't one task's.
    """
    h = F.md5(F.col("doc_id").cast("string"))
    d = table(spark, sf, "documents").select("lang", "doc_id", "source", h.alias("h")).withColumn("part", F.substring("h", 1, 3))
    parts = d.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("lang", "part").orderBy("h", "doc_id")) - 1
    r = d.join(parts.select("lang", "part", before.alias("b")), ["lang", "part"]).withColumn("r", own + F.col("b"))
    pair = r.groupBy("lang", F.floor(F.col("r") / 2).alias("pair")).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("n"), (F.min("source") == F.max("source")).alias("same"))
    return pair.where("n = 2").select("lang", "pair", "a", "b", "same")


Q["a33_stratified_pairs"], O["a33_stratified_pairs"] = a33, "WITH d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r FROM documents) SELECT lang, r // 2 AS pair, min(doc_id) AS a, max(doc_id) AS b, min(source) = max(source) AS same FROM d GROUP BY lang, r // 2 HAVING count(*) = 2"


def k9(spark, sf):
    """Documents without looping lines and without runs of five or more equal lines that loop together: what is kept, and each loop with its words."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    t = tokens(spark, sf).select("doc_id", "pos", "words")
    said = t.where(F.size("words") > 0).withColumn("key", F.array_join("words", " "))
    said = said.withColumn("g", F.sum(F.when(F.lag("key").over(w) == F.col("key"), 0).otherwise(1)).over(w))
    runs = said.groupBy("doc_id", "g").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("n"), F.first("words").alias("w"))
    size = F.col("n") * F.size("w")
    runs = runs.where((F.col("n") >= 5) & (size > 6) & (F.size(F.array_distinct("w")) <= F.greatest(F.lit(2), F.floor(size / 3)))).select("doc_id", "first", "last", size.alias("words"))
    reach = t.select("doc_id", "pos", "words", F.lit(1).alias("o")).unionByName(runs.select("doc_id", F.col("first").alias("pos"), F.lit(0).alias("o"), F.col("last").alias("end")), allowMissingColumns=True)
    inside = F.last("end", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos", "o"))
    left = reach.withColumn("reached", inside).where("o = 1 AND (reached IS NULL OR pos > reached)")
    single = left.where(X.is_loop(F.col("words"))).select("doc_id", F.col("pos").alias("first"), F.col("pos").alias("last"), F.size("words").alias("words"))
    unclear = runs.unionByName(single).groupBy("doc_id").agg(F.count(F.lit(1)).alias("loops"), F.sum("words").cast("long").alias("unclear"), F.max(F.col("last") - F.col("first") + 1).cast("long").alias("longest"))
    kept = left.where(~X.is_loop(F.col("words"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.size("words")).alias("kept"))
    return unclear.join(kept, "doc_id", "full_outer").na.fill(0)


Q["k9_without_loops"], O["k9_without_loops"] = k9, TOK + """, k AS (SELECT doc_id, pos, words, array_to_string(words, ' ') AS key FROM w WHERE len(words) > 0),
g AS (SELECT *, CASE WHEN lag(key) OVER (PARTITION BY doc_id ORDER BY pos) = key THEN 0 ELSE 1 END AS f FROM k), h AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM g),
runs AS (SELECT doc_id, min(pos) AS first, max(pos) AS last, count(*) * len(any_value(words)) AS n FROM h GROUP BY doc_id, g HAVING count(*) >= 5 AND count(*) * len(any_value(words)) > 6 AND len(list_distinct(any_value(words))) <= greatest(2, count(*) * len(any_value(words)) // 3)),
l AS (SELECT w.* , len(words) > 6 AND len(list_distinct(words)) <= greatest(2, len(words) // 3) AS loop FROM w WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = w.doc_id AND w.pos BETWEEN r.first AND r.last)),
u AS (SELECT doc_id, count(*) AS loops, CAST(sum(n) AS BIGINT) AS unclear, CAST(max(len) AS BIGINT) AS longest FROM (SELECT doc_id, n, last - first + 1 AS len FROM runs UNION ALL SELECT doc_id, len(words), 1 FROM l WHERE loop) GROUP BY 1),
sk AS (SELECT doc_id, count(*) AS lines, CAST(sum(len(words)) AS BIGINT) AS kept FROM l WHERE NOT loop GROUP BY 1)
SELECT doc_id, coalesce(loops, 0) AS loops, coalesce(unclear, 0) AS unclear, coalesce(longest, 0) AS longest, coalesce(lines, 0) AS lines, coalesce(kept, 0) AS kept FROM u FULL JOIN sk USING (doc_id)"""


def k5(spark, sf):
    """Turns as sentences of at most twelve words and four seconds, cut at punctuation and at pauses of a second."""
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), F.posexplode(F.regexp_extract_all("text", F.lit(r"[ \n\t]*[^ \n\t.!?]+|[.!?]"), F.lit(0))).alias("k", "w"))
    t = F.col("k") * 200 + F.floor(F.col("k") / 11) * 1500
    tokens_ = c.select("doc", F.col("k").cast("long").alias("token"), t.alias("t"), (t + 150).alias("e"), "w")
    s = C.sentences_of(tokens_, "doc", 12, 1000, 4000)
    g = s.groupBy("doc", "sent").agg(F.min("t").alias("start"), F.max("e").alias("end"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("token", "w"))).alias("a"))
    return g.select("doc", "sent", "start", "end", "n", F.md5(F.array_join(F.transform("a", lambda x: x["w"]), "")).alias("digest"))


Q["k5_tokens_to_sentences"], O["k5_tokens_to_sentences"] = k5, r"""WITH RECURSIVE p AS (SELECT conv_id * 1000 + turn AS doc, regexp_extract_all(text, '[ \n\t]*[^ \n\t.!?]+|[.!?]') AS w FROM conversations),
k AS (SELECT doc, i - 1 AS k, w[i] AS w, (i - 1) * 200 + (i - 1) // 11 * 1500 AS t FROM p, unnest(range(1, len(w) + 1)) AS u(i)),
f AS (SELECT *, lead(w) OVER x AS nx, lead(t) OVER x AS nt FROM k WINDOW x AS (PARTITION BY doc ORDER BY k)),
h AS (SELECT *, regexp_matches(w, '[!?]') OR (contains(w, '.') AND (nx IS NULL OR contains(nx, ' '))) OR coalesce(nt - t - 150 >= 1000, false) AS hard FROM f),
r AS (SELECT doc, k, 0::BIGINT AS sent, CASE WHEN contains(w, ' ') THEN 1 ELSE 0 END AS n, t AS t0, hard OR coalesce(CASE WHEN contains(w, ' ') THEN 1 ELSE 0 END + CASE WHEN contains(nx, ' ') THEN 1 ELSE 0 END > 12, false) AS ends FROM h WHERE k = 0
 UNION ALL SELECT doc, k, sent, n, t0, hard OR (nx IS NOT NULL AND n + CASE WHEN contains(nx, ' ') THEN 1 ELSE 0 END > 12) OR t + 150 - t0 >= 4000
 FROM (SELECT h.*, CASE WHEN ends THEN sent + 1 ELSE sent END AS sent, CASE WHEN ends THEN 0 ELSE n END + CASE WHEN contains(h.w, ' ') THEN 1 ELSE 0 END AS n, CASE WHEN ends THEN h.t ELSE t0 END AS t0 FROM r JOIN h ON h.doc = r.doc AND h.k = r.k + 1))
SELECT doc, sent, min(t) AS start, max(t + 150) AS "end", count(*) AS n, md5(string_agg(w, '' ORDER BY k)) AS digest FROM r JOIN h USING (doc, k) GROUP BY 1, 2"""
