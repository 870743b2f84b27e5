"""Queries that shape tokens, join spans by overlap, compare readings and normalise text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Window, functions as F, types as T

from ..functions import text as X
from ..operators import intervals as I, kernels
from .queries_text import TOK, WORD_SQL, table, tokens
from .queries_time import ALL, EV, MINUTE, others, points, spans, turns

Q, O = {}, {}


def p4(spark, sf):
    """Token times to three places (start, end no earlier), confidence only of engines that measure it."""
    w = points(spark, sf).select("event_id", (F.col("t") / 1000).alias("a"), ((F.col("t") + F.floor(F.col("value") * 10) - 5) / 1000).alias("b"), "value", "event_type")
    a = F.round("a", 3)
    return w.select("event_id", a.alias("t"), F.greatest(F.round("b", 3), a).alias("e"), F.when(F.col("event_type").isin("click", "view"), F.floor(F.col("value") * 10) / 1000).alias("c"))


Q["p4_token_projection"], O["p4_token_projection"] = p4, EV + "SELECT event_id, round(t / 1000, 3) AS t, greatest(round((t + floor(value * 10) - 5) / 1000, 3), round(t / 1000, 3)) AS e, CASE WHEN event_type IN ('click', 'view') THEN floor(value * 10) / 1000 END AS c FROM ev"


def p5(spark, sf):
    """Turns with their speaker's place, and each conversation's speakers beside."""
    c = table(spark, sf, "conversations")
    names = c.groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("speakers"))
    return c.join(names, "conv_id").select("conv_id", "turn", (F.array_position("speakers", F.col("role")) - 1).alias("speaker"), F.to_json(F.struct("speakers")).alias("keys"))


Q["p5_with_speakers"], O["p5_with_speakers"] = p5, """WITH n AS (SELECT conv_id, list_sort(list(DISTINCT role)) AS s FROM conversations GROUP BY 1)
SELECT conv_id, turn, CAST(list_position(s, role) - 1 AS BIGINT) AS speaker, '{"speakers":["' || array_to_string(s, '","') || '"]}' AS keys FROM conversations JOIN n USING (conv_id)"""


def p7(spark, sf):
    """The label at a speaker's index; null where there is no index or no such label."""
    c = table(spark, sf, "conversations")
    names = c.groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("s"))
    at = F.when(F.col("turn") % 4 != 3, (F.col("turn") % 3).cast("int"))
    return c.join(names, "conv_id").select("conv_id", "turn", F.get("s", at).alias("label"))


Q["p7_speaker_label"], O["p7_speaker_label"] = p7, "WITH n AS (SELECT conv_id, list_sort(list(DISTINCT role)) AS s FROM conversations GROUP BY 1) SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 THEN s[turn % 3 + 1] END AS label FROM conversations JOIN n USING (conv_id)"


def p13(spark, sf):
    share = X.script_share(F.col("text"), "éèêëàâçîïôûùäöüßñáíóú")
    engine = F.when(F.col("doc_id") % 3 == 0, "parakeet").otherwise("whisper")
    return table(spark, sf, "documents").select("doc_id", X.language_tag(share, engine).alias("tag"))


Q["p13_language_tag"], O["p13_language_tag"] = p13, r"""WITH a AS (SELECT doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n, length(regexp_replace(text, '[^éèêëàâçîïôûùäöüßñáíóú]', '', 'g')) AS k FROM documents), b AS (SELECT doc_id, CASE WHEN n > 0 THEN k / n ELSE 0.0::DOUBLE END AS s FROM a)
SELECT doc_id, CASE WHEN s >= 0.5 THEN 'urdu' WHEN doc_id % 3 = 0 THEN 'english' WHEN s >= 0.05 THEN 'mixed' ELSE 'english' END AS tag FROM b"""


def p14(spark, sf):
    """Run modes: progress is reported unless the engine reads a file at once; speech is cut first only for whisper without a start."""
    p = points(spark, sf)
    return p.select("event_id", ((F.col("event_type") != "view") | (F.col("value") > 50)).alias("reports"), ((F.col("event_type") == "click") & (F.col("value") < 30)).alias("cuts"))


Q["p14_run_modes"], O["p14_run_modes"] = p14, "SELECT event_id, event_type <> 'view' OR value > 50 AS reports, event_type = 'click' AND value < 30 AS cuts FROM events"


def p16(spark, sf):
    """Title and date of a file name: a stamp only if it is a day of the calendar; the rest without its ending."""
    stamp = F.concat(F.year("o_orderdate").cast("string"), F.lit("-"), F.lpad((F.col("o_orderkey") % 14).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("o_orderkey") % 33).cast("string"), 2, "0"))
    name = F.concat(F.lit("talk "), stamp, F.lit(" "), "o_orderpriority", F.lit(".mp4"))
    found = table(spark, sf, "orders").select("o_orderkey", name.alias("name")).withColumn("stamp", F.regexp_extract("name", r"\d{4}-\d{2}-\d{2}", 0))
    day = F.try_to_timestamp("stamp", F.lit("yyyy-MM-dd")).cast("date")
    rest = F.regexp_replace("name", r"\.[A-Za-z0-9]{1,5}$", "")
    title = F.when(day.isNotNull(), F.trim(F.regexp_replace(F.replace(rest, F.col("stamp"), F.lit(" ")), " +", " "))).otherwise(rest)
    return found.select("o_orderkey", day.cast("string").alias("day"), title.alias("title"))


Q["p16_title"], O["p16_title"] = p16, r"""WITH n AS (SELECT o_orderkey, printf('%d-%02d-%02d', year(o_orderdate), o_orderkey % 14, o_orderkey % 33) AS s, o_orderpriority AS p FROM orders)
SELECT o_orderkey, CAST(TRY_CAST(s AS DATE) AS VARCHAR) AS day, CASE WHEN TRY_CAST(s AS DATE) IS NOT NULL THEN 'talk ' || p ELSE 'talk ' || s || ' ' || p END AS title FROM n"""


def p20(spark, sf):
    """Sentences from words: sorted by start (equal starts in their order), shifted, rounded, ends no earlier than starts."""
    word = F.struct("l_quantity", "l_linenumber", "l_partkey", "l_extendedprice", F.col("l_discount").alias("d"))
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(word)).alias("w"))
    shift = (F.col("l_orderkey") % 100).cast("double")
    each = g.select("l_orderkey", F.posexplode("w").alias("i", "x"), shift.alias("s"))
    t = F.round(F.col("x.l_quantity") + F.col("s"), 3)
    return each.select("l_orderkey", "i", t.alias("t"), F.greatest(t, F.round(F.col("x.l_quantity") + F.col("s") + F.col("x.d") - 0.05, 3)).alias("e"))


Q["p20_sentences_from"], O["p20_sentences_from"] = p20, "WITH w AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey, l_extendedprice, l_discount) - 1 AS i, l_quantity AS q, l_orderkey % 100 AS s, l_discount AS d FROM lineitem) SELECT l_orderkey, CAST(i AS INTEGER) AS i, round(q + s, 3) AS t, greatest(round(q + s, 3), round(q + s + d - 0.05::DOUBLE, 3)) AS e FROM w"


def p22(spark, sf):
    """Where a recording's media is: an absolute path, else beside it if there, else in the work folder if there, else beside."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    beside = table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("b"))
    work = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("w"))
    j = o.join(beside, o.o_custkey == F.col("b"), "left").join(work, o.o_custkey == F.col("w"), "left")
    return j.select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "absolute").when(F.col("b").isNotNull(), "beside").when(F.col("w").isNotNull(), "work").otherwise("beside?").alias("media"))


Q["p22_media_of"], O["p22_media_of"] = p22, "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'absolute' WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) THEN 'beside' WHEN o_custkey IN (SELECT s_suppkey FROM supplier) THEN 'work' ELSE 'beside?' END AS media FROM orders"


def p23(spark, sf):
    ok = (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O") & (F.col("l_quantity") >= 16) & (F.col("l_tax") < 0.05)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (~ok).alias("convert"))


Q["p23_needs_conversion"], O["p23_needs_conversion"] = p23, "SELECT l_orderkey, l_linenumber, l_partkey, NOT (l_returnflag = 'N' AND l_linestatus = 'O' AND l_quantity >= 16 AND l_tax < 0.05) AS convert FROM lineitem"


def j4(spark, sf):
    """Speaker of most shared time for each point's five minutes; of equals the least."""
    items = others(spark, sf).select("user_id", F.col("event_id").alias("item"), F.col("t").alias("start"), (F.col("t") + 5 * MINUTE).alias("end"))
    u = I.binned(turns(spark, sf), "start", "end", 60 * MINUTE).select("user_id", "event_id", "speaker", F.col("start").alias("b0"), F.col("end").alias("b1"), "__bin")
    shared = I.overlap(F.col("start"), F.col("end"), F.col("b0"), F.col("b1"))
    met = I.binned(items, "start", "end", 60 * MINUTE).join(u, ["user_id", "__bin"]).select("item", "event_id", "speaker", shared.alias("shared")).where("shared > 0").distinct()
    total = met.groupBy("item", "speaker").agg(F.sum("shared").alias("shared"))
    return total.groupBy("item").agg(F.max(F.struct("shared", (-F.col("speaker")).alias("s"))).alias("b")).select("item", (-F.col("b.s")).alias("speaker"), "b.shared")


Q["j4_overlap_label"], O["j4_overlap_label"] = j4, EV + """, x AS (SELECT p.event_id AS item, u.speaker, sum(least(p.t + 300000, u.e) - greatest(p.t, u.s)) AS shared FROM pts p JOIN turns u ON u.user_id = p.user_id AND u.s < p.t + 300000 AND u.e > p.t GROUP BY ALL)
SELECT item, speaker, CAST(shared AS BIGINT) AS shared FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY shared DESC, speaker) AS k FROM x WHERE shared > 0) WHERE k = 1"""


def j9(spark, sf):
    """What of each purchase's hours the other turns of its user leave uncovered: from the end of those that run into it from before, to the first that starts later inside."""
    t = spans(spark, sf).join(points(spark, sf).select("event_id", "event_type"), "event_id")
    ask = t.where("event_type = 'purchase'").select("user_id", "event_id", F.col("start").alias("lo0"), (F.col("start") + 1440 * MINUTE).alias("hi0"))
    others_ = t.where("event_type <> 'purchase'").select("user_id", "start", "end")
    return I.uncovered(ask, others_, "user_id", "event_id").select("event_id", F.col("lo").alias("start_ms"), F.col("hi").alias("end_ms"))


Q["j9_unread"], O["j9_unread"] = j9, ALL.replace("WITH ", "WITH RECURSIVE ", 1) + """, a AS (SELECT turns.*, event_type FROM turns JOIN ev USING (event_id)), q AS (SELECT user_id, event_id, s AS lo0, s + 86400000 AS hi0 FROM a WHERE event_type = 'purchase'), o AS (SELECT user_id, s, e FROM a WHERE event_type <> 'purchase'),
r AS (SELECT user_id, event_id, hi0, lo0 AS lo FROM q UNION SELECT r.user_id, r.event_id, hi0, o.e FROM r JOIN o ON o.user_id = r.user_id AND o.s <= r.lo AND r.lo < o.e),
l AS (SELECT user_id, event_id, hi0, max(lo) AS lo FROM r GROUP BY 1, 2, 3)
SELECT event_id, lo AS start_ms, least(hi0, coalesce((SELECT min(s) FROM o WHERE o.user_id = l.user_id AND o.s > l.lo AND o.s < l.hi0), hi0)) AS end_ms FROM l WHERE lo < hi0"""


def j11(spark, sf):
    """Points that start in a turn (half a second of tolerance before it), and those that only overlap its edge."""
    t = turns(spark, sf).select("user_id", F.col("event_id").alias("turn"), (F.col("start") - 1000).alias("start"), "end")
    left = others(spark, sf).withColumn("__bin", F.floor(F.col("t") / (60 * MINUTE)))
    right = I.binned(t, "start", "end", 60 * MINUTE)
    met = left.join(right, ["user_id", "__bin"]).where((F.col("t") >= F.col("start")) & (F.col("t") < F.col("end")))
    return met.select("turn", "event_id", (F.col("t") >= F.col("start") + 500).alias("inside"))


Q["j11_entry_range"], O["j11_entry_range"] = j11, EV + "SELECT u.event_id AS turn, p.event_id, p.t >= u.s - 500 AS inside FROM pts p JOIN turns u ON u.user_id = p.user_id AND p.t >= u.s - 1000 AND p.t < u.e"


def j15(spark, sf):
    """Types of the points whose middle (a minute on) lies in a turn, in order."""
    mid = others(spark, sf).withColumn("m", F.col("t") + MINUTE)
    t = turns(spark, sf).select("user_id", F.col("event_id").alias("turn"), "start", "end")
    met = mid.withColumn("__bin", F.floor(F.col("m") / (60 * MINUTE))).join(I.binned(t, "start", "end", 60 * MINUTE), ["user_id", "__bin"]).where("m >= start AND m < end")
    g = met.groupBy("turn").agg(F.sort_array(F.collect_list(F.struct("t", "event_id", "event_type"))).alias("a"))
    return g.select("turn", F.array_join(F.transform("a", lambda x: x["event_type"]), " ").alias("original"))


Q["j15_original_text"], O["j15_original_text"] = j15, EV + "SELECT u.event_id AS turn, string_agg(event_type, ' ' ORDER BY p.t, p.event_id) AS original FROM pts p JOIN turns u ON u.user_id = p.user_id AND p.t + 60000 >= u.s AND p.t + 60000 < u.e GROUP BY 1"


def j16(spark, sf):
    """Turns by what stands in them, a minute of tolerance: an error is listed, else a purchase censored, else anything other, else dropped."""
    t = turns(spark, sf).select("user_id", F.col("event_id").alias("turn"), (F.col("start") - MINUTE).alias("start"), (F.col("end") + MINUTE).alias("end"))
    left = others(spark, sf).withColumn("__bin", F.floor(F.col("t") / (60 * MINUTE)))
    met = left.join(I.binned(t, "start", "end", 60 * MINUTE), ["user_id", "__bin"]).where("t >= start AND t < end")
    rank = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    best = met.groupBy("turn").agg(F.min(rank).alias("r"))
    kinds = F.array(F.lit("listed"), F.lit("censored"), F.lit("other"))
    return t.select("turn").join(best, "turn", "left").select("turn", F.coalesce(F.get(kinds, F.col("r")), F.lit("dropped")).alias("kind"))


Q["j16_classify"], O["j16_classify"] = j16, EV + """, r AS (SELECT u.event_id AS turn, min(CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END) AS r FROM pts p JOIN turns u ON u.user_id = p.user_id AND p.t >= u.s - 60000 AND p.t < u.e + 60000 GROUP BY 1)
SELECT event_id AS turn, CASE r WHEN 0 THEN 'listed' WHEN 1 THEN 'censored' WHEN 2 THEN 'other' ELSE 'dropped' END AS kind FROM turns LEFT JOIN r ON turn = event_id"""


def j17(spark, sf):
    """For each purchase's span the token (another event's span) it shares most time with; without one, of those whose middle is within six hours the one that starts nearest."""
    t = spans(spark, sf).join(points(spark, sf).select("event_id", "event_type"), "event_id")
    ask = t.where("event_type = 'purchase'").select("user_id", "event_id", "start", (F.col("start") + 10 * MINUTE).alias("end"))
    tokens_ = t.where("event_type <> 'purchase'").select("user_id", F.col("event_id").alias("token"), "start", (F.col("start") + MINUTE * (1 + F.col("event_id") % 90)).alias("end"))
    return I.nearest_token(ask, tokens_, "user_id", "event_id", 360 * MINUTE).select("event_id", "token", "shared")


Q["j17_nearest_token"], O["j17_nearest_token"] = j17, EV + """, q AS (SELECT user_id, event_id, t AS s, t + 600000 AS e FROM ev WHERE event_type = 'purchase'), k AS (SELECT user_id, event_id AS token, t AS s, t + 60000 * (1 + event_id % 90) AS e FROM ev WHERE event_type <> 'purchase'),
p AS (SELECT q.event_id, token, least(q.e, k.e) - greatest(q.s, k.s) AS shared, abs((k.s + k.e) - (q.s + q.e)) AS m2, abs(k.s - q.s) AS d FROM q JOIN k USING (user_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY CASE WHEN shared > 0 THEN 0 ELSE 1 END, CASE WHEN shared > 0 THEN -shared ELSE d END, token) AS n FROM p WHERE shared > 0 OR m2 <= 2 * 21600000)
SELECT event_id, token, greatest(shared, 0) AS shared FROM r WHERE n = 1"""


def j21(spark, sf):
    """A review taken up again on a transcript made anew: spans found within a tolerance keep flags and speaker, checks only if the words are the same; lost: checks dropped.

    The earlier review lacks a third of the turns; of the rest every seventh was heard otherwise.
    """
    t = spans(spark, sf)
    words = lambda odd: F.md5(F.concat(F.lit("w"), (F.col("event_id") % 97).cast("string"), F.when(odd, "x").otherwise("")))
    fresh = t.select("user_id", F.col("event_id").alias("seg"), "start", "end", words(F.lit(False)).alias("words_hash"))
    k = F.col("event_id")
    saved = t.where("event_id % 3 <> 1").select(
        "user_id", k.alias("old"), (F.col("start") + k % 90).alias("start"), (F.col("end") - k % 70).alias("end"), F.when(k % 4 != 0, "checked").otherwise("unchecked").alias("state"),
        F.when(k % 5 == 0, F.array(F.lit("noise"))).otherwise(F.array().cast("array<string>")).alias("flags"), (k % 3).alias("speaker"), F.when(k % 6 != 0, words(k % 7 == 0)).alias("words_hash"),
    )
    r, lost = I.resumed(fresh, saved, "user_id", 50)
    return r.select("user_id", "seg", "state", F.array_join("flags", ",").alias("flags"), "speaker").join(lost, "user_id")


Q["j21_resume_review"], O["j21_resume_review"] = j21, ALL + """, f AS (SELECT user_id, event_id AS seg, s, e, md5('w' || (event_id % 97)) AS h FROM turns),
o AS (SELECT user_id, event_id AS old, s + event_id % 90 AS s2, e - event_id % 70 AS e2, CASE WHEN event_id % 4 <> 0 THEN 'checked' ELSE 'unchecked' END AS state, CASE WHEN event_id % 5 = 0 THEN 'noise' ELSE '' END AS flags, event_id % 3 AS speaker,
  CASE WHEN event_id % 6 <> 0 THEN md5('w' || (event_id % 97) || CASE WHEN event_id % 7 = 0 THEN 'x' ELSE '' END) END AS h2 FROM turns WHERE event_id % 3 <> 1),
m AS (SELECT f.user_id, seg, h, o.*, row_number() OVER (PARTITION BY f.user_id, seg ORDER BY s2, old) AS n FROM f JOIN o ON o.user_id = f.user_id AND abs(s - s2) <= 50 AND abs(e - e2) <= 50),
k AS (SELECT *, coalesce(state = 'checked' AND h = h2, false) AS kept FROM m WHERE n = 1),
l AS (SELECT o.user_id, count(*) FILTER (state = 'checked' AND old NOT IN (SELECT old FROM k WHERE kept)) AS lost FROM o GROUP BY 1)
SELECT f.user_id, f.seg, CASE WHEN kept THEN 'checked' ELSE 'unchecked' END AS state, coalesce(k.flags, '') AS flags, k.speaker, lost FROM f LEFT JOIN k ON k.user_id = f.user_id AND k.seg = f.seg JOIN l ON l.user_id = f.user_id"""


def j24(spark, sf):
    """Neighbouring turns of a user that overlap, with the points of each that lie in what they share."""
    w = Window.partitionBy("user_id").orderBy("start", "event_id")
    t = turns(spark, sf).withColumns({"a": F.lead("start").over(w), "b": F.least("end", F.lead("end").over(w))}).where("a < b")
    shared = t.select("user_id", F.col("event_id").alias("turn"), F.col("a").alias("start"), F.col("b").alias("end"))
    left = others(spark, sf).withColumn("__bin", F.floor(F.col("t") / (60 * MINUTE)))
    n = left.join(I.binned(shared, "start", "end", 60 * MINUTE), ["user_id", "__bin"]).where("t >= start AND t < end").groupBy("turn").agg(F.count(F.lit(1)).alias("n"))
    return shared.join(n, "turn", "left").select("turn", (F.col("end") - F.col("start")).alias("ms"), F.coalesce("n", F.lit(0)).alias("n"))


Q["j24_shared"], O["j24_shared"] = j24, EV + """, a AS (SELECT user_id, event_id AS turn, lead(s) OVER w AS a, least(e, lead(e) OVER w) AS b FROM turns WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id))
SELECT turn, b - a AS ms, (SELECT count(*) FROM pts p WHERE p.user_id = a.user_id AND p.t >= a.a AND p.t < a.b) AS n FROM a WHERE a.a < a.b"""


def w9(spark, sf):
    """Long turns that begin within five minutes of the end before: begun no earlier than twice their user's median before their end."""
    w = Window.partitionBy("user_id").orderBy("start", "event_id")
    size = F.col("end") - F.col("start")
    t = spans(spark, sf).withColumns({"before": F.lag("end").over(w), "next": F.lead("start").over(w), "longest": 2 * F.percentile(size, F.lit(0.5)).over(Window.partitionBy("user_id"))})
    held = (F.abs(F.col("start") - F.col("before")) <= 300 * MINUTE) & (size > F.col("longest"))
    return t.select("event_id", F.when(F.coalesce(held, F.lit(False)), F.least(F.col("end") - F.col("longest"), F.coalesce("next", F.col("end")).cast("double"))).otherwise(F.col("start").cast("double")).alias("begin"))


Q["w9_pause_free_starts"], O["w9_pause_free_starts"] = w9, ALL + """, a AS (SELECT event_id, s, e, lag(e) OVER w AS b, lead(s) OVER w AS n, 2 * quantile_cont(CAST(e - s AS DOUBLE), 0.5::DOUBLE) OVER (PARTITION BY user_id) AS l FROM turns WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id))
SELECT event_id, CASE WHEN coalesce(abs(s - b) <= 18000000 AND e - s > l, false) THEN least(e - l, CAST(coalesce(n, e) AS DOUBLE)) ELSE CAST(s AS DOUBLE) END AS begin FROM a"""


def w15(spark, sf):
    """Of each line: its longest run of one word, and how often its first two words are said back to back at most."""
    t = tokens(spark, sf).where(F.size("words") > 0)
    return kernels.repeats_of_rows(t.select("doc_id", "pos", "words"), "words")


Q["w15_repeats"], O["w15_repeats"] = w15, TOK.replace("WITH ", "WITH RECURSIVE ", 1) + """, k AS (SELECT doc_id, pos, i AS k, words[i] AS w FROM w, unnest(range(1, len(words) + 1)) AS u(i)), g AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, pos, w ORDER BY k) AS g FROM k),
c AS (SELECT doc_id, pos, count(*) AS n FROM g GROUP BY doc_id, pos, w, g), l AS (SELECT doc_id, pos, max(n) AS longest FROM c GROUP BY 1, 2),
o AS (SELECT doc_id, pos, words, words[1:2] AS p, least(len(words), 2) AS n FROM w WHERE len(words) > 0),
r AS (SELECT doc_id, pos, 1::BIGINT AS i, 0::BIGINT AS run, 0::BIGINT AS best FROM o
 UNION ALL SELECT r.doc_id, r.pos, CASE WHEN words[i:i + n - 1] = p THEN i + n ELSE i + 1 END, CASE WHEN words[i:i + n - 1] = p THEN run + 1 ELSE 0 END, CASE WHEN words[i:i + n - 1] = p THEN greatest(best, run + 1) ELSE best END FROM r JOIN o USING (doc_id, pos) WHERE i + n - 1 <= len(words))
SELECT l.doc_id, l.pos, longest, (SELECT max(best) FROM r WHERE r.doc_id = l.doc_id AND r.pos = l.pos) AS phrase FROM l"""


def t5(spark, sf):
    """The next and previous error of each user from each purchase."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    error = F.when(F.col("event_type") == "error", F.col("event_id"))
    back = Window.partitionBy("user_id").orderBy(F.desc("t"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    p = points(spark, sf).withColumns({"previous": F.last(error, ignorenulls=True).over(w), "next": F.last(error, ignorenulls=True).over(back)})
    return p.where("event_type = 'purchase'").select("event_id", "previous", "next")


Q["t5_pass_order"], O["t5_pass_order"] = t5, EV + """, a AS (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id) AS previous,
first_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM ev) SELECT event_id, previous, next FROM a WHERE event_type = 'purchase'"""


def u1(spark, sf):
    """Two streams of a user as one, in order of start, with each row's place."""
    one = points(spark, sf).where("event_type = 'error'").select("user_id", "t", "event_id", F.lit("loop").alias("reason"))
    two = points(spark, sf).where("value < 3").select("user_id", "t", "event_id", F.lit("silence").alias("reason"))
    w = Window.partitionBy("user_id").orderBy("t", "event_id", "reason")
    return one.unionByName(two).select("user_id", "event_id", "reason", F.row_number().over(w).cast("long").alias("place"))


Q["u1_concat_streams"], O["u1_concat_streams"] = u1, EV + "SELECT user_id, event_id, reason, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id, reason) AS place FROM (SELECT *, 'loop' AS reason FROM ev WHERE event_type = 'error' UNION ALL SELECT *, 'silence' FROM ev WHERE value < 3)"


def k18(spark, sf):
    """Paragraphs (runs that a purchase opens) as lines of types; errors are muted to [bleep], a leading space kept."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    p = points(spark, sf).withColumn("paragraph", F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).over(w))
    word = F.when(F.col("event_type") == "error", F.lit(" [bleep]")).otherwise(F.concat(F.lit(" "), "event_type"))
    g = p.groupBy("user_id", "paragraph").agg(F.sort_array(F.collect_list(F.struct("t", "event_id", word.alias("w")))).alias("a"), F.min("t").alias("start_ms"))
    return g.select("user_id", "paragraph", "start_ms", F.array_join(F.transform("a", lambda x: x["w"]), "").alias("line"))


Q["k18_as_payload"], O["k18_as_payload"] = k18, EV + """, g AS (SELECT *, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS BIGINT) AS paragraph FROM ev)
SELECT user_id, paragraph, min(t) AS start_ms, string_agg(CASE WHEN event_type = 'error' THEN ' [bleep]' ELSE ' ' || event_type END, '' ORDER BY t, event_id) AS line FROM g GROUP BY 1, 2"""


def k21(spark, sf):
    """Points of each user's days dealt to its turns by the share of the day they take."""
    day = 1440 * MINUTE
    n = others(spark, sf).groupBy("user_id", F.floor(F.col("t") / day).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    t = turns(spark, sf).select("user_id", "event_id", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / day), F.floor(F.col("end") / day))).alias("day"))
    part = I.overlap(F.col("start"), F.col("end"), F.col("day") * day, (F.col("day") + 1) * day)
    return t.join(n, ["user_id", "day"]).groupBy("event_id").agg(F.round(F.sum(F.col("n") * part / day), 6).alias("words"))


Q["k21_share_in"], O["k21_share_in"] = k21, EV + """, n AS (SELECT user_id, t // 86400000 AS day, count(*) AS n FROM pts GROUP BY 1, 2), d AS (SELECT *, unnest(range(s // 86400000, e // 86400000 + 1)) AS day FROM turns)
SELECT event_id, round(sum(n * (least(e, (d.day + 1) * 86400000) - greatest(s, d.day * 86400000)) / 86400000), 6) AS words FROM d JOIN n ON n.user_id = d.user_id AND n.day = d.day GROUP BY 1"""


@F.pandas_udf(T.StringType())
def nfkc_folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def f2(spark, sf):
    """Titles in normal form: compatibility forms and case folded, letter variants one, letters, marks, digits and * only."""
    d = table(spark, sf, "documents").select("doc_id", nfkc_folded(F.split("text", "\n")[0]).alias("n"))
    one = F.translate("n", "يكهىة", "یکہیہ")
    return d.select("doc_id", F.regexp_replace(F.regexp_replace(one, "[\\u064B-\\u0652]", ""), r"[^\p{L}\p{M}\p{N}*]", "").alias("key"))


Q["f2_normalize"], O["f2_normalize"] = f2, r"""SELECT doc_id, regexp_replace(replace(lower(string_split(text, chr(10))[1]), 'ß', 'ss'), '[^\p{L}\p{M}\p{N}*]', '', 'g') AS key FROM documents"""


def f3(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.folded(F.col("text")).alias("folded"))


Q["f3_fold"], O["f3_fold"] = f3, r"SELECT conv_id, turn, lower(regexp_replace(text, '\p{M}', '', 'g')) AS folded FROM conversations"


@F.pandas_udf(T.StringType())
def composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def f4(spark, sf):
    """Words for comparison: composed, folded, without punctuation and signs. Every other turn comes decomposed."""
    apart = F.when(F.col("turn") % 2 == 0, F.translate("text", "é", "¤")).otherwise(F.col("text"))
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.replace(apart, F.lit("¤"), F.lit("e\u0301")).alias("text"))
    return c.select("conv_id", "turn", F.regexp_replace(X.folded(composed("text")), r"[\p{P}\p{S}]", "").alias("key"))


Q["f4_compare_form"], O["f4_compare_form"] = f4, r"SELECT conv_id, turn, regexp_replace(lower(regexp_replace(nfc_normalize(text), '\p{M}', '', 'g')), '[\p{P}\p{S}]', '', 'g') AS key FROM conversations"


def f5(spark, sf):
    """Direction of each line by its first letter: right to left if Arabic or Hebrew, none without letters."""
    from .queries_text import sentences

    first = F.regexp_extract("line", r"\p{L}", 0)
    return sentences(spark, sf).select("doc_id", "pos", F.when(first == "", None).when(F.rlike(first, F.lit("[\\u0590-\\u08FF]")), "rtl").otherwise("ltr").alias("direction"))


Q["f5_first_strong"], O["f5_first_strong"] = f5, TOK + r"SELECT doc_id, pos, CASE WHEN regexp_matches(line, '\p{L}') THEN CASE WHEN regexp_matches(regexp_extract(line, '\p{L}'), '[\x{0590}-\x{08FF}]') THEN 'rtl' ELSE 'ltr' END END AS direction FROM w"


def f6(spark, sf):
    """Pieces that are scored: letters and digits apart, per cent spelled, tags and fillers gone."""
    t = F.regexp_replace(F.regexp_replace(F.lower("text"), "<[^>]*>", " "), "%", " percent ")
    t = F.regexp_replace(F.regexp_replace(t, r"(\p{L})(\p{N})", "$1 $2"), r"(\p{N})(\p{L})", "$1 $2")
    w = F.filter(F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda x: ~x.isin("uh", "um", "hm"))
    return table(spark, sf, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.md5(F.array_join(w, " ")).alias("digest"))


Q["f6_pieces"], O["f6_pieces"] = f6, r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '<[^>]*>', ' ', 'g'), '%', ' percent ', 'g'), '(\p{L})(\p{N})', '\1 \2', 'g'), '(\p{N})(\p{L})', '\1 \2', 'g') AS t FROM documents),
b AS (SELECT doc_id, list_filter(regexp_extract_all(t, '[\p{L}\p{N}]+'), lambda x: x NOT IN ('uh', 'um', 'hm')) AS w FROM a) SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM b"""


def f15(spark, sf):
    """Content id: size, and the digest of both ends of a mebibyte (all of it, if no longer than both)."""
    return table(spark, sf, "documents").select("doc_id", X.content_id(F.encode("text", "UTF-8")).alias("content_id"))


Q["f15_content_id"], O["f15_content_id"] = f15, "SELECT doc_id, CAST(strlen(text) AS VARCHAR) || '-' || CASE WHEN strlen(text) <= 2097152 THEN sha256(text) ELSE sha256(from_hex(left(hex(encode(text)), 2097152) || right(hex(encode(text)), 2097152))) END AS content_id FROM documents"


def f16(spark, sf):
    """Seconds of stamps, by whole milliseconds."""
    d = table(spark, sf, "documents").select("doc_id", X.clock(F.col("doc_id") * 7919 * 13).alias("stamp"))
    return d.select("doc_id", (X.stamp_ms(F.col("stamp")) / 1000).alias("seconds"))


Q["f16_seconds"], O["f16_seconds"] = f16, "SELECT doc_id, doc_id * 7919 * 13 / 1000 AS seconds FROM documents"


def f17(spark, sf):
    """What one turn's text changes of the one before: the length of their common beginning and end, not overlapping."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text", F.lag("text").over(w).alias("b")).where("b IS NOT NULL")
    prefix, suffix = X.common_ends(F.col("text"), F.col("b"))
    return c.select("conv_id", "turn", prefix.cast("long").alias("prefix"), suffix.cast("long").alias("suffix"))


Q["f17_splice"], O["f17_splice"] = f17, """WITH c AS (SELECT conv_id, turn, string_split(text, '') AS x, lag(string_split(text, '')) OVER (PARTITION BY conv_id ORDER BY turn) AS y FROM conversations),
n AS (SELECT *, least(len(x), len(y)) AS n FROM c WHERE y IS NOT NULL),
p AS (SELECT *, coalesce(nullif(list_position([x[k] = y[k] for k in range(1, n + 1)], false), 0) - 1, n) AS p FROM n)
SELECT conv_id, turn, CAST(p AS BIGINT) AS prefix, CAST(coalesce(nullif(list_position([x[len(x) - k] = y[len(y) - k] for k in range(n - p)], false), 0) - 1, n - p) AS BIGINT) AS suffix FROM p"""


def f18(spark, sf):
    """Times of a corrected turn's words by their letters' share of its five seconds."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(X.words(F.col("text"))).alias("k", "w"))
    own = Window.partitionBy("conv_id", "turn")
    before = F.coalesce(F.sum(F.length("w")).over(own.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.select("conv_id", "turn", "k", F.floor(5000 * before / F.sum(F.length("w")).over(own)).alias("at_ms"))


Q["f18_correction"], O["f18_correction"] = f18, f"""WITH c AS (SELECT conv_id, turn, regexp_extract_all(text, '{WORD_SQL}') AS w FROM conversations), k AS (SELECT conv_id, turn, i - 1 AS k, length(w[i]) AS n FROM c, unnest(range(1, len(w) + 1)) AS u(i))
SELECT conv_id, turn, CAST(k AS INTEGER) AS k, CAST(floor(5000 * coalesce(sum(n) OVER (PARTITION BY conv_id, turn ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY conv_id, turn)) AS BIGINT) AS at_ms FROM k"""


def f21(spark, sf):
    """Texts that tell of memory that ran out."""
    return table(spark, sf, "conversations").select("conv_id", "turn", X.memory_failure(F.col("text")).alias("memory"))


Q["f21_memory_failure"], O["f21_memory_failure"] = f21, "SELECT conv_id, turn, regexp_matches(lower(text), 'out of memory|oom|cannot allocate|bad_alloc') AS memory FROM conversations"


def f22(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.safe_name(F.col("url")).alias("name"))


Q["f22_safe_name"], O["f22_safe_name"] = f22, r"SELECT page_id, regexp_replace(regexp_replace(url, '[^\p{L}\p{N}._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS name FROM pages"
