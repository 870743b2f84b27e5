"""Queries that check readings against each other: runs of words, corrections, readings by several engines."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as X
from ..operators import intervals as I, kernels
from ..operators.groups import spread_letters
from ..operators.review import within_edits
from .queries_text import TOK, WORD_SQL, table, tokens
from .queries_time import EV, MINUTE, others, points, spans, turns

Q, O = {}, {}


def a20_ngrams(spark, sf):
    """Runs of two and three words of a line that stand five times or more; documents are dealt out so that what a task counts before the shuffle stays in memory."""
    n = F.size("words")
    run = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice("words", i, k), " ")))
    docs = spread_letters(table(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id")
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).withColumn("words", X.words(F.col("line")))
    words = lines.withColumn("words", F.transform("words", F.lower))
    grams = words.select(F.explode(F.concat(F.coalesce(run(2), F.array()), F.coalesce(run(3), F.array()))).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")


Q["a20_ngrams"], O["a20_ngrams"] = a20_ngrams, TOK + """, l AS (SELECT list_transform(words, lambda x: lower(x)) AS w FROM w),
g AS (SELECT array_to_string(w[i:i + 1], ' ') AS gram FROM l, unnest(range(1, len(w))) AS u(i) UNION ALL SELECT array_to_string(w[i:i + 2], ' ') FROM l, unnest(range(1, len(w) - 1)) AS u(i))
SELECT gram, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 5"""


def f19(spark, sf):
    """What changed between a role's turn and its next one: words equal before and behind, words left out and put in."""
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("b", X.words(F.col("text"))).withColumn("a", F.lag("b").over(w)).where("a IS NOT NULL")
    least = F.least(F.size("a"), F.size("b"))
    same = lambda x, y, most: F.coalesce(F.nullif(F.array_position(F.transform(F.slice(F.arrays_zip(x.alias("p"), y.alias("q")), 1, most), lambda z: ~F.equal_null(z["p"], z["q"])), True), F.lit(0)) - 1, most)
    c = c.withColumn("head", same(F.col("a"), F.col("b"), least).cast("long")).withColumn("rest", (least - F.col("head")).cast("int"))
    c = c.withColumn("tail", same(F.reverse("a"), F.reverse("b"), F.col("rest")).cast("long"))
    return c.select("conv_id", "turn", "head", "tail", (F.size("a") - F.col("head") - F.col("tail")).alias("n_out"), (F.size("b") - F.col("head") - F.col("tail")).alias("n_in"))


Q["f19_word_correction"], O["f19_word_correction"] = f19, f"""WITH t AS (SELECT conv_id, role, turn, regexp_extract_all(text, '{WORD_SQL}') AS b FROM conversations),
l AS (SELECT conv_id, turn, b, lag(b) OVER (PARTITION BY conv_id, role ORDER BY turn) AS a FROM t),
h AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i]), true) - 1, least(len(a), len(b))) AS head FROM l WHERE a IS NOT NULL),
k AS (SELECT *, coalesce(list_position(list_transform(range(0, least(len(a), len(b)) - head), lambda i: a[len(a) - i] <> b[len(b) - i]), true) - 1, least(len(a), len(b)) - head) AS tail FROM h)
SELECT conv_id, turn, CAST(head AS BIGINT) AS head, CAST(tail AS BIGINT) AS tail, CAST(len(a) - head - tail AS BIGINT) AS n_out, CAST(len(b) - head - tail AS BIGINT) AS n_in FROM k"""

#: Spellings that a cross-check looks for.


def j23(spark, sf):
    """Purchases as targets: what other points of the user within two hours read when put together, and the nearest listed spelling within two edits.

    Listed are the types that events have, and two of them run together, without their last letter.
    """
    near, p = 120 * MINUTE, points(spark, sf)
    target = p.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("target"), F.col("t").alias("at"))
    target = target.withColumn("__bin", F.explode(F.array(*[F.floor(F.col("at") / near) + k for k in (-1, 0, 1)])))
    met = p.where("event_type <> 'purchase'").withColumn("__bin", F.floor(F.col("t") / near)).join(target, ["user_id", "__bin"]).where(F.abs(F.col("t") - F.col("at")) <= near)
    heard = met.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("t", "event_id", "event_type"))).alias("a"))
    heard = heard.select("target", F.array_join(F.transform("a", lambda x: x["event_type"]), "").alias("heard"))
    types = p.agg(F.array_sort(F.collect_set("event_type")).alias("a"))  # as many as there are types
    both = F.flatten(F.transform("a", lambda x: F.transform("a", lambda y: F.concat(x, y))))
    listed = types.select(F.explode(F.array_distinct(F.concat("a", both))).alias("s")).select(F.expr("substring(s, 1, length(s) - 1)").alias("entry")).distinct()
    found = within_edits(heard.select(F.col("heard").alias("word")).distinct(), listed, 2)
    best = found.groupBy(F.col("word").alias("heard")).agg(F.min(F.struct("edits", "entry"))["entry"].alias("spelling"))
    return heard.join(best, "heard", "left").select("target", "heard", "spelling")


Q["j23_cross_check"], O["j23_cross_check"] = j23, EV + """, h AS (SELECT a.event_id AS target, string_agg(b.event_type, '' ORDER BY b.t, b.event_id) AS heard FROM ev a JOIN ev b ON a.user_id = b.user_id AND abs(a.t - b.t) <= 7200000 AND b.event_type <> 'purchase' WHERE a.event_type = 'purchase' GROUP BY 1),
ty AS (SELECT DISTINCT event_type AS s FROM ev), sp AS (SELECT DISTINCT left(s, length(s) - 1) AS s FROM (SELECT s FROM ty UNION SELECT a.s || b.s FROM ty a, ty b)),
d AS (SELECT target, heard, s, levenshtein(heard, s) AS d FROM h, sp)
SELECT target, heard, CASE WHEN min(d) <= 2 THEN arg_min(s, (d, s)) END AS spelling FROM d GROUP BY 1, 2"""


DAY = 1440 * MINUTE


def k6(spark, sf):
    """Points read by windows of six days, a new one every five; each point is written by the window that owns its middle.

    Windows hand over in the middle of the day they share, but where just one of them loops there (two points or
    more, all of one type) the other writes all of it. A point that starts before the end of what earlier windows
    own is theirs. In the day they share windows read differently:
    each misses another seventh of the points, which the other has.
    """
    step, day = 5 * DAY, DAY
    p = points(spark, sf).select("user_id", "event_id", "event_type", "t", F.floor(F.col("t") / step).alias("k"))
    own = F.when(F.col("t") - F.col("k") * step < day, F.array(F.col("k"), F.col("k") - 1)).otherwise(F.array("k"))
    read = p.withColumn("w", F.explode(own)).where((F.col("t") - F.col("k") * step >= day) | ((F.col("event_id") + F.col("w")) % 7 != 0))
    shared = read.where(F.col("t") - F.col("k") * step < day)
    loop = lambda side: (F.count(F.when(side, 1)) >= 2) & (F.countDistinct(F.when(side, F.col("event_type"))) == 1)
    seams = shared.groupBy("user_id", "k").agg(loop(F.col("w") == F.col("k") - 1).alias("before"), loop(F.col("w") == F.col("k")).alias("after"))
    shift = F.when(F.col("before") & ~F.col("after"), 0).when(F.col("after") & ~F.col("before"), day).otherwise(day // 2)
    seams = seams.select("user_id", "k", shift.alias("shift"))
    lo = seams.select("user_id", F.col("k").alias("w"), F.col("shift").alias("lo"))
    hi = seams.select("user_id", (F.col("k") - 1).alias("w"), F.col("shift").alias("hi"))
    r = read.join(lo, ["user_id", "w"], "left").join(hi, ["user_id", "w"], "left")
    middle = F.col("t") + 500
    r = r.where((middle >= F.col("w") * step + F.coalesce("lo", F.lit(day // 2))) & (middle < (F.col("w") + 1) * step + F.coalesce("hi", F.lit(day // 2))))
    earlier = Window.partitionBy("user_id").orderBy("w").rangeBetween(Window.unboundedPreceding, -1)
    return r.withColumn("written", F.max(F.col("t") + 1000).over(earlier)).where("written IS NULL OR t >= written").select("event_id", F.col("w").alias("window"))


Q["k6_handover"], O["k6_handover"] = k6, EV + """, r AS (SELECT user_id, event_id, event_type, t, t // 432000000 AS k, unnest(CASE WHEN t % 432000000 < 86400000 THEN [t // 432000000, t // 432000000 - 1] ELSE [t // 432000000] END) AS w FROM ev),
q AS (SELECT * FROM r WHERE t % 432000000 >= 86400000 OR (event_id + w) % 7 <> 0),
g AS (SELECT user_id, k, w, count(*) >= 2 AND count(DISTINCT event_type) = 1 AS l FROM q WHERE t - k * 432000000 < 86400000 GROUP BY ALL),
s AS (SELECT user_id, k, coalesce(bool_or(l) FILTER (w = k - 1), false) AS b, coalesce(bool_or(l) FILTER (w = k), false) AS a FROM g GROUP BY ALL),
h AS (SELECT user_id, k, CASE WHEN b AND NOT a THEN 0 WHEN a AND NOT b THEN 86400000 ELSE 43200000 END AS shift FROM s),
o AS (SELECT q.* FROM q LEFT JOIN h x ON x.user_id = q.user_id AND x.k = q.w LEFT JOIN h y ON y.user_id = q.user_id AND y.k = q.w + 1 WHERE t + 500 >= q.w * 432000000 + coalesce(x.shift, 43200000) AND t + 500 < (q.w + 1) * 432000000 + coalesce(y.shift, 43200000))
SELECT event_id, w AS "window" FROM (SELECT *, max(t + 1000) OVER (PARTITION BY user_id ORDER BY w RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS z FROM o) WHERE z IS NULL OR t >= z"""


def k7(spark, sf):
    """Each user's time in turns as clips of twelve hours at most, cut where a point of least value lies."""
    speech = I.merged_spans(spans(spark, sf), "user_id").select("user_id", "start", "end")
    found = kernels.speech_clips(speech, points(spark, sf).select("user_id", "t", "value"), "user_id", 720.0 * MINUTE)
    return found.select("user_id", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"))


Q["k7_speech_clips"] = k7


def f12(spark, sf):
    """Words of a turn and of the one before that a longest common subsequence leaves out."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", X.words(F.lower("text")).alias("words"))
    c = c.withColumn("before", F.lag("words").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before IS NOT NULL")
    return kernels.differing(c, "before", "words")


Q["f12_differing"] = f12


def w14(spark, sf):
    """Runs of three words or more of a line that come again within four seconds, words being 0.3 s long."""
    t = tokens(spark, sf).where(F.size("words") >= 6).select("doc_id", "pos", F.transform("words", F.lower).alias("words"))
    t = t.withColumn("times", F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: i * 0.3))
    return kernels.echoes(t, "words", "times", 4.0).select("doc_id", "pos", F.explode("echoes").alias("e")).select("doc_id", "pos", "e.place", "e.size")


Q["w14_echoes"] = w14


def k10(spark, sf):
    """What of loops (errors, two minutes for each of their value) to read again: loops that no silence crosses (a signup's
    forty minutes, a second inside its edges), cut to what sentences (half an hour from a purchase) around them leave."""
    p = points(spark, sf)
    loops = p.where("event_type = 'error'").select("user_id", "event_id", "t", (F.col("t") + F.floor("value") * 2 * MINUTE).alias("end"))
    quiet = p.where("event_type = 'signup'").select(F.col("user_id").alias("u"), (F.col("t") + 1000).alias("start"), (F.col("t") + 40 * MINUTE - 1000).alias("quiet_end"))
    quiet = I.binned(quiet, "start", "quiet_end", 60 * MINUTE).withColumnsRenamed({"__bin": "b"})
    crossed = (F.col("user_id") == F.col("u")) & (F.col("__bin") == F.col("b")) & (F.col("t") < F.col("quiet_end")) & (F.col("start") < F.col("end"))
    near = I.binned(loops, "t", "end", 60 * MINUTE).join(quiet, crossed, "left_semi").select("event_id").distinct()
    read = I.merged_spans(p.where("event_type = 'purchase'").select("user_id", F.col("t").alias("start"), (F.col("t") + 30 * MINUTE).alias("end")), "user_id")
    todo = I.turn_at(loops.join(near, "event_id", "left_anti"), read, "user_id", "t", label="end").withColumnRenamed("speaker_at", "covered")
    both = todo.unionByName(read.select("user_id", F.col("start").alias("t")), allowMissingColumns=True)
    both = both.withColumn("next", I.next_time(F.when(F.col("event_id").isNull(), F.col("t")), "user_id", "t")).where("event_id IS NOT NULL")
    return both.select("event_id", F.coalesce("covered", "t").alias("lo"), F.least("end", F.coalesce("next", "end")).alias("hi")).where("lo < hi")


Q["k10_retry_plan"], O["k10_retry_plan"] = k10, EV.replace("turns AS (SELECT user_id, t AS s, t + 60000 * (1 + event_id % 600) AS e", "turns AS (SELECT user_id, t AS s, t + 1800000 AS e").replace("WHERE event_id % 5 = 0", "WHERE event_type = 'purchase'") + """,
m0 AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM turns),
m1 AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e) AS g FROM m0),
m AS (SELECT user_id, min(s) AS s, max(e) AS e FROM m1 GROUP BY user_id, g),
q AS (SELECT user_id, t + 1000 AS a, t + 2399000 AS b FROM ev WHERE event_type = 'signup'),
l AS (SELECT user_id, event_id, t, t + CAST(floor(value) AS BIGINT) * 120000 AS e FROM ev WHERE event_type = 'error'),
k AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.user_id = l.user_id AND l.t < q.b AND q.a < l.e)),
x AS (SELECT k.*, CASE WHEN m.e >= k.t THEN m.e ELSE k.t END AS lo FROM k ASOF LEFT JOIN m ON k.user_id = m.user_id AND k.t >= m.s),
y AS (SELECT x.event_id, x.lo, least(x.e, coalesce(m.s, x.e)) AS hi FROM x ASOF LEFT JOIN m ON x.user_id = m.user_id AND x.t < m.s)
SELECT event_id, lo, hi FROM y WHERE lo < hi"""


def a5_straddles(spark, sf):
    """Votes of each user's days (sentences): of one speaker, of several, of none as all points lie in gaps; points in gaps."""
    voted = I.turn_at(others(spark, sf), turns(spark, sf), "user_id", "t")
    day = voted.groupBy("user_id", F.floor(F.col("t") / DAY)).agg(F.countDistinct("speaker_at").alias("k"), F.count("speaker_at").alias("inside"), F.count(F.lit(1)).alias("n"))
    when = lambda c: F.count(F.when(c, 1))
    return day.groupBy("user_id").agg(
        when(F.col("k") == 1).alias("unanimous"), when(F.col("k") > 1).alias("straddling"), when(F.col("k") == 0).alias("all_in_gap"),
        F.sum(F.col("n") - F.col("inside")).alias("gap_tokens"), F.sum("n").alias("tokens"),
    )


Q["a5_straddles"], O["a5_straddles"] = a5_straddles, EV + """, v AS (SELECT p.user_id, p.t // 86400000 AS d, CASE WHEN p.t <= u.e THEN u.speaker END AS sp FROM pts p ASOF LEFT JOIN turns u ON p.user_id = u.user_id AND p.t >= u.s),
d AS (SELECT user_id, d, count(DISTINCT sp) AS k, count(sp) AS i, count(*) AS n FROM v GROUP BY 1, 2)
SELECT user_id, count(CASE WHEN k = 1 THEN 1 END) AS unanimous, count(CASE WHEN k > 1 THEN 1 END) AS straddling, count(CASE WHEN k = 0 THEN 1 END) AS all_in_gap, CAST(sum(n - i) AS BIGINT) AS gap_tokens, CAST(sum(n) AS BIGINT) AS tokens FROM d GROUP BY 1"""
