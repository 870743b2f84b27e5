"""Scores, shares and percentiles over transcripts, and sources that are read, filtered and joined."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import numbers as N, text as X
from ..operators import intervals as I
from .queries_text import TOK, WORD_SQL, table, tokens
from .queries_time import EV, MINUTE, others, points, turns

Q, O = {}, {}


def a3(spark, sf):
    """A word's confidence is its pieces' least: pieces are order lines; a missing one counts as 1, or hides the word."""
    c = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount"))
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min(F.coalesce(c, F.lit(1.0))).alias("scored"), F.count(F.when(c.isNull(), 1)).alias("missing"), F.min(c).alias("least"))
    return g.select("l_orderkey", "scored", F.when(F.col("missing") == 0, F.col("least")).alias("shown"))


Q["a3_word_confidence"], O["a3_word_confidence"] = a3, "WITH c AS (SELECT l_orderkey, CASE WHEN l_linenumber % 3 <> 0 THEN l_discount END AS c FROM lineitem) SELECT l_orderkey, min(coalesce(c, 1.0::DOUBLE)) AS scored, CASE WHEN count(c) = count(*) THEN min(c) END AS shown FROM c GROUP BY 1"


def _ranked(spark, sf):
    w = Window.partitionBy("user_id")
    return points(spark, sf).select("user_id", "value", F.row_number().over(w.orderBy("value", "event_id")).alias("r"), F.count(F.lit(1)).over(w).alias("n"))


def a9(spark, sf):
    """The value at index min(n - 1, floor(q n)) of a user's sorted values."""
    at = lambda q: F.max(F.when(F.col("r") - 1 == F.least(F.col("n") - 1, F.floor(F.col("n") * q)), F.col("value")))
    return _ranked(spark, sf).groupBy("user_id").agg(at(0.5).alias("p50"), at(0.9).alias("p90"))


Q["a9_pct"], O["a9_pct"] = a9, "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, max(CASE WHEN r = least(n - 1, CAST(floor(n * 0.5::DOUBLE) AS BIGINT)) THEN value END) AS p50, max(CASE WHEN r = least(n - 1, CAST(floor(n * 0.9::DOUBLE) AS BIGINT)) THEN value END) AS p90 FROM r GROUP BY 1"


def a10(spark, sf):
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return points(spark, sf).groupBy("user_id").agg(p(0.1).alias("p10"), p(0.5).alias("p50"), p(0.95).alias("p95"))


Q["a10_linear_percentiles"], O["a10_linear_percentiles"] = a10, "SELECT user_id, round(quantile_cont(value, 0.1::DOUBLE), 6) AS p10, round(quantile_cont(value, 0.5::DOUBLE), 6) AS p50, round(quantile_cont(value, 0.95::DOUBLE), 6) AS p95 FROM events GROUP BY 1"


def a11(spark, sf):
    """Median of a user's values, and the share of quiet ones."""
    return points(spark, sf).groupBy("user_id").agg(F.round(F.median("value"), 6).alias("median"), F.round(F.avg(F.when(F.col("value") < 20, 1.0).otherwise(0.0)), 6).alias("quiet"))


Q["a11_median"], O["a11_median"] = a11, "SELECT user_id, round(median(value), 6) AS median, round(avg(CASE WHEN value < 20 THEN 1.0 ELSE 0.0 END), 6) AS quiet FROM events GROUP BY 1"


def a12(spark, sf):
    """Words, letters and lines that loops take in each document."""
    t = tokens(spark, sf).where(X.is_loop(F.col("words")))
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.size("words")).alias("words"), F.sum(F.length("line")).alias("letters"))


Q["a12_loop_words"], O["a12_loop_words"] = a12, TOK + "SELECT doc_id, count(*) AS lines, CAST(sum(len(words)) AS BIGINT) AS words, CAST(sum(length(line)) AS BIGINT) AS letters FROM w WHERE len(words) > 6 AND len(list_distinct(words)) <= greatest(2, len(words) // 3) GROUP BY 1"


def a21(spark, sf):
    """One-sided sign test by user: of its points against the ones before, how often the value rose, and the chance of as many."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    d = points(spark, sf).select("user_id", (F.col("value") - F.lag("value").over(w)).alias("d")).where("d <> 0")
    g = d.groupBy("user_id").agg(F.count(F.when(F.col("d") > 0, 1)).alias("wins"), F.count(F.lit(1)).alias("n"))
    return g.select("user_id", "wins", "n", F.round(N.sign_tail(F.col("wins"), F.col("n")), 6).alias("p"))


Q["a21_sign_test"], O["a21_sign_test"] = a21, """WITH d AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events),
g AS (SELECT user_id, count(CASE WHEN d > 0 THEN 1 END) AS wins, count(*) AS n FROM d WHERE d <> 0 GROUP BY 1)
SELECT user_id, wins, n, round(sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2.0::DOUBLE))), 6) AS p FROM (SELECT *, unnest(range(wins, n + 1)) AS k FROM g) GROUP BY ALL"""


def a22(spark, sf):
    """A baseline of supplied draws (orders, dealt out by number) against each user's mean value: their distance."""
    draws = table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 1000).alias("user_id")).agg(F.avg(F.col("o_totalprice") / 1000).alias("draw"))
    p = points(spark, sf).groupBy("user_id").agg(F.avg("value").alias("own"))
    return p.join(draws, "user_id").select("user_id", F.round(F.abs(F.col("own") - F.col("draw")), 6).alias("distance"))


Q["a22_random_baseline"], O["a22_random_baseline"] = a22, "WITH d AS (SELECT o_orderkey % 1000 AS user_id, avg(o_totalprice / 1000) AS draw FROM orders GROUP BY 1), p AS (SELECT user_id, avg(value) AS own FROM events GROUP BY 1) SELECT user_id, round(abs(own - draw), 6) AS distance FROM p JOIN d USING (user_id)"


def a27(spark, sf):
    """Of each conversation's words of its last turn, how many stand in the text of the turns before it."""
    c = table(spark, sf, "conversations")
    last = c.groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("l")).select("conv_id", "l.turn", F.array_distinct(X.words(F.lower("l.text"))).alias("items"))
    before = c.join(last.select("conv_id", F.col("turn").alias("stop")), "conv_id").where("turn < stop")
    hay = before.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: F.lower(x["text"])), " ").alias("hay"))
    hits = F.size(F.filter("items", lambda w: F.contains(F.col("hay"), w)))
    return last.join(hay, "conv_id").select("conv_id", hits.cast("long").alias("hits"), F.size("items").cast("long").alias("n"))


Q["a27_recall"], O["a27_recall"] = a27, f"""WITH l AS (SELECT conv_id, max(turn) AS stop FROM conversations GROUP BY 1),
i AS (SELECT conv_id, list_distinct(regexp_extract_all(lower(text), '{WORD_SQL}')) AS items FROM conversations JOIN l USING (conv_id) WHERE turn = stop),
h AS (SELECT conv_id, string_agg(lower(text), ' ' ORDER BY turn) AS hay FROM conversations JOIN l USING (conv_id) WHERE turn < stop GROUP BY 1)
SELECT conv_id, len(list_filter(items, lambda w: contains(hay, w))) AS hits, len(items) AS n FROM i JOIN h USING (conv_id)"""


def a31(spark, sf):
    """Words of each user's segments (turns) outside its speech (spans around points): how many, as if spread evenly, and the least covered segment's share."""
    seg = turns(spark, sf).select("user_id", "event_id", "start", "end")
    speech = I.merged_spans(others(spark, sf).select("user_id", (F.col("t") - 20 * MINUTE).alias("start"), (F.col("t") + 20 * MINUTE).alias("end")), "user_id")
    n = F.col("event_id") % 13 + 1
    times = seg.select("user_id", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: F.col("start") + F.floor((2 * k + 1) * (F.col("end") - F.col("start")) / (2 * n)))).alias("t"))
    heard = I.turn_at(times, speech.withColumn("end", F.col("end") - 1), "user_id", "t", label="n_spans")
    lost = heard.groupBy("user_id").agg(F.count(F.lit(1)).alias("words"), F.count(F.when(F.col("speaker_at").isNull(), 1)).alias("outside"))
    a = I.binned(seg, "start", "end", 60 * MINUTE).select("user_id", "event_id", F.col("start").alias("a0"), F.col("end").alias("a1"), "__bin")
    b = I.binned(speech, "start", "end", 60 * MINUTE).select("user_id", F.col("start").alias("b0"), F.col("end").alias("b1"), "__bin")
    part = a.join(b, ["user_id", "__bin"]).select("user_id", "event_id", "b0", I.overlap(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")).alias("ms")).distinct()
    sums = part.groupBy("user_id", "event_id").agg(F.sum("ms").alias("ms"))
    share = F.coalesce("ms", F.lit(0)) / (F.col("end") - F.col("start"))
    least = seg.join(sums, ["user_id", "event_id"], "left").groupBy("user_id").agg(F.round(F.min(share), 6).alias("least_covered"))
    return lost.join(least, "user_id")


SPEECH = EV + """, sm AS (SELECT user_id, t - 1200000 AS s, t + 1200000 AS e FROM pts), m0 AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM sm),
m1 AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e) AS g FROM m0), sp AS (SELECT user_id, min(s) AS s, max(e) AS e FROM m1 GROUP BY user_id, g)"""
Q["a31_vad_recall"], O["a31_vad_recall"] = a31, SPEECH + """, w AS (SELECT user_id, s + (2 * k + 1) * (e - s) // (2 * n) AS t FROM (SELECT *, event_id % 13 + 1 AS n, unnest(range(event_id % 13 + 1)) AS k FROM turns)),
l AS (SELECT w.user_id, count(*) AS words, count(*) FILTER (sp.e IS NULL OR w.t >= sp.e) AS outside FROM w ASOF LEFT JOIN sp ON w.user_id = sp.user_id AND w.t >= sp.s GROUP BY 1),
c AS (SELECT turns.user_id, turns.event_id, coalesce(sum(CASE WHEN sp.s IS NOT NULL THEN least(sp.e, turns.e) - greatest(sp.s, turns.s) END), 0) / (any_value(turns.e) - any_value(turns.s)) AS c FROM turns LEFT JOIN sp ON sp.user_id = turns.user_id AND sp.s < turns.e AND turns.s < sp.e GROUP BY 1, 2)
SELECT l.user_id, words, outside, round(least_covered, 6) AS least_covered FROM l JOIN (SELECT user_id, min(c) AS least_covered FROM c GROUP BY 1) USING (user_id)"""


def a32(spark, sf):
    """Levels of each word (turn): mean and peak of its frames (points) in decibels, the loudest frame within an hour of its start, and how deep it starts in a quiet stretch."""
    f = others(spark, sf).select("user_id", "t", (F.col("value") * F.col("value")).alias("power"))
    word = turns(spark, sf).select("user_id", "event_id", "start", "end")
    db = lambda p: F.round(10 * F.log10(F.greatest(p, F.lit(1e-18))), 6)
    of = lambda spans_: I.points_in_spans(f, spans_, "user_id", "t", 120 * MINUTE)
    own = of(word.select("user_id", "start", "end").distinct()).groupBy("user_id", F.col("span_start").alias("start"), F.col("span_end").alias("end")).agg(db(F.avg("power")).alias("db"), db(F.max("power")).alias("peak"))
    near = of(word.select("user_id", (F.col("start") - 60 * MINUTE).alias("start"), (F.col("start") + 60 * MINUTE).alias("end")).distinct())
    near = near.groupBy("user_id", (F.col("span_start") + 60 * MINUTE).alias("start")).agg(db(F.max("power")).alias("near"))
    quiet = I.islands(others(spark, sf), ["user_id"], ["t", "event_id"], F.col("value") < 20, "t").where("start < end").select("user_id", "start", "end", F.col("start").alias("speaker"))
    at = I.turn_at(word.select("user_id", "event_id", F.col("start").alias("t")).distinct(), quiet, "user_id", "t")
    deep = at.join(quiet.select("user_id", F.col("start").alias("speaker_at"), "end"), ["user_id", "speaker_at"]).select("event_id", F.least(F.col("t") - F.col("speaker_at"), F.col("end") - F.col("t")).alias("depth"))
    j = word.join(own, ["user_id", "start", "end"], "left").join(near, ["user_id", "start"], "left").join(deep, "event_id", "left")
    return j.select("event_id", "db", "peak", "near", F.coalesce("depth", F.lit(0)).alias("depth"))


Q["a32_word_levels"], O["a32_word_levels"] = a32, EV + """, i AS (SELECT *, value < 20 AS f, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM pts),
j AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS g FROM i WHERE f), q AS (SELECT user_id, min(t) AS s, max(t) AS e FROM j GROUP BY user_id, g HAVING min(t) < max(t)),
o AS (SELECT u.event_id, avg(value * value) AS p, max(value * value) AS x FROM turns u JOIN pts p ON p.user_id = u.user_id AND p.t >= u.s AND p.t < u.e GROUP BY 1),
k AS (SELECT u.event_id, max(value * value) AS x FROM turns u JOIN pts p ON p.user_id = u.user_id AND p.t >= u.s - 3600000 AND p.t < u.s + 3600000 GROUP BY 1)
SELECT u.event_id, round(10 * log10(CASE WHEN o.p < 1e-18 THEN 1e-18 ELSE o.p END), 6) AS db, round(10 * log10(CASE WHEN o.x < 1e-18 THEN 1e-18 ELSE o.x END), 6) AS peak, round(10 * log10(CASE WHEN k.x < 1e-18 THEN 1e-18 ELSE k.x END), 6) AS near,
 coalesce((SELECT max(least(u.s - q.s, q.e - u.s)) FROM q WHERE q.user_id = u.user_id AND u.s >= q.s AND u.s <= q.e), 0) AS depth FROM turns u LEFT JOIN o USING (event_id) LEFT JOIN k USING (event_id)"""


def a35(spark, sf):
    """Each user's time from first to last point against the time its turns cover, and points in no turn."""
    spans = I.merged_spans(turns(spark, sf), "user_id")
    wall = spans.groupBy("user_id").agg(F.sum(F.col("end") - F.col("start")).alias("wall"))
    p = points(spark, sf).groupBy("user_id").agg((F.max("t") - F.min("t")).alias("duration"))
    gap = I.points_in_spans(points(spark, sf), spans, "user_id", "t", 240 * MINUTE, "left_anti").groupBy("user_id").agg(F.count(F.lit(1)).alias("gap_words"))
    j = p.join(wall, "user_id").join(gap, "user_id", "left")
    return j.select("user_id", F.round(F.col("duration") / F.col("wall"), 6).alias("speed"), F.coalesce("gap_words", F.lit(0)).alias("gap_words"))


MERGED = """m0 AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM turns),
m1 AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e) AS g FROM m0),
m AS (SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n_spans FROM m1 GROUP BY user_id, g)"""
Q["a35_wall_table"], O["a35_wall_table"] = a35, EV + "," + MERGED + """, w AS (SELECT user_id, sum(e - s) AS wall FROM m GROUP BY 1), d AS (SELECT user_id, max(t) - min(t) AS duration FROM ev GROUP BY 1),
g AS (SELECT user_id, count(*) AS n FROM ev WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.user_id = ev.user_id AND ev.t >= m.s AND ev.t < m.e) GROUP BY 1)
SELECT user_id, round(duration / wall, 6) AS speed, coalesce(n, 0) AS gap_words FROM d JOIN w USING (user_id) LEFT JOIN g USING (user_id)"""


def s7(spark, sf):
    """Turns in order with their label's place among the sorted distinct labels; assistants stay unnamed."""
    c = table(spark, sf, "conversations").withColumn("label", F.when(F.col("role") != "assistant", F.col("role")))
    labels = c.groupBy("conv_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    place = F.when(F.col("label").isNotNull(), F.array_position("labels", F.col("label")) - 1)
    return c.join(labels, "conv_id").select("conv_id", "turn", place.alias("speaker"), F.array_join("labels", ",").alias("labels"))


Q["s7_parse"], O["s7_parse"] = s7, """WITH c AS (SELECT *, CASE WHEN role <> 'assistant' THEN role END AS label FROM conversations), l AS (SELECT conv_id, coalesce(list_sort(list(DISTINCT label) FILTER (WHERE label IS NOT NULL)), []) AS labels FROM c GROUP BY 1)
SELECT conv_id, turn, CASE WHEN label IS NOT NULL THEN CAST(list_position(labels, label) - 1 AS BIGINT) END AS speaker, array_to_string(labels, ',') AS labels FROM c JOIN l USING (conv_id)"""


def s10(spark, sf):
    """Lists in their order: benchmark words come before part names, these before conversations; a word's first list has it."""
    own = lambda t, c, k, n: table(spark, sf, t).select(F.explode(X.words(F.lower(c))).alias("word"), F.lit(k).alias("list"), F.lit(n).alias("priority"))
    every = own("benchmark", "text", "bench", 0).unionByName(own("part", "p_name", "part", 1)).unionByName(own("conversations", "text", "talk", 2))
    return every.groupBy("word").agg(F.min(F.struct("priority", "list")).alias("m")).select("word", F.concat_ws(":", "m.list", "word").alias("entry"))


LISTS = f"""SELECT unnest(regexp_extract_all(lower(text), '{WORD_SQL}')) AS word, 'bench' AS list, 0 AS p FROM benchmark UNION ALL SELECT unnest(regexp_extract_all(lower(p_name), '{WORD_SQL}')), 'part', 1 FROM part
UNION ALL SELECT unnest(regexp_extract_all(lower(text), '{WORD_SQL}')), 'talk', 2 FROM conversations"""
Q["s10_word_lists"], O["s10_word_lists"] = s10, f"SELECT word, arg_min(list, p) || ':' || word AS entry FROM ({LISTS}) GROUP BY 1"


def s13(spark, sf):
    """Each user's purchases as a Markdown list in order of time."""
    p = points(spark, sf).where("event_type = 'purchase'")
    line = F.format_string("- **%s** #%d", X.clock(F.col("t") % 86400000), F.col("event_id"))
    g = p.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("t", "event_id", line.alias("line")))).alias("a"))
    return g.select("user_id", F.array_join(F.transform("a", lambda x: x["line"]), "\n").alias("markdown"))


Q["s13_export_marks"], O["s13_export_marks"] = s13, EV + """SELECT user_id, string_agg('- **' || printf('%02d:%02d:%02d,%03d', t % 86400000 // 3600000, t // 60000 % 60, t // 1000 % 60, t % 1000) || '** #' || event_id, chr(10) ORDER BY t, event_id) AS markdown FROM ev WHERE event_type = 'purchase' GROUP BY 1"""


def s16(spark, sf):
    """Orders still to do: those without a line whose fingerprint (order, customer, status) a finished one has; why named."""
    o = table(spark, sf, "orders")
    mark = F.concat_ws("-", F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority")
    done = o.where("o_orderstatus = 'F'").select(mark.alias("fingerprint")).distinct()
    todo = o.withColumn("fingerprint", F.concat_ws("-", F.col("o_custkey").cast("string"), F.lit("F"), "o_orderpriority"))
    return todo.join(done, "fingerprint", "left_anti").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "again").otherwise("new").alias("why"))


Q["s16_checkpoint"], O["s16_checkpoint"] = s16, "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'again' ELSE 'new' END AS why FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_orderstatus = 'F' AND b.o_custkey = a.o_custkey AND b.o_orderpriority = a.o_orderpriority)"


def s18(spark, sf):
    """A customer's tag: the newest order's priority (the sidecar) wins over the segment (the tag in the file)."""
    side = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderpriority")).alias("s")).select("o_custkey", "s.o_orderpriority")
    c = table(spark, sf, "customer")
    return c.join(side, c.c_custkey == side.o_custkey, "left").select("c_custkey", F.coalesce("o_orderpriority", "c_mktsegment").alias("tag"), F.col("o_orderpriority").isNotNull().alias("sidecar"))


Q["s18_sidecar"], O["s18_sidecar"] = s18, "WITH s AS (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS p FROM orders GROUP BY 1) SELECT c_custkey, coalesce(p, c_mktsegment) AS tag, p IS NOT NULL AS sidecar FROM customer LEFT JOIN s ON o_custkey = c_custkey"


def s19(spark, sf):
    """Rows of a file's shard in order, cut off by an end: each user's points by place, of those that end within its first week."""
    first = Window.partitionBy("user_id")
    w = first.orderBy("t", "event_id")
    p = points(spark, sf).select("event_id", "user_id", F.row_number().over(w).cast("long").alias("place"), (F.col("t") - F.min("t").over(first)).alias("since"))
    return p.where(F.col("since") <= 7 * 1440 * MINUTE)


Q["s19_corpora_reader"], O["s19_corpora_reader"] = s19, EV + "SELECT * FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS place, t - min(t) OVER (PARTITION BY user_id) AS since FROM ev) WHERE since <= 604800000"


def s20(spark, sf):
    """One column of several subsets, labelled rows only, empty texts gone, under each one's name."""
    d = table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels").where("toxic = 1").select("doc_id"), "doc_id").select(F.lit("documents").alias("subset"), "text")
    c = table(spark, sf, "conversations").where("role = 'user'").select(F.lit("conversations").alias("subset"), "text")
    return d.unionByName(c).where(X.trimmed(F.col("text")) != "").select("subset", F.md5("text").alias("digest"))


Q["s20_subsets"], O["s20_subsets"] = s20, r"SELECT * FROM (SELECT 'documents' AS subset, md5(text) AS digest FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND regexp_replace(text, '^\s+|\s+$', '', 'g') <> '' UNION ALL SELECT 'conversations', md5(text) FROM conversations WHERE role = 'user' AND regexp_replace(text, '^\s+|\s+$', '', 'g') <> '')"
