"""Queries that shape tokens, labels and segments."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import intervals as I
from .queries_text import TOK, table, tokens
from .queries_time import EV, MINUTE, others, points, turns

Q, O = {}, {}


def p2(spark, sf):
    """Hours widened to the tokens they hold: least start, greatest end of points of half a minute."""
    p = points(spark, sf).withColumn("hour", F.floor(F.col("t") / (60 * MINUTE)))
    g = p.groupBy("user_id", "hour").agg(F.min("t").alias("a"), F.max(F.col("t") + 30000).alias("b"))
    return g.select("user_id", "hour", F.least("a", F.col("hour") * 60 * MINUTE + 60000).alias("start_ms"), F.greatest("b", (F.col("hour") + 1) * 60 * MINUTE).alias("end_ms"))


Q["p2_widen_bounds"], O["p2_widen_bounds"] = p2, EV + "SELECT user_id, t // 3600000 AS hour, least(min(t), t // 3600000 * 3600000 + 60000) AS start_ms, greatest(max(t + 30000), (t // 3600000 + 1) * 3600000) AS end_ms FROM ev GROUP BY user_id, t // 3600000"


def p8(spark, sf):
    """Names shown for roles: a custom one, else the role's place, else the role."""
    c = table(spark, sf, "conversations").select("conv_id", "role").distinct()
    place = F.dense_rank().over(Window.partitionBy("conv_id").orderBy("role"))
    custom = F.when((F.col("conv_id") % 3 == 0) & (F.col("role") == "user"), F.lit("Guest"))
    return c.select("conv_id", "role", F.coalesce(custom, F.when(F.col("role") == "assistant", F.concat(F.lit("Speaker "), place.cast("string"))), F.col("role")).alias("name"))


Q["p8_display_name"], O["p8_display_name"] = p8, "SELECT conv_id, role, CASE WHEN conv_id % 3 = 0 AND role = 'user' THEN 'Guest' WHEN role = 'assistant' THEN 'Speaker ' || dense_rank() OVER (PARTITION BY conv_id ORDER BY role) ELSE role END AS name FROM (SELECT DISTINCT conv_id, role FROM conversations)"


def p10(spark, sf):
    """Types only where known."""
    return points(spark, sf).select("event_id", F.when(F.col("event_type").isin("view", "click", "purchase"), F.col("event_type")).alias("engine"))


Q["p10_engine_of"], O["p10_engine_of"] = p10, "SELECT event_id, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type END AS engine FROM events"


def a26(spark, sf):
    """Changes of type by user: sentences, distinct types, changes."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    p = points(spark, sf).withColumn("changed", F.lag("event_type").over(w) != F.col("event_type"))
    return p.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("kinds"), F.count(F.when(F.col("changed"), 1)).alias("changes"))


Q["a26_changepoint_meta"], O["a26_changepoint_meta"] = a26, EV + "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, count(CASE WHEN c THEN 1 END) AS changes FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) <> event_type AS c FROM ev) GROUP BY 1"


def t2(spark, sf):
    """Place of each point in its user's order of value; equal values keep the order they came in."""
    w = Window.partitionBy("user_id").orderBy("value", "event_id")
    return points(spark, sf).select("event_id", F.row_number().over(w).cast("long").alias("place"))


Q["t2_time_order"], O["t2_time_order"] = t2, "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS place FROM events"


def u3(spark, sf):
    """Union of the words of each line and the one before it in its document, and what they share."""
    before = F.lag("words").over(Window.partitionBy("doc_id").orderBy("pos"))
    t = tokens(spark, sf).withColumn("a", before).where("a IS NOT NULL")
    return t.select("doc_id", "pos", F.size(F.array_union("a", "words")).cast("long").alias("either"), F.size(F.array_intersect("a", "words")).cast("long").alias("both"))


Q["u3_flag_union"], O["u3_flag_union"] = u3, TOK + "SELECT a.doc_id, b.pos, len(list_distinct(list_concat(a.words, b.words))) AS either, len(list_intersect(a.words, b.words)) AS both FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1"


def j7(spark, sf):
    """Points by their middle (half a minute on) in the span they fall in, else the nearer one; of equals the earlier."""
    mid = others(spark, sf).select("event_id", "user_id", (F.col("t") + 30000).alias("t"))
    return I.nearest_turn(mid, turns(spark, sf), "user_id", "t").where("distance <= 3600000").select("event_id", "nearest_speaker", "distance")


Q["j7_opinion_words"], O["j7_opinion_words"] = j7, EV + """, q AS (SELECT event_id, user_id, t + 30000 AS t FROM pts),
b AS (SELECT q.event_id, q.user_id, q.t, u.s AS bs, greatest(q.t - u.e, 0) AS db, u.speaker AS lb FROM q ASOF LEFT JOIN turns u ON q.user_id = u.user_id AND q.t >= u.s),
n AS (SELECT b.*, u.s - b.t AS da, u.speaker AS la FROM b ASOF LEFT JOIN turns u ON b.user_id = u.user_id AND b.t < u.s),
r AS (SELECT event_id, CASE WHEN bs IS NOT NULL AND (da IS NULL OR db <= da) THEN lb ELSE la END AS nearest_speaker, CASE WHEN bs IS NOT NULL AND (da IS NULL OR db <= da) THEN db ELSE da END AS distance FROM n)
SELECT * FROM r WHERE distance <= 3600000"""


def j6(spark, sf):
    """Types of the points of each span in order of time, and who speaks first there."""
    inside = I.points_in_spans(others(spark, sf), turns(spark, sf), "user_id", "t", 60 * MINUTE)
    g = inside.groupBy("user_id", "span_start", "span_end").agg(F.sort_array(F.collect_list(F.struct("t", "event_id", "event_type"))).alias("a"))
    return g.select("user_id", "span_start", "span_end", F.array_join(F.transform("a", lambda x: x["event_type"]), " ").alias("line"), (F.col("a")[0]["event_id"] % 3).alias("speaker"))


Q["j6_texts_per_segment"], O["j6_texts_per_segment"] = j6, EV + "SELECT p.user_id, u.s AS span_start, u.e AS span_end, string_agg(event_type, ' ' ORDER BY p.t, p.event_id) AS line, first(p.event_id % 3 ORDER BY p.t, p.event_id) AS speaker FROM pts p JOIN turns u ON u.user_id = p.user_id AND p.t >= u.s AND p.t < u.e GROUP BY ALL"


def j22(spark, sf):
    """Each point's latest hour mark of its user by then: the last error, clamped to the first."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    mark = F.when(F.col("event_type") == "error", F.col("t"))
    first = F.min(mark).over(Window.partitionBy("user_id"))
    return points(spark, sf).select("event_id", F.coalesce(F.last(mark, ignorenulls=True).over(w), first).alias("segment_start"))


Q["j22_segment_lookup"], O["j22_segment_lookup"] = j22, EV + "SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'error' THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id), min(CASE WHEN event_type = 'error' THEN t END) OVER (PARTITION BY user_id)) AS segment_start FROM ev"


def k19(spark, sf):
    """Spans of paragraphs: runs of points that a purchase opens."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    p = points(spark, sf).withColumn("paragraph", F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).over(w))
    return p.groupBy("user_id", "paragraph").agg(F.min("t").alias("start_ms"), F.max(F.col("t") + 1000).alias("end_ms"), F.count(F.lit(1)).alias("n"))


Q["k19_sentence_spans"], O["k19_sentence_spans"] = k19, EV + ", g AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS paragraph FROM ev) SELECT user_id, CAST(paragraph AS BIGINT) AS paragraph, min(t) AS start_ms, max(t + 1000) AS end_ms, count(*) AS n FROM g GROUP BY user_id, paragraph"
