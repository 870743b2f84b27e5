"""Queries over points, turns, spans and series, on the events table as recordings (user) of timed points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import intervals as I

MINUTE = 60_000


def points(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), "value", "event_type")


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a turn, for queries over turns alone."""
    return points(spark, sf).select("user_id", F.col("t").alias("start"), (F.col("t") + MINUTE * (1 + F.col("event_id") % 600)).alias("end"), (F.col("event_id") % 3).alias("speaker"), "event_id")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Events in the part of turns where others() have that of points; such queries read both."""
    return spans(spark, sf).where("event_id % 5 = 0")


def others(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).where("event_id % 5 <> 0")


EV = """WITH ev AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS t, value, event_type FROM events),
turns AS (SELECT user_id, t AS s, t + 60000 * (1 + event_id % 600) AS e, event_id % 3 AS speaker, event_id FROM ev WHERE event_id % 5 = 0),
pts AS (SELECT * FROM ev WHERE event_id % 5 <> 0)
"""
ALL = EV.replace(" WHERE event_id % 5 = 0", "")
Q, O = {}, {}


def j1(spark, sf):
    return I.turn_at(others(spark, sf), turns(spark, sf), "user_id", "t").select("event_id", "speaker_at")


Q["j1_speaker_at"], O["j1_speaker_at"] = j1, EV + """
SELECT p.event_id, CASE WHEN p.t <= u.e THEN u.speaker END AS speaker_at FROM pts p ASOF LEFT JOIN turns u ON p.user_id = u.user_id AND p.t >= u.s"""


def j2(spark, sf):
    return I.nearest_turn(others(spark, sf), turns(spark, sf), "user_id", "t").select("event_id", "nearest_speaker", "distance")


NEAREST = """b AS (SELECT p.event_id, p.user_id, p.t, u.s AS bs, greatest(p.t - u.e, 0) AS db, u.speaker AS lb FROM pts p ASOF LEFT JOIN turns u ON p.user_id = u.user_id AND p.t >= u.s),
n AS (SELECT b.*, u.s - b.t AS da, u.speaker AS la FROM b ASOF LEFT JOIN turns u ON b.user_id = u.user_id AND b.t < u.s),
near AS (SELECT event_id, user_id, t, CASE WHEN bs IS NOT NULL AND (da IS NULL OR db <= da) THEN lb ELSE la END AS nearest_speaker,
 CASE WHEN bs IS NOT NULL AND (da IS NULL OR db <= da) THEN db ELSE da END AS distance FROM n)"""
Q["j2_nearest_speaker"], O["j2_nearest_speaker"] = j2, EV + "," + NEAREST + " SELECT event_id, nearest_speaker, distance FROM near"


def j3(spark, sf):
    """Sentences are a user's points of one hour; their points vote."""
    tokens = others(spark, sf).withColumn("hour", F.floor(F.col("t") / (60 * MINUTE)))
    voted = I.turn_at(tokens, turns(spark, sf), "user_id", "t")
    heads = tokens.groupBy("user_id", "hour").agg(F.min("t").alias("t"))
    near = I.nearest_turn(heads, turns(spark, sf), "user_id", "t").drop("distance")
    return I.label_by_vote(near, voted, ["user_id", "hour"], "event_id").select("user_id", "hour", "speaker", "votes")


Q["j3_label_sentences"], O["j3_label_sentences"] = j3, EV + """,
tok AS (SELECT p.event_id, p.user_id, p.t // 3600000 AS hour, p.t, CASE WHEN p.t <= u.e THEN u.speaker END AS sp FROM pts p ASOF LEFT JOIN turns u ON p.user_id = u.user_id AND p.t >= u.s),
heads AS (SELECT user_id, hour, min(t) AS t FROM tok GROUP BY ALL),
v AS (SELECT user_id, hour, sp, count(*) AS n, min(event_id) AS f FROM tok WHERE sp IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, hour ORDER BY n DESC, f) AS k FROM v),
b AS (SELECT h.user_id, h.hour, h.t, u.s AS bs, greatest(h.t - u.e, 0) AS db, u.speaker AS lb FROM heads h ASOF LEFT JOIN turns u ON h.user_id = u.user_id AND h.t >= u.s),
n AS (SELECT b.*, u.s - b.t AS da, u.speaker AS la FROM b ASOF LEFT JOIN turns u ON b.user_id = u.user_id AND b.t < u.s)
SELECT n.user_id, n.hour, coalesce(r.sp, CASE WHEN bs IS NOT NULL AND (da IS NULL OR db <= da) THEN lb ELSE la END) AS speaker, coalesce(r.n, 0) AS votes
FROM n LEFT JOIN r ON r.user_id = n.user_id AND r.hour = n.hour AND r.k = 1"""


def k11(spark, sf):
    return I.merged_spans(spans(spark, sf), "user_id").select("user_id", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), "n_spans")


MERGED = """m0 AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM turns),
m1 AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e) AS g FROM m0),
m AS (SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n_spans FROM m1 GROUP BY user_id, g)"""
Q["k11_merged_spans"], O["k11_merged_spans"] = k11, ALL + "," + MERGED + " SELECT user_id, s AS start_ms, e AS end_ms, n_spans FROM m"


def k13(spark, sf):
    """Mute spans: padded by 0.1 s, at most 1.4 s or to the next start, clipped and merged."""
    p = points(spark, sf).withColumn("next", I.next_time(F.col("t"), "user_id", "t"))
    hit = p.where("event_type = 'error'").select("user_id", F.greatest(F.col("t") - 100, F.lit(0)).alias("start"), (F.least(F.col("t") + 1400, F.coalesce("next", F.col("t") + 1400)) + 100).alias("end"))
    return I.merged_spans(hit, "user_id").select("user_id", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), "n_spans")


Q["k13_spans_to_mute"], O["k13_spans_to_mute"] = k13, """WITH ev AS (SELECT user_id, event_type, (epoch_us(ts) // 1000) AS t FROM events),
nx AS (SELECT *, min(t) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nt FROM ev),
turns AS (SELECT user_id, greatest(t - 100, 0) AS s, least(t + 1400, coalesce(nt, t + 1400)) + 100 AS e FROM nx WHERE event_type = 'error'),
""" + MERGED + " SELECT user_id, s AS start_ms, e AS end_ms, n_spans FROM m"


def u2(spark, sf):
    merged = I.merged_spans(spans(spark, sf), "user_id")
    bounds = spans(spark, sf).groupBy("user_id").agg((F.min("start") - MINUTE).alias("lo"), (F.max("end") + MINUTE).alias("hi"))
    return I.complement(merged, bounds, "user_id").select("user_id", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"))


Q["u2_complement"], O["u2_complement"] = u2, ALL + "," + MERGED + """, c AS (SELECT user_id, min(s) - 60000 AS lo, max(e) + 60000 AS hi FROM turns GROUP BY 1),
x AS (SELECT user_id, s, e FROM m UNION ALL SELECT user_id, hi, hi FROM c),
y AS (SELECT x.user_id, coalesce(max(e) OVER (PARTITION BY x.user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo) AS start_ms, s AS end_ms FROM x JOIN c USING (user_id))
SELECT * FROM y WHERE start_ms < end_ms"""


def w1(spark, sf):
    """Runs of low values that last an hour or more."""
    runs = I.islands(points(spark, sf), ["user_id"], ["t", "event_id"], F.col("value") < 20, "t").where(F.col("end") - F.col("start") >= 60 * MINUTE)
    return runs.select("user_id", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), "n")


Q["w1_silences"], O["w1_silences"] = w1, EV + """, a AS (SELECT *, value < 20 AS f, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n1 FROM ev),
b AS (SELECT *, n1 - row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS g FROM a WHERE f)
SELECT user_id, min(t) AS start_ms, max(t) AS end_ms, count(*) AS n FROM b GROUP BY user_id, g HAVING max(t) - min(t) >= 3600000"""


def w4(spark, sf):
    return I.sessions(points(spark, sf), "user_id", "t", 30 * MINUTE, "event_id").select("user_id", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), "n")


Q["w4_group_times"], O["w4_group_times"] = w4, EV + """, a AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 1800000 THEN 0 ELSE 1 END AS f FROM ev),
b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY t, event_id) AS g FROM a)
SELECT user_id, min(t) AS start_ms, max(t) AS end_ms, count(*) AS n FROM b GROUP BY user_id, g"""


def w8(spark, sf):
    """Stretches of over eight hours without a point, from the first point of all to the last."""
    p = points(spark, sf)
    edges = p.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    ends = p.select("user_id").distinct().join(F.broadcast(edges)).select("user_id", F.explode(F.array("a", "b")).alias("t"))
    return I.gaps(p.select("user_id", "t").unionByName(ends), "user_id", "t", 8 * 60 * MINUTE).select("user_id", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"))


Q["w8_gaps"], O["w8_gaps"] = w8, EV + """SELECT user_id, t AS start_ms, nt AS end_ms FROM (SELECT user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nt FROM (SELECT user_id, t FROM ev UNION ALL SELECT user_id, unnest([a, b]) FROM (SELECT DISTINCT user_id FROM ev), (SELECT min(t) AS a, max(t) AS b FROM ev))) WHERE nt - t > 28800000"""


def j8(spark, sf):
    """Points outside of turns (a second inside their edges), put together again by hour."""
    quiet = turns(spark, sf).select("user_id", "start", "end")
    left = I.points_in_spans(others(spark, sf), quiet, "user_id", "t", 60 * MINUTE, "left_anti", 1000, 1000)
    g = left.groupBy("user_id", F.floor(F.col("t") / (60 * MINUTE)).alias("hour")).agg(F.array_sort(F.collect_list(F.struct("t", "event_id", "event_type"))).alias("a"))
    return g.select("user_id", "hour", F.array_join(F.transform("a", lambda x: x["event_type"]), " ").alias("line"), F.size("a").cast("long").alias("n"))


Q["j8_without_silence"], O["j8_without_silence"] = j8, EV + "SELECT user_id, t // 3600000 AS hour, string_agg(event_type, ' ' ORDER BY t, event_id) AS line, count(*) AS n FROM pts p WHERE NOT EXISTS (SELECT 1 FROM turns u WHERE u.user_id = p.user_id AND p.t >= u.s + 1000 AND p.t < u.e - 1000) GROUP BY 1, 2"


def j8_dropped(spark, sf):
    """Points that each turn takes out, counted by turn."""
    out = I.points_in_spans(others(spark, sf), turns(spark, sf), "user_id", "t", 60 * MINUTE, "inner", 1000, 1000)
    return out.groupBy("user_id", "span_start", "span_end").agg(F.count(F.lit(1)).alias("n"))


Q["j8_words_per_stretch"], O["j8_words_per_stretch"] = j8_dropped, EV + "SELECT p.user_id, u.s AS span_start, u.e AS span_end, count(*) AS n FROM pts p JOIN turns u ON u.user_id = p.user_id AND p.t >= u.s + 1000 AND p.t < u.e - 1000 GROUP BY ALL"


def j10(spark, sf):
    """Points clipped to spans: each with the time left in the span."""
    return I.points_in_spans(others(spark, sf), turns(spark, sf), "user_id", "t", 60 * MINUTE).select(
        "event_id", "span_start", F.least(F.col("t") + 60000, F.col("span_end")).alias("clipped_end")
    )


Q["j10_within"], O["j10_within"] = j10, EV + "SELECT event_id, u.s AS span_start, least(p.t + 60000, u.e) AS clipped_end FROM pts p JOIN (SELECT DISTINCT ON (user_id, s, event_id) * FROM turns) u ON u.user_id = p.user_id AND p.t >= u.s AND p.t < u.e".replace("SELECT event_id,", "SELECT p.event_id,")


def j5(spark, sf):
    items = others(spark, sf).select("user_id", F.col("event_id").alias("item"), F.col("t").alias("start"), (F.col("t") + 5 * MINUTE).alias("end"))
    segments = turns(spark, sf).withColumnRenamed("event_id", "segment")
    best = I.best_overlap(items, segments, "user_id", "item", 60 * MINUTE).select("item", "segment", "shared")
    alone = items.join(best, "item", "left_anti").select("user_id", "item", F.col("start").alias("t"))
    near = I.nearest_turn(alone, segments, "user_id", "t", label="segment").where("nearest_speaker IS NOT NULL")
    return best.unionByName(near.select("item", F.col("nearest_speaker").alias("segment"), F.lit(0).cast("long").alias("shared")))


Q["j5_segment_of"], O["j5_segment_of"] = j5, EV + """, x AS (SELECT p.event_id AS item, u.event_id AS segment, least(p.t + 300000, u.e) - greatest(p.t, u.s) AS shared FROM pts p JOIN turns u ON u.user_id = p.user_id AND u.s < p.t + 300000 AND u.e > p.t),
y AS (SELECT item, segment, shared FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY shared DESC, segment) AS k FROM x WHERE shared > 0) WHERE k = 1),
al AS (SELECT * FROM pts WHERE event_id NOT IN (SELECT item FROM y)),
b AS (SELECT p.event_id, p.user_id, p.t, u.s AS bs, greatest(p.t - u.e, 0) AS db, u.event_id AS lb FROM al p ASOF LEFT JOIN turns u ON p.user_id = u.user_id AND p.t >= u.s),
n AS (SELECT b.*, u.s - b.t AS da, u.event_id AS la FROM b ASOF LEFT JOIN turns u ON b.user_id = u.user_id AND b.t < u.s)
SELECT * FROM y UNION ALL SELECT event_id, CASE WHEN bs IS NOT NULL AND (da IS NULL OR db <= da) THEN lb ELSE la END, 0 FROM n WHERE bs IS NOT NULL OR la IS NOT NULL"""


def a19(spark, sf):
    """Share of each user's time from first to last point that turns cover."""
    merged = I.merged_spans(turns(spark, sf), "user_id")
    bounds = points(spark, sf).groupBy("user_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    cover = F.sum(I.overlap(F.col("start"), F.col("end"), F.col("lo"), F.col("hi")))
    return merged.join(bounds, "user_id").groupBy("user_id").agg(cover.alias("covered"), (F.max("hi") - F.max("lo")).alias("total"))


Q["a19_covered"], O["a19_covered"] = a19, EV + "," + MERGED + ", c AS (SELECT user_id, min(t) AS lo, max(t) AS hi FROM ev GROUP BY 1) SELECT m.user_id, CAST(sum(greatest(least(e, hi) - greatest(s, lo), 0)) AS BIGINT) AS covered, max(hi) - max(lo) AS total FROM m JOIN c USING (user_id) GROUP BY 1"


def w3(spark, sf):
    """Consecutive points of one type are a block; a gap of over two days breaks it."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    p = points(spark, sf).withColumn("new", F.when((F.lag("event_type").over(w) == F.col("event_type")) & (F.col("t") - F.lag("t").over(w) <= 2880 * MINUTE), 0).otherwise(1)).withColumn("block", F.sum("new").over(w))
    return p.groupBy("user_id", "block").agg(F.first("event_type").alias("event_type"), F.min("t").alias("start_ms"), F.max("t").alias("end_ms"), F.count(F.lit(1)).alias("n"))


Q["w3_turns"], O["w3_turns"] = w3, EV + """, a AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type AND t - lag(t) OVER w <= 172800000 THEN 0 ELSE 1 END AS f FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY t, event_id) AS block FROM a)
SELECT user_id, CAST(block AS BIGINT) AS block, min(event_type) AS event_type, min(t) AS start_ms, max(t) AS end_ms, count(*) AS n FROM b GROUP BY user_id, block"""


def w6(spark, sf):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    return points(spark, sf).select("event_id", F.coalesce(F.lead("t").over(w), F.col("t") + 1000).alias("word_end"))


Q["w6_word_end"], O["w6_word_end"] = w6, EV + "SELECT event_id, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id), t + 1000) AS word_end FROM ev"


def w7(spark, sf):
    """Backwards steps of value in time order."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    step = points(spark, sf).select("user_id", (F.lag("value").over(w) - F.col("value")).alias("back"))
    return step.groupBy("user_id").agg(F.count(F.when(F.col("back") > 0, 1)).alias("n_back"), F.round(F.max("back"), 6).alias("largest"))


Q["w7_inversions"], O["w7_inversions"] = w7, EV + "SELECT user_id, count(CASE WHEN b > 0 THEN 1 END) AS n_back, round(max(b), 6) AS largest FROM (SELECT user_id, lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id) - value AS b FROM ev) GROUP BY 1"


def w10(spark, sf):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    p = points(spark, sf).withColumns({"before": F.lag("event_type").over(w), "lower_bound": F.lag("t").over(w)})
    return p.where(F.col("before") != F.col("event_type")).select("event_id", "t", "lower_bound", "before", F.when(F.col("event_type") == "error", "view_cut").otherwise("slide_flip").alias("kind"))


Q["w10_changepoints"], O["w10_changepoints"] = w10, EV + "SELECT event_id, t, lower_bound, before, CASE WHEN event_type = 'error' THEN 'view_cut' ELSE 'slide_flip' END AS kind FROM (SELECT *, lag(event_type) OVER w AS before, lag(t) OVER w AS lower_bound FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) WHERE before <> event_type"


def w11(spark, sf):
    return points(spark, sf).select("event_id", I.next_time(F.col("t"), "user_id", "t").alias("next_start"))


Q["w11_next_start"], O["w11_next_start"] = w11, EV + "SELECT event_id, min(t) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_start FROM ev"


def w16(spark, sf):
    """Points whose running largest value has stood for a day or more."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    p = points(spark, sf).withColumn("top", F.max("value").over(w)).withColumn("since", F.when((F.lag("top").over(w) != F.col("top")) | F.lag("top").over(w).isNull(), F.col("t")))
    p = p.withColumn("since", F.last("since", ignorenulls=True).over(w))
    return p.where(F.col("t") - F.col("since") >= 24 * 60 * MINUTE).select("event_id", (F.col("t") - F.col("since")).alias("stalled_ms"))


Q["w16_stalled"], O["w16_stalled"] = w16, EV + """, a AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY t, event_id) AS top FROM ev),
b AS (SELECT *, CASE WHEN lag(top) OVER w IS NULL OR lag(top) OVER w <> top THEN t END AS c FROM a WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
d AS (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id) AS since FROM b)
SELECT event_id, t - since AS stalled_ms FROM d WHERE t - since >= 86400000"""


def a28(spark, sf):
    """Loudness: mean square of a frame of a day in decibels, part frames of under five points dropped."""
    p = points(spark, sf).withColumn("frame", F.floor(F.col("t") / (24 * 60 * MINUTE)))
    power = F.avg(F.col("value") * F.col("value"))
    return p.groupBy("user_id", "frame").agg(F.round(10 * F.log10(F.greatest(power, F.lit(1e-18))), 6).alias("db"), F.count(F.lit(1)).alias("n")).where("n >= 5").drop("n")


Q["a28_loudness"], O["a28_loudness"] = a28, EV + "SELECT user_id, t // 86400000 AS frame, round(10 * log10(greatest(avg(value * value), 1e-18)), 6) AS db FROM ev GROUP BY 1, 2 HAVING count(*) >= 5"


def a29(spark, sf):
    p = points(spark, sf).withColumn("bucket", F.floor(F.col("t") / (6 * 60 * MINUTE)))
    scaled = lambda c: F.greatest(F.least(F.floor(c / 100 * 127 + 0.5), F.lit(127)), F.lit(-127)).cast("long")
    return p.groupBy("user_id", "bucket").agg(scaled(F.min("value")).alias("low"), scaled(F.max("value")).alias("high"))


Q["a29_envelope"], O["a29_envelope"] = a29, EV + "SELECT user_id, t // 21600000 AS bucket, CAST(greatest(least(floor(min(value) / 100 * 127 + 0.5), 127), -127) AS BIGINT) AS low, CAST(greatest(least(floor(max(value) / 100 * 127 + 0.5), 127), -127) AS BIGINT) AS high FROM ev GROUP BY 1, 2"


def a24(spark, sf):
    """Upper median of the gaps between a user's points, of three gaps or more."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    g = points(spark, sf).select("user_id", (F.col("t") - F.lag("t").over(w)).alias("gap")).where("gap IS NOT NULL")
    ranked = g.withColumns({"r": F.row_number().over(Window.partitionBy("user_id").orderBy("gap")), "n": F.count(F.lit(1)).over(Window.partitionBy("user_id"))})
    return ranked.where("n >= 3 AND r = floor(n / 2) + 1").select("user_id", F.col("gap").alias("typical_gap"))


Q["a24_time_left"], O["a24_time_left"] = a24, EV + """, g AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM ev),
r AS (SELECT user_id, gap, row_number() OVER (PARTITION BY user_id ORDER BY gap) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM g WHERE gap IS NOT NULL)
SELECT user_id, gap AS typical_gap FROM r WHERE n >= 3 AND r = n // 2 + 1"""


def k1(spark, sf):
    """Starts of chunks of 120 s that overlap by 15 s over each user's time."""
    total = points(spark, sf).groupBy("user_id").agg(((F.max("t") - F.min("t")) / 1000).cast("long").alias("total"))
    return total.where("total > 0").select("user_id", F.explode(F.sequence(F.lit(0), F.col("total") - 1, F.lit(105 * 60))).alias("chunk_start"))


Q["k1_chunk_starts"], O["k1_chunk_starts"] = k1, EV + "SELECT user_id, unnest(range(0, total, 6300)) AS chunk_start FROM (SELECT user_id, (max(t) - min(t)) // 1000 AS total FROM ev GROUP BY 1) WHERE total > 0"


def t6(spark, sf):
    """The next low value after each purchase, else the user's first."""
    p = points(spark, sf)
    low = F.when(F.col("value") < 5, F.col("t"))
    first = F.min(low).over(Window.partitionBy("user_id"))
    return p.select("event_id", "event_type", F.coalesce(I.next_time(low, "user_id", "t"), first).alias("next_low")).where("event_type = 'purchase'").drop("event_type")


Q["t6_step_unsure"], O["t6_step_unsure"] = t6, EV + """, a AS (SELECT event_id, event_type, coalesce(min(CASE WHEN value < 5 THEN t END) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min(CASE WHEN value < 5 THEN t END) OVER (PARTITION BY user_id)) AS next_low FROM ev)
SELECT event_id, next_low FROM a WHERE event_type = 'purchase'"""
