"""Readings of chunks merged at their seams, sentences cut apart where they overlap, gaps read again."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window, functions as F

from ..operators import seams
from ..operators.groups import each_group, parts_of
from .queries_text import table
from .queries_time import EV, MINUTE, points

Q, O = {}, {}
CHUNK, STEP, WORD_MS = 120, 105, 500
OVERLAP, LEAST = (CHUNK - STEP) * WORD_MS, 10_000
#: What stands between words: the SQL's \s, which Spark's exceeds by the vertical tab.
SPACE = r"[ \t\n\f\r]+"


def readings(spark, sf):
    """(conv_id, chunk, begins, lasts, i, word, at, until): a conversation's words, half a second each, as its chunks of a minute heard them.

    Chunks overlap by 15 words. Each reading misses some words, hears some otherwise and times all a little off.
    A turn without text has no words; turns without a number come last. Turns of one number stand by their words.
    """
    c = table(spark, sf, "conversations").where("text IS NOT NULL")
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.isnull("turn").alias("last"), "turn", F.split("text", SPACE).alias("w")))).alias("a"))
    w = g.select("conv_id", F.flatten(F.transform("a", lambda x: x["w"])).alias("w")).select("conv_id", F.size("w").alias("n"), F.posexplode("w").alias("i", "word"))
    first = F.greatest(F.ceil((F.col("i") - CHUNK + 1) / STEP), F.lit(0))
    r = w.select("*", F.explode(F.sequence(first, F.floor(F.col("i") / STEP))).alias("chunk"))
    h = (F.col("i") * 31 + F.col("chunk") * 17) % 29
    at = (F.col("i") - F.col("chunk") * STEP) * WORD_MS + (F.col("i") * 7 + F.col("chunk") * 13) % 5 * 40 + 120
    return r.where(h != 0).select(
        "conv_id", "chunk", (F.col("chunk") * STEP * WORD_MS).alias("begins"), (F.least(F.lit(CHUNK), F.col("n") - F.col("chunk") * STEP) * WORD_MS).alias("lasts"),
        "i", F.when(h == 1, F.concat("word", F.lit("~"))).otherwise(F.col("word")).alias("word"), at.alias("at"), (at + 300).alias("until"),
    )


def placed(spark, sf):
    """The readings' tokens by place in their chunk, with times of the recording."""
    order = Window.partitionBy("conv_id", "chunk").orderBy("i")
    return readings(spark, sf).select("conv_id", "chunk", (F.row_number().over(order) - 1).alias("place"), "word", (F.col("begins") + F.col("at")).alias("start"), (F.col("begins") + F.col("until")).alias("end"))


READ = rf"""WITH RECURSIVE c AS (SELECT conv_id, turn, string_split_regex(text, '\s+') AS w FROM conversations),
f AS (SELECT conv_id, flatten(list(w ORDER BY turn)) AS w FROM c GROUP BY 1),
i AS (SELECT conv_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM f),
k AS (SELECT *, unnest(range(greatest((i - {CHUNK - 1} + {STEP - 1}) // {STEP}, 0), i // {STEP} + 1)) AS chunk FROM i),
r AS (SELECT conv_id, chunk, row_number() OVER (PARTITION BY conv_id, chunk ORDER BY i) - 1 AS place, CASE WHEN (i * 31 + chunk * 17) % 29 = 1 THEN word || '~' ELSE word END AS word,
  i * {WORD_MS} + (i * 7 + chunk * 13) % 5 * 40 + 120 AS s, i * {WORD_MS} + (i * 7 + chunk * 13) % 5 * 40 + 420 AS e FROM k WHERE (i * 31 + chunk * 17) % 29 <> 0),
edge AS (SELECT conv_id, chunk, arg_min(s, place) AS first, arg_max(e, place) AS last FROM r GROUP BY 1, 2),
seam AS (SELECT x.conv_id, x.chunk, y.first AS b_first, x.last AS a_last FROM edge x JOIN edge y ON x.conv_id = y.conv_id AND y.chunk = x.chunk + 1 WHERE x.last > y.first),
a AS (SELECT r.*, row_number() OVER (PARTITION BY r.conv_id, r.chunk ORDER BY place) AS n FROM r JOIN seam USING (conv_id, chunk) WHERE e > b_first - {OVERLAP}),
b AS (SELECT r.conv_id, seam.chunk, r.place, r.word, r.s, row_number() OVER (PARTITION BY r.conv_id, r.chunk ORDER BY place) AS n FROM r JOIN seam ON r.conv_id = seam.conv_id AND r.chunk = seam.chunk + 1 WHERE s < a_last + {OVERLAP}),
sides AS (SELECT * FROM (SELECT conv_id, chunk, count(*) AS n_a, list(word ORDER BY n) AS aw, list(s ORDER BY n) AS ats FROM a GROUP BY 1, 2)
  JOIN (SELECT conv_id, chunk, count(*) AS n_b, list(word ORDER BY n) AS bw, list(s ORDER BY n) AS bts FROM b GROUP BY 1, 2) USING (conv_id, chunk) WHERE n_a >= 2 AND n_b >= 2)
"""


def _digest(merged):
    g = merged.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("place", "word"))).alias("a"))
    return g.select("conv_id", "n", F.md5(F.array_join(F.transform("a", lambda x: x["word"]), " ")).alias("digest"))


def k2(spark, sf):
    """All readings of a conversation folded into one stream; a last chunk of under ten seconds isn't read."""
    return _digest(seams.chunk_loop(readings(spark, sf), "conv_id", OVERLAP, LEAST))


Q["k2_chunk_loop"] = k2


def s16r(spark, sf):
    """The chunk loop taken up where an earlier run stopped, at the fourth chunk: its tokens are banked, earlier chunks are skipped."""
    r = readings(spark, sf)
    banked = seams.chunk_loop(r.where("chunk < 3"), "conv_id", OVERLAP, LEAST)
    marks = r.groupBy("conv_id").agg(F.lit(3 * STEP * WORD_MS).alias("next_start"))
    return _digest(seams.chunk_loop(r, "conv_id", OVERLAP, LEAST, banked, marks))


Q["s16_resumed_chunks"] = s16r


def k3(spark, sf):
    """The longest run of equal words at the seam of each reading with the next, and whether it is long enough to merge along."""
    return seams.contiguous_seams(placed(spark, sf), "conv_id", OVERLAP)


Q["k3_merge_contiguous"], O["k3_merge_contiguous"] = k3, READ + f""", p AS (SELECT a.conv_id, a.chunk, a.place AS i, b.place AS j FROM a JOIN b ON a.conv_id = b.conv_id AND a.chunk = b.chunk AND a.word = b.word AND abs(a.s - b.s) < {OVERLAP // 2}),
g AS (SELECT *, i - j AS d, i - row_number() OVER (PARTITION BY conv_id, chunk, i - j ORDER BY i) AS g FROM p),
runs AS (SELECT conv_id, chunk, count(*) AS run, min(i) AS i, min(j) AS j FROM g GROUP BY conv_id, chunk, d, g),
best AS (SELECT *, row_number() OVER (PARTITION BY conv_id, chunk ORDER BY run DESC, i, j) AS k FROM runs)
SELECT conv_id, chunk, n_a, coalesce(run, 0) AS run, i AS a_at, j AS b_at, coalesce(run, 0) >= n_a // 2 AS enough FROM sides LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (conv_id, chunk)"""


def k4(spark, sf):
    """The longest common subsequence at each seam, read from its end: places of its pairs in the two overlaps."""
    p = placed(spark, sf)
    edges = p.groupBy("conv_id", "chunk").agg(F.min_by("start", "place").alias("first"), F.max_by("end", "place").alias("last"))
    at = lambda by: edges.select("conv_id", (F.col("chunk") + by).alias("chunk"), F.col("first").alias("b_first"), F.col("last").alias("a_last"))
    bounds = edges.select("conv_id", "chunk", F.col("last").alias("a_last")).join(at(-1).drop("a_last"), ["conv_id", "chunk"]).where("a_last > b_first")
    a = p.join(bounds, ["conv_id", "chunk"]).where(F.col("end") > F.col("b_first") - OVERLAP).withColumn("side", F.lit(0))
    b = p.withColumn("chunk", F.col("chunk") - 1).join(bounds, ["conv_id", "chunk"]).where(F.col("start") < F.col("a_last") + OVERLAP).withColumn("side", F.lit(1))

    def pairs(part: list[tuple]) -> list[tuple]:
        x, y = ([r for r in part if r[5] == side] for side in (0, 1))
        if min(len(x), len(y)) < 2:
            return []
        number: dict[str, int] = {}
        (words, starts), (others, times) = (np.array([(number.setdefault(r[3], len(number)), r[4]) for r in side]).T for side in (x, y))
        same = (words[:, None] == others) & (abs(starts[:, None] - times) < OVERLAP / 2)
        found = seams.longest_subsequence(same)
        return [(*part[0][:2], len(found), ",".join(f"{i}:{j}" for i, j in found))]

    both = a.unionByName(b).select("conv_id", "chunk", "place", "word", "start", "side")
    return each_group(both, ["conv_id", "chunk"], ["place"], pairs, "conv_id long, chunk long, n long, pairs string")


Q["k4_merge_lcs"], O["k4_merge_lcs"] = k4, READ + f""", dp AS (
  SELECT conv_id, chunk, 0::BIGINT AS i, [0 for j in range(n_b + 1)] AS line FROM sides
  UNION ALL
  SELECT conv_id, chunk, i + 1, [0] || [list_max([CASE WHEN aw[i + 1] = bw[k] AND abs(ats[i + 1] - bts[k]) < {OVERLAP // 2} THEN line[k] + 1 ELSE line[k + 1] END for k in range(1, j + 1)]) for j in range(1, n_b + 1)]
  FROM dp JOIN sides USING (conv_id, chunk) WHERE i < n_a),
back AS (
  SELECT conv_id, chunk, n_a AS i, n_b AS j, 0::BIGINT AS n, '' AS pairs FROM sides
  UNION ALL
  SELECT conv_id, chunk, CASE WHEN eq OR up THEN i - 1 ELSE i END, CASE WHEN eq OR NOT up THEN j - 1 ELSE j END, CASE WHEN eq THEN n + 1 ELSE n END,
    CASE WHEN eq THEN concat(i - 1, ':', j - 1, CASE WHEN pairs = '' THEN '' ELSE ',' END, pairs) ELSE pairs END
  FROM (SELECT b.*, aw[b.i] = bw[b.j] AND abs(ats[b.i] - bts[b.j]) < {OVERLAP // 2} AS eq, o.line[b.j + 1] > h.line[b.j] AS up
    FROM back b JOIN sides USING (conv_id, chunk) JOIN dp h ON h.conv_id = b.conv_id AND h.chunk = b.chunk AND h.i = b.i JOIN dp o ON o.conv_id = b.conv_id AND o.chunk = b.chunk AND o.i = b.i - 1 WHERE b.i > 0 AND b.j > 0))
SELECT conv_id, chunk, n, pairs FROM back WHERE i = 0 OR j = 0"""


def j25(spark, sf):
    """The merge at seven pairing tolerances: steps back in time, which get fewer as words must be nearer to pair."""
    tolerances = [OVERLAP / 2, 3000, 2000, 1000, 500, 250, 100]
    return seams.replayed(readings(spark, sf), "conv_id", OVERLAP, tolerances)


Q["j25_seam_replay"] = j25


def spoken(spark, sf):
    """(user_id, sent, token, t, e): events as tokens, six to a sentence; some are timed hours early, some have no end."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    p = points(spark, sf).withColumn("n", F.row_number().over(w) - 1)
    early = F.when(F.col("event_id") % 7 == 0, F.col("event_id") % 3 * 720 * MINUTE).otherwise(0)
    t = F.col("t") - early
    return p.select("user_id", F.floor(F.col("n") / 6).alias("sent"), F.col("event_id").alias("token"), t.alias("t"), F.when(F.col("event_id") % 11 != 0, t + F.col("event_id") % 240 * MINUTE).alias("e"))


SPOKEN = EV + """, sp AS (SELECT user_id, event_id AS token, t - CASE WHEN event_id % 7 = 0 THEN event_id % 3 * 43200000 ELSE 0 END AS t, (row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1) // 6 AS sent FROM ev),
tk AS (SELECT *, CASE WHEN token % 11 <> 0 THEN t + token % 240 * 60000 END AS e FROM sp)"""


def k12c(spark, sf):
    """Where each sentence and the next, if they overlap, are best cut apart."""
    s = spoken(spark, sf)
    bounds = s.groupBy("user_id", "sent").agg(F.min("t").alias("start"), F.max(F.coalesce("e", "t")).alias("end"))
    after = bounds.select("user_id", (F.col("sent") - 1).alias("sent"), F.col("start").alias("next_start"))
    pair = bounds.join(after, ["user_id", "sent"]).where("end > next_start").select("user_id", F.col("sent").alias("seam"))
    sides = s.select("*", F.explode(F.array(F.struct(F.col("sent").alias("seam"), F.lit(False).alias("of_b")), F.struct((F.col("sent") - 1).alias("seam"), F.lit(True).alias("of_b")))).alias("x"))
    sides = sides.select("user_id", "x.seam", "x.of_b", "token", "t", "e").join(pair, ["user_id", "seam"])
    return seams.cheapest_cuts(sides, ["user_id", "seam"])


Q["k12_seam_cut"], O["k12_seam_cut"] = k12c, SPOKEN + """, b AS (SELECT user_id, sent, min(t) AS s, max(coalesce(e, t)) AS e FROM tk GROUP BY 1, 2),
p AS (SELECT a.user_id, a.sent AS seam FROM b a JOIN b ON a.user_id = b.user_id AND b.sent = a.sent + 1 WHERE a.e > b.s),
x AS (SELECT p.user_id, p.seam, tk.sent > p.seam AS of_b, t, coalesce(e, t) AS e, token FROM p JOIN tk ON tk.user_id = p.user_id AND tk.sent IN (p.seam, p.seam + 1)),
n AS (SELECT *, row_number() OVER w AS cut, lead(t) OVER w - max(e) OVER (w ROWS UNBOUNDED PRECEDING) AS pause,
  count(*) FILTER (of_b) OVER (w ROWS UNBOUNDED PRECEDING) + count(*) FILTER (NOT of_b) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS moved FROM x WINDOW w AS (PARTITION BY user_id, seam ORDER BY t, of_b, token)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, seam ORDER BY moved, pause DESC, cut) AS k FROM n WHERE pause >= 0)
SELECT user_id, seam, cut, moved, pause FROM r WHERE k = 1"""


def k12(spark, sf):
    """Sentences after overlapping ones are cut apart, again and again until none overlap that can be cut."""
    s = seams.split_at_seams(spoken(spark, sf), "user_id")
    g = s.groupBy("user_id", F.col("sent_after").alias("sent"))
    return g.agg(F.min("t").alias("start_ms"), F.max(F.coalesce("e", "t")).alias("end_ms"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("sent") != F.col("sent_after"), 1).otherwise(0)).alias("moved"))


Q["k12_split_at_seams"] = k12


def k8(spark, sf):
    """Gaps of over a day read again, three deep: each reading hears only every fourth of the events that the ones before missed."""
    p = points(spark, sf).select("user_id", "event_id", F.col("t").cast("double").alias("t"), (F.col("t") + F.col("event_id") % 60 * MINUTE).cast("double").alias("e"))
    heard = lambda level: p.where(F.col("event_id") % 4 == level)
    parts = parts_of(p)

    def decode(gaps, level):
        """Gaps of a user don't overlap: an event can only lie in the last one that began before it."""
        rows = gaps.select("user_id", F.col("lo").alias("t"), F.lit(0).alias("o"), "hi").unionByName(heard(level).select("user_id", "t", F.lit(1).alias("o"), "e"), allowMissingColumns=True)
        w = Window.partitionBy("user_id").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
        found = rows.repartition(parts, "user_id").withColumns({"lo": F.last(F.when(F.col("o") == 0, F.col("t")), ignorenulls=True).over(w), "hi": F.last("hi", ignorenulls=True).over(w)})
        return found.where("o = 1 AND t < hi")

    bounds = p.groupBy("user_id").agg((F.max("t") + 2880 * MINUTE).alias("hi"))
    found = seams.reread(heard(0).select("user_id", "t", "e").repartition(parts, "user_id"), bounds, decode, "user_id", 1440 * MINUTE)
    return found.groupBy("user_id", "level").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("e") - F.col("t")) / MINUTE).cast("long").alias("minutes"))


GAP = "SELECT user_id, e AS lo, coalesce(lead(t) OVER (PARTITION BY user_id{0} ORDER BY t, e), hi) AS hi FROM {1}"
Q["k8_gap_reread"], O["k8_gap_reread"] = k8, EV + """, p AS (SELECT user_id, event_id, t, t + event_id % 60 * 60000 AS e FROM ev), bd AS (SELECT user_id, max(t) + 172800000 AS hi FROM ev GROUP BY 1),
l0 AS (SELECT p.user_id, t, e, hi FROM p JOIN bd USING (user_id) WHERE event_id % 4 = 0), g0 AS (""" + GAP.format("", "l0") + """),
l1 AS (SELECT p.user_id, t, e, lo, hi FROM g0 JOIN p USING (user_id) WHERE hi - lo > 86400000 AND event_id % 4 = 1 AND t >= lo AND t < hi), g1 AS (""" + GAP.format(", lo, hi", "l1") + """),
l2 AS (SELECT p.user_id, t, e, lo, hi FROM g1 JOIN p USING (user_id) WHERE hi - lo > 86400000 AND event_id % 4 = 2 AND t >= lo AND t < hi), g2 AS (""" + GAP.format(", lo, hi", "l2") + """),
l3 AS (SELECT p.user_id, t, e FROM g2 JOIN p USING (user_id) WHERE hi - lo > 86400000 AND event_id % 4 = 3 AND t >= lo AND t < hi),
x AS (SELECT user_id, t, e, 0 AS level FROM l0 UNION ALL SELECT user_id, t, e, 1 FROM l1 UNION ALL SELECT user_id, t, e, 2 FROM l2 UNION ALL SELECT user_id, t, e, 3 FROM l3)
SELECT user_id, level, count(*) AS n, CAST(sum((e - t) // 60000) AS BIGINT) AS minutes FROM x GROUP BY 1, 2"""
