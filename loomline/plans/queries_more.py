"""More queries over the same stand-ins: shaping, lookups, carried state and quality checks."""

from __future__ import annotations

import gzip

from functools import reduce

import pandas as pd
from pyspark.sql import Window, functions as F, types as T

from ..functions import text as X
from ..operators import intervals as I, kernels
from .queries_text import SENT, TOK, sentences, table, tokens
from .queries_time import ALL, EV, MINUTE, points, spans

Q, O = {}, {}


def p12(spark, sf):
    """Words under an engine's cutoff: values under a limit by event type; unknown types are never flagged."""
    cuts = spark.createDataFrame([("view", 3.0), ("click", 9.0), ("error", 5.0)], "event_type string, cut double")
    return points(spark, sf).join(F.broadcast(cuts), "event_type").where("value < cut").select("event_id")


Q["p12_unsure_words"], O["p12_unsure_words"] = p12, "SELECT event_id FROM events JOIN (VALUES ('view', 3.0::DOUBLE), ('click', 9.0), ('error', 5.0)) c(event_type, cut) USING (event_type) WHERE value < cut"


def p18(spark, sf):
    """Progress of each user: share of points done, speed, and time left where it moves."""
    p = points(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("value") >= 10, 1)).alias("done"), ((F.max("t") - F.min("t")) / 3600000).alias("hours"))
    return p.select("user_id", F.round(F.col("done") / F.col("n"), 6).alias("fraction"), F.round((F.col("n") - F.col("done")) * F.col("hours") / F.nullif("done", F.lit(0)), 6).alias("eta_hours"))


Q["p18_progress"], O["p18_progress"] = p18, "SELECT user_id, round(d / n, 6) AS fraction, round((n - d) * h / nullif(d, 0), 6) AS eta_hours FROM (SELECT user_id, count(*) AS n, count(CASE WHEN value >= 10 THEN 1 END) AS d, (max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000)) / 3600000 AS h FROM events GROUP BY 1)"


def p21(spark, sf):
    """Distinct labels of each conversation as a dense index."""
    w = Window.partitionBy("conv_id").orderBy("role")
    return table(spark, sf, "conversations").select("conv_id", "turn", (F.dense_rank().over(w) - 1).cast("long").alias("speaker"))


Q["p21_to_turns"], O["p21_to_turns"] = p21, "SELECT conv_id, turn, dense_rank() OVER (PARTITION BY conv_id ORDER BY role) - 1 AS speaker FROM conversations"


def p9(spark, sf):
    """Labels in order of first use."""
    first = table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    return first.select("conv_id", "role", (F.row_number().over(Window.partitionBy("conv_id").orderBy("first"))).cast("long").alias("place"))


Q["p9_labels_of"], O["p9_labels_of"] = p9, "SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY f) AS place FROM (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY 1, 2)"


def p24(spark, sf):
    """Where to resume: the last purchase, unless within an hour of either end."""
    p = points(spark, sf).groupBy("user_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.max(F.when(F.col("event_type") == "purchase", F.col("t"))).alias("at"))
    near = (F.col("at") - F.col("lo") < 60 * MINUTE) | (F.col("hi") - F.col("at") < 60 * MINUTE)
    return p.select("user_id", F.when(~near, F.col("at")).alias("resume_at"))


Q["p24_resume_at"], O["p24_resume_at"] = p24, EV + "SELECT user_id, CASE WHEN NOT (pt - lo < 3600000 OR hi - pt < 3600000) THEN pt END AS resume_at FROM (SELECT user_id, min(t) AS lo, max(t) AS hi, max(CASE WHEN event_type = 'purchase' THEN t END) AS pt FROM ev GROUP BY 1)"


def w5(spark, sf):
    """Words of tokens: a token (here up to three letters, with the space before it) opens one at the start of its line or with a space; others go on with it."""
    words = F.regexp_extract_all("line", F.lit(r"[ \t\r]*[^ \t\r]+"), F.lit(0))  # the tokens from one that opens a word up to the next such one
    return kernels.token_words(sentences(spark, sf).select("doc_id", "pos", words.alias("words")), "words", 3).withColumn("word", F.md5("word"))


Q["w5_words_from_tokens"], O["w5_words_from_tokens"] = w5, SENT + r""", p AS (SELECT doc_id, pos, regexp_extract_all(line, '[ \t\r]*[^ \t\r]{1,3}') AS w FROM s), k AS (SELECT doc_id, pos, i - 1 AS k, w[i] AS w FROM p, unnest(range(1, len(w) + 1)) AS u(i)),
g AS (SELECT *, sum(CASE WHEN k = 0 OR regexp_matches(w, '^[ \t\r]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, pos ORDER BY k) AS g FROM k)
SELECT doc_id, pos, CAST(g AS BIGINT) AS g, count(*) AS n, min(k) AS first, md5(string_agg(w, '' ORDER BY k)) AS word FROM g GROUP BY doc_id, pos, g"""


def w12(spark, sf):
    """Turns that begin exactly where, or before, the one before ends."""
    w = Window.partitionBy("user_id").orderBy("start", "event_id")
    t = spans(spark, sf).withColumn("before", F.lag("end").over(w))
    return t.where("start <= before").select("event_id", (F.col("before") - F.col("start")).alias("overlap"))


Q["w12_chained"], O["w12_chained"] = w12, ALL + "SELECT event_id, b - s AS overlap FROM (SELECT *, lag(e) OVER (PARTITION BY user_id ORDER BY s, event_id) AS b FROM turns) WHERE s <= b"


def w13(spark, sf):
    """Order numbers of a recording that jump, with the running total laid out before each."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") - F.lag("o_orderkey").over(w)).alias("jump"), F.row_number().over(w).cast("long").alias("n"))
    return o.where("jump > 1")


Q["w13_numbering_jumps"], O["w13_numbering_jumps"] = w13, "SELECT * FROM (SELECT o_custkey, o_orderkey, o_orderkey - lag(o_orderkey) OVER w AS jump, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE jump > 1"


def a13(spark, sf):
    """Violations of seven invariants, counted over turns (sentences with a token each), errors (unclear spans) and documents."""
    w = Window.partitionBy("user_id").orderBy("start", "event_id")
    token = F.col("start") + F.floor(F.col("value") * 10) * MINUTE
    t = spans(spark, sf).join(points(spark, sf).select("event_id", "value", "event_type"), "event_id").withColumns({"before": F.lag("end").over(w), "token": token})
    seconds = F.floor(F.col("value")) - 5
    u = points(spark, sf).where("event_type = 'error'").select("event_id", "user_id", F.col("t").alias("a"), (F.col("t") + seconds * 1000).alias("b"), (F.col("event_id") % 60).alias("n"))
    u = u.withColumn("__bin", F.floor(F.col("a") / (60 * MINUTE)))
    held = I.binned(t.select("user_id", "start", "end"), "start", "end", 60 * MINUTE).join(u, ["user_id", "__bin"]).where("start <= a AND b <= end")
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    counts = [
        t.where("before > start").agg(F.lit("overlaps").alias("name"), F.count(F.lit(1)).alias("n")),
        t.where("NOT (start <= token AND token + 500 <= end)").agg(F.lit("stray_tokens").alias("name"), F.count(F.lit(1)).alias("n")),
        u.where("b <= a").agg(F.lit("empty_unclear").alias("name"), F.count(F.lit(1)).alias("n")),
        u.where("b > a AND n * 1000 > 3 * (b - a)").agg(F.lit("crowded_unclear").alias("name"), F.count(F.lit(1)).alias("n")),
        held.agg(F.lit("unclear_inside").alias("name"), F.count(F.lit(1)).alias("n")),
        table(spark, sf, "documents").where(F.array_join(lines, "\n") != F.col("text")).agg(F.lit("text_mismatch").alias("name"), F.count(F.lit(1)).alias("n")),
        t.where("speaker NOT BETWEEN 0 AND 2").agg(F.lit("labels").alias("name"), F.count(F.lit(1)).alias("n")),
    ]
    return reduce(lambda a, b: a.unionByName(b), counts)


Q["a13_invariants"], O["a13_invariants"] = a13, ALL + """, t AS (SELECT turns.*, lag(e) OVER (PARTITION BY turns.user_id ORDER BY s, turns.event_id) AS before, s + CAST(floor(value * 10) AS BIGINT) * 60000 AS token FROM turns JOIN ev USING (event_id)),
u AS (SELECT user_id, t AS a, t + (CAST(floor(value) AS BIGINT) - 5) * 1000 AS b, event_id % 60 AS n FROM ev WHERE event_type = 'error')
SELECT 'overlaps' AS name, count(*) AS n FROM t WHERE before > s UNION ALL SELECT 'stray_tokens', count(*) FROM t WHERE NOT (s <= token AND token + 500 <= e)
UNION ALL SELECT 'empty_unclear', count(*) FROM u WHERE b <= a UNION ALL SELECT 'crowded_unclear', count(*) FROM u WHERE b > a AND n * 1000 > 3 * (b - a)
UNION ALL SELECT 'unclear_inside', count(*) FROM u JOIN turns ON turns.user_id = u.user_id AND s <= a AND b <= e
UNION ALL SELECT 'text_mismatch', count(*) FROM documents WHERE array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10)) <> text
UNION ALL SELECT 'labels', count(*) FROM t WHERE speaker NOT BETWEEN 0 AND 2"""


def a7(spark, sf):
    """Share of time in lines with over a tenth of accented characters, by language."""
    s = sentences(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").withColumn("n", F.length("line"))
    heavy = F.length(F.regexp_replace("line", "[^éèêëàâçîïôûùäöüßñáíóú]", "")) > 0.1 * F.col("n")
    return s.groupBy("lang").agg(F.round(F.sum(F.when(heavy, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("share"))


Q["a7_seconds_share"], O["a7_seconds_share"] = a7, SENT + "SELECT lang, round(sum(CASE WHEN length(regexp_replace(line, '[^éèêëàâçîïôûùäöüßñáíóú]', '', 'g')) > 0.1 * length(line) THEN length(line) ELSE 0 END) / sum(length(line)), 6) AS share FROM s JOIN documents USING (doc_id) GROUP BY 1"


def a23(spark, sf):
    """Review counts of each source: labelled, good, toxic, and progress."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count("quality").alias("checked"), F.count(F.when(F.col("quality") == 0, 1)).alias("flagged"), F.round(F.count("quality") / F.count(F.lit(1)), 6).alias("progress"))


Q["a23_review_counts"], O["a23_review_counts"] = a23, "SELECT source, count(quality) AS checked, count(CASE WHEN quality = 0 THEN 1 END) AS flagged, round(count(quality) / count(*), 6) AS progress FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"


def j18(spark, sf):
    """Distance of each error to the nearest purchase of its user."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    back = Window.partitionBy("user_id").orderBy(F.desc("t"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("event_type") == "purchase", F.col("t"))
    p = points(spark, sf).withColumns({"b": F.last(mark, ignorenulls=True).over(w), "a": F.last(mark, ignorenulls=True).over(back)})
    return p.where("event_type = 'error'").select("event_id", F.least(F.col("t") - F.col("b"), F.col("a") - F.col("t")).alias("distance"))


Q["j18_nearest_mark"], O["j18_nearest_mark"] = j18, EV + """, m AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN t END IGNORE NULLS) OVER w AS b, min(CASE WHEN event_type = 'purchase' THEN t END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, least(t - b, a - t) AS distance FROM m WHERE event_type = 'error'"""


def k20(spark, sf):
    """Gain of each point: the product over its user's muted spans (an error and `value` minutes after it) of raised-cosine fades of an hour on both sides."""
    p, fade = points(spark, sf), 60 * MINUTE
    muted = p.where("event_type = 'error'").select("user_id", F.col("t").alias("a"), (F.col("t") + F.floor(F.col("value") * MINUTE)).alias("b"))
    wide = I.binned(muted.withColumns({"start": F.col("a") - fade, "end": F.col("b") + fade}), "start", "end", fade).select("user_id", "a", "b", "__bin")
    far = F.least(F.greatest(F.col("a") - F.col("t"), F.col("t") - F.col("b"), F.lit(0)) / fade, F.lit(1.0))
    met = p.withColumn("__bin", F.floor(F.col("t") / fade)).join(wide, ["user_id", "__bin"], "left")
    gain = F.product(F.when(F.col("a").isNotNull(), 0.5 - 0.5 * F.cos(far * F.lit(3.141592653589793))))
    return met.groupBy("event_id").agg(F.round(F.coalesce(gain, F.lit(1.0)), 6).alias("gain"))


Q["k20_gain_at"], O["k20_gain_at"] = k20, EV + """, m AS (SELECT user_id, t AS a, t + CAST(floor(value * 60000) AS BIGINT) AS b FROM ev WHERE event_type = 'error')
SELECT event_id, round(coalesce(product(CASE WHEN a IS NOT NULL THEN 0.5 - 0.5 * cos(3.141592653589793::DOUBLE * least(greatest(a - t, t - b, 0) / 3600000, 1)) END), 1), 6) AS gain FROM ev LEFT JOIN m ON m.user_id = ev.user_id AND t BETWEEN a - 3600000 AND b + 3600000 GROUP BY 1"""


@F.pandas_udf(T.BinaryType())
def zipped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else gzip.compress(x.encode("utf-8", "surrogatepass"), mtime=0))


@F.pandas_udf(T.StringType())
def unzipped(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else gzip.decompress(x).decode("utf-8", "surrogatepass"))


CUE = 60_000


def embedded(texts, key: str, text: str, size: int = CUE):
    """(key, k, cue): texts packed and cut into numbered cues of base64; a text of any length is packed whole."""
    packed = texts.select(key, F.regexp_replace(F.base64(zipped(F.col(text))), r"\s", "").alias("b")).where("b IS NOT NULL")
    n = F.floor((F.length("b") - 1) / size).cast("int")
    return packed.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), n), lambda k: F.substr("b", k * size + 1, F.lit(size)))).alias("k", "cue"))


def extracted(cues, key: str):
    """(key, text) of cues, put together in the order of their numbers."""
    whole = cues.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("k", "cue"))).alias("a"))
    return whole.select(key, unzipped(F.unbase64(F.array_join(F.transform("a", lambda x: x["cue"]), ""))).alias("text"))


def s14(spark, sf):
    """Documents packed into cues, and unpacked again."""
    back = extracted(embedded(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text").repartition("doc_id", "k"), "doc_id")
    return back.select("doc_id", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("digest"))


Q["s14_embed_codec"], O["s14_embed_codec"] = s14, "SELECT doc_id, length(text) AS n, sha256(text) AS digest FROM documents WHERE text IS NOT NULL"
