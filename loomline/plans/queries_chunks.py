"""Chunks of transcripts merged at their seams, timed captions written and read, and error rates."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as X
from ..operators import kernels, review as R
from ..sources import captions, wordlists
from .queries_text import table
from .queries_time import EV, points

Q, O = {}, {}


def vtt(spark, sf):
    """Each conversation as WebVTT: words stamped if later than the last stamp and inside the cue."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.split("text", r"\s+").alias("w"))
    start, end = F.col("turn") * 5000, F.col("turn") * 5000 + 4500
    stamped = F.transform("w", lambda w, k: F.concat(F.when((k > 0) & (start + k * 300 < end), F.concat(F.lit("<"), X.clock((start + k * 300).cast("long"), "."), F.lit(">"))).otherwise(""), X.escape(w)))
    cue = F.concat(X.clock(start, "."), F.lit(" --> "), X.clock(end, "."), F.lit("\n<v "), F.col("role"), F.lit(">"), F.array_join(stamped, " "), F.lit("\n"))
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", cue.alias("cue")))).alias("a"))
    return g.select("conv_id", F.concat(F.lit("WEBVTT\n\nNOTE made\n\nSTYLE\n::cue {}\n\n"), F.array_join(F.transform("a", lambda x: x["cue"]), "\n")).alias("vtt"))


def s12v(spark, sf):
    """How many stamps each cue gets."""
    return captions.read_cues(vtt(spark, sf), "conv_id", "vtt").select("conv_id", "start_ms", F.size(F.regexp_extract_all("body", F.lit(r"<\d"), F.lit(0))).cast("long").alias("stamps"))


TURNS = r"WITH c AS (SELECT conv_id, turn, role, string_split_regex(text, '\s+') AS w FROM conversations)"
Q["k16_vtt_timed_words"], O["k16_vtt_timed_words"] = s12v, TURNS + " SELECT conv_id, turn * 5000 AS start_ms, least(len(w), 15) - 1 AS stamps FROM c"


def s2(spark, sf):
    """Cues of a file: blocks with a timing line; header, notes and styles are none."""
    c = captions.read_cues(vtt(spark, sf), "conv_id", "vtt")
    return c.select("conv_id", "start_ms", "end_ms", X.unescape(F.regexp_replace("body", "<[^>]*>", "")).alias("line"))


Q["s2_read_cues"], O["s2_read_cues"] = s2, TURNS + " SELECT conv_id, turn * 5000 AS start_ms, turn * 5000 + 4500 AS end_ms, array_to_string(w, ' ') AS line FROM c"


def s4(spark, sf):
    """Words of a WebVTT file with their stamps and speakers."""
    return captions.read_vtt(vtt(spark, sf), "conv_id", "vtt").select("conv_id", "start_ms", "k", "t", "speaker", X.trimmed(F.col("w")).alias("w"))


Q["s4_read_vtt"], O["s4_read_vtt"] = s4, TURNS + ", k AS (SELECT *, unnest(range(least(len(w), 15))) AS k FROM c) SELECT conv_id, turn * 5000 AS start_ms, CAST(k AS INTEGER) AS k, turn * 5000 + k * 300 AS t, role AS speaker, CASE WHEN k < 14 THEN w[k + 1] ELSE array_to_string(w[15:], ' ') END AS w FROM k"


def s5(spark, sf):
    """Sentences of cues: tokens joined, all but the first with their leading space; a single token ends with its cue."""
    t = captions.read_vtt(vtt(spark, sf), "conv_id", "vtt")
    g = t.groupBy("conv_id", "start_ms").agg(F.sort_array(F.collect_list(F.struct("k", "w"))).alias("a"), F.max("end_ms").alias("e"), F.count(F.lit(1)).alias("n"))
    return g.select("conv_id", "start_ms", X.trimmed(F.array_join(F.transform("a", lambda x: x["w"]), "")).alias("line"), F.when(F.col("n") == 1, F.col("e")).alias("single_end"))


Q["s5_cue_sentence"], O["s5_cue_sentence"] = s5, TURNS + " SELECT conv_id, turn * 5000 AS start_ms, array_to_string(w, ' ') AS line, CASE WHEN len(w) = 1 THEN turn * 5000 + 4500 END AS single_end FROM c"


def s12t(spark, sf):
    """Each conversation as plain text: a paragraph for each run of one speaker."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("new", F.when(F.lag("role").over(w) == F.col("role"), 0).otherwise(1)).withColumn("block", F.sum("new").over(w))
    b = c.groupBy("conv_id", "block", "role").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("a"))
    b = b.select("conv_id", "block", F.concat("role", F.lit(": "), F.array_join(F.transform("a", lambda x: x["text"]), " ")).alias("line"))
    g = b.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "line"))).alias("a"))
    return g.select("conv_id", F.array_join(F.transform("a", lambda x: x["line"]), "\n\n").alias("txt"))


Q["s12_to_txt"], O["s12_to_txt"] = s12t, """WITH f AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS f FROM conversations), b AS (SELECT *, sum(f) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM f),
g AS (SELECT conv_id, block, role || ': ' || string_agg(text, ' ' ORDER BY turn) AS line FROM b GROUP BY conv_id, block, role) SELECT conv_id, string_agg(line, chr(10) || chr(10) ORDER BY block) AS txt FROM g GROUP BY 1"""


def s9(spark, sf):
    """Word lists, a file for each brand of parts: spellings with the entry that has them, and what is refused with its reason."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("place"))
    k = F.col("p_partkey")
    said = F.when(k % 50 == 7, F.lit("?!")).when(k % 70 == 9, F.lit("one two three four")).otherwise(F.initcap("p_name"))
    text = F.concat(F.lit('[[entry]]\nname = "'), k.cast("string"), F.lit('"\nroman = ["'), said, F.lit('"]\n'), F.when(k % 90 == 11, "odd = 1\n").otherwise(""))
    files = p.groupBy(F.col("p_brand").alias("list"), "place").agg(F.sort_array(F.collect_list(F.struct("p_partkey", text.alias("t")))).alias("a"))
    files = files.select("list", "place", F.concat(F.array_join(F.transform("a", lambda x: x["t"]), ""), F.when(F.col("place") % 9 == 3, "= broken").otherwise("")).alias("toml"))
    words, refused = wordlists.load(files)
    return words.unionByName(refused.select(F.concat_ws(":", "list", "name").alias("entry"), "reason"), allowMissingColumns=True)


Q["s9_load_words"], O["s9_load_words"] = s9, r"""WITH p AS (SELECT p_partkey AS k, lower(p_name) AS n, p_brand AS b, CAST(regexp_extract(p_brand, '(\d+)') AS BIGINT) AS place FROM part),
r AS (SELECT *, CASE WHEN k % 90 = 11 THEN 'unknown key odd' WHEN k % 50 = 7 THEN 'a spelling without letters' WHEN k % 70 = 9 THEN 'a spelling of over three words' WHEN len(string_split(n, ' ')) > 3 THEN 'a spelling of over three words' END AS reason FROM p WHERE place % 9 <> 3),
f AS (SELECT place, k, b, form, CASE form WHEN 0 THEN n ELSE replace(n, ' ', '') END AS spelling FROM r, (SELECT unnest([0, 1]) AS form) WHERE reason IS NULL)
SELECT spelling, arg_min(b || ':' || k, (place, k, form)) AS entry, NULL AS reason FROM f GROUP BY 1 UNION ALL SELECT NULL, b || ':' || k, reason FROM r WHERE reason IS NOT NULL UNION ALL SELECT DISTINCT NULL, b, 'no TOML' FROM p WHERE place % 9 = 3"""


def f20(spark, sf):
    """Turns split at a caret (a place in the text, some outside it): before which word and when, or why not."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("words"))
    caret = (F.col("conv_id") * 37 + F.col("turn") * 101) % 400
    return R.split_at(c.withColumn("caret", caret), ["conv_id", "turn"])


Q["f20_split_at"], O["f20_split_at"] = f20, r"""WITH c AS (SELECT conv_id, turn, (conv_id * 37 + turn * 101) % 400 AS caret, [x for x in string_split_regex(text, '\s+') if x <> ''] AS w FROM conversations),
i AS (SELECT conv_id, turn, caret, len(w) AS n, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS k FROM c),
p AS (SELECT *, CAST(coalesce(sum(length(w) + 1) OVER (PARTITION BY conv_id, turn ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM i),
q AS (SELECT conv_id, turn, caret, any_value(n) AS n, min(k) FILTER (k > 0 AND caret = b - 1 OR k > 0 AND caret = b) AS gap, min(CASE WHEN caret - b <= b + length(w) - caret THEN k ELSE k + 1 END) FILTER (caret > b AND caret < b + length(w)) AS inside FROM p GROUP BY 1, 2, 3),
r AS (SELECT *, coalesce(gap, inside, CASE WHEN caret <= 0 THEN 0 ELSE n END) AS wd FROM q)
SELECT c.conv_id, c.turn, CASE WHEN n > 1 AND wd > 0 AND wd < n THEN wd END AS word, CASE WHEN coalesce(n, 0) = 0 THEN 'no words' WHEN n = 1 THEN 'one word' WHEN wd <= 0 OR wd >= n THEN 'not between two words' END AS refused FROM c LEFT JOIN r USING (conv_id, turn)"""


def f20m(spark, sf):
    """Each second segment of a conversation (a turn) joined to the one before it: flags of both, the first speaker that is known, edited if either is."""
    k = F.col("conv_id") + F.col("turn")
    s = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("seg"), (F.col("turn") * 10).alias("start"), (F.col("turn") * 10 + 9).alias("end"), F.when(k % 3 == 0, F.array(F.lit("noise"), F.lit("names"))).when(k % 3 == 1, F.array(F.lit("names"))).otherwise(F.array().cast("array<string>")).alias("flags"),
                                                     F.when(k % 4 != 0, F.col("role")).alias("speaker"), (k % 5 == 0).alias("edited"))
    m = R.merge_with_previous(s, s.where("seg % 2 = 1").select("conv_id", "seg"), "conv_id")
    return R.toggle_flag(m, "names", F.col("seg") % 3 == 0).select("conv_id", "seg", "start", "end", F.array_join(F.array_sort("flags"), ",").alias("flags"), "speaker", "edited")


Q["f20_merge"], O["f20_merge"] = f20m, """WITH s AS (SELECT conv_id, turn, CASE (conv_id + turn) % 3 WHEN 0 THEN ['noise', 'names'] WHEN 1 THEN ['names'] ELSE []::VARCHAR[] END AS f, CASE WHEN (conv_id + turn) % 4 <> 0 THEN role END AS sp, (conv_id + turn) % 5 = 0 AS ed FROM conversations),
m AS (SELECT a.conv_id, a.turn AS seg, a.turn * 10 AS start, coalesce(b.turn, a.turn) * 10 + 9 AS "end", list_distinct(list_concat(a.f, coalesce(b.f, []))) AS f, coalesce(a.sp, b.sp) AS sp, a.ed OR coalesce(b.ed, false) AS ed FROM s a LEFT JOIN s b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0),
t AS (SELECT *, CASE WHEN seg % 3 = 0 THEN CASE WHEN list_contains(f, 'names') THEN [x for x in f if x <> 'names'] ELSE list_append(f, 'names') END ELSE f END AS g FROM m)
SELECT conv_id, seg, start, "end", array_to_string(list_sort(g), ',') AS flags, sp AS speaker, ed AS edited FROM t"""


def echoed(spark, sf):
    """(conv_id, t) of each word of a conversation that begins an echo, words being half a second apart."""
    c = table(spark, sf, "conversations")
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", X.words(F.lower("text")).alias("w")))).alias("a")).select("conv_id", F.flatten(F.transform("a", lambda x: x["w"])).alias("words"))
    timed = g.where(F.size("words") >= 6).withColumns({"times": F.transform("words", lambda _, i: i * 0.5), "n": F.size("words")})
    return timed.select("conv_id", "n"), kernels.echoes(timed, "words", "times", 4.0).select("conv_id", F.explode("echoes").alias("e")).select("conv_id", (F.col("e.place") * 500).alias("t"))


def a25(spark, sf):
    """Echoes of each conversation at the seams of its chunks (their overlap and two seconds around it) and elsewhere, and how many an hour."""
    step, over, pad, word = 52_500, 7_500, 2_000, 500
    sizes, e = echoed(spark, sf)
    place = F.col("t") % step
    first = F.col("t") >= step - pad
    at = first & ((place >= step - pad) | (place <= over + pad))
    counts = e.groupBy("conv_id").agg(F.count(F.when(at, 1)).alias("at_seams"), F.count(F.when(~at, 1)).alias("elsewhere"))
    whole = F.col("n") * word
    seams_ms = F.greatest(F.floor((whole - 1) / step), F.lit(0)) * (over + 2 * pad)
    j = sizes.join(counts, "conv_id", "left").na.fill(0, ["at_seams", "elsewhere"])
    rate = lambda n, ms: F.when(ms > 0, F.round(F.col(n) * 3_600_000 / ms, 6))
    return j.select("conv_id", "at_seams", "elsewhere", rate("at_seams", seams_ms).alias("seams_an_hour"), rate("elsewhere", whole - seams_ms).alias("elsewhere_an_hour"))


Q["a25_echo_rate"] = a25


