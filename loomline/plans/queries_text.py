"""Queries over transcripts: sentences (lines of documents), words, labels, exports and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as X

Q, O = {}, {}
WORD_SQL = r"[\p{L}\p{N}]+(?:''[\p{L}\p{N}]+)?"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, pos, line): the lines of documents."""
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


SENT = """WITH s AS (SELECT doc_id, i - 1 AS pos, p[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), unnest(range(1, len(p) + 1)) AS u(i))
"""
TOK = SENT.rstrip() + f""", w AS (SELECT doc_id, pos, line, regexp_extract_all(line, '{WORD_SQL}') AS words FROM s)
"""


def tokens(spark, sf):
    return sentences(spark, sf).withColumn("words", X.words(F.col("line")))


def f1(spark, sf):
    return tokens(spark, sf).select("doc_id", "pos", F.size("words").cast("long").alias("n_words"), F.md5(F.array_join("words", "|")).alias("digest"))


Q["f1_words"], O["f1_words"] = f1, TOK + "SELECT doc_id, pos, len(words) AS n_words, md5(array_to_string(words, '|')) AS digest FROM w"


def l1(spark, sf):
    return tokens(spark, sf).where(X.is_loop(F.col("words"))).select("doc_id", "pos", F.size("words").cast("long").alias("n"))


Q["l1_is_loop"], O["l1_is_loop"] = l1, TOK + "SELECT doc_id, pos, len(words) AS n FROM w WHERE len(words) > 6 AND len(list_distinct(words)) <= greatest(2, len(words) // 3)"


def w2(spark, sf):
    """Runs of five or more neighbouring lines of the same words that are a loop together; lines without words don't break them."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    t = tokens(spark, sf).where(F.size("words") > 0).withColumn("key", F.array_join("words", " "))
    t = t.withColumn("g", F.sum(F.when(F.lag("key").over(w) == F.col("key"), 0).otherwise(1)).over(w))
    runs = t.groupBy("doc_id", "g").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("n"), F.first("words").alias("w"))
    size, kinds = F.col("n") * F.size("w"), F.size(F.array_distinct("w"))
    return runs.where((F.col("n") >= 5) & (size > 6) & (kinds <= F.greatest(F.lit(2), F.floor(size / 3)))).drop("g", "w")


Q["w2_loop_runs"], O["w2_loop_runs"] = w2, TOK + """, k AS (SELECT doc_id, pos, words, array_to_string(words, ' ') AS key FROM w WHERE len(words) > 0),
g AS (SELECT *, CASE WHEN lag(key) OVER (PARTITION BY doc_id ORDER BY pos) = key THEN 0 ELSE 1 END AS f FROM k),
h AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM g)
SELECT doc_id, min(pos) AS first, max(pos) AS last, count(*) AS n FROM h GROUP BY doc_id, g HAVING count(*) >= 5 AND count(*) * len(any_value(words)) > 6 AND len(list_distinct(any_value(words))) <= greatest(2, count(*) * len(any_value(words)) // 3)"""


def p3(spark, sf):
    """Characters of a document before each line."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return sentences(spark, sf).select("doc_id", "pos", F.coalesce(F.sum(F.length("line")).over(w), F.lit(0)).alias("char_offset"))


Q["p3_char_offsets"], O["p3_char_offsets"] = p3, SENT + "SELECT doc_id, pos, coalesce(CAST(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS char_offset FROM s"


def p1(spark, sf):
    """Text rebuilt from its lines."""
    s = sentences(spark, sf).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("a"))
    return s.select("doc_id", F.md5(F.array_join(F.transform("a", lambda x: x["line"]), "\n")).alias("digest"))


Q["p1_text_from_tokens"], O["p1_text_from_tokens"] = p1, "SELECT doc_id, md5(text) AS digest FROM documents"


def p6(spark, sf):
    return sentences(spark, sf).where(X.trimmed(F.col("line")) != "").select("doc_id", "pos")


Q["p6_spoken"], O["p6_spoken"] = p6, SENT + r"SELECT doc_id, pos FROM s WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> ''"


def p15(spark, sf):
    """Documents in whose title (first line) every word of a query stands: the first two words of each benchmark item."""
    words = lambda c: F.filter(F.split(X.folded(c), r"\s+"), lambda w: w != "")
    q = table(spark, sf, "benchmark").select("item_id", F.slice(words(F.col("text")), 1, 2).alias("ws")).where(F.size("ws") > 0)
    d = table(spark, sf, "documents").select("doc_id", X.folded(F.split("text", "\n", 2)[0]).alias("hay")).where(F.length("hay") > 0)
    return substring_hits(d, q, "doc_id", "item_id").groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


def substring_hits(titles, queries, title, query, few: int = 1000):
    """(query, title) where each word of the query's ws stands in hay.

    Up to `few` queries are grouped by their rarest-looking (longest) word and sent to all tasks: each title is read once against them. More meet
    titles by the gram of three letters of their longest word that the fewest titles have, so common grams of a query make no pairs.
    """
    longest = F.aggregate("ws", F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    all_in = F.forall("ws", lambda w: F.contains(F.col("hay"), w))
    if queries.count() <= few:
        asked = F.broadcast(queries.withColumn("head", longest))
        return titles.join(asked, F.contains("hay", "head") & all_in).select(query, title)
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))
    each = queries.withColumn("head", longest).select(query, "ws", F.explode(grams("head")).alias("gram"))
    met = titles.select(title, F.explode(grams("hay")).alias("gram"))
    counts = met.join(each.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("c"))
    rarest = each.join(counts, "gram", "left").groupBy(query).agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "gram")).alias("m"), F.first("ws").alias("ws"), F.max(F.length("gram")).alias("long"))
    whole = rarest.where("long = 3").select(query, "ws", "m.gram")
    short = rarest.where("long < 3").select(query, "ws")  # of one or two letters: they stand in most titles
    hits = met.join(whole, "gram").select(title, query, "ws").join(titles, title).where(all_in).select(query, title)
    return hits.unionByName(titles.join(short, all_in).select(query, title))


Q["p15_library_search"], O["p15_library_search"] = p15, r"""WITH q AS (SELECT item_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')[1:2] AS ws FROM benchmark),
d AS (SELECT doc_id, lower(string_split(text, chr(10))[1]) AS hay FROM documents)
SELECT item_id, count(*) AS n, min(doc_id) AS first FROM d, q WHERE len(ws) > 0 AND len(list_filter(ws, lambda x: NOT contains(hay, x))) = 0 GROUP BY 1"""


def p16(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") * 7919 * 13).alias("ms"))
    return d.select("doc_id", X.clock(F.col("ms")).alias("srt"), X.clock(F.col("ms"), ".").alias("vtt"), X.short_clock(F.col("ms")).alias("short"))


Q["p17_clock"], O["p17_clock"] = p16, """WITH c AS (SELECT doc_id, doc_id * 7919 * 13 AS ms FROM documents)
SELECT doc_id, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS srt, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS vtt,
CASE WHEN ms >= 3600000 THEN printf('%d:%02d:%02d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60) ELSE printf('%d:%02d', ms // 60000 % 60, ms // 1000 % 60) END AS short FROM c"""


def p19(spark, sf):
    h = table(spark, sf, "pages").select("page_id", X.escape(F.col("html")).alias("e"), "html")
    return h.select("page_id", F.md5("e").alias("digest"), (X.unescape(F.col("e")) == F.col("html")).alias("back"))


Q["p19_escape"], O["p19_escape"] = p19, "SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS digest, true AS back FROM pages"


def a6(spark, sf):
    share = X.script_share(F.col("text"), "éèêëàâçîïôûùäöüßñáíóú")
    d = table(spark, sf, "documents").select("doc_id", F.round(share, 6).alias("share"), "lang")
    return d.select("doc_id", "share", X.language_tag(F.col("share"), F.col("lang")).alias("tag"))


Q["a6_script_share"], O["a6_script_share"] = a6, r"""WITH a AS (SELECT doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n, length(regexp_replace(text, '[^éèêëàâçîïôûùäöüßñáíóú]', '', 'g')) AS k FROM documents),
b AS (SELECT doc_id, round(CASE WHEN n > 0 THEN k / n ELSE 0.0::DOUBLE END, 6) AS share FROM a)
SELECT doc_id, share, CASE WHEN share >= 0.5 THEN 'urdu' WHEN share >= 0.05 THEN 'mixed' ELSE 'english' END AS tag FROM b"""


def a20(spark, sf):
    """Words of five documents or more, with their counts and the share in labelled toxic documents."""
    w = tokens(spark, sf).select("doc_id", F.explode("words").alias("word")).withColumn("word", F.lower("word"))
    l = table(spark, sf, "labels").select("doc_id", "toxic")
    c = w.groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("n")).join(l, "doc_id", "left")
    return c.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("toxic"), F.lit(0)).cast("long").alias("toxic_docs")).where("docs >= 5")


Q["a20_vocabulary"], O["a20_vocabulary"] = a20, TOK + """, x AS (SELECT doc_id, lower(unnest(words)) AS word FROM w), c AS (SELECT word, doc_id, count(*) AS n FROM x GROUP BY ALL)
SELECT word, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs, CAST(coalesce(sum(toxic), 0) AS BIGINT) AS toxic_docs FROM c LEFT JOIN labels USING (doc_id) GROUP BY word HAVING count(*) >= 5"""


def a4(spark, sf):
    """Turns, words and runs of each role."""
    c = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumns({"n": F.size(X.words(F.col("text"))), "new": F.when(F.lag("role").over(w) == F.col("role"), 0).otherwise(1)})
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.sum("n").alias("words"), F.sum("new").alias("runs"))


Q["a4_speaker_histogram"], O["a4_speaker_histogram"] = a4, f"""WITH a AS (SELECT role, len(regexp_extract_all(text, '{WORD_SQL}')) AS n, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS f FROM conversations)
SELECT role, count(*) AS turns, CAST(sum(n) AS BIGINT) AS words, CAST(sum(f) AS BIGINT) AS runs FROM a GROUP BY 1"""


def s12(spark, sf):
    """Each conversation as SRT: a cue of five seconds for each turn."""
    c = table(spark, sf, "conversations")
    cue = F.format_string("%d\n%s --> %s\n%s: %s\n", F.col("turn") + 1, X.clock(F.col("turn") * 5000), X.clock(F.col("turn") * 5000 + 4500), F.col("role"), F.replace("text", F.lit("\n"), F.lit(" ")))
    one = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", cue.alias("cue")))).alias("a"))
    return one.select("conv_id", F.array_join(F.transform("a", lambda x: x["cue"]), "\n").alias("srt"))


SRT = """SELECT conv_id, string_agg(printf('%d', turn + 1) || chr(10) || printf('%02d:%02d:%02d,%03d', turn * 5000 // 3600000, turn * 5000 // 60000 % 60, turn * 5000 // 1000 % 60, turn * 5000 % 1000) || ' --> '
|| printf('%02d:%02d:%02d,%03d', (turn * 5000 + 4500) // 3600000, (turn * 5000 + 4500) // 60000 % 60, (turn * 5000 + 4500) // 1000 % 60, (turn * 5000 + 4500) % 1000) || chr(10) || role || ': ' || replace(text, chr(10), ' ') || chr(10), chr(10) ORDER BY turn) AS srt FROM conversations GROUP BY 1"""
Q["s12_to_srt"], O["s12_to_srt"] = s12, SRT


def s3(spark, sf):
    """SRT read back: cue times, speaker and text."""
    from ..sources import captions

    return captions.read_srt(s12(spark, sf), "conv_id", "srt")


Q["s3_read_srt"], O["s3_read_srt"] = s3, "SELECT conv_id, turn AS pos, turn * 5000 AS start_ms, turn * 5000 + 4500 AS end_ms, role AS speaker, replace(text, chr(10), ' ') AS line FROM conversations"


def s1(spark, sf):
    d = s12(spark, sf).select("conv_id", "srt")
    return d.select("conv_id", X.detect_format(F.col("srt")).alias("a"), X.detect_format(F.concat(F.lit("﻿ WEBVTT\n"), "srt")).alias("b"), X.detect_format(F.lit("{}")).alias("c"), X.detect_format(F.lit("none")).alias("d"))


Q["s1_detect_format"], O["s1_detect_format"] = s1, "SELECT conv_id, 'srt' AS a, 'vtt' AS b, 'json' AS c, CAST(NULL AS VARCHAR) AS d FROM conversations GROUP BY 1"


def f14(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.concat(F.octet_length("text").cast("string"), F.lit("-"), F.sha2("text", 256)).alias("content_id"))


Q["f14_sha"], O["f14_sha"] = f14, "SELECT doc_id, sha256(text) AS sha, CAST(strlen(text) AS VARCHAR) || '-' || sha256(text) AS content_id FROM documents"


def a8(spark, sf):
    """Nearest-rank percentiles of line lengths by language, and counts over a length."""
    n = sentences(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").withColumn("n", F.length("line"))
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY n)")
    return n.groupBy("lang").agg(disc(0.5).cast("long").alias("p50"), disc(0.99).cast("long").alias("p99"), F.count(F.when(F.col("n") > 200, 1)).alias("n_long"), F.round(F.expr("percentile(n, 0.9)"), 6).alias("p90_linear"))


Q["a8_percentiles"], O["a8_percentiles"] = a8, SENT + "SELECT lang, CAST(quantile_disc(length(line), 0.5) AS BIGINT) AS p50, CAST(quantile_disc(length(line), 0.99) AS BIGINT) AS p99, count(CASE WHEN length(line) > 200 THEN 1 END) AS n_long, round(quantile_cont(length(line), 0.9::DOUBLE), 6) AS p90_linear FROM s JOIN documents USING (doc_id) GROUP BY 1"


def a16(spark, sf):
    """Tinted documents, precision and recall of a score at nine cutoffs: the share of repeated words against quality labels."""
    w = table(spark, sf, "documents").withColumn("w", X.words(F.col("text"))).where(F.size("w") > 0)
    s = w.select("doc_id", (F.size(F.array_distinct("w")) / F.size("w")).alias("c")).join(table(spark, sf, "labels"), "doc_id")
    cuts = F.explode(F.array(*[F.lit(k / 10) for k in range(1, 10)])).alias("cut")
    each = s.select("c", "quality", cuts)
    tint = F.col("c") < F.col("cut")
    return each.groupBy("cut").agg(F.count(F.when(tint, 1)).alias("tinted"), F.count(F.when(tint & (F.col("quality") == 0), 1)).alias("hits"), F.count(F.when(F.col("quality") == 0, 1)).alias("wrong"))


Q["a16_cutoff_sweep"], O["a16_cutoff_sweep"] = a16, f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '{WORD_SQL}') AS w FROM documents), s AS (SELECT len(list_distinct(w)) / len(w) AS c, quality FROM w JOIN labels USING (doc_id) WHERE len(w) > 0),
k AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS cut)
SELECT cut, count(CASE WHEN c < cut THEN 1 END) AS tinted, count(CASE WHEN c < cut AND quality = 0 THEN 1 END) AS hits, count(CASE WHEN quality = 0 THEN 1 END) AS wrong FROM s, k GROUP BY 1"""


def a18(spark, sf):
    l = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    return l.rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))


Q["a18_recall_table"], O["a18_recall_table"] = a18, "SELECT lang, source, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good, CAST(sum(toxic) AS BIGINT) AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, source)"


def u4(spark, sf):
    """Words of a conversation's later turns that its first turn lacks."""
    c = table(spark, sf, "conversations").withColumn("w", F.array_distinct(X.words(F.lower("text"))))
    first = c.where("turn = 0").select("conv_id", F.col("w").alias("f"))
    return c.where("turn > 0").join(first, "conv_id").select("conv_id", "turn", F.size(F.array_except("w", "f")).cast("long").alias("n_new"), F.size(F.array_union("w", "f")).cast("long").alias("n_all"))


Q["u4_key_differences"], O["u4_key_differences"] = u4, f"""WITH c AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '{WORD_SQL}')) AS w FROM conversations)
SELECT c.conv_id, c.turn, len(list_filter(c.w, lambda x: NOT list_contains(f.w, x))) AS n_new, len(list_distinct(list_concat(c.w, f.w))) AS n_all FROM c JOIN c f ON f.conv_id = c.conv_id AND f.turn = 0 WHERE c.turn > 0"""
