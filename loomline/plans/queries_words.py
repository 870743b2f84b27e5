"""Words of two readings scored, keyed and matched; likely errors; tiles of frames."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as X
from ..operators import grids, matching as M, review as R
from ..operators.groups import kept
from .queries_edits import LISTS, lists
from .queries_text import TOK, WORD_SQL, table, tokens

Q, O = {}, {}


def latin_words(spark, sf):
    """The distinct words of a to z of the conversations."""
    w = table(spark, sf, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    return w.distinct()


def f7(spark, sf):
    """The phonetic key of each Latin word."""
    return M.with_key(latin_words(spark, sf), "w")


def key_sql(word: str, given: str) -> str:
    """CTEs that add <word>_key to the rows of `given`, for a column of Latin words."""
    s = word
    for a, b in M.SOUNDS:
        s = f"replace({s}, '{a}', '{b}')"
    s = f"replace(regexp_replace({s}, 'ge$', 'j'), 'ch', 'C')"
    s = f"replace(regexp_replace({s}, 'c([eiy])', 's\\1', 'g'), 'c', 'k')"
    for a, b in M.DIGRAPHS:
        s = f"replace({s}, '{a}', '{b}')"
    return f"""{word}1 AS (SELECT *, {s} AS s FROM {given}), {word}2 AS (SELECT * EXCLUDE (s), string_split(s[1] || replace(s[2:], 'h', ''), '') AS c FROM {word}1),
{word}3 AS (SELECT * EXCLUDE (c), array_to_string(list_filter(c, lambda x, i: i = 1 OR x <> c[i - 1]), '') AS s FROM {word}2),
{word}4 AS (SELECT *, regexp_extract(s, '[aeiouyw]+$') AS tail FROM {word}3), {word}5 AS (SELECT *, CASE WHEN len(tail) = len(s) THEN tail[2:] ELSE tail END AS run FROM {word}4),
{word}6 AS (SELECT *, s[1:len(s) - len(run)] AS body, CASE WHEN run = '' THEN '' WHEN run LIKE '%a' THEN 'A' WHEN run LIKE '%e' OR run IN ('ai', 'ay', 'ei', 'ey', 'ae') THEN 'E' WHEN regexp_matches(run, '[iy]$') THEN 'I' ELSE 'O' END AS final FROM {word}5),
{word}7 AS (SELECT * EXCLUDE (s, tail, run, body, final), CASE WHEN s = '' THEN '_' ELSE CASE WHEN body[1] IN ('a', 'e', 'i', 'o', 'u') THEN 'a' ELSE body[1] END || regexp_replace(body[2:], '[aeiouyw]', '', 'g') || final END AS {word}_key FROM {word}6)"""


LATIN = "WITH l0 AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations),"
Q["f7_key"], O["f7_key"] = f7, LATIN + key_sql("w", "l0") + " SELECT w, w_key AS key FROM w7"


def f8(spark, sf):
    """Each Latin word against itself with a letter changed: whether their keys are near."""
    w = latin_words(spark, sf)
    n = F.length("w")
    other = (
        F.when(n % 4 == 0, F.expr("substring(w, 1, length(w) - 1)")).when(n % 4 == 1, F.concat("w", F.lit("ah")))
        .when(n % 4 == 2, F.concat(F.lit("t"), F.expr("substring(w, 2)"))).otherwise(F.concat(F.expr("substring(w, 1, 2)"), F.lit("s"), F.expr("substring(w, 3)")))
    )
    both = M.with_key(M.with_key(w.withColumn("x", other).where("x <> ''"), "w", "w_key"), "x", "x_key")
    return both.select("w", "x", M.near_keys(F.col("w_key"), F.col("x_key")).alias("near"))


Q["f8_near"], O["f8_near"] = f8, LATIN + """l1 AS (SELECT w, CASE len(w) % 4 WHEN 0 THEN w[1:len(w) - 1] WHEN 1 THEN w || 'ah' WHEN 2 THEN 't' || w[2:] ELSE w[1:2] || 's' || w[3:] END AS x FROM l0),
l2 AS (SELECT * FROM l1 WHERE x <> ''),""" + key_sql("w", "l2") + "," + key_sql("x", "w7") + " SELECT w, x, w_key = x_key OR (least(len(w_key), len(x_key)) >= 4 AND levenshtein(w_key, x_key) <= 1) AS near FROM x7"


def heard(spark, sf):
    """(conv_id, turn, reference, heard): each turn's words, and the same with some lost, changed, doubled or written in Arabic letters."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", X.words(F.lower("text")).alias("reference")).where(F.size("reference") > 0)

    def told(w, k):
        h = (k * 7 + F.col("turn") * 3 + F.col("conv_id")) % 23
        arabic = F.translate(F.translate(w, "aeiouy", "ا"), "bdfghjklmnpqrstvwxz", "بدفگہجکلمنپقرستووکز")
        return F.when(h == 0, F.array().cast("array<string>")).when(h == 1, F.array(arabic)).when(h == 2, F.array(F.concat(w, F.lit("x")))).when(h == 3, F.array(w, w)).otherwise(F.array(w))

    return t.select("conv_id", "turn", "reference", F.flatten(F.transform("reference", told)).alias("heard"))


def keyed(rows):
    """rows with their two lists as keys."""
    words = rows.select(F.explode("reference").alias("w")).union(rows.select(F.explode("heard"))).distinct()
    keys = M.with_key(words, "w")
    for c in ("reference", "heard"):
        each = rows.select("conv_id", "turn", F.posexplode(c).alias("k", "w")).join(keys, "w")
        made = each.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("k", "key"))).alias("a")).select("conv_id", "turn", F.transform("a", lambda x: x["key"]).alias(f"{c}_key"))
        rows = rows.join(made, ["conv_id", "turn"], "left")
    return rows


def _scored(spark, sf, by_key):
    r = keyed(heard(spark, sf)) if by_key else heard(spark, sf).withColumns({"reference_key": F.col("reference"), "heard_key": F.col("heard")})
    return M.with_errors(r, "heard_key", "reference_key", by_key)


def a14(spark, sf):
    """Word error rate of what was heard of each turn, by the words as they are and by their keys."""
    e = F.col("substituted") + F.col("missed") + F.col("inserted")
    n = F.size("reference")
    of = lambda by_key, name: _scored(spark, sf, by_key).select("conv_id", "turn", e.cast("long").alias(f"{name}_errors"), F.round(e / n, 6).alias(f"{name}_wer"))
    return of(False, "strict").join(of(True, "keyed"), ["conv_id", "turn"])


Q["a14_wer"] = a14


def f10(spark, sf):
    """Words of each turn aligned with what was heard, in two passes: by equal keys, then between them by near ones."""
    return _scored(spark, sf, True).select("conv_id", "turn", "substituted", "missed", "inserted", F.size("pairs").cast("long").alias("places"))


Q["f10_align"] = f10


def _pairs(spark, sf):
    p = _scored(spark, sf, True).select("conv_id", "turn", "reference", "heard", F.explode("pairs").alias("p"))
    return p.select("conv_id", "turn", F.get("reference", F.col("p.r")).alias("said"), F.get("heard", F.col("p.h")).alias("got"), "p.ok")


def a15(spark, sf):
    """Errors by the script of the reference word; inserted words by their own."""
    p = _pairs(spark, sf).withColumn("script", R.script(F.coalesce("said", "got")))
    is_ = lambda cond: F.count(F.when(cond, 1))
    said, got = F.col("said").isNotNull(), F.col("got").isNotNull()
    return p.groupBy("script").agg(is_(said).alias("n"), is_(said & got & ~F.col("ok")).alias("substituted"), is_(said & ~got).alias("missed"), is_(~said).alias("inserted"))


Q["a15_by_script"] = a15


def a17(spark, sf):
    """Latin reference words by what stands in their place: themselves, the same in Arabic letters, another word in either script, or nothing."""
    p = _pairs(spark, sf).where("said IS NOT NULL").where(R.script(F.col("said")) == "other")
    arabic = F.coalesce(R.script(F.col("got")) == "arabic", F.lit(False))
    bucket = F.when(F.col("got").isNull(), "missed").when(F.col("ok"), F.when(arabic, "arabic_letters").otherwise("same")).when(arabic, "arabic_word").otherwise("wrong_latin")
    return p.withColumn("bucket", bucket).groupBy("conv_id").pivot("bucket", ["same", "arabic_letters", "arabic_word", "wrong_latin", "missed"]).count().na.fill(0)


Q["a17_buckets"] = a17


def a34(spark, sf):
    """What a second reading of each turn gained: words at (time, text) that the first hadn't, how many of them are right, and the error rates of both.

    The first reading lacks every fourth word from the ninth on, as if a loop had been taken out there.
    """
    h = heard(spark, sf)
    first = F.filter("heard", lambda w, k: (k < 8) | (k % 4 != 0))
    both = [M.with_errors(h.withColumns({"__h": c, "__r": F.col("reference")}), "__h", "__r", False) for c in (first, F.col("heard"))]
    wer = lambda name: F.round((F.col("substituted") + F.col("missed") + F.col("inserted")) / F.size("reference"), 6).alias(name)
    one = both[0].select("conv_id", "turn", wer("wer_before"))
    two = both[1].select("conv_id", "turn", wer("wer_after"), F.transform(F.filter("pairs", lambda p: p["ok"]), lambda p: p["h"]).alias("right"))
    times = h.select("conv_id", "turn", F.posexplode("heard").alias("k", "w")).withColumn("t", F.col("k") * 300)
    old = times.where("k < 8 OR k % 4 <> 0").select("conv_id", "turn", "t", "w")
    new = times.join(old, ["conv_id", "turn", "t", "w"], "left_anti").join(two.select("conv_id", "turn", "right"), ["conv_id", "turn"])
    gain = new.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_new"), F.count(F.when(F.array_contains("right", F.col("k")), 1)).alias("n_right"))
    return one.join(two.drop("right"), ["conv_id", "turn"]).join(gain, ["conv_id", "turn"], "left").na.fill(0, ["n_new", "n_right"])


Q["a34_retry_gain"] = a34


def f11(spark, sf):
    """Words of each turn in matching blocks with what was heard, and those of its Latin words."""
    h = heard(spark, sf).select("conv_id", "turn", F.size("reference").cast("long").alias("n"), "reference", "heard")

    def both(a, b):
        """Of all words and of the Latin ones; where all are Latin, the blocks are the same."""
        one, latin = M.blocks(a, b), [[w for w in side if "a" <= w[:1] <= "z"] for side in (a, b)]
        two = one if [len(x) for x in latin] == [len(a), len(b)] else M.blocks(*latin)
        return sum(n for *_, n in one), len(one), sum(n for *_, n in two), len(two)

    return M.per_pair(h, "reference", "heard", both, "matched long, n_blocks long, latin long, latin_blocks long")


Q["f11_blocks"] = f11


def second_reading(spark, sf):
    """(doc, word, start, end, text): another reading of the edit lists, some words changed, lost or moved."""
    e, k = lists(spark, sf), F.col("event_id")
    w = e.where("kind = 'item' AND text <> ''").where(k % 13 != 0)
    shift = F.when(k % 5 == 0, 200_000).otherwise(0)
    start = F.col("source_start") + shift
    return w.select("doc", k.alias("word"), start.alias("start"), (start + F.col("length")).alias("end"), F.when(k % 11 == 0, F.lit("other")).when(k % 7 == 0, F.concat(F.upper("text"), F.lit(","))).otherwise(F.col("text")).alias("text"))


def _apart(spans):
    """Spans cut where the next one starts."""
    after = F.lead("start").over(Window.partitionBy("doc").orderBy("start", "seg"))
    return spans.withColumn("end", F.least("end", F.coalesce(after, "end")))


OPINION = LISTS + r""", sg AS (SELECT *, sum(CASE WHEN kind = 'paragraph' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) - 1 AS seg FROM l),
s0 AS (SELECT doc, seg, arg_min(source_start, pos) AS s, max(source_start + length) AS e0, list(text ORDER BY pos) AS own, min(confidence) AS least FROM sg WHERE kind = 'item' AND text <> '' GROUP BY 1, 2),
sp AS (SELECT *, least(e0, coalesce(lead(s) OVER (PARTITION BY doc ORDER BY s, seg), e0)) AS e FROM s0),
ow AS (SELECT doc, event_id AS word, source_start + CASE WHEN event_id % 5 = 0 THEN 200000 ELSE 0 END + length / 2 AS m, CASE WHEN event_id % 11 = 0 THEN 'other' WHEN event_id % 7 = 0 THEN upper(text) || ',' ELSE text END AS text FROM l WHERE kind = 'item' AND text <> '' AND event_id % 13 <> 0),
b AS (SELECT ow.*, sp.e AS be, sp.seg AS bg FROM ow ASOF LEFT JOIN sp ON ow.doc = sp.doc AND ow.m >= sp.e),
a AS (SELECT b.*, sp.s AS fs, sp.seg AS fg FROM b ASOF LEFT JOIN sp ON b.doc = sp.doc AND b.m < sp.e),
g AS (SELECT doc, word, text, CASE WHEN fs <= m THEN fg WHEN be IS NULL THEN CASE WHEN fs - m <= 1000 THEN fg END WHEN fs IS NULL THEN CASE WHEN m - be <= 1000 THEN bg END WHEN m - be <= fs - m THEN bg ELSE fg END AS seg FROM a),
th AS (SELECT doc, seg, list(text ORDER BY word) AS theirs FROM g WHERE seg IS NOT NULL GROUP BY 1, 2),
dis AS (SELECT sp.doc, sp.seg, coalesce(len(theirs), 0) AS n, least, CASE WHEN theirs IS NULL THEN true ELSE own <> [lower(replace(x, ',', '')) for x in theirs] END AS disagrees FROM sp LEFT JOIN th USING (doc, seg))"""


def m19(spark, sf):
    """Sentences of each list in which the second reading has other words."""
    spans = _apart(R.spans_of(lists(spark, sf)))
    return R.disagreements(spans, second_reading(spark, sf), "doc").select("doc", "seg", F.size("theirs").cast("long").alias("n"), "disagrees")


Q["m19_second_opinion"], O["m19_second_opinion"] = m19, OPINION + " SELECT doc, seg, n, disagrees FROM dis"


def m18(spark, sf):
    """Sentences that a flag, the second reading or an unsure word marks."""
    spans = _apart(R.spans_of(lists(spark, sf)))
    flags = spans.where("(doc + seg) % 10 = 0").select("doc", "seg")
    return R.likely_errors(spans, flags, R.disagreements(spans, second_reading(spark, sf), "doc"), 0.05, "doc")


Q["m18_likely_errors"], O["m18_likely_errors"] = m18, OPINION + " SELECT * FROM (SELECT doc, seg, (doc + seg) % 10 = 0 AS flagged, disagrees, coalesce(least < 0.05, false) AS unsure FROM dis) WHERE flagged OR disagrees OR unsure"


def m17(spark, sf):
    """The answer key of the sentences that were checked (two of three), with the gaps before them."""
    spans = _apart(R.spans_of(lists(spark, sf)))
    return R.answer_key(spans, spans.where("seg % 3 <> 1"), "doc")


Q["m17_answer_key"], O["m17_answer_key"] = m17, OPINION + """, ck AS (SELECT doc, seg, s, e, array_to_string(own, ' ') AS t, coalesce(lag(e) OVER (PARTITION BY doc ORDER BY s), 0) AS f FROM sp WHERE seg % 3 <> 1)
SELECT doc, seg, s AS start, e AS "end", t AS ground_truth, 'clip' AS kind FROM ck UNION ALL SELECT doc, seg, f, s, NULL, 'gap' FROM ck WHERE f < s"""


def vocabulary(spark, sf):
    """(words, entries): words that stand three times or more; each two hundredth of them, by hash, is listed."""
    w = tokens(spark, sf).select(F.explode("words").alias("word")).withColumn("word", F.lower("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("word")
    w = kept(w)  # read by each search
    h = F.conv(F.substring(F.md5("word"), 1, 6), 16, 10).cast("long")
    listed = w.where((h % 200 == 0) & (F.length("word") >= 4)).select(F.col("word").alias("entry"), F.md5("word").alias("place"))
    return w, kept(listed)


def m20(spark, sf):
    """Words near a listed spelling."""
    return R.candidates(*vocabulary(spark, sf))


Q["m20_candidates"], O["m20_candidates"] = m20, TOK + """, v AS (SELECT lower(unnest(words)) AS word FROM w), c AS (SELECT word FROM v GROUP BY 1 HAVING count(*) >= 3),
k AS (SELECT word AS entry, md5(word) AS place FROM c WHERE ('0x' || substr(md5(word), 1, 6))::BIGINT % 200 = 0 AND length(word) >= 4),
p AS (SELECT word, entry, place, contains(word, entry) AS held, levenshtein(translate(word, 'éèêëàâçîïôûùäöüßñáíóú', 'ABCDEFGHIJKLMNOPQRSTU'), translate(entry, 'éèêëàâçîïôûùäöüßñáíóú', 'ABCDEFGHIJKLMNOPQRSTU')) <= CASE WHEN length(entry) >= 7 THEN 2 ELSE 1 END AS near
  FROM (SELECT word FROM c WHERE length(word) >= 4 AND word NOT IN (SELECT entry FROM k)), k),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY place) AS n FROM p WHERE held OR near)
SELECT word, entry AS near, CASE WHEN held THEN 'contains' ELSE 'edit' END AS how FROM r WHERE n = 1"""


def f9(spark, sf):
    """Words one or two edits from a benchmark word."""
    own = lambda t, c: table(spark, sf, t).select(F.explode(X.words(F.lower("text"))).alias(c)).distinct()
    near = R.within_edits(own("conversations", "word"), own("benchmark", "entry"), 2)
    return near.where("edits >= 1").select("word", "entry", F.col("edits").cast("long").alias("edits"))


Q["f9_edits"], O["f9_edits"] = f9, f"""WITH b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORD_SQL}')) AS entry FROM benchmark),
w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORD_SQL}')) AS word FROM conversations)
SELECT word, entry, CAST(e AS BIGINT) AS edits FROM (SELECT word, entry, levenshtein(translate(word, 'éèêëàâçîïôûùäöüßñáíóú', 'ABCDEFGHIJKLMNOPQRSTU'), translate(entry, 'éèêëàâçîïôûùäöüßñáíóú', 'ABCDEFGHIJKLMNOPQRSTU')) AS e
 FROM w JOIN b ON abs(length(word) - length(entry)) <= 2) WHERE e BETWEEN 1 AND 2"""


def tiles(spark, sf):
    """Vectors as frames of 8 x 8 tiles, by label as recording."""
    return table(spark, sf, "embeddings").select(F.col("label").alias("rec"), F.col("vec_id").alias("frame"), F.transform("embedding", lambda c: F.floor(c.cast("double") * 256)).alias("tiles"))


def l3(spark, sf):
    """The largest region of changed tiles of each frame, without noisy tiles, and whether it is a mark."""
    return grids.frames_with_change(tiles(spark, sf), "rec", "frame", "tiles", 8, 8, 40, 0.45, 10)


TILES = """WITH RECURSIVE f AS (SELECT label AS rec, vec_id AS frame, [floor(c::DOUBLE * 256) for c in embedding] AS t FROM embeddings),
p AS (SELECT *, lag(t) OVER (PARTITION BY rec ORDER BY frame) AS b FROM f),
c AS (SELECT rec, frame, unnest(range(64)) AS k, unnest(t) AS x, unnest(b) AS y FROM p WHERE b IS NOT NULL),
"""
Q["l3_largest_region"], O["l3_largest_region"] = l3, TILES + """n AS (SELECT rec, k, avg(CASE WHEN abs(x - y) > 40 THEN 1.0::DOUBLE ELSE 0.0 END) >= 0.45 AS noisy FROM c GROUP BY 1, 2),
u AS (SELECT *, avg(CASE WHEN noisy THEN 1.0::DOUBLE ELSE 0.0 END) OVER (PARTITION BY rec) AS part FROM n),
m AS (SELECT rec, frame, k FROM c JOIN u USING (rec, k) WHERE abs(x - y) > 40 AND (NOT noisy OR part > 0.25)),
e AS (SELECT a.frame, a.k AS a, b.k AS b FROM m a JOIN m b ON a.frame = b.frame AND (abs(a.k - b.k) = 8 OR (abs(a.k - b.k) = 1 AND a.k // 8 = b.k // 8))),
r AS (SELECT frame, k AS a, k AS b FROM m UNION SELECT r.frame, r.a, e.b FROM r JOIN e ON e.frame = r.frame AND e.a = r.b),
s AS (SELECT frame, a, count(*) AS size FROM r GROUP BY 1, 2)
SELECT rec, frame, coalesce(max(size), 0) AS size, coalesce(max(size), 0) >= 10 AS mark FROM p LEFT JOIN s USING (frame) WHERE b IS NOT NULL GROUP BY 1, 2"""


def l3c(spark, sf):
    """Frames as block means of 2 x 2 tiles."""
    return tiles(spark, sf).select("frame", F.array_join(grids.coarser(F.col("tiles"), 8, 8, 2), ",").alias("blocks"))


Q["l3_block_means"], O["l3_block_means"] = l3c, """WITH f AS (SELECT vec_id AS frame, unnest(range(64)) AS k, unnest([floor(c::DOUBLE * 256) for c in embedding]) AS x FROM embeddings),
b AS (SELECT frame, (k // 16) * 4 + (k % 8) // 2 AS blk, CAST(floor(sum(x) / 4) AS BIGINT) AS m FROM f GROUP BY 1, 2) SELECT frame, string_agg(CAST(m AS VARCHAR), ',' ORDER BY blk) AS blocks FROM b GROUP BY 1"""


def a20l(spark, sf):
    """Lopsided words: of three labelled documents or more, nine tenths of them toxic, and not near any listed spelling."""
    words, listed = vocabulary(spark, sf)
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    again = kept(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"))  # ids that repeat: their words are told apart by a shuffle, others' by row
    each = lambda d: d.join(labels, "doc_id").select("doc_id", "toxic", F.explode(F.array_distinct(F.transform(X.words(F.col("text")), F.lower))).alias("word"))
    each = each(docs) if again.isEmpty() else each(docs.join(again, "doc_id", "left_anti")).unionByName(each(docs.join(again, "doc_id", "left_semi")).distinct())
    g = each.groupBy("word").agg(F.count(F.lit(1)).alias("docs"), F.sum("toxic").cast("long").alias("toxic_docs")).where("docs >= 3 AND toxic_docs * 10 >= docs * 9")
    return g.join(R.candidates(words, listed).select("word"), "word", "left_anti").join(listed.select(F.col("entry").alias("word")), "word", "left_anti")


Q["a20_lopsided"], O["a20_lopsided"] = a20l, O["m20_candidates"].replace("SELECT word, entry AS near, CASE", ", near AS (SELECT word, entry AS near, CASE", 1) + """),
lb AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1), x AS (SELECT DISTINCT doc_id, toxic, lower(unnest(words)) AS word FROM w JOIN lb USING (doc_id))
SELECT word, count(*) AS docs, CAST(sum(toxic) AS BIGINT) AS toxic_docs FROM x WHERE word NOT IN (SELECT word FROM near) AND word NOT IN (SELECT entry FROM k) GROUP BY 1 HAVING count(*) >= 3 AND sum(toxic) * 10 >= count(*) * 9"""


def placed_tiles(spark, sf):
    """The tiles with their frames' places in the recording, from 0."""
    place = F.row_number().over(Window.partitionBy("rec").orderBy("frame")) - 1
    return tiles(spark, sf).withColumn("place", place.cast("long"))


def l2(spark, sf):
    """How much each frame differs from the frames before and after it."""
    return grids.instability(placed_tiles(spark, sf), "rec", "place", "tiles", 40).select("rec", "place", F.round("instability", 6).alias("instability"))


PLACED = "WITH f AS (SELECT label AS rec, [floor(c::DOUBLE * 256) for c in embedding] AS t, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place FROM embeddings),"
Q["l2_instability"], O["l2_instability"] = l2, PLACED + """ p AS (SELECT rec, place, t, lag(t) OVER w AS b FROM f WINDOW w AS (PARTITION BY rec ORDER BY place)),
c AS (SELECT rec, place, list_sum([CASE WHEN abs(t[k] - b[k]) > 40 THEN 1.0::DOUBLE ELSE 0 END for k in range(1, 65)]) / 64 AS back FROM p WHERE b IS NOT NULL),
o AS (SELECT f.rec, f.place, (c.back + lead(c.back) OVER (PARTITION BY f.rec ORDER BY f.place)) / 2 AS own FROM f LEFT JOIN c ON c.rec = f.rec AND c.place = f.place)
SELECT rec, place, round(coalesce(own, lead(own) OVER w, lag(own) OVER w), 6) AS instability FROM o WINDOW w AS (PARTITION BY rec ORDER BY place)"""


def l2c(spark, sf):
    """How well the ninth frame of each seventeen stands for all of them."""
    f = placed_tiles(spark, sf)
    s = f.where("place % 17 = 0").select("rec", F.col("place").alias("boundary"), (F.col("place") + 8).alias("sample"))
    return grids.coverage(f, s, "rec", "place", "tiles", 40).select("rec", F.round("coverage", 6).alias("coverage"))


Q["l2_coverage"], O["l2_coverage"] = l2c, PLACED + """ n AS (SELECT rec, max(place) AS last FROM f GROUP BY 1),
a AS (SELECT f.rec, f.place, f.t, s.t AS u FROM f JOIN n USING (rec) JOIN f s ON s.rec = f.rec AND s.place = least(f.place - f.place % 17 + 8, n.last) WHERE f.place > 0 AND f.place < n.last)
SELECT rec, round(avg(list_sum([CASE WHEN abs(t[k] - u[k]) <= 40 THEN 1.0::DOUBLE ELSE 0 END for k in range(1, 65)]) / 64), 6) AS coverage FROM a GROUP BY 1"""
