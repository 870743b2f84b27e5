"""Catalog queries: recordings (customers), transcripts (orders), entries (line items), and ordered kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import kernels

Q, O = {}, {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def j19(spark, sf):
    """Recordings with their newest transcript, newest first; the left side stays whole."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("newest"), F.count(F.lit(1)).alias("n"))
    c = table(spark, sf, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "newest", F.coalesce("n", F.lit(0)).alias("n_transcripts"))


Q["j19_catalog_join"], O["j19_catalog_join"] = j19, "SELECT c_custkey, max(o_orderdate) AS newest, count(o_orderkey) AS n_transcripts FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"


def j20(spark, sf):
    """The newest other transcript of each recording: the second in order of date."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf, "orders").withColumn("r", F.row_number().over(w)).where("r = 2").select("o_custkey", "o_orderkey")


Q["j20_second_reading"], O["j20_second_reading"] = j20, "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 2"


def a2(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.groupBy("l_orderkey").agg(F.round(F.exp(F.avg(F.log(F.col("l_discount") + F.lit(1e-10)))), 8).alias("confidence"), F.min("l_discount").alias("least"))


Q["a2_geometric_mean"], O["a2_geometric_mean"] = a2, "SELECT l_orderkey, round(exp(avg(ln(l_discount + 1e-10))), 8) AS confidence, min(l_discount) AS least FROM lineitem GROUP BY 1"


def a1(spark, sf):
    """Votes for a supplier among an order's lines: count, first voter."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("votes"), F.min("l_linenumber").alias("first"))


Q["a1_votes"], O["a1_votes"] = a1, "SELECT l_orderkey, l_suppkey, count(*) AS votes, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2"


def a5(spark, sf):
    """Margin of the first over the second status among each recording's transcripts."""
    n = table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("o_custkey").orderBy(F.desc("n"), "o_orderstatus")
    r = n.withColumns({"r": F.row_number().over(w), "all": F.sum("n").over(Window.partitionBy("o_custkey"))})
    top = lambda k: F.max(F.when(F.col("r") == k, F.col("n")))
    return r.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("speakers"), F.round((top(1) - F.coalesce(top(2), F.lit(0))) / F.max("all"), 8).alias("margin"), (F.count(F.lit(1)) == 1).alias("unanimous"))


Q["a5_vote_margins"], O["a5_vote_margins"] = a5, """WITH n AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderstatus) AS r FROM n)
SELECT o_custkey, count(*) AS speakers, round((max(CASE WHEN r = 1 THEN n END) - coalesce(max(CASE WHEN r = 2 THEN n END), 0)) / sum(n), 8) AS margin, count(*) = 1 AS unanimous FROM r GROUP BY 1"""


def t4(spark, sf):
    """Each recording's three newest transcripts."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf, "orders").withColumn("place", F.row_number().over(w)).where("place <= 3").select("o_custkey", "place", "o_orderkey")


Q["t4_newest_first"], O["t4_newest_first"] = t4, "SELECT o_custkey, place, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders) WHERE place <= 3"


def p11(spark, sf):
    """Three-state flags of a recording: null where there is nothing to know it from."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.max(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.countDistinct("o_orderstatus").alias("speakers"), F.count(F.when(F.col("o_totalprice") > 300000, 1)).alias("marks")
    )
    c = table(spark, sf, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "urgent", "speakers", "marks")


Q["p11_counts"], O["p11_counts"] = p11, "SELECT c_custkey, max(o_orderpriority = '1-URGENT') AS urgent, CASE WHEN count(o_orderkey) > 0 THEN count(DISTINCT o_orderstatus) END AS speakers, CASE WHEN count(o_orderkey) > 0 THEN count(CASE WHEN o_totalprice > 300000 THEN 1 END) END AS marks FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"


def s11(spark, sf):
    """The list of words that conversations have, and behind it those of part names that it lacks, each from its first part."""
    listed = table(spark, sf, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    w = table(spark, sf, "part").select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    new = w.groupBy("word").agg(F.min("p_partkey").alias("first")).join(listed, "word", "left_anti")
    return listed.select("word", F.lit(None).cast("long").alias("first")).unionByName(new.withColumn("first", F.col("first").cast("long")))


Q["s11_add_word"], O["s11_add_word"] = s11, """WITH l AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations)
SELECT word, CAST(NULL AS BIGINT) AS first FROM l UNION ALL SELECT word, CAST(min(p_partkey) AS BIGINT) FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS word FROM part) WHERE word NOT IN (SELECT word FROM l) GROUP BY 1"""


def s8(spark, sf):
    """Sources that some entry uses (left semi), and those that none uses (left anti)."""
    l = table(spark, sf, "lineitem").where("l_quantity > 49").select("l_suppkey")
    s = table(spark, sf, "supplier").select("s_suppkey")
    on = F.col("s_suppkey") == F.col("l_suppkey")
    return s.join(l, on, "left_semi").withColumn("used", F.lit(True)).unionByName(s.join(l, on, "left_anti").withColumn("used", F.lit(False)))


Q["s8_used_sources"], O["s8_used_sources"] = s8, "SELECT s_suppkey, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) AS used FROM supplier"


def a30(spark, sf):
    """Change scores: dimensions of consecutive frames that differ by over 0.1."""
    return _changes(spark, sf).select("vec_id", "score")


def _changes(spark, sf):
    v = table(spark, sf, "embeddings").select("label", "vec_id", "embedding")
    w = Window.partitionBy("label").orderBy("vec_id")
    v = v.withColumn("before", F.lag("embedding").over(w)).where("before IS NOT NULL")
    score = F.size(F.filter(F.zip_with("embedding", "before", lambda a, b: F.abs(a - b) > F.lit(0.1).cast("float")), lambda x: x))
    return v.select("label", "vec_id", score.cast("long").alias("score"))


Q["a30_change_scores"], O["a30_change_scores"] = a30, """WITH v AS (SELECT vec_id, embedding AS a, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT vec_id, len(list_filter(list_zip(a, b), lambda x: abs(x[1] - x[2]) > 0.1::FLOAT)) AS score FROM v WHERE b IS NOT NULL"""


def _recordings(v):
    """Frames of a label in recordings of a hundred."""
    return v.withColumn("rec", F.col("label") * 100_000 + F.floor(F.col("vec_id") / 100))


def t1(spark, sf):
    """Marks: at most eight frames of each recording by score, four or more apart, and where to look."""
    return kernels.select_marks(_recordings(_changes(spark, sf)), "rec", "vec_id", "score", budget=8, least_gap=4)


Q["t1_select_marks"], O["t1_select_marks"] = t1, """WITH RECURSIVE v AS (SELECT vec_id, label, embedding AS a, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
c AS (SELECT label * 100000 + vec_id // 100 AS rec, vec_id, len(list_filter(list_zip(a, b), lambda x: abs(x[1] - x[2]) > 0.1::FLOAT)) AS score FROM v WHERE b IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY score DESC, vec_id) AS k, max(vec_id) OVER (PARTITION BY rec) AS last FROM c),
p AS (SELECT * FROM o WHERE score > 0),
r AS (SELECT rec, k, [vec_id] AS taken FROM p WHERE k = 1 UNION ALL SELECT r.rec, p.k, CASE WHEN len(taken) < 8 AND coalesce(list_min([abs(x - p.vec_id) for x in taken]), 9) >= 4 THEN list_append(taken, p.vec_id) ELSE taken END FROM r JOIN p ON p.rec = r.rec AND p.k = r.k + 1),
e AS (SELECT rec, unnest(taken) AS vec_id FROM (SELECT rec, arg_max(taken, k) AS taken FROM r GROUP BY 1))
SELECT e.rec, e.vec_id, (e.vec_id + coalesce(lead(e.vec_id) OVER (PARTITION BY e.rec ORDER BY e.vec_id), m.last)) / 2 AS look FROM e JOIN (SELECT rec, max(vec_id) AS last FROM c GROUP BY 1) m USING (rec)"""


def t3(spark, sf):
    """Frames of each recording whose sign bits differ in over 20 places from the last kept frame. What is kept hangs on the frame kept before: a recording is one task's."""
    bits = F.aggregate("embedding", F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("long")))
    v = _recordings(table(spark, sf, "embeddings").select("label", "vec_id", bits.alias("hash"))).select("rec", "vec_id", "hash")
    return kernels.keep_changed(v, "rec", "vec_id", "hash", 20).select("rec", "vec_id")


Q["t3_keep_count"], O["t3_keep_count"] = t3, """WITH RECURSIVE v AS (SELECT label * 100000 + vec_id // 100 AS rec, vec_id, [x > 0 for x in embedding] AS b FROM embeddings), o AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY vec_id) AS k FROM v),
r AS (SELECT rec, k, vec_id, b AS last, true AS kept FROM o WHERE k = 1
 UNION ALL SELECT o.rec, o.k, o.vec_id, CASE WHEN d > 20 THEN b ELSE last END, d > 20 FROM (SELECT o.*, r.last, list_sum([CASE WHEN o.b[i] <> r.last[i] THEN 1 ELSE 0 END for i in range(1, 65)]) AS d FROM r JOIN o ON o.rec = r.rec AND o.k = r.k + 1) o)
SELECT rec, vec_id FROM r WHERE kept"""


def f13(spark, sf):
    """FNV-1a of each turn's words."""
    return kernels.with_fnv(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "text")


Q["f13_words_hash"], O["f13_words_hash"] = f13, r"""WITH h AS (SELECT conv_id, turn, hex(encode(array_to_string(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''), ' '))) AS h FROM conversations)
SELECT conv_id, turn, lower(printf('%08x', list_reduce(list_concat([2166136261::BIGINT], list_transform(range(1, length(h) + 1, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)), lambda a, b: xor(a, b) * 16777619 % 4294967296))) AS words_hash FROM h"""


def j12(spark, sf):
    """Dictionary phrases of up to three words in documents: longest match first, not overlapping."""
    b = table(spark, sf, "benchmark").select(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "").alias("w"), "item_id")
    phrases = b.select("item_id", F.explode(F.array(*[F.slice("w", 1, k) for k in (1, 2, 3)])).alias("p"))
    words = phrases.groupBy(F.array_join("p", " ").alias("phrase")).agg(F.min("item_id").alias("entry"))
    return kernels.find_phrases(table(spark, sf, "documents").select("doc_id", "text"), words, "text", 3)


Q["j12_find_phrases"], O["j12_find_phrases"] = j12, r"""WITH RECURSIVE b AS (SELECT item_id, [x for x in string_split_regex(lower(text), '[^\p{L}\p{N}]+') if x <> ''] AS w FROM benchmark),
ph AS (SELECT phrase, min(item_id) AS entry, len(string_split(phrase, ' ')) AS n FROM (SELECT item_id, array_to_string(w[1:k], ' ') AS phrase FROM b, (SELECT unnest([1, 2, 3]) AS k)) GROUP BY phrase),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS first, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w)),
m AS (SELECT doc_id, first, max(k) AS n, arg_max(entry, k) AS entry FROM g JOIN ph ON g.phrase = ph.phrase AND g.k = ph.n GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS r FROM m),
t AS (SELECT doc_id, r, first, n, entry, first + n AS free, true AS taken FROM o WHERE r = 1
 UNION ALL SELECT o.doc_id, o.r, o.first, o.n, o.entry, CASE WHEN o.first >= free THEN o.first + o.n ELSE free END, o.first >= free FROM t JOIN o ON o.doc_id = t.doc_id AND o.r = t.r + 1)
SELECT doc_id, first, CAST(n AS INTEGER) AS size, entry FROM t WHERE taken"""
