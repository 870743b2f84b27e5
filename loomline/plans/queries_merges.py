"""Edit lists patched and put aside, recordings and transcripts merged into their tables, banked results taken up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edits as E, merges as M
from ..operators.groups import kept
from ..streaming.resume import reused
from .queries_edits import LISTS, lists
from .queries_text import table
from .queries_time import points

Q, O = {}, {}


def m7(spark, sf):
    """Two patches for each list, some made against an older one, outside it or breaking it: what became of each, and of the list."""
    e = kept(lists(spark, sf).drop("event_id"), "doc")
    now = kept(M.list_digests(e), "doc")
    word = lambda start: F.array(F.struct(*[F.lit(v).cast(t.split()[1]).alias(t.split()[0]) if t.split()[0] != "source_start" else start.cast("long").alias("source_start") for t, v in zip(E.ENTRY.split(", "), ("item", None, None, "0", 0, 1, "new", False, 1.0))])).cast(E.ENTRIES)
    both = now.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    doc = F.col("doc")
    p = both.select(
        "doc", (doc * 10 + F.col("k")).alias("seq"), F.when((doc + F.col("k")) % 7 == 0, F.lit("old")).otherwise(F.col("digest")).alias("against"),
        F.when((doc + F.col("k")) % 5 == 0, F.col("size")).otherwise(doc % 9 + 1).alias("start"), (doc % 3).alias("gone"), word(F.when(doc % 11 == 2, -1).otherwise(5)).alias("put"),
    )
    p = p.unionByName(p.where("seq % 100 = 1").withColumn("doc", F.col("doc") + 10**9))
    docs = e.select("doc").distinct()
    after, outcome = M.patched(e, p, docs.select("doc", F.lit("0").alias("source"), F.lit("/a").alias("path")), docs.select("doc", F.lit("a").alias("label"), F.lit("b").alias("name")))
    size = after.groupBy("doc").agg(F.count(F.lit(1)).alias("size"), F.count(F.when(F.col("text") == "new", 1)).alias("added"))
    return outcome.join(size, "doc", "left")


Q["m7_patch"], O["m7_patch"] = m7, LISTS + """, p AS (SELECT doc, size, doc * 10 + k AS seq, (doc + k) % 7 = 0 AS old, CASE WHEN (doc + k) % 5 = 0 THEN size ELSE doc % 9 + 1 END AS start, doc % 3 AS gone FROM sz, (SELECT unnest([1, 2]) AS k)),
r AS (SELECT *, NOT old AND start <= size AND gone <= size - start AS ready FROM p),
f AS (SELECT *, min(seq) FILTER (ready) OVER (PARTITION BY doc) AS first FROM r),
o AS (SELECT doc, size, seq, gone, CASE WHEN seq = first THEN CASE WHEN doc % 11 = 2 THEN 'broken: start is no time' ELSE 'applied' END
  WHEN old OR (seq > first AND doc % 11 <> 2) THEN 'changed' WHEN NOT (start <= size AND gone <= size - start) THEN 'outside' ELSE 'not tried' END AS outcome FROM f),
a AS (SELECT doc, max(CASE WHEN outcome = 'applied' THEN 1 - gone END) AS d FROM o GROUP BY 1)
SELECT doc, seq, outcome, size + coalesce(d, 0) AS size, CASE WHEN d IS NULL THEN 0 ELSE 1 END AS added FROM o JOIN a USING (doc)
UNION ALL SELECT doc + 1000000000, seq, 'no such list', NULL, NULL FROM o WHERE seq % 100 = 1"""


def m8(spark, sf):
    """Lists of customers' orders: those made from another transcript than the newest are put aside under a free name."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), "o_orderkey", F.md5(F.concat(F.lit("t"), (F.col("o_orderkey") % 5).cast("string"))).alias("sha"))
    newest = o.groupBy("doc").agg(F.max_by("sha", "o_orderkey").alias("sha"))
    first = o.groupBy("doc").agg(F.min_by("sha", "o_orderkey").alias("made_from")).withColumn("names", F.create_map(F.lit("SPEAKER_00"), F.concat(F.lit("n"), F.col("doc").cast("string"))))
    asides = o.where("o_orderkey % 3 = 0").select("doc", F.col("sha").alias("digest"))
    s = M.settled(first, newest, asides)
    return s.select("doc", "state", "aside", "made_from", F.element_at("names", "SPEAKER_00").alias("name"))


Q["m8_put_aside"], O["m8_put_aside"] = m8, """WITH o AS (SELECT o_custkey AS doc, o_orderkey AS k, md5('t' || (o_orderkey % 5)) AS sha FROM orders),
l AS (SELECT doc, arg_min(sha, k) AS made, arg_max(sha, k) AS sha FROM o GROUP BY 1), a AS (SELECT doc, substr(sha, 1, 12) AS d, count(*) AS n FROM o WHERE k % 3 = 0 GROUP BY ALL)
SELECT l.doc, CASE WHEN made <> sha THEN 'aside' ELSE 'kept' END AS state, CASE WHEN made <> sha THEN l.doc || '.' || substr(made, 1, 12) || CASE WHEN n > 0 THEN '-' || (n + 1) ELSE '' END END AS aside, sha AS made_from, 'n' || l.doc AS name
FROM l LEFT JOIN a ON a.doc = l.doc AND a.d = substr(made, 1, 12)"""


def library(spark, sf):
    """(seen, recordings): orders as files that were seen, customers as recordings."""
    k = F.col("o_orderkey")
    seen = table(spark, sf, "orders").select(F.concat(F.lit("/m/"), (F.col("o_custkey") * 3 % 997).cast("string")).alias("path"), F.when(k % 6 != 0, F.concat(F.lit("c"), (k % 2003).cast("string"))).alias("content_id"), k.alias("seq"))
    c = F.col("c_custkey")
    recordings = table(spark, sf, "customer").select(c.alias("id"), F.concat(F.lit("/m/"), (c * 7 % 1103).cast("string")).alias("path"), F.when(c % 4 != 0, F.concat(F.lit("c"), c.cast("string"))).alias("content_id"), (c % 9 == 0).alias("missing"))
    return seen, recordings


LIBRARY = """WITH s0 AS (SELECT '/m/' || (o_custkey * 3 % 997) AS path, CASE WHEN o_orderkey % 6 <> 0 THEN 'c' || (o_orderkey % 2003) END AS content_id, o_orderkey AS seq FROM orders),
s AS (SELECT * FROM s0 QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1),
r AS (SELECT c_custkey AS id, '/m/' || (c_custkey * 7 % 1103) AS path, CASE WHEN c_custkey % 4 <> 0 THEN 'c' || c_custkey END AS content_id, c_custkey % 9 = 0 AS missing FROM customer),
t AS (SELECT s.*, k.id AS same, CASE WHEN k.id IS NULL THEN (SELECT max(id) FROM r e WHERE e.content_id IS NULL AND e.path = s.path) END AS fill FROM s LEFT JOIN r k ON k.content_id = s.content_id WHERE s.content_id IS NOT NULL),
t2 AS (SELECT *, coalesce(same, first_value(fill) OVER (PARTITION BY content_id ORDER BY seq)) AS id FROM t),
a AS (SELECT s.*, (SELECT max(id) FROM r e WHERE e.path = s.path) AS id FROM s WHERE content_id IS NULL),
nw AS (SELECT content_id, min(seq) AS seq, arg_min(path, seq) AS path, false AS missing FROM t2 WHERE id IS NULL GROUP BY 1 UNION ALL SELECT NULL, seq, path, true FROM a WHERE id IS NULL),
nn AS (SELECT *, (SELECT max(id) FROM r) + row_number() OVER (ORDER BY seq) AS id FROM nw),
m AS (SELECT t2.path, t2.content_id, coalesce(t2.id, nn.id) AS id, t2.seq FROM t2 LEFT JOIN nn ON nn.content_id = t2.content_id),
g AS (SELECT a.path, NULL AS content_id, coalesce(a.id, nn.id) AS id FROM a LEFT JOIN nn ON nn.content_id IS NULL AND nn.path = a.path)
"""


def m9a(spark, sf):
    return M.recordings_for(*library(spark, sf))[0]


Q["m9_recording_for"], O["m9_recording_for"] = m9a, LIBRARY + "SELECT path, content_id, id FROM m UNION ALL SELECT path, content_id, id FROM g"


def m9b(spark, sf):
    return M.recordings_for(*library(spark, sf))[1]


Q["m9_add_recording"], O["m9_add_recording"] = m9b, LIBRARY + """, h AS (SELECT id, arg_min(path, seq) AS moved, list(path) AS paths, any_value(content_id) AS filled FROM m GROUP BY 1)
SELECT r.id, CASE WHEN h.id IS NOT NULL AND NOT list_contains(paths, r.path) THEN moved ELSE r.path END AS path, coalesce(r.content_id, filled) AS content_id,
 CASE WHEN h.id IS NOT NULL THEN false WHEN (r.content_id IS NOT NULL AND s.content_id IS NOT NULL AND s.content_id <> r.content_id) OR r.id IN (SELECT id FROM g) THEN true ELSE r.missing END AS missing
FROM r LEFT JOIN h ON h.id = r.id LEFT JOIN s ON s.path = r.path
UNION ALL SELECT id, path, content_id, missing FROM nn"""


def m10(spark, sf):
    """Order lines as runs and finds of transcripts, customers as transcripts that are known."""
    n = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1001 + F.col("l_suppkey") % 1001
    kind = F.when(n % 5 == 0, "run").otherwise("adopt")
    ev = table(spark, sf, "lineitem").select(
        (F.col("l_partkey") * 7 % 1999).alias("path"), n.alias("seq"), kind.alias("kind"), F.col("l_suppkey").alias("recording_id"),
        F.when((n % 3 == 0) | (n % 5 == 0), F.concat("l_returnflag", "l_linestatus")).alias("engine"), F.when(n % 5 == 0, F.col("l_linestatus")).alias("language"), F.col("l_returnflag").alias("model"), (n % 1000).alias("finished_at"),
    )
    old = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("path"), F.col("c_nationkey").cast("long").alias("recording_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("engine"),
        F.lit(None).cast("string").alias("language"), F.lit("m0").alias("model"), F.lit(0).cast("long").alias("finished_at"),
    )
    return M.upserted(old, ev)


Q["m10_upsert"], O["m10_upsert"] = m10, """WITH e AS (SELECT l_partkey * 7 % 1999 AS path, (l_orderkey * 10 + l_linenumber) * 1001 + l_suppkey % 1001 AS seq, ((l_orderkey * 10 + l_linenumber) * 1001 + l_suppkey % 1001) % 5 = 0 AS run, l_suppkey, CASE WHEN ((l_orderkey * 10 + l_linenumber) * 1001 + l_suppkey % 1001) % 3 = 0 OR ((l_orderkey * 10 + l_linenumber) * 1001 + l_suppkey % 1001) % 5 = 0 THEN l_returnflag || l_linestatus END AS engine,
  CASE WHEN ((l_orderkey * 10 + l_linenumber) * 1001 + l_suppkey % 1001) % 5 = 0 THEN l_linestatus END AS language, l_returnflag AS model, ((l_orderkey * 10 + l_linenumber) * 1001 + l_suppkey % 1001) % 1000 AS f FROM lineitem),
g AS (SELECT path, max(seq) FILTER (run) AS r, arg_max(model, seq) AS model, arg_max(l_suppkey, seq) FILTER (run) AS rs, arg_max(engine, seq) FILTER (run) AS re, arg_max(language, seq) FILTER (run) AS rl, arg_max(f, seq) FILTER (run) AS rf,
  arg_min(l_suppkey, seq) AS fs, arg_min(f, seq) AS ff, arg_min(engine, seq) FILTER (NOT run AND engine IS NOT NULL) AS fe FROM e GROUP BY 1),
o AS (SELECT c_custkey AS path, CAST(c_nationkey AS BIGINT) AS rid, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS engine FROM customer)
SELECT path, CASE WHEN r IS NOT NULL THEN rs WHEN o.rid IS NOT NULL THEN o.rid ELSE fs END AS recording_id, CASE WHEN r IS NOT NULL THEN re ELSE coalesce(o.engine, fe) END AS engine, CASE WHEN r IS NOT NULL THEN rl END AS language,
 coalesce(g.model, 'm0') AS model, CASE WHEN r IS NOT NULL THEN rf WHEN o.rid IS NOT NULL THEN 0 ELSE ff END AS finished_at FROM o FULL JOIN g USING (path)"""


def m11(spark, sf):
    """Files picked for recordings (suppliers of parts): what came of each pick."""
    _, recordings = library(spark, sf)
    p = table(spark, sf, "part").select("p_partkey")
    k = F.col("p_partkey")
    picks = p.select(k.alias("id"), F.concat(F.lit("/new/"), k.cast("string")).alias("path"), F.when(k % 5 == 0, F.concat(F.lit("c"), (k + 1).cast("string"))).when(k % 4 == 0, F.concat(F.lit("d"), k.cast("string"))).otherwise(F.concat(F.lit("c"), k.cast("string"))).alias("content_id"))
    transcripts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("recording_id"))
    r, moved, outcome = M.relinked(recordings, transcripts, picks)
    n = moved.groupBy(F.col("recording_id").alias("id")).agg(F.count(F.lit(1)).alias("transcripts"))
    return outcome.join(r, "id", "full_outer").join(n, "id", "left").select("id", "outcome", "path", "content_id", "missing", F.coalesce("transcripts", F.lit(0)).alias("transcripts"))


Q["m11_relink"], O["m11_relink"] = m11, LIBRARY + """, pk AS (SELECT p_partkey AS id, '/new/' || p_partkey AS path, CASE WHEN p_partkey % 5 = 0 THEN 'c' || (p_partkey + 1) WHEN p_partkey % 4 = 0 THEN 'd' || p_partkey ELSE 'c' || p_partkey END AS content_id FROM part),
oc AS (SELECT pk.id, pk.path, pk.content_id, k.id AS known, CASE WHEN r.id IS NULL THEN 'no such recording' WHEN r.content_id IS NOT NULL AND r.content_id <> pk.content_id THEN 'not the same' WHEN k.id <> pk.id THEN 'joined' ELSE 'linked' END AS outcome
  FROM pk LEFT JOIN r ON r.id = pk.id LEFT JOIN r k ON k.content_id = pk.content_id),
tg AS (SELECT CASE outcome WHEN 'joined' THEN known ELSE id END AS id, arg_max(path, id) AS path, any_value(content_id) AS content_id FROM oc WHERE outcome IN ('joined', 'linked') GROUP BY 1),
ra AS (SELECT r.id, coalesce(tg.path, r.path) AS path, coalesce(r.content_id, tg.content_id) AS content_id, CASE WHEN tg.id IS NOT NULL THEN false ELSE missing END AS missing FROM r LEFT JOIN tg USING (id) WHERE r.id NOT IN (SELECT id FROM oc WHERE outcome = 'joined')),
tr AS (SELECT coalesce(known, o_custkey) AS id, count(*) AS transcripts FROM orders LEFT JOIN (SELECT * FROM oc WHERE outcome = 'joined') j ON j.id = o_custkey GROUP BY 1)
SELECT coalesce(oc.id, ra.id) AS id, outcome, ra.path, ra.content_id, missing, coalesce(transcripts, 0) AS transcripts FROM oc FULL JOIN ra ON oc.id = ra.id LEFT JOIN tr ON tr.id = coalesce(oc.id, ra.id)"""


def s17(spark, sf):
    """Finished results of users' recordings, used again only if nothing about the run has changed; else what has."""
    p = points(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_type").alias("model"))
    u = F.col("user_id")
    now = F.create_map(F.lit("schema"), F.lit("2"), F.lit("content_id"), u.cast("string"), F.lit("model_id"), F.col("model"), F.lit("language"), F.lit("en"))
    then = F.create_map(F.lit("schema"), F.when(u % 7 == 0, "1").otherwise("2"), F.lit("content_id"), (u + F.when(u % 5 == 0, 1).otherwise(0)).cast("string"), F.lit("model_id"), F.when(u % 3 == 0, "x").otherwise(F.col("model")), F.lit("beam"), F.lit("4"))
    same = F.when(u % 2 == 0, F.map_concat(F.map_filter(then, lambda k, _: k != "beam"), F.create_map(F.lit("language"), F.lit("en")))).otherwise(then)
    bank = p.where("user_id % 11 <> 0").select("user_id", same.alias("fingerprint"), F.concat(F.lit("text of "), F.col("n").cast("string")).alias("result"))
    return reused(p.select("user_id", now.alias("fingerprint")), bank, "user_id").drop("fingerprint")


Q["s17_bank"], O["s17_bank"] = s17, """WITH p AS (SELECT user_id AS u, count(*) AS n, min(event_type) AS model FROM events GROUP BY 1),
d AS (SELECT *, [x for x in [CASE WHEN u % 2 = 1 THEN 'another engine (beam)' END, CASE WHEN u % 5 = 0 THEN 'the recording has other contents (content_id)' END, CASE WHEN u % 2 = 1 THEN 'another language (language)' END,
  CASE WHEN u % 3 = 0 AND model <> 'x' THEN 'another model (model_id)' END] if x IS NOT NULL] AS odd FROM p),
r AS (SELECT *, CASE WHEN u % 11 = 0 THEN 'nothing banked' WHEN u % 7 = 0 THEN 'written in another format (schema)' WHEN len(odd) > 0 THEN array_to_string(odd, '; ') END AS reason FROM d)
SELECT u AS user_id, CASE WHEN reason IS NULL THEN 'text of ' || n END AS result, reason FROM r"""


def s15(spark, sf):
    """Two tables written as one version, then a version that fails between them, then one that succeeds: what readers see of each."""
    from ..store import Changed, TableSet, scratch

    store = TableSet(spark, scratch(spark))
    p = points(spark, sf)
    by = lambda c, rows: rows.groupBy(F.col(c).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    first = store.write({"types": by("event_type", p), "users": by("user_id", p)}, 0)
    broken = by("user_id", p).withColumn("n", F.when(F.col("k") == F.col("k"), F.raise_error(F.lit("a writer stops here")).cast("long")))
    try:
        store.write({"types": by("event_type", p.limit(1)), "users": broken}, first)
    except Changed:
        raise
    except Exception as stopped:  # the failure that the query is about
        if "a writer stops here" not in str(stopped):
            raise
    half = p.where("event_id % 2 = 0")
    second = store.write({"types": by("event_type", half)}, first)
    seen = [store.read(name, v).select(F.lit(v).alias("version"), F.lit(name).alias("name"), "k", "n") for v in (first, second) for name in ("types", "users")]
    return seen[0].unionByName(seen[1]).unionByName(seen[2]).unionByName(seen[3])


Q["s15_atomic_tables"], O["s15_atomic_tables"] = s15, """SELECT 1 AS version, 'types' AS name, event_type AS k, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT v, 'users', CAST(user_id AS VARCHAR), count(*) FROM events, (SELECT unnest([1, 2]) AS v) GROUP BY v, user_id
UNION ALL SELECT 2, 'types', event_type, count(*) FROM events WHERE event_id % 2 = 0 GROUP BY event_type"""
