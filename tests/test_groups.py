"""Groups settled in Arrow batches: many small ones in seconds, some without a row, and what each is given."""

import time

import pytest
from pyspark.sql import functions as F

from loomline import catalog
from loomline.functions import text as X
from loomline.operators import cues as C, edits as E, groups as G, matching as M, seams as S
from loomline.plans import queries_edits as Q, queries_merges as W, queries_more as O, queries_recut as R
from loomline.sources import documents as D


def test_groups_are_whole_in_order_and_may_give_nothing(spark):
    rows = spark.range(50_000).select((F.col("id") % 7001).alias("k"), (F.col("id") * 7919 % 50_000).alias("n"), F.col("id").cast("string").alias("t"))
    took = lambda group: [(group[0][0], [r[1] for r in group], group[-1][2])] if group[0][0] % 3 else []
    got = {r.k: r for r in G.each_group(rows, ["k"], [F.desc("n")], took, "k long, n array<long>, t string").collect()}
    want = {}
    for i in range(50_000):
        want.setdefault(i % 7001, []).append((i * 7919 % 50_000, str(i)))
    want = {k: sorted(v, reverse=True) for k, v in want.items() if k % 3}
    assert {k: (r.n, r.t) for k, r in got.items()} == {k: ([n for n, _ in v], v[-1][1]) for k, v in want.items()}
    assert G.each_group(rows.where("k < 0"), ["k"], ["n"], took, "k long, n array<long>, t string").count() == 0


def test_stamps_of_a_hundred_hours_and_more(spark):
    ms = [0, 99 * 3_600_000 + 5, 100 * 3_600_000, 12_345 * 3_600_000 + 7]
    r = spark.createDataFrame([(m,) for m in ms], "ms long").select("ms", X.stamp_ms(X.clock(F.col("ms"))).alias("back")).collect()
    assert [x.back for x in r] == [x.ms for x in r] and len(r) == 4


def test_many_small_cues(spark):
    k = F.col("id")
    s = spark.range(120_000).select(F.floor(k / 4).alias("u"), k.alias("sent"), (F.floor(k % 4 / 2) * 10).alias("start"), (F.floor(k % 4 / 2) * 10 + k % 2 * 3).alias("end"))
    begun = time.time()
    assert C.one_timeline(s, "u").agg(F.count("n"), F.sum("n"), F.max("n")).first() == (60_000, 120_000, 2)
    assert time.time() - begun < 60


def test_many_small_sentences(spark):
    t = spark.range(120_000).select(F.floor(F.col("id") / 4).alias("k"), F.col("id").alias("token"), (F.col("id") % 4 * 100).alias("t"), (F.col("id") % 4 * 100 + 50).alias("e"), F.lit(" a").alias("w"))
    begun = time.time()
    assert C.sentences_of(t, "k", 2, 1000, 4000).groupBy("sent").count().orderBy("sent").collect() == [(0, 60_000), (1, 60_000)]
    assert time.time() - begun < 60


def test_one_word_said_again_and_again_is_paired(spark):
    w = spark.range(40_000).select(F.lit(0).cast("long").alias("doc"), F.col("id").alias("word"), F.lit(0).cast("long").alias("turn"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 10).alias("end"), F.lit("a").alias("text"), F.lit(True).alias("sure"))
    t = w.where("word % 100 <> 7").select("doc", F.col("word").alias("token"), "start", "end", "text")
    begun = time.time()
    pairs = E.paired(w, t, "doc")
    assert pairs.where("word = token").count() == 39_600 and pairs.where("token IS NULL AND word % 100 = 7").count() == 400
    assert time.time() - begun < 60


def test_seams_with_one_token_on_a_side_have_no_row(spark, monkeypatch):
    one = [(0, 0, p, f"w{p}", 1000.0 * p, 1000.0 * p + 900) for p in range(5)] + [(0, 1, 0, "w4", 4050.0, 4400.0), (1, 0, 0, "a", 0.0, 500.0), (1, 0, 1, "b", 600.0, 900.0), (1, 1, 0, "a", 10.0, 510.0), (1, 1, 1, "b", 610.0, 920.0)]
    df = spark.createDataFrame(one, "conv_id long, chunk long, place long, word string, start double, end double")
    monkeypatch.setattr(R, "placed", lambda spark, sf: df)
    assert [tuple(r) for r in R.k4(spark, "").collect()] == [(1, 0, 2, "0:0,1:1")]


def test_readings_merged_at_all_tolerances_in_one_group(spark):
    said = [(c, i, f"w{(i * 7 + c) % 50}", 500.0 * (i - 105 * c) + 40 * c, 500.0 * (i - 105 * c) + 300) for c in range(3) for i in range(105 * c, 105 * c + 120)]
    rows = [(k, 52_500.0 * c, 60_000.0, w, at, until) for k in range(6_000) for c, i, w, at, until in (said if k == 0 else said[:2])]
    chunks = spark.createDataFrame(rows, "k long, begins double, lasts double, word string, at double, until double")
    begun = time.time()
    got = {(r.k, r.tolerance): r for r in S.replayed(chunks, "k", 7500.0, [3750.0, 100.0, 1.0]).collect()}
    assert time.time() - begun < 60 and len(got) == 18_000
    for t in (3750.0, 100.0, 1.0):
        starts = [x[1] for x in S.folded([[(w, 52_500.0 * c + a, 52_500.0 * c + u) for d, _, w, a, u in said if d == c] for c in range(3)], 7500.0, t)]
        back = [a - b for a, b in zip(starts, starts[1:]) if b < a]
        assert tuple(got[0, t])[2:] == (len(starts), len(back), max(back, default=0.0))


def test_pairs_of_texts_are_held_a_few_at_a_time(spark):
    rows = spark.range(1_000, numPartitions=1).select("id", F.array(F.lit("a")).alias("a"), F.when(F.col("id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("b"))

    class Plan:
        schema = rows.schema

        def mapInArrow(self, run, schema):
            return list(run(iter([rows.toArrow().combine_chunks().to_batches()[0]])))

    made = M.per_pair(Plan(), "a", "b", lambda x, y: (len(x), len(y)), "n long, m long")
    assert max(b.num_rows for b in made) <= M.PAIRS and sum(b.num_rows for b in made) == 1_000
    got = M.per_pair(rows, "a", "b", lambda x, y: (len(x), len(y)), "n long, m long").collect()
    assert sorted(map(tuple, got)) == [(i, 1, 2 if i % 2 == 0 else 0) for i in range(1_000)]


def test_parts_follow_rows_not_bytes(spark):
    rows = spark.range(40_000).select((F.col("id") % 900).alias("k"))
    assert G.spread(rows, "k", each=1_000).rdd.getNumPartitions() == 40


def test_edit_lists_are_made_once(spark):
    for query in (Q.m5, Q.m6, W.m7):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "FileScan" not in plan  # the lists and what was settled before stand on disk


def test_first_cues_are_not_one_task_s(spark):
    plan = O.s14(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k#" not in plan and "hashpartitioning(doc_id#" in plan


@pytest.mark.parametrize("name", ["k13_refusals", "s8_edit_lists"])
def test_queries_over_lists_make_them_in_one_pass(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode(parts") == 1


def test_lists_dealt_out_stay_so_in_joins(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rows = G.spread(spark.range(20_000).select((F.col("id") % 999).alias("doc")), "doc", each=1_000)
        assert rows.rdd.getNumPartitions() == 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_written_lists_name_the_sources_that_items_play_from(spark):
    entry = lambda doc, pos, kind, source: (doc, pos, kind, None, None, source, 0, 1, "x", False, 1.0)
    e = spark.createDataFrame([entry(1, 0, "item", "b"), entry(1, 1, "item", "b"), entry(2, 0, "paragraph", "a"), entry(3, 0, "item", "z"), entry(4, 0, "item", None)], E.LIST)
    sources = spark.createDataFrame([(d, s, "/" + s) for d in (1, 2, 4) for s in "ab"], "doc long, source string, path string")
    names = spark.createDataFrame([(1, "L", "N")], "doc long, label string, name string")
    good, odd = D.read_edit_lists(D.write_edit_lists(e, sources, names))
    assert {r.doc: (r.sources, r.names, len(r.content)) for r in good.collect()} == {1: ({"b": "/b"}, {"L": "N"}, 2), 2: ({}, None, 1), 3: ({}, None, 1), 4: ({}, None, 1)}
    assert odd.count() == 0


def test_gaps_meet_events_without_a_join(spark):
    plan = R.k8(spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 4  # that with the recordings' ends, once for each level of the result


def test_parts_follow_letters_and_grams_are_counted_in_them(spark):
    rows = spark.range(1_000).select("id", F.when(F.col("id") % 2 == 0, F.repeat(F.lit("ab "), 100)).alias("text"))
    assert G.spread_letters(rows, "text", "id", letters=5_000).rdd.getNumPartitions() == 30
    assert G.spread_letters(rows.where("text IS NULL"), "text", "id").count() == 500
    plan = catalog.QUERIES["a20_ngrams"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc_id" in plan
