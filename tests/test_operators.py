import random

from pyspark.sql import functions as F

from loomline.functions import text as X
from loomline.operators import intervals as I, kernels as K
from loomline.sources.captions import read_srt


def test_boundaries_ties_and_gaps_of_turns(spark):
    turns = spark.createDataFrame([(1, 0, 10, 0), (1, 10, 20, 1), (1, 40, 50, 2)], "k long, start long, end long, speaker long")
    points = spark.createDataFrame([(1, t) for t in (0, 10, 20, 21, 30, 31, 60)] + [(2, 5)], "k long, t long")
    at = {(r.k, r.t): r.speaker_at for r in I.turn_at(points, turns, "k", "t").collect()}
    assert at == {(1, 0): 0, (1, 10): 1, (1, 20): 1, (1, 21): None, (1, 30): None, (1, 31): None, (1, 60): None, (2, 5): None}
    near = {(r.k, r.t): r.nearest_speaker for r in I.nearest_turn(points, turns, "k", "t").collect()}
    assert near[1, 30] == 1 and near[1, 31] == 2 and near[1, 60] == 2 and near[2, 5] is None


def test_union_strict_and_closed(spark):
    spans = spark.createDataFrame([(1, 0, 10), (1, 10, 12), (1, 3, 5), (1, 20, 21)], "k long, start long, end long")
    closed = sorted((r.start, r.end) for r in I.merged_spans(spans, "k").collect())
    strict = sorted((r.start, r.end) for r in I.merged_spans(spans, "k", touching=False).collect())
    assert closed == [(0, 12), (20, 21)] and strict == [(0, 10), (10, 12), (20, 21)]


def test_scripts_and_folding(spark):
    row = spark.createDataFrame([("سلام hello", "كتاب")], "a string, b string").select(
        X.script_share(F.col("a"), "؀-ۿ").alias("s"), X.folded(F.col("b")).alias("f"), X.language_tag(F.lit(0.1), F.lit("whisper")).alias("l")
    ).first()
    assert abs(row.s - 4 / 9) < 1e-9 and row.f == "کتاب" and row.l == "mixed"


def test_captions(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,500\nSpeaker 1: a <i>b</i>\nc &amp; d\n\nNOTE x\n\n2\n01:00:00.000 --> 01:00:01.000\ne"
    got = read_srt(spark.createDataFrame([(1, srt)], "id long, s string"), "id", "s").orderBy("start_ms").collect()
    assert [(r.start_ms, r.end_ms, r.speaker, r.line) for r in got] == [(1000, 2500, "Speaker 1", "a b c & d"), (3600000, 3601000, None, "e")]


def test_kernels(spark):
    frames = spark.createDataFrame([(1, i, s) for i, s in enumerate([5, 9, 9, 0, 7, 1])], "k long, f long, s long")
    assert [r.f for r in K.select_marks(frames, "k", "f", "s", 3, 2).orderBy("f").collect()] == [1, 4]
    texts = spark.createDataFrame([(1, "The big red dog and red cat"), (2, None)], "doc_id long, t string")
    phrases = spark.createDataFrame([("red", 1), ("big red dog", 2)], "phrase string, entry long")
    assert [(r.first, r.size, r.entry) for r in K.find_phrases(texts, phrases, "t", 3).orderBy("first").collect()] == [(1, 3, 2), (5, 1, 1)]
    assert K.with_fnv(texts, "t").where("doc_id = 2").first().words_hash == "811c9dc5"


def test_phrases_against_a_scan(spark):
    rng = random.Random(10)
    texts = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(12)))) for i in range(50)]
    entries = {" ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 4))): k for k in range(20)}
    want = set()
    for i, t in texts:
        w, k = t.split(), 0
        while k < len(w):
            n = next((n for n in (3, 2, 1) if k + n <= len(w) and " ".join(w[k : k + n]) in entries), 0)
            if n:
                want.add((i, k, n, entries[" ".join(w[k : k + n])]))
            k += n or 1
    got = K.find_phrases(spark.createDataFrame(texts, "doc_id long, t string"), spark.createDataFrame(list(entries.items()), "phrase string, entry long"), "t", 3)
    assert {tuple(r) for r in got.collect()} == want
