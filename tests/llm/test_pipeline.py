import random
import re
from collections import Counter

import pyarrow.parquet as pq

import corpus_pipeline as P
from tests.llm.test_near_copies import brute as brute_copies

SF = "/root/testdata/sf0.001"


def brute_passages(texts):
    """Texts without what repeated strings cover, where enough words begin in it."""
    data, out = [t.encode() for t in texts], []
    seen = Counter(d[i : i + P.WIDTH] for d in data for i in range(len(d) - P.WIDTH + 1))
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - P.WIDTH + 1):
            if seen[d[i : i + P.WIDTH]] > 1:
                gone[i : i + P.WIDTH] = b"\1" * P.WIDTH
        for m in re.finditer(b"\1+", bytes(gone)):
            if len(d[m.start() : m.end()].split()) < P.WORDS:
                gone[m.start() : m.end()] = bytes(m.end() - m.start())
        out.append(bytes(b for b, g in zip(d, gone) if not g).decode("utf-8", "ignore"))
    return out


def test_repeated_passages_of_over_50_words_go(spark):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))
    passages, line = [text(n) for n in range(51, 61)], text(20)
    texts = [f"{text(80)} {p} {text(rng.randint(5, 90))} {line}" for p in passages for _ in range(3)] + [text(200) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in P.drop_repeated_strings(spark, docs, "").orderBy("doc_id").collect()]
    assert not any(p in t for p in passages for t in got) and all(line in t for t in got[:30]) and got[30:] == texts[30:]
    assert all(a.startswith(" ".join(b.split()[:79])) for a, b in zip(got, texts))


def test_every_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.toPandas()
    columns = docs.columns
    kept = P.drop_toxic(spark, docs, SF)
    assert kept.columns == columns and 0 < kept.count() <= len(before)

    one = P.drop_near_copies(spark, docs, SF)
    assert one.columns == columns
    assert sorted(r.doc_id for r in one.collect()) == [before["doc_id"].iloc[i] for i in brute_copies(before["text"].tolist())]

    cut = P.drop_repeated_strings(spark, docs, SF)
    assert cut.columns == columns
    assert {r.doc_id: r.text for r in cut.collect()} == dict(zip(before["doc_id"], brute_passages(before["text"].tolist())))

    clean = P.drop_contaminated(spark, docs, SF)
    assert clean.columns == columns and clean.count() <= len(before)
    assert all(r.decodes for r in P.encode(spark, docs, SF).collect())


def test_run_and_odd_rows(spark, tmp_path):
    out = P.run(spark, SF)
    assert out.columns[:5] == pq.read_schema(f"{SF}/documents.parquet").names and out.count() > 0
    rows = [(None, None), (1, ""), (1, ""), (2, "a b c"), (None, "x y z w v " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "'q' as n_words", "2 as fp")
    for _, stage in P.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and got.count() > 0
        assert stage(spark, docs.limit(0), SF).count() == 0
