import random
import re
from itertools import combinations

import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline as P
from loomline.llm import near_copies as N, simhash


def shingles(text, k=5):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(texts):
    """The first of each group by the similarity of all pairs."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))
    for i, j in combinations(range(len(sets)), 2):
        if root[i] != root[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    return sorted(set(root))


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in P.drop_near_copies(spark, docs, "").collect())


def test_whole_table(spark):
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    assert kept(spark, texts) == brute(texts)


def test_similarity_around_the_limit_and_a_large_group(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**9)}"
    texts = [None, "", " ", "a b", "A  B", "a c"]
    for edits in [1, 2, 3, 4, 5, 6, 8, 10] * 6:
        base = [word() for _ in range(204)]
        copy = [word() if i % (204 // edits) == 9 else w for i, w in enumerate(base)]
        texts += [" ".join(base), " ".join(copy)]
    base = [word() for _ in range(150)]
    for _ in range(300):  # near each other or linked by others only
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(150)] = word()
        texts.append(" ".join(copy))
    assert kept(spark, texts) == brute(texts)


def test_simhash_links_copies_on_its_own(spark, monkeypatch):
    rng = random.Random(5)
    texts = []
    for _ in range(20):  # a word of 600 changed: few bits differ
        base = [f"w{rng.randrange(10**9)}" for _ in range(600)]
        texts += [" ".join(base), " ".join(["other", *base[1:]])]
    texts += [f"{t} end" for t in ("a b c d e", "f g h i j")]
    near = [i for i in range(0, 40, 2) if ((simhash.simhash(texts[i], 5) ^ simhash.simhash(texts[i + 1], 5)) & (1 << 64) - 1).bit_count() <= N.BITS]
    assert len(near) > 10
    monkeypatch.setattr(N, "_best_partners", lambda open_, rank: open_.select(F.col("node").alias("x"), F.col("node").alias("y")).where("false"))
    monkeypatch.setattr(N, "_all_partners", lambda open_: open_.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false"))
    got = kept(spark, texts)
    assert not {i + 1 for i in near} & set(got) and {*range(0, 40, 2), 40, 41} <= set(got)
