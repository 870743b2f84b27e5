import re
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from loomline.llm import simhash as S


def brute_fp(text, k=4):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, bits=4):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= bits:
            parent[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        r = find(i)
        least[r] = min(least.get(r, ids[i]), ids[i])
    return [least[find(i)] for i in range(len(ids))]


def check(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = S.near_duplicates(docs).orderBy("doc_id").collect()
    fps = [brute_fp(t) for t in texts]
    assert [r.fingerprint for r in got] == [f"{f:016x}" for f in fps]
    assert [r.component_id for r in got] == brute_components(list(range(len(texts))), fps)


def test_small_cases(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from it all day long in the sun".split()
    near = [" ".join(base[:i] + ["X"] + base[i + 1 :]) for i in range(3)]
    check(spark, [None, "", " ", "a", "A", "a b", " ".join(base), " ".join(base).upper(), *near, "É é", "a " * 1000, "a " * 1001])


def test_whole_table(spark):
    check(spark, pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist())


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n,spread", [(40, 3), (500, 5), (700, 9)])
def test_dense_lists_give_the_components_of_all_pairs(n, spread, monkeypatch):
    monkeypatch.setattr(S, "LIST", 60)
    monkeypatch.setattr(S, "MIDPOINTS", 20_000)
    rng = np.random.default_rng(n)
    base = [int(x) for x in rng.integers(0, 2**63, 4)]
    flips = [sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(0, spread))}) for _ in range(n)]
    fps = np.unique(np.array([base[rng.integers(4)] ^ f for f in flips], np.uint64))
    a, b = [], []
    for positions in combinations(range(8), 4):
        x, y = S.term_links(fps, positions, 4)
        a.append(np.searchsorted(fps, x))
        b.append(np.searchsorted(fps, y))
    label = S.labels_of(len(fps), np.concatenate(a), np.concatenate(b))
    assert label.tolist() == brute_components(list(range(len(fps))), [int(f) for f in fps])
