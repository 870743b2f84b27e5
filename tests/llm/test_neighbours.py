import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomline.llm.neighbours import build_graph, nearest, query


def brute(ids, x, queries, top=10):
    out = {}
    for i in queries:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if j != i][:top]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_recall_and_scores(spark):
    table = pq.read_table("/root/testdata/sf0.01/embeddings.parquet")
    ids = table["vec_id"].to_numpy()
    x = np.array(table["embedding"].to_pylist(), np.float32).astype(float)
    true = brute(ids, x, np.flatnonzero(ids % 100 == 0))
    got = {}
    for r in query(spark, "/root/testdata/sf0.01").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == true.keys() and all(len(v) == 10 for v in got.values())
    place = {int(i): k for k, i in enumerate(ids)}
    for q, found in got.items():
        assert all(abs(s - np.sqrt(((x[place[q]] - x[place[v]]) ** 2).sum())) < 1e-12 for v, s in found)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in true[q]}) for q in true)
    assert hits >= 0.9 * 10 * len(true)


def test_odd_vectors_and_copies(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(60)] + [(200, [1.0, 1.0]), (None, [1.0, 1.0]), (300, None), (400, [0.0, 0.0])]
    rows += [(500, [float("nan"), 1.0]), (600, [1.0]), (700, [None, 1.0]), (800, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest(df, F.col("id") % 100 == 0, top=12).orderBy("query_id", "rank").collect()
    good = [(i, v) for i, v in rows if i is not None and i <= 200]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    true = brute(ids, x, np.flatnonzero(ids % 100 == 0), 12)
    assert {r.query_id for r in got} == {0, 200}
    for q in true:
        assert [(r.vec_id, r.score) for r in got if r.query_id == q] == true[q]


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    df = spark.createDataFrame([(100 * i, [1.0, float(i)]) for i in range(n)], "vec_id long, embedding array<float>")
    assert nearest(df, F.col("id") % 100 == 0).count() == n * (n - 1)


def test_the_graph_holds_the_nearest(spark):
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, x = table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist(), np.float32).astype(float)
    true = brute(ids, x, range(len(ids)), 32)
    vectors = spark.createDataFrame([(int(i), v) for i, v in zip(ids, x.tolist())], "node long, vec array<double>")
    got = build_graph(vectors).select("node", "near").collect()
    hits = sum(len({v for v, _ in true[r.node]} & set(r.near)) for r in got)
    assert len(got) == len(ids) and hits >= 0.9 * 32 * len(ids)


def made(n, where, clusters, seed=3):
    """n vectors of 24 numbers: around one place, or in tight clusters far from each other."""
    r = np.random.default_rng(seed)
    if not clusters:
        return r.normal(size=(n, 24)) + where
    return r.normal(size=(clusters, 24))[r.integers(0, clusters, n)] * 1e4 + r.normal(size=(n, 24)) + where


@pytest.mark.parametrize("n, where, clusters, kind", [(12_000, 1000, 0, "float"), (3_000, 0, 0, "float"), (3_000, 1e9, 0, "double"), (6_000, 0, 20, "double")])
def test_recall_wherever_the_vectors_lie(spark, n, where, clusters, kind):
    x = made(n, where, clusters)
    x = x.astype(np.float32).astype(float) if kind == "float" else x
    ids = np.arange(len(x))
    true = brute(ids, x, ids[ids % 100 == 0])
    df = spark.createDataFrame(list(zip(ids.tolist(), x.tolist())), f"vec_id long, embedding array<{kind}>").repartition(8)
    got = {}
    for r in nearest(df, F.col("id") % 100 == 0).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert all(len(v) == 10 for v in got.values()) and got.keys() == true.keys()
    hits = sum(len(got[q].keys() & {v for v, _ in true[q]}) for q in true)
    assert hits >= 0.9 * 10 * len(true)
    assert all(s == pytest.approx(np.sqrt(((x[q] - x[v]) ** 2).sum()), rel=1e-12) for q in true for v, s in got[q].items())


def test_huge_and_tiny_numbers_keep_their_order(spark):
    x = np.concatenate([made(300, 0, 0), made(300, 5, 0)])
    for size in (1e250, 1e-250):
        df = spark.createDataFrame([(i, (v * size).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        true = brute(np.arange(600), x, range(0, 600, 100))
        got = {}
        for r in nearest(df, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score / size))
        hits = sum(len({v for v, _ in got[q]} & {v for v, _ in true[q]}) for q in true)
        assert hits >= 0.9 * 60 and all(s == pytest.approx(np.sqrt(((x[q] - x[v]) ** 2).sum()), rel=1e-9) for q in got for v, s in got[q])


def test_the_first_round_holds_few_pairs(spark, monkeypatch, tmp_path):
    """What is further than k found ones, and the second sight of a pair, isn't held: fewer entries are sorted than pairs are measured."""
    from loomline.llm import neighbours

    log, best = tmp_path / "sizes", neighbours._best

    def counted(v, *rest):
        with log.open("a") as f:
            f.write(f"{len(v)}\n")
        return best(v, *rest)

    monkeypatch.setattr(neighbours, "_best", counted)
    monkeypatch.setattr(neighbours, "HELD", 50_000)
    x = made(1000, 0, 0)
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "node long, vec array<double>")
    neighbours.descended(neighbours.random_graph(vectors, 1000, 1, 32), 1, 32, 0).count()
    sizes = list(map(int, log.read_text().split()))
    assert len(sizes) > 2 and sum(sizes) < 1_500_000
