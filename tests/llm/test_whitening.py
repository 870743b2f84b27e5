import math
import random

import numpy as np
import pytest

from loomline.llm import exact_spectrum, whitening


def plain(vectors, scale=256, k=4):
    """x, n, deviations, explained and absolute whitened values by numpy, for vectors that all take part."""
    x = [[math.floor(scale * float(c)) for c in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, x))), float)
    n, s = len(fit), fit.sum(0)
    values, vecs = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, vecs = values[::-1][:k], vecs[:, ::-1][:, :k]
    dev = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(v, s)) for v in x]
    return n, dev, values / np.trace(np.cov(fit.T, bias=True)), np.abs((np.array(x, float) - s / n) @ vecs / np.sqrt(values))


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    return out


def test_rows_equal_numpy(spark):
    r = np.random.default_rng(1)
    vectors = (r.normal(size=(300, 9)) * np.array([9, 5, 3, 2, 1, 1, 0.5, 0.1, 0.01]) + 3).astype(np.float32).tolist()
    vectors += vectors[:7] + [vectors[0]] * 100
    df = spark.createDataFrame([(i, v, "c") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, Component string")
    got = collected(whitening.whitened(df))
    n, dev, explained, w = plain(vectors)
    assert n == 300 and len(got) == len(vectors)
    for i in got:
        assert sorted(got[i]) == [1, 2, 3, 4]
        for c, row in got[i].items():
            assert (row["n"], row["deviation"]) == (n, dev[i])
            assert row["explained"] == pytest.approx(explained[c - 1], rel=1e-9)
            assert abs(row["whitened"]) == pytest.approx(w[i][c - 1], abs=1e-8)
            assert row["identity_error"] < 1e-9


def test_whole_table_is_white(spark):
    rows = whitening.query(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 4 * spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").count()
    assert rows[0]["identity_error"] < 1e-9
    by = {c: [r["whitened"] for r in rows if r["component"] == c] for c in (1, 2, 3, 4)}
    explained = [next(r["explained"] for r in rows if r["component"] == c) for c in by]
    assert explained == sorted(explained, reverse=True)
    assert np.cov(np.array(list(by.values())), bias=True) == pytest.approx(np.eye(4), abs=1e-9)


def test_odd_vectors_take_no_part(spark):
    good = [[1.0, 2.0], [2.0, 1.0], [0.0, 0.5], [1.0, 2.0]]
    odd = [None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0], [1.0, 2.0, 3.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(good + odd)], "vec_id long, embedding array<double>")
    got = collected(whitening.whitened(df))
    assert sorted(got) == [0, 1, 2, 3] and sorted(got[0]) == [1, 2] and got[0][1]["n"] == 3
    assert got[0][1]["whitened"] == got[3][1]["whitened"]
    assert whitening.whitened(df.where("false")).collect() == []
    assert whitening.whitened(df.where("vec_id in (0, 3)")).collect() == []  # one distinct vector: no covariance


def test_values_beyond_doubles_and_longs(spark):
    rows = [(0, [1e300, 1.0]), (1, [-1e300, 3.0]), (2, [2.0**40, 2.0]), (3, [2.0**40 + 1, 5.0])]
    got = collected(whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    x = [[2**63 - 1, 256], [-(2**63), 768], [2**48, 512], [2**48 + 256, 1280]]
    s = [sum(c) for c in zip(*x)]
    for i, v in enumerate(x):
        dev = sum((4 * a - b) ** 2 for a, b in zip(v, s))
        assert got[i][1]["deviation"] == (dev if dev < 2**63 else None)
    far = [(i, [1e6 + i % 7, 1e6 + i % 3, -1e6 + i % 5]) for i in range(50)]
    got = collected(whitening.whitened(spark.createDataFrame(far, "vec_id long, embedding array<double>")))
    assert got[0][1]["identity_error"] < 1e-9 and len(got[0]) == 3


def test_flat_directions_have_no_component(spark):
    rows = [(i, [float(i % 5), 2.0 * (i % 5), float(i % 3), 7.0, 0.0]) for i in range(40)]
    got = collected(whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert all(sorted(c) == [1, 2] for c in got.values())


def test_equal_eigenvalues_get_orthonormal_vectors(spark):
    rows = [(2 * i + j, [float(s if c == i else 0) for c in range(5)]) for i in range(5) for j, s in enumerate((1, -1))]
    got = collected(whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert all(sorted(c) == [1, 2, 3, 4] for c in got.values()) and got[0][1]["identity_error"] < 1e-12
    assert {round(r["explained"], 12) for r in got[0].values()} == {0.2}


def test_polynomial_and_roots_are_exact():
    r = random.Random(4)
    for d in (1, 2, 3, 6):
        half = np.array([[r.randrange(-50, 50) for _ in range(d)] for _ in range(d)], object)
        m = half @ half.T
        trace = int(sum(m[i, i] for i in range(d)))
        used = exact_spectrum.primes(exact_spectrum.n_primes(d, trace))
        c = exact_spectrum.combined({p: exact_spectrum.polynomial_mod((m % p).astype(np.int64), p) for p in used})
        assert c[-1] == 1 and c[-2] == -trace
        power = [np.array([[int(i == j) for j in range(d)] for i in range(d)], object)]
        for _ in range(d):
            power.append(power[-1] @ m)
        assert not sum((p * k for p, k in zip(power, c)), 0 * power[0]).any()  # a matrix is a root of its own polynomial
        roots = exact_spectrum.top_roots(c, d, trace)
        values = [x.value / 2**x.bits for x in roots for _ in range(x.times)]
        assert values == pytest.approx(sorted(np.linalg.eigvalsh(m.astype(float)), reverse=True)[: len(values)], rel=1e-9)


def test_roots_that_nearly_agree_are_told_apart():
    big = 10**40
    m = np.array([[big + 1, 0, 0], [0, big, 0], [0, 0, 5]], object)
    trace = 2 * big + 6
    used = exact_spectrum.primes(exact_spectrum.n_primes(3, trace))
    c = exact_spectrum.combined({p: exact_spectrum.polynomial_mod((m % p).astype(np.int64), p) for p in used})
    roots = exact_spectrum.top_roots(c, 3, trace)
    assert [(x.value, x.times) for x in roots] == [((big + 1) << roots[0].bits, 1), (big << roots[0].bits, 1), (5 << roots[0].bits, 1)]
    for i in (0, 1):
        assert exact_spectrum.vectors(m, roots[i], 4)[0] == pytest.approx([float(j == i) for j in range(3)], abs=1e-60)
