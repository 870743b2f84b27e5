"""Whitening of vectors along their first principal components, from exact integer statistics.

Entries become x = floor(scale * entry). The scatter matrix n * sum(x x') - S S' over the distinct x is an exact
integer matrix (limbs of 20 bits multiplied in doubles that hold them exactly). Its characteristic polynomial is
found modulo primes that are dealt out as rows, put together, and its largest roots and their vectors follow in
integer arithmetic (exact_spectrum.py). What comes to the driver is the scatter matrix and (primes x coefficients)
residues, sized by the dimension alone.

A component is returned only if its eigenvalue is positive: so with one distinct vector there are no rows. Vectors of an
eigenvalue that occurs more than once are any orthonormal ones.

Cases: rows whose vector is null, empty or holds nulls, NaN or infinities are dropped, and so are those whose length isn't the
one of most of the rest (the greater of equals); entries beyond the range of long after scaling are cut to it; a deviation that a
long can't hold is null; equal rows give rows each; an empty table gives an empty table; columns of the input
named like results (in any case) are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import exact_spectrum
from .common import checkpointed, without

#: Bits of the parts that entries are cut into, rows multiplied at once, and bits and number of the parts of sums.
LIMB, BLOCK, SUM_LIMB, SUM_LIMBS = 20, 8192, 40, 5
RESULTS = {"component": T.IntegerType(), "n": T.LongType(), "deviation": T.LongType(), "whitened": T.DoubleType(), "explained": T.DoubleType(), "identity_error": T.DoubleType()}


class Model(NamedTuple):
    """n distinct vectors with the sums of their entries; of the scatter matrix n^2 times the covariance: eigenvalues, unit vectors, shares of the trace."""

    n: int
    sums: list[int]
    values: list[Fraction]
    vectors: list[list[float]]
    explained: list[float]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, as long integers where all fit, else as Python's."""
        if (int(np.abs(x.astype(object)).max(initial=0)) if len(x) else 0) * self.n + max(map(abs, self.sums)) < 1 << 62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, dev: np.ndarray) -> np.ndarray:
        return np.asarray(dev, float) @ np.array(self.vectors).T / np.array([math.sqrt(v) for v in self.values])


def _entries(column: pa.Array, d: int) -> np.ndarray:
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), d)


def with_longs(df: DataFrame, vec_col: str, scale: int) -> DataFrame:
    """Rows of df whose vector takes part, with __x, its entries as longs."""
    entry = F.transform(F.col(f"`{vec_col}`"), lambda c: c.cast("double"))
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    whole = df.withColumn("__x", F.transform(entry, lambda c: F.floor(c * F.lit(float(scale)))))
    kept = whole.where(F.col(f"`{vec_col}`").isNotNull() & (F.size(f"`{vec_col}`") > 0) & ~F.exists(entry, odd))
    sizes = kept.groupBy(F.size("__x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return kept.where(F.size("__x") == (sizes["d"] if sizes else -1))


def moments(x: np.ndarray) -> np.ndarray:
    """The exact matrix of sums of products of (1, x), as Python integers."""
    whole = np.concatenate([np.ones((len(x), 1), np.int64), x], 1)
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    n_limbs = top.bit_length() // LIMB + 1
    cut = [((whole >> LIMB * i) & (1 << LIMB) - 1 if i < n_limbs - 1 else whole >> LIMB * i).astype(float) for i in range(n_limbs)]
    out = np.zeros((whole.shape[1],) * 2, object)
    for at in range(0, len(x), BLOCK):
        for i, a in enumerate(cut):
            for j, b in enumerate(cut):
                out += (a[at : at + BLOCK].T @ b[at : at + BLOCK]).astype(np.int64).astype(object) << LIMB * (i + j)
    return out


def scatter(fit: DataFrame, d: int) -> np.ndarray:
    """The moments of all rows of fit (__x), summed in limbs."""
    kind = "i int, j int, " + ", ".join(f"l{k} long" for k in range(SUM_LIMBS))
    i, j = np.triu_indices(d + 1)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for b in batches:
            if len(b):
                more = moments(_entries(b.column(0), d))
                found = more if found is None else found + more
        if found is not None:
            own, limbs = found[i, j], []
            for k in range(SUM_LIMBS):
                limbs.append(own if k == SUM_LIMBS - 1 else own & (1 << SUM_LIMB) - 1)
                own = own >> SUM_LIMB
            yield pa.record_batch({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32())} | {f"l{k}": pa.array([int(v) for v in x], pa.int64()) for k, x in enumerate(limbs)})

    sums = fit.select("__x").mapInArrow(part, kind).groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(SUM_LIMBS)])
    out = np.zeros((d + 1, d + 1), object)
    for r in sums.collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = sum(r[f"l{k}"] << SUM_LIMB * k for k in range(SUM_LIMBS))
    return out


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Coefficients of det(x - matrix), constant first; a row of primes is reduced by the tasks, each modulo its own."""
    trace = int(np.trace(matrix))
    used = exact_spectrum.primes(exact_spectrum.n_primes(len(matrix), trace))

    def reduce_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [used[k] for k in b.column(0).to_pylist()]
            found = [exact_spectrum.polynomial_mod((matrix % p).astype(np.int64), p) for p in own]
            yield pa.record_batch({"p": pa.array(own, pa.int64()), "c": pa.array(found, pa.list_(pa.int64()))})

    parts = max(1, min(len(used), 2 * spark.sparkContext.defaultParallelism))
    rows = spark.range(0, len(used), 1, parts).mapInArrow(reduce_each, "p long, c array<long>").collect()
    return exact_spectrum.combined({r["p"]: r["c"] for r in rows})


def fitted(spark: SparkSession, fit: DataFrame, components: int) -> Model | None:
    first = fit.select("__x").first()
    if first is None:
        return None
    d = len(first[0])
    sums = scatter(fit, d)
    n, s = int(sums[0, 0]), [int(v) for v in sums[0, 1:]]
    matrix = sums[1:, 1:] * n - np.outer(np.array(s, object), np.array(s, object))
    trace = int(np.trace(matrix))
    if trace == 0:
        return Model(n, s, [], [], [])
    unit = reduce(math.gcd, (int(v) for v in matrix.ravel()))
    small = matrix // unit
    roots = exact_spectrum.top_roots(characteristic_polynomial(spark, small), components, trace // unit)
    values, vectors = [], []
    for root in roots:
        found = exact_spectrum.vectors(small, root, components - len(values))
        vectors += found
        values += [Fraction(root.value * unit, 1 << root.bits)] * len(found)
    return Model(n, s, values, vectors, [float(v / trace) for v in values])


def identity_error(fit: DataFrame, model: Model) -> float:
    """The largest absolute entry of (covariance of the whitened fit list minus the identity)."""
    k, d = len(model.values), len(model.sums)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((k + 1, k + 1))
        for b in batches:
            w = model.whitened(model.deviations(_entries(b.column(0), d)))
            w = np.concatenate([np.ones((len(w), 1)), w], 1)
            found += w.T @ w
        i, j = np.indices(found.shape)
        yield pa.record_batch({"i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel(), pa.int32()), "v": pa.array(found.ravel())})

    out = np.zeros((k + 1, k + 1))
    for r in fit.select("__x").mapInArrow(part, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    mean = out[0, 1:] / model.n
    return float(np.abs(out[1:, 1:] / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def whitened(df: DataFrame, vec_col: str = "embedding", scale: int = 256, components: int = 4) -> DataFrame:
    """For each row of df that takes part, and each component up to `components`, the columns of df and RESULTS."""
    spark, base = df.sparkSession, without(df, list(RESULTS))
    taken = with_longs(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*base.columns, vec_col])]), vec_col, scale)
    fit = checkpointed(taken.select("__x").distinct())
    model = fitted(spark, fit, components)
    schema = T.StructType([*base.schema, *[T.StructField(c, t) for c, t in RESULTS.items()]])
    if model is None or not model.values:
        return spark.createDataFrame([], schema)
    error, d, k = identity_error(fit, model), len(model.sums), len(model.values)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dev = model.deviations(_entries(b.column(b.num_columns - 1), d))
            square = dev.astype(object) if dev.dtype == object or np.abs(dev).max(initial=0) >= math.isqrt((1 << 62) // d) else dev
            square = (square * square).sum(1)
            square = pa.array([v if v < 1 << 63 else None for v in square.tolist()], pa.int64())
            w = model.whitened(dev)
            row, comp = np.repeat(np.arange(len(b)), k), np.tile(np.arange(k), len(b))
            old = [b.column(i).take(pa.array(row)) for i in range(b.num_columns - 1)]
            new = [pa.array(comp + 1, pa.int32()), pa.array(np.full(len(row), model.n)), square.take(pa.array(row)), pa.array(w.ravel()), pa.array(np.array(model.explained)[comp]), pa.array(np.full(len(row), error))]
            yield pa.RecordBatch.from_arrays([*old, *new], names=[*b.schema.names[:-1], *RESULTS])

    return taken.select(*[F.col(f"`{c}`") for c in base.columns], "__x").mapInArrow(each, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return whitened(rows).drop("embedding")
