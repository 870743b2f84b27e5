"""Packed hashes between shards of documents and ranges of hashes.

A shard sends, to each bucket of the hash range, its distinct hashes there, as one row. A bucket
finds which of them stand in more than one place of all shards, and answers each row with one bit
for each hash. So a row is moved for each shard and bucket, not for each hash, and a hash that a
third of all documents hold is sent once by each shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .hashing import U

SENT = "bucket int, shard int, keys binary, checks binary, twice binary"
ANSWER = "shard int, bucket int, repeated binary"
KEYS = "shard int, bucket int, repeated binary, many binary"


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """The upper 32 bits deal the keys out; sorted keys give ascending buckets."""
    return ((keys >> U(32)) * U(n_buckets) >> U(32)).astype(np.int64)


def send(shard: int, keys: np.ndarray, checks: np.ndarray | None, twice: np.ndarray, n_buckets: int) -> pa.Table:
    """Rows of SENT for a shard's distinct, sorted keys (and the second half of 128 bits, if any)."""
    bounds = np.searchsorted(bucket_of(keys, n_buckets), np.arange(n_buckets + 1))
    rows = [b for b in range(n_buckets) if bounds[b] < bounds[b + 1]]
    cut = lambda x: [x[bounds[b] : bounds[b + 1]].tobytes() for b in rows]
    return pa.table(
        {
            "bucket": pa.array(rows, pa.int32()),
            "shard": pa.array([shard] * len(rows), pa.int32()),
            "keys": pa.array(cut(keys), pa.binary()),
            "checks": pa.array(cut(checks) if checks is not None else [b""] * len(rows), pa.binary()),
            "twice": pa.array(cut(twice.astype(np.uint8)), pa.binary()),
        }
    )


def answer(sent: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, U) for x in sent.column("keys").to_pylist()]
    keys = np.concatenate(parts)
    checks = np.concatenate([np.frombuffer(x, U) for x in sent.column("checks").to_pylist()])
    weight = np.concatenate([np.frombuffer(x, np.uint8) for x in sent.column("twice").to_pylist()]).astype(np.int64) + 1
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if len(checks):
        if np.any(same & (checks[order][1:] != checks[order][:-1])):
            order = np.lexsort((checks, keys))
        k, c = keys[order], checks[order]
        same = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
    first = np.flatnonzero(np.append(True, ~same))
    total = np.add.reduceat(weight[order], first)
    repeated = np.empty(len(keys), bool)
    repeated[order] = np.repeat(total >= 2, np.diff(np.append(first, len(keys))))
    ends = np.cumsum([len(p) for p in parts])
    return pa.table(
        {
            "shard": sent.column("shard"),
            "bucket": sent.column("bucket"),
            "repeated": pa.array([np.packbits(repeated[e - len(p) : e]).tobytes() for p, e in zip(parts, ends)], pa.binary()),
        }
    )


def answered(sent: DataFrame) -> DataFrame:
    """One row of ANSWER for each row of SENT."""
    return sent.groupBy("bucket").applyInArrow(answer, ANSWER)


def repeated_keys(sent: DataFrame, crowded: int) -> DataFrame:
    """For each row of SENT its repeated keys, and whether each one's checks (numbers here) add up to over `crowded`."""

    def keys_of(sent: pa.Table) -> pa.Table:
        read = lambda c, kind: [np.frombuffer(x, kind) for x in sent.column(c).to_pylist()]
        parts = read("keys", U)
        all_, place = np.unique(np.concatenate(parts), return_inverse=True)
        add = lambda x: np.bincount(place, np.concatenate(x).astype(float), len(all_))[place]
        repeated, many = add([x + 1.0 for x in read("twice", np.uint8)]) >= 2, add(read("checks", U)) > crowded
        ends = np.cumsum([len(x) for x in parts])
        own = [slice(e - len(x), e) for x, e in zip(parts, ends)]
        return pa.table(
            {
                "shard": sent.column("shard"),
                "bucket": sent.column("bucket"),
                "repeated": pa.array([x[repeated[o]].tobytes() for x, o in zip(parts, own)], pa.binary()),
                "many": pa.array([many[o][repeated[o]].tobytes() for o in own], pa.binary()),
            }
        )

    return sent.groupBy("bucket").applyInArrow(keys_of, KEYS)


def read_answer(answer: pa.Table, keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """For each of the shard's sorted keys whether it is repeated anywhere."""
    bounds = np.searchsorted(bucket_of(keys, n_buckets), np.arange(n_buckets + 1))
    out = np.zeros(len(keys), bool)
    for b, bits in zip(answer.column("bucket").to_pylist(), answer.column("repeated").to_pylist()):
        i, j = bounds[b], bounds[b + 1]
        out[i:j] = np.unpackbits(np.frombuffer(bits, np.uint8), count=j - i).astype(bool)
    return out
