"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

A fingerprint has eight bytes. Two that differ in at most d bits differ in at most d bytes, so their
tally of shared positional bytes is at least m = 8 - d. A single byte is shared by a 256th of all
fingerprints, so an index of single bytes would have lists that grow with the input and pairs that
grow with its square. The terms of this index are therefore sets of m positional bytes: a pair's
tally reaches the guaranteed minimum if and only if it shares a term, so the filter is the lookup
itself. What shares a term is tallied again byte for byte and verified by its differing bits.

Equal fingerprints are one node from the start. Within a term, links are reduced to a spanning
forest before they leave the task, so dense groups give no more links than members: a list of up
to LIST members is compared block by block, a longer one by midpoints (two fingerprints differ in
at most four bits if and only if some value differs from each in at most two), in slices.

Cases: null and empty texts have fingerprint zero and link with each other and with what is near
to zero; texts of fewer words than a shingle are one shingle; equal rows share a component; null
ids never name a component unless all its ids are null; a text of any length is taken whole; other columns than the id and the text don't come out, so none can
clash; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import checkpointed, without
from .components import components
from .hashing import U, mixed

SEED = 42
#: Members of a term's list that are compared directly.
LIST = 16384
#: Midpoints that are held at a time.
MIDPOINTS = 4 << 20
#: Fingerprints of one slice of one term set.
SLICE = 1 << 20


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of each run of `size` words (A-Z lower-cased, joined by one space)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, U)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(size, len(words))
    starts = np.append(0, ends)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[i : j - 1], SEED) for i, j in zip(starts, ends[k - 1 :].tolist())], U)


def simhash(text: str | None, size: int) -> int:
    """64 bits, signed: each is set if it is set in over half of the shingles' hashes."""
    h = shingle_hashes(text or "", size)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 18):
        bits = np.unpackbits(h[i : i + (1 << 18)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, shingle: int = 4, text_col: str = "text", out_col: str = "fp") -> DataFrame:
    """docs with out_col, the fingerprint of its text as a signed long."""

    @F.pandas_udf(T.LongType())
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash(t, shingle) for t in texts], dtype="int64")

    return without(docs, [out_col]).withColumn(out_col, hashed(F.col(f"`{text_col}`")))


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component, for n members and links a-b."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while np.any(root != (root := root[root])):
            pass
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _within(x: np.ndarray, y: np.ndarray, max_bits: int) -> np.ndarray:
    """The tally of shared positional bytes, then the differing bits."""
    differ = x ^ y
    tally = (np.ascontiguousarray(differ).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    ok = tally >= 8 - max_bits
    ok[ok] = np.bitwise_count(differ[ok]) <= max_bits
    return ok


def _spread(group: np.ndarray, max_bits: int) -> np.ndarray:
    """Labels of a list of up to LIST: each member reached takes in all unreached ones near it."""
    label = np.full(len(group), -1)
    left = np.arange(len(group))
    for i in range(len(group)):
        if label[i] >= 0:
            continue
        label[i], queue = i, [i]
        left = left[left != i]
        while queue and len(left):
            j = queue.pop()
            near = np.bitwise_count(group[left] ^ group[j]) <= max_bits
            label[left[near]] = i
            queue += left[near].tolist()
            left = left[~near]
    return label


def _flips(free: int, max_flips: int) -> np.ndarray:
    """Every value with at most max_flips of the free bits set."""
    bits = [1 << i for i in range(64) if free >> i & 1]
    return np.array([sum(c) for k in range(max_flips + 1) for c in combinations(bits, k)], U)


def _by_midpoints(group: np.ndarray, free: int, max_bits: int) -> np.ndarray:
    """Labels of a long list whose members agree outside the free bits; max_bits is even."""
    flips = _flips(free, max_bits // 2)
    slices = max(1, len(group) * len(flips) // MIDPOINTS)
    a, b = [], []
    for s in range(slices):
        mids, whose = [], []
        for f in flips:
            m = group ^ f
            own = np.flatnonzero(mixed(m.copy()) % U(slices) == U(s)) if slices > 1 else np.arange(len(m))
            mids.append(m[own])
            whose.append(own)
        mids, whose = np.concatenate(mids), np.concatenate(whose)
        order = np.argsort(mids, kind="stable")
        same = np.flatnonzero(mids[order][1:] == mids[order][:-1])
        x, y = whose[order][same], whose[order][same + 1]
        root = labels_of(len(group), x, y)
        a.append(np.flatnonzero(root != np.arange(len(root))))
        b.append(root[a[-1]])
    return labels_of(len(group), np.concatenate(a), np.concatenate(b))


def term_links(fps: np.ndarray, positions: tuple[int, ...], max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between distinct fps that share the bytes at the positions."""
    mask = sum(0xFF << 8 * p for p in positions)
    keys = fps & U(mask)
    order = np.argsort(keys, kind="stable")
    fps, keys = fps[order], keys[order]
    edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(edge, len(keys)))
    a, b = [], []
    short = np.repeat(sizes <= 32, sizes)
    rank = np.repeat(sizes, sizes) - (np.arange(len(keys)) - np.repeat(edge, sizes))  # members from here on
    for d in range(1, 32):
        i = np.flatnonzero(short & (rank > d))
        if not len(i):
            break
        ok = _within(fps[i], fps[i + d], max_bits)
        a.append(i[ok])
        b.append(i[ok] + d)
    for at, n in zip(edge[sizes > 32].tolist(), sizes[sizes > 32].tolist()):
        group = fps[at : at + n]
        label = _spread(group, max_bits) if n <= LIST or max_bits % 2 else _by_midpoints(group, ~mask & (1 << 64) - 1, max_bits)
        own = np.flatnonzero(label != np.arange(n))
        a.append(at + own)
        b.append(at + label[own])
    a = np.concatenate([*a, np.zeros(0, np.int64)])
    root = labels_of(len(fps), a, np.concatenate([*b, np.zeros(0, np.int64)]))
    own = np.flatnonzero(root != np.arange(len(fps)))
    return fps[own], fps[root[own]]


def fingerprint_links(nodes: DataFrame, max_bits: int = 4, col: str = "fp") -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all those of at most max_bits differing bits."""
    terms = list(combinations(range(8), 8 - max_bits))
    slices = max(1, nodes.count() // SLICE)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(parts: list[np.ndarray]) -> pa.RecordBatch:
            fps = np.unique(np.concatenate(parts)).view(U)
            bucket, data = [], []
            for t, positions in enumerate(terms):
                mask = U(sum(0xFF << 8 * p for p in positions))
                own = mixed(fps & mask) % U(slices)
                for s in range(slices):
                    if len(part := fps[own == U(s)]):
                        bucket.append(t * slices + s)
                        data.append(part.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "fps"])

        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            n += len(held[-1])
            if n >= SLICE // 4:
                yield rows(held)
                held, n = [], 0
        if n:
            yield rows(held)

    def link(table: pa.Table) -> pa.Table:
        fps = np.unique(np.concatenate([np.frombuffer(x, U) for x in table.column("fps").to_pylist()]))
        a, b = term_links(fps, terms[table.column("bucket")[0].as_py() // slices], max_bits)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    sent = nodes.select(F.col(col).cast("long")).mapInArrow(index, "bucket int, fps binary")
    return sent.groupBy("bucket").applyInArrow(link, "a long, b long").distinct()


def rooted(rows: DataFrame, id_col: str, max_bits: int, fp_col: str = "fp") -> DataFrame:
    """(fp, least, root) of each distinct fingerprint: its least id, and one fingerprint for all that links reach."""
    nodes = checkpointed(rows.groupBy(fp_col).agg(F.min(id_col).alias("least")))
    found = components(fingerprint_links(nodes, max_bits, fp_col))
    return nodes.join(found.withColumnRenamed("node", fp_col), fp_col, "left").select(
        fp_col, "least", F.coalesce("root", fp_col).alias("root")
    )


def with_components(rows: DataFrame, id_col: str = "doc_id", max_bits: int = 4, fp_col: str = "fp") -> DataFrame:
    """rows with component_id, the smallest id of what its fingerprint reaches by links.

    rows are read twice; they should be a written table.
    """
    nodes = rooted(rows, id_col, max_bits, fp_col)
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = nodes.join(least, "root").select(fp_col, "component_id")
    return without(rows, ["component_id"]).join(by_fp, fp_col)


def one_of_each(docs: DataFrame, shingle: int = 5, max_bits: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: of those with the smallest id the first."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = checkpointed(with_fingerprints(whole, shingle, "text").select("row", "id", "fp", F.monotonically_increasing_id().alias("place")))
    roots = rooted(rows, "id", max_bits).select("fp", "root")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "place"))
    kept = rows.select("fp", "id", "place").join(roots, "fp").groupBy("root").agg(first.alias("first")).select("first.place")
    return rows.join(kept, "place", "left_semi").select("row.*")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id of every row of docs."""
    rows = checkpointed(with_fingerprints(docs.select(id_col, text_col), shingle, text_col).select(id_col, "fp"))
    return with_components(rows, id_col, max_bits).select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
