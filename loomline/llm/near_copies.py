"""One document of each group of near copies: those of shingle sets with a Jaccard similarity of 0.8 or more.

SimHash comes first: fingerprints of 64 bits (op5's, of the same shingles) are indexed by their positional bytes
and linked where BITS bits or fewer differ, and the links whose exact shingle sets are similar enough join groups.
A pair of 0.8 is mostly further apart than that (a sixth to a seventh of the bits differ), so what SimHash leaves
in different groups goes on to a second fingerprint.

That one has BANDS x VALUES bytes, each from the least of the shingles' hashes under another
permutation, so two texts share a positional byte with the chance of their similarity. Terms of the inverted index are sets of VALUES positional bytes: a pair of similarity 0.8 shares none of
the BANDS with a chance of (1 - 0.8**5)**30 < 0.00001. Pairs that share a term are tallied byte for byte; those
under LEAST shared bytes (at 0.8 a chance of about 0.00001) go, all others are verified by their exact shingle
sets before they are links. Groups are the components of the links; equal sets are one node from the start.

Rounds join groups: each node is paired with the one of another group that shares most bytes with it, in the next
round with the second of those, and so on, until a round adds links for under a hundredth of the nodes that are still
open; a dense group is joined after a few rounds of as many pairs as it has members. Terms whose nodes are all in one group
are closed. At last nodes of an open term that are in different groups are paired with all others there that reach the
tally, and a second one over MORE bytes, which pairs of under 0.7 seldom do. So no pair that shares a term and reaches
the tallies is lost. Texts are read for such pairs only.

Cases: null and empty texts have the empty set, so one of them stays; texts of fewer words than a shingle
are one shingle; words are parted by space and 0x09 to 0x0D, A-Z are lower-cased; ids may be null or repeat,
of equal rows one stays; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import checkpointed, let_go, small_enough
from .components import components
from .hashing import U, blocks, buffers, runs, word_hashes, word_spans
from .simhash import fingerprint_links, simhash

BANDS, VALUES, LEAST = 30, 5, 96
#: Differing bits of SimHash fingerprints up to which texts are linked.
BITS = 4
#: Nodes of a term that one task compares with each other, or with as many.
LIST = 2048
SEED = 7
#: More bytes of nodes that rounds leave in different groups, and those that a pair of 0.8 shares of all 600 but for a chance of 0.000001.
MORE, LEAST_OF_ALL = 450, 433
_RNG = np.random.default_rng(SEED)
_MULTIPLY = _RNG.integers(0, 1 << 31, BANDS * VALUES + MORE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, BANDS * VALUES + MORE, dtype=np.uint32)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The distinct hashes of each text's runs of `size` words, sorted."""
    whole, offsets = buffers(texts)
    for a, b in blocks(offsets):
        at = offsets[a : b + 1]
        data = whole[at[0] : at[-1]]
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        starts, ends, first = word_spans(data, at - at[0])
        words = word_hashes(data, starts, ends, SEED)
        for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
            yield np.unique(runs(words[i:j], min(size, j - i))) if j > i else np.zeros(0, U)


def fingerprint(hashes: np.ndarray, first: int = 0, last: int = BANDS * VALUES) -> bytes:
    """A byte for each of some permutations; none for the empty set."""
    if not len(hashes):
        return b""
    multiply, add = _MULTIPLY[first:last], _ADD[first:last]
    short, least = (hashes >> U(32)).astype(np.uint32), np.full(len(multiply), ~np.uint32(0))
    for i in range(0, len(short), 2048):
        x = short[i : i + 2048, None] * multiply
        x += add
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(least, x.min(axis=0), out=least)
    least ^= least >> np.uint32(16)
    return (least * np.uint32(0x297A2D39) >> np.uint32(24)).astype(np.uint8).tobytes()


def _signed(rows: DataFrame, shingle: int) -> DataFrame:
    """id and h of rows, with the digest that equal sets share, the SimHash and the fingerprint of bytes."""

    @F.pandas_udf("digest binary, bytes binary, fp long")
    def signed(texts: pd.Series) -> pd.DataFrame:
        let_go()
        sets = shingle_sets(pa.array(texts, pa.string()), shingle)
        all_ = [(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), fingerprint(s), simhash(t, shingle)) for s, t in zip(sets, texts)]
        return pd.DataFrame(all_, columns=["digest", "bytes", "fp"])

    return rows.withColumn("signed", signed("text")).select("id", "h", "signed.digest", "signed.bytes", "signed.fp")


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b) of nodes (node, fp) that connect all those whose fingerprints are linked by BITS differing bits or fewer: no more of them than nodes."""
    first = checkpointed(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    equal = nodes.join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    x, y = (first.select(F.col("fp").alias(c), F.col("first").alias(n)) for c, n in (("a", "x"), ("b", "y")))
    near = fingerprint_links(first, BITS).join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return checkpointed(equal.unionByName(near).distinct())


def _best_partners(open_: DataFrame, rank: int) -> DataFrame:
    """(x, y): for each node of open_ (term, node, root, bytes) one of another root that shares a term and LEAST bytes or more with it: of those
    with the most shared bytes the one of this rank in its term, of all its terms' the best.

    Lists of over LIST nodes are compared by pairs of parts, so that no task has more than two of them.
    """
    def best(rows: pa.Table) -> pa.Table:
        node, root, part = (rows.column(c).to_numpy() for c in ("node", "root", "part"))
        bytes_ = np.frombuffer(b"".join(rows.column("bytes").to_pylist()), np.uint8).reshape(len(node), -1)
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        a, b = np.flatnonzero(part == i), np.flatnonzero(part == j)
        shared = np.empty((len(a), len(b)), np.int16)
        for k in range(0, len(a), 32):
            shared[k : k + 32] = (bytes_[a[k : k + 32], None] == bytes_[b][None]).sum(2)
        shared[root[a][:, None] == root[b]] = -1
        out = []
        for x, y, t in ((a, b, shared), *([(b, a, shared.T)] if i != j else [])):
            if rank < t.shape[1]:
                at = np.argsort(-t, axis=1, kind="stable")[:, rank]
                n = t[np.arange(len(x)), at]
                out.append((node[x][n >= LEAST], node[y][at[n >= LEAST]], n[n >= LEAST]))
        x, y, n = (np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(3))
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64()), "n": pa.array(n.astype(np.int32))})

    found = _in_parts(open_).groupBy("term", "i", "j").applyInArrow(best, "x long, y long, n int")
    return found.groupBy("x").agg(F.max(F.struct("n", "y"))["y"].alias("y"))


def _in_parts(open_: DataFrame) -> DataFrame:
    """open_ with part, a row for each pair (i, j) of parts of its term that its own is one of."""
    parts = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("term")) / LIST).cast("int")
    dealt = open_.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    with_ = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))
    return dealt.withColumn("__p", F.explode(with_)).select(*open_.columns, "part", "__p.i", "__p.j")


def _all_partners(open_: DataFrame) -> DataFrame:
    """(a, b), once each: all pairs of different roots in open_ (term, band, node, root, bytes, more) that share a term, LEAST bytes, and LEAST_OF_ALL with more."""

    def pairs(rows: pa.Table) -> pa.Table:
        node, root, part, band = (rows.column(c).to_numpy() for c in ("node", "root", "part", "band"))
        bytes_, more = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint8).reshape(len(node), -1) for c in ("bytes", "more"))
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        a, b = np.flatnonzero(part == i), np.flatnonzero(part == j)
        out = [np.zeros((2, 0), np.int64)]
        for k in range(0, len(a), 32):
            own = a[k : k + 32]
            same = bytes_[own, None] == bytes_[b][None]
            shared = same.sum(2)
            at = np.nonzero((shared >= LEAST) & (root[own][:, None] != root[b]) & ((own[:, None] < b) | (i != j)))
            first = same[at].reshape(len(at[0]), BANDS, VALUES).all(2).argmax(1)  # a pair is met in each band that it shares; the first one has it
            at = tuple(x[first == band[0]] for x in at)
            x, y, n = own[at[0]], b[at[1]], shared[at]
            for m in range(0, len(x), 8192):
                c = slice(m, m + 8192)
                ok = n[c] + (more[x[c]] == more[y[c]]).sum(1) >= LEAST_OF_ALL
                out.append(np.sort(np.stack([node[x[c][ok]], node[y[c][ok]]]), 0))
        found = np.concatenate(out, 1)
        return pa.table({"a": pa.array(found[0]), "b": pa.array(found[1])})

    return _in_parts(open_).groupBy("term", "i", "j").applyInArrow(pairs, "a long, b long").distinct()


def _more_bytes(texts: DataFrame, shingle: int) -> DataFrame:
    """node and more, the further bytes of texts (node, text)."""

    @F.pandas_udf("binary")
    def more(series: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, BANDS * VALUES, BANDS * VALUES + MORE) for x in shingle_sets(pa.array(series, pa.string()), shingle)], dtype=object)

    return texts.select("node", more("text").alias("more"))


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, tenths: int) -> DataFrame:
    """The pairs whose shingle sets have a similarity of `tenths` tenths or more."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            ids = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in "ab"}
            for c in "ab":
                new = [i for i, x in zip(*np.unique(ids[c], return_index=True)[::-1]) if x not in held]
                column = batch.column("text_" + c).take(pa.array(new, pa.int64()))
                held |= zip(ids[c][new].tolist(), shingle_sets(column, shingle))
            ok = []
            for a, b in zip(ids["a"].tolist(), ids["b"].tolist()):
                shared = len(np.intersect1d(held[a], held[b], assume_unique=True))
                ok.append(10 * shared >= tenths * (len(held[a]) + len(held[b]) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], names=["a", "b"])
            if sum(map(len, held.values())) > 1 << 22:
                held.clear()

    both = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")
    return checkpointed(both.select("a", "b", "text_a", "text_b").mapInArrow(similar, "a long, b long"))


def similar_groups(nodes: DataFrame, rows: DataFrame, shingle: int, tenths: int) -> DataFrame:
    """(node, root) of each node that is linked to another. nodes: (node, bytes, fp, id, h); rows: (id, h, text)."""
    term = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring(F.col("bytes"), k * VALUES + 1, F.lit(VALUES))))
    keys = nodes.where(F.length("bytes") > 0).select("node", F.posexplode(term).alias("band", "term"))
    own = Window.partitionBy("term")
    keys = checkpointed(keys.withColumn("size", F.count(F.lit(1)).over(own)).where("size > 1").select("term", "band", "node"))
    pairs = _simhash_pairs(nodes.where(F.length("bytes") > 0))
    either = keys.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    wanted = nodes.join(either, "node", "left_semi").select("node", F.col("id").alias("i"), F.col("h").alias("g"))
    wanted = small_enough(checkpointed(wanted), 40)
    texts = checkpointed(rows.join(wanted, (F.col("h") == F.col("g")) & F.equal_null("id", "i")).select("node", "text").dropDuplicates(["node"]))
    tested, links = pairs, _verified(pairs, texts, shingle, tenths)
    found, rank, more = components(links), 0, True
    while True:
        rooted = keys.join(found, "node", "left").select("term", "band", "node", F.coalesce("root", "node").alias("root"))
        several = F.min("root").over(own) < F.max("root").over(own)
        rooted = checkpointed(rooted.withColumn("several", several).where("several").drop("several"))
        keys, open_ = rooted.select("term", "band", "node"), rooted.join(nodes.select("node", "bytes"), "node")
        if not more:
            break
        pairs = _best_partners(open_, rank).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        pairs = checkpointed(pairs.join(tested, ["a", "b"], "left_anti"))
        new = _verified(pairs, texts, shingle, tenths)
        tested, links = tested.union(pairs), links.union(new)
        found, rank = components(links), rank + 1
        more = 100 * new.count() > keys.select("node").distinct().count()
    left = texts.join(keys.select("node").distinct(), "node", "left_semi")
    rest = _all_partners(open_.join(checkpointed(_more_bytes(left, shingle)), "node")).join(tested, ["a", "b"], "left_anti")
    return components(links.union(_verified(checkpointed(rest), texts, shingle, tenths)))


def one_of_each(docs: DataFrame, shingle: int = 5, tenths: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group: one of the smallest id. docs are read more than once; they should be a written table."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"), F.col(f"`{text_col}`").alias("text"))
    signed = checkpointed(_signed(rows, shingle))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("least")
    own = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "fp")).alias("least")
    nodes = signed.groupBy("digest").agg(F.first("bytes").alias("bytes"), own).select("bytes", "least.fp", "least.id", "least.h", "digest")
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))
    roots = nodes.join(similar_groups(nodes, rows, shingle, tenths), "node", "left").select("id", "h", F.coalesce("root", "node").alias("root"))
    kept = checkpointed(roots.groupBy("root").agg(least).select(F.col("least.id").alias("__i"), F.col("least.h").alias("__h")))
    same = F.equal_null(signed["id"], kept["__i"]) & (signed["h"] == kept["__h"])
    gone = checkpointed(signed.join(kept, same, "left_anti").select(F.col("id").alias("__i"), F.col("h").alias("__h")).distinct())
    here = docs.withColumn("__own", F.xxhash64(F.col(f"`{text_col}`")))
    left = here.join(small_enough(gone, 40), F.equal_null(F.col(f"`{id_col}`"), F.col("__i")) & (F.col("__own") == F.col("__h")), "left_anti")
    if signed.groupBy("id", "h").count().where("count > 1").isEmpty():
        return left.drop("__own")
    order = Window.partitionBy(id_col, "__own").orderBy(F.lit(0))  # equal ids and texts: one of them
    return left.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__own", "__n")
