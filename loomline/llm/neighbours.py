"""Nearest neighbours by NN-descent and greedy graph search.

Each distinct vector is a node. The graph starts with random neighbours. In each round a node's
block is joined with the vectors of its neighbours and of the nodes it is a neighbour of; pairs
among these of which at least one came into a list in the round before are measured, as neighbours of neighbours are
likely neighbours, and each node keeps its `k` nearest so far. Rounds end when under UPDATES of all entries are new.
Distances are taken in doubles from one of the neighbours as origin, so vectors far off the origin, or in tight
clusters far from each other, keep their order. A query starts at its own node and a few others: each hop joins the nearest
nodes not yet expanded with the graph, and stops when all of its `beam` nearest are expanded.

Nodes are dealt to blocks of about BLOCK by a hash of their id. What passes between blocks is packed,
one row for each pair of blocks. Of the nodes that name a node, `k` are used in each round, new ones first, others by
chance, and the search follows the nearest NAMED of them: graph and search are approximate, their recall is measured
in tests and in the README. Nothing is gathered on the driver but counts.

Cases: vectors that are null, zero, of another length than most, or that hold null or non-finite
numbers, and rows without an id, take no part; equal vectors are one node and all come back, smaller
ids first; fewer candidates than asked for are all returned; vectors of numbers beyond 1e100 (or all under 1e-100) are
measured in units of a power of two; other columns of rows don't come out; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import checkpointed

BLOCK, QUERY_BLOCK = 4096, 256
#: Updates that are held before the best of each node are kept.
HELD = 1_000_000
#: Share of the graph's entries that must be new for another round, and rounds at most (a safeguard: they halve each time or so).
UPDATES, ROUNDS = 0.002, 40
#: Nodes that name a node which the search follows.
NAMED = 64


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec) of the rows that take part."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = rows.where(F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    size = ok.groupBy(F.size(v).alias("s")).count().orderBy(F.desc("count"), "s").first()
    return ok.where(F.size(v) == (size.s if size else 0)).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vec"))


def _matrix(column: pa.ChunkedArray, dtype) -> np.ndarray:
    flat = pa.concat_arrays(column.chunks).flatten().to_numpy(zero_copy_only=False) if column.num_chunks else np.zeros(0)
    return flat.astype(dtype).reshape(len(column), -1)


def _lists(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists in a row, and the lists' sizes."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(dtype), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _numbers(column: pa.ChunkedArray, dtype=np.int64) -> np.ndarray:
    return column.to_numpy().astype(dtype)


def block_of(ids: np.ndarray, n_blocks: int) -> np.ndarray:
    """A multiplicative hash of the id, the same in Spark expressions and here."""
    return (((ids % 1000003 + 1000003) % 1000003) * 7919 % 1000003) % n_blocks


def block_column(ids: Column, n_blocks: int) -> Column:
    return (F.pmod(ids, F.lit(1000003)) * 7919 % 1000003 % n_blocks).cast("int")


def _packed(target: np.ndarray, arrays: dict[str, np.ndarray], name: str) -> pa.Table:
    """One row for each target with the bytes of its share of each array."""
    order = np.argsort(target, kind="stable")
    rows, at = np.unique(target[order], return_index=True)
    ends = np.append(at[1:], len(order))
    columns = {name: pa.array(rows, pa.int32())}
    for key, x in arrays.items():
        s = x[order]
        columns[key] = pa.array([s[i:j].tobytes() for i, j in zip(at, ends)], pa.binary())
    return pa.table(columns)


def _unpacked(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *[np.frombuffer(x, dtype) for x in column.to_pylist()]])


def _best(v: np.ndarray, w: np.ndarray, d: np.ndarray, fresh: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each v its `most` nearest distinct w; one that is known stays as it is known, not fresh."""
    if not len(v):
        return v, w, d, fresh
    if min(v.min(), w.min()) >= 0 and max(v.max(), w.max()) < 1 << 31:
        order = np.argsort(v << 32 | w)
    else:
        order = np.lexsort((w, v))
    v, w, d, fresh = v[order], w[order], d[order], fresh[order]
    at = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])))
    new = np.logical_and.reduceat(fresh, at)
    nearest_known = np.minimum.reduceat(np.where(fresh, np.inf, d), at)
    v, w, d, fresh = v[at], w[at], np.where(new, np.minimum.reduceat(d, at), nearest_known), new
    order = np.argsort(d, kind="stable")  # by w so far
    order = order[np.argsort(v[order], kind="stable")]
    at = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    order = order[np.arange(len(v)) - np.repeat(at, np.diff(np.append(at, len(v)))) < most]
    return v[order], w[order], d[order], fresh[order]


def _sample(v: np.ndarray, u: np.ndarray, fresh: np.ndarray, most: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most `most` u of each v, fresh ones first, then by chance."""
    order = np.lexsort((np.random.default_rng(seed).random(len(v)), ~fresh, v))
    v, u, fresh = v[order], u[order], fresh[order]
    keep = np.arange(len(v)) - np.searchsorted(v, v) < most
    return v[keep], u[keep], fresh[keep]


GRAPH = "block int, node long, vec array<double>, near array<long>, dist array<double>, fresh array<boolean>"


def random_graph(vectors: DataFrame, n: int, n_blocks: int, k: int, rounds: int = 3) -> DataFrame:
    """GRAPH of (node, vec): neighbours met by chance in groups dealt out by `rounds` hashes; not measured yet."""
    groups = max(1, n * rounds // k)
    dealt = vectors.select("node", F.explode(F.array(*map(F.lit, range(rounds)))).alias("r"))
    dealt = dealt.withColumn("g", F.pmod(F.xxhash64("node", "r"), F.lit(groups)))
    met = dealt.groupBy("r", "g").agg(F.collect_list("node").alias("all"))  # about k / rounds each
    near = met.select(F.explode("all").alias("node"), "all").groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("all"))).alias("near"))
    near = near.select("node", F.slice(F.filter("near", lambda x: x != F.col("node")), 1, k).alias("near"))
    return vectors.join(near, "node").select(
        block_column(F.col("node"), n_blocks).alias("block"), "node", "vec", "near",
        F.transform("near", lambda _: F.lit(float("inf"))).alias("dist"), F.transform("near", lambda _: F.lit(True)).alias("fresh"),
    )


def descended(graph: DataFrame, n_blocks: int, k: int, seed: int) -> DataFrame:
    """GRAPH after one round."""

    def name_neighbours(g: pa.Table) -> pa.Table:
        v, sizes = _lists(g.column("near"), np.int64)
        u = np.repeat(_numbers(g.column("node")), sizes)
        fresh, _ = _lists(g.column("fresh"), bool)
        v, u, fresh = _sample(v, u, fresh, k, seed)
        return _packed(block_of(v, n_blocks), {"v": v, "u": u, "fresh": fresh}, "block")

    def gather(g: pa.Table, named: pa.Table) -> pa.Table:
        nodes, (near, sizes) = _numbers(g.column("node")), _lists(g.column("near"), np.int64)
        v, u, new = _sample(*(_unpacked(named.column(c), t) for c, t in (("v", np.int64), ("u", np.int64), ("fresh", bool))), k, seed + 1)
        own, at = np.repeat(nodes, sizes + 1), np.cumsum(sizes) - sizes
        other, fresh = np.insert(near, at, nodes), np.insert(_lists(g.column("fresh"), bool)[0], at, False)
        own, other, fresh = np.concatenate([own, v]), np.concatenate([other, u]), np.concatenate([fresh, new])
        order = np.lexsort((~fresh, other, own))  # a node that is met both ways counts once, as fresh if it is so either way
        own, other, fresh = own[order], other[order], fresh[order]
        once = np.ones(len(own), bool)
        once[1:] = (own[1:] != own[:-1]) | (other[1:] != other[:-1])
        own, other, fresh = own[once], other[once], fresh[once]
        order = np.lexsort((~fresh, own))  # fresh ones first
        own, other, fresh = own[order], other[order], fresh[order]
        first = np.append(True, own[1:] != own[:-1])[: len(own)]
        open_ = fresh[np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))]
        own, other, fresh = own[open_], other[open_], fresh[open_]  # where nothing is fresh, all has been measured
        wanted = np.unique(other)
        asks = _packed(block_of(wanted, n_blocks), {"ids": wanted}, "to").to_pylist()
        kind = pa.list_(pa.struct([("to", pa.int32()), ("ids", pa.binary())]))
        return pa.table(
            {
                "block": pa.array(g.column("block").to_pylist()[:1] if g.num_rows else [], pa.int32()),
                "own": pa.array([own.tobytes()][: g.num_rows], pa.binary()),
                "other": pa.array([other.tobytes()][: g.num_rows], pa.binary()),
                "fresh": pa.array([fresh.tobytes()][: g.num_rows], pa.binary()),
                "wanted": pa.array([asks][: g.num_rows], kind),
            }
        )

    def serve(g: pa.Table, asked: pa.Table) -> pa.Table:
        ids = _numbers(g.column("node"))
        order = np.argsort(ids)
        x = _matrix(g.column("vec"), np.float64)[order]
        dist, sizes = _lists(g.column("dist"), np.float64)
        last = np.full(len(ids), np.inf)
        last[sizes >= k] = dist[np.cumsum(sizes)[sizes >= k] - 1]
        last = last[order]
        at = [np.searchsorted(ids[order], np.frombuffer(b, np.int64)) for b in asked.column("ids").to_pylist()]
        return pa.table(
            {
                "block": asked.column("back"),
                "ids": asked.column("ids"),
                "vecs": pa.array([x[a].tobytes() for a in at], pa.binary()),
                "kth": pa.array([last[a].tobytes() for a in at], pa.binary()),
            }
        )

    def local_join(around: pa.Table, vectors: pa.Table) -> pa.Table:
        if not any(around.column("own").to_pylist()):
            return _packed(np.zeros(0, np.int64), {"v": np.zeros(0, np.int64), "w": np.zeros(0, np.int64), "d": np.zeros(0)}, "block")
        ids = _unpacked(vectors.column("ids"), np.int64)
        order = np.argsort(ids)
        x = _unpacked(vectors.column("vecs"), np.float64).reshape(len(ids), -1)[order]
        last = _unpacked(vectors.column("kth"), np.float64)[order]
        ids = ids[order]
        own, other, fresh = (_unpacked(around.column(c), t) for c, t in (("own", np.int64), ("other", np.int64), ("fresh", bool)))
        at = np.searchsorted(ids, other)
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(own)))
        n_fresh = np.add.reduceat(fresh.astype(np.int64), starts) if len(starts) else sizes
        by = np.lexsort((sizes, n_fresh))
        starts, sizes, n_fresh = starts[by], sizes[by], n_fresh[by]
        none = np.zeros(0, np.int64)
        kept: tuple = (none, none, np.zeros(0), np.zeros(0, bool))
        held, n_held = [], 0
        for i in range(0, len(starts), 64):
            s, n, f = starts[i : i + 64], sizes[i : i + 64], n_fresh[i : i + 64]
            place = s[:, None] + np.arange(n.max())[None]
            there = np.arange(n.max())[None] < n[:, None]
            m = at[np.where(there, place, s[:, None])]
            y = x[m]
            y -= y[:, :1].copy()  # one of them as origin
            z, mine = y[:, : f.max()], m[:, : f.max()]
            d = (z * z).sum(2)[:, :, None] + (y * y).sum(2)[:, None, :] - 2 * np.matmul(z, y.transpose(0, 2, 1))
            pair = (np.arange(f.max())[None] < f[:, None])[:, :, None] & there[:, None, :] & (mine[:, :, None] != m[:, None, :])
            old = (np.arange(n.max())[None] >= f[:, None])[:, None, :]  # fresh ones have rows of their own
            for ok, v, w in ((pair & (d < last[mine][:, :, None]), 0, 1), (pair & old & (d < last[m][:, None, :]), 1, 0)):
                a, b, c = np.nonzero(ok)
                both = mine[a, b], m[a, c]
                held.append((both[v], both[w], np.maximum(d[a, b, c], 0), np.zeros(len(a), bool)))
                n_held += len(a)
            if n_held > HELD or i + 64 >= len(starts):
                kept = _best(*[np.concatenate(p) for p in zip(kept, *held)], k)  # k suffice: what ends among the k nearest is among the k best found
                held, n_held = [], 0
                end = np.flatnonzero(np.append(kept[0][1:] != kept[0][:-1], True))[: len(kept[0])]
                end = end[np.diff(np.append(-1, end)) == k]  # what is further than k found ones needn't be held
                last[kept[0][end]] = np.minimum(last[kept[0][end]], kept[2][end])
        v = ids[kept[0]]
        return _packed(block_of(v, n_blocks), {"v": v, "w": ids[kept[1]], "d": kept[2]}, "block")

    def merge(g: pa.Table, found: pa.Table) -> pa.Table:
        nodes, (near, sizes), (dist, _) = _numbers(g.column("node")), _lists(g.column("near"), np.int64), _lists(g.column("dist"), np.float64)
        order = np.argsort(nodes)
        v = np.concatenate([np.repeat(nodes, sizes), _unpacked(found.column("v"), np.int64)])
        w = np.concatenate([near, _unpacked(found.column("w"), np.int64)])
        d = np.concatenate([dist, _unpacked(found.column("d"), np.float64)])
        known = np.zeros(len(d), bool)
        known[: len(near)] = np.isfinite(dist)
        v, w, d, fresh = _best(v, w, d, ~known, k)
        ends = np.concatenate([[0], np.searchsorted(v, nodes[order], "right")]).astype(np.int32)
        return pa.table(
            {
                "block": g.column("block").take(pa.array(order)),
                "node": g.column("node").take(pa.array(order)),
                "vec": g.column("vec").take(pa.array(order)),
                "near": pa.ListArray.from_arrays(pa.array(ends), pa.array(w)),
                "dist": pa.ListArray.from_arrays(pa.array(ends), pa.array(d)),
                "fresh": pa.ListArray.from_arrays(pa.array(ends), pa.array(fresh)),
            }
        )

    links = graph.select("block", "node", "near", "fresh")
    named = links.groupBy("block").applyInArrow(name_neighbours, "block int, v binary, u binary, fresh binary")
    around = links.groupBy("block").cogroup(named.groupBy("block")).applyInArrow(
        gather, "block int, own binary, other binary, fresh binary, wanted array<struct<to int, ids binary>>"
    )
    around = checkpointed(around)
    asked = around.select(F.col("block").alias("back"), F.inline("wanted"))
    vectors = graph.groupBy("block").cogroup(asked.groupBy("to")).applyInArrow(serve, "block int, ids binary, vecs binary, kth binary")
    found = around.groupBy("block").cogroup(vectors.groupBy("block")).applyInArrow(local_join, "block int, v binary, w binary, d binary")
    return checkpointed(graph.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(merge, GRAPH))


def build_graph(vectors: DataFrame, k: int = 32, updates: float = UPDATES, rounds: int = ROUNDS) -> DataFrame:
    """GRAPH of (node, vec) after rounds in which `updates` of its entries or more were new."""
    n = vectors.count()
    n_blocks = max(1, -(-n // BLOCK))
    graph = checkpointed(random_graph(vectors, n, n_blocks, k))
    for r in range(rounds):
        graph = descended(graph, n_blocks, k, 2 * r)
        size, fresh = graph.agg(F.sum(F.size("near")), F.sum(F.size(F.filter("fresh", lambda x: x)))).first()
        if not fresh or fresh < updates * size:
            break
    return graph


def both_ways(graph: DataFrame) -> DataFrame:
    """(block, node, vec, near): neighbours, and of the nodes that name a node the nearest."""
    back = graph.select("node", F.explode(F.arrays_zip("near", "dist")).alias("e")).select(
        F.col("e.near").alias("to"), F.struct(F.col("e.dist").alias("d"), F.col("node").alias("from")).alias("s")
    )
    # a node that very many name is cut down in parts first
    parts = back.withColumn("part", F.pmod(F.xxhash64("s.from"), F.lit(16))).groupBy("to", "part").agg(F.slice(F.sort_array(F.collect_list("s")), 1, NAMED).alias("s"))
    named = parts.groupBy("to").agg(F.slice(F.sort_array(F.flatten(F.collect_list("s"))), 1, NAMED).alias("s"))
    named = named.select(F.col("to").alias("node"), F.transform("s", lambda x: x["from"]).alias("more"))
    return graph.join(named, "node", "left").select(
        "block", "node", "vec", F.array_union("near", F.coalesce("more", F.array().cast("array<long>"))).alias("near")
    )


STATE = "qblock int, query long, vec array<double>, state binary"


def search(graph: DataFrame, queries: DataFrame, beam: int = 256, width: int = 24, entries: int = 6) -> DataFrame:
    """(query, node, dist): the `beam` nearest nodes found for queries (query, vec, start array<long>)."""
    n_blocks = graph.agg(F.max("block")).first()[0]
    n_blocks = 1 if n_blocks is None else n_blocks + 1
    n_queries = max(1, -(-queries.count() // QUERY_BLOCK))
    graph = checkpointed(both_ways(graph))

    def first_state(table: pa.Table) -> pa.Table:
        empty = {"ids": np.zeros(0, np.int64), "d": np.zeros(0), "done": np.zeros(0, bool), "near": [], "seen": np.zeros(0, np.int64)}
        states = [pickle.dumps(empty | {"ask": np.unique(np.array(s, np.int64))}) for s in table.column("start").to_pylist()]
        return table.drop_columns(["start"]).append_column("state", pa.array(states, pa.binary()))

    def ask(table: pa.Table) -> pa.Table:
        query, node, vec = [], [], _matrix(table.column("vec"), np.float64)
        bound = []
        for q, s in zip(table.column("query").to_pylist(), map(pickle.loads, table.column("state").to_pylist())):
            query.append(np.full(len(s["ask"]), q))
            node.append(s["ask"])
            bound.append(np.full(len(s["ask"]), s["d"][-1] if len(s["d"]) >= beam else np.inf))
        place = np.repeat(np.arange(len(node)), [len(x) for x in node])
        query, node, bound = np.concatenate(query), np.concatenate(node), np.concatenate(bound)
        to = block_of(node, n_blocks)
        rows = _packed(to, {"query": query, "node": node, "bound": bound}, "block")
        vecs = [vec[np.unique(place[to == b])].tobytes() for b in rows.column("block").to_pylist()]  # by row of the block
        whose = [query[np.flatnonzero(to == b)[np.unique(place[to == b], return_index=True)[1]]].tobytes() for b in rows.column("block").to_pylist()]
        qblock = pa.array([table.column("qblock")[0].as_py()] * rows.num_rows, pa.int32())
        return rows.append_column("vecs", pa.array(vecs, pa.binary())).append_column("whose", pa.array(whose, pa.binary())).append_column("qblock", qblock)

    def measure(g: pa.Table, asked: pa.Table) -> pa.Table:
        ids = _numbers(g.column("node"))
        order = np.argsort(ids)
        ids = ids[order]
        x = _matrix(g.column("vec"), np.float64)[order] if len(ids) else np.zeros((0, 1))
        near, sizes = _lists(g.column("near"), np.int64)
        ends = np.cumsum(sizes)
        out = {"qblock": [], "query": [], "node": [], "d": [], "size": [], "near": []}
        for row in asked.to_pylist():
            query, node, bound = np.frombuffer(row["query"], np.int64), np.frombuffer(row["node"], np.int64), np.frombuffer(row["bound"], np.float64)
            whose = np.frombuffer(row["whose"], np.int64)
            vecs = np.frombuffer(row["vecs"], np.float64).reshape(len(whose), -1)
            by_id = np.argsort(whose)
            q = vecs[by_id[np.searchsorted(whose[by_id], query)]]
            at = np.searchsorted(ids, node)
            d = np.concatenate([np.sqrt(((x[at[i : i + 4096]] - q[i : i + 4096]) ** 2).sum(1)) for i in range(0, len(at), 4096)])
            good = np.flatnonzero(d <= bound)
            mine = order[at[good]]
            lists = [near[i:j] for i, j in zip((ends - sizes)[mine].tolist(), ends[mine].tolist())]
            out["qblock"].append(row["qblock"])
            out["query"].append(query[good].tobytes())
            out["node"].append(node[good].tobytes())
            out["d"].append(d[good].tobytes())
            out["size"].append(np.array([len(x) for x in lists], np.int64).tobytes())
            out["near"].append(np.concatenate([np.zeros(0, np.int64), *lists]).tobytes())
        return pa.table({k: pa.array(v, pa.int32() if k == "qblock" else pa.binary()) for k, v in out.items()})

    def advance(table: pa.Table, answers: pa.Table) -> pa.Table:
        query, node, d = (_unpacked(answers.column(c), t) for c, t in (("query", np.int64), ("node", np.int64), ("d", np.float64)))
        near = np.split(_unpacked(answers.column("near"), np.int64), np.cumsum(_unpacked(answers.column("size"), np.int64))[:-1]) if len(node) else []
        order = np.argsort(query, kind="stable")
        states = []
        for q, s in zip(table.column("query").to_pylist(), map(pickle.loads, table.column("state").to_pylist())):
            mine = order[np.searchsorted(query[order], q) : np.searchsorted(query[order], q, "right")]
            seen = np.union1d(s["seen"], s["ask"])
            ids = np.concatenate([s["ids"], node[mine]])
            dist = np.concatenate([s["d"], d[mine]])
            done = np.concatenate([s["done"], np.zeros(len(mine), bool)])
            lists = s["near"] + [near[i] for i in mine]
            best = np.lexsort((ids, dist))[:beam]
            ids, dist, done, lists = ids[best], dist[best], done[best], [lists[i] for i in best]
            todo = np.flatnonzero(~done)[:width]
            ask_next = np.setdiff1d(np.concatenate([np.zeros(0, np.int64), *[lists[i] for i in todo]]), seen)
            done[todo] = True
            lists = [None if f else x for f, x in zip(done, lists)]
            states.append(pickle.dumps({"ids": ids, "d": dist, "done": done, "near": lists, "seen": seen, "ask": ask_next, "open": bool(len(ask_next)) or not done.all()}))
        at = table.schema.get_field_index("state")
        table = table.set_column(at, "state", pa.array(states, pa.binary()))
        return table.append_column("open", pa.array([pickle.loads(x)["open"] for x in states], pa.bool_()))

    starts = queries.select(F.pmod(F.xxhash64("query"), F.lit(n_queries)).cast("int").alias("qblock"), "query", "vec", "start")
    state = checkpointed(starts.groupBy("qblock").applyInArrow(first_state, STATE)).withColumn("open", F.lit(True))
    done: list[DataFrame] = []
    while True:
        active = state.where("open").drop("open")
        asked = active.groupBy("qblock").applyInArrow(
            ask, "block int, query binary, node binary, bound binary, vecs binary, whose binary, qblock int"
        )
        answers = graph.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(
            measure, "qblock int, query binary, node binary, d binary, size binary, near binary"
        )
        state = checkpointed(active.groupBy("qblock").cogroup(answers.groupBy("qblock")).applyInArrow(advance, STATE + ", open boolean"))
        done.append(state.where("NOT open"))
        if state.where("open").isEmpty():
            break

    def results(batches):
        for batch in batches:
            states = [pickle.loads(x) for x in batch.column("state").to_pylist()]
            n = [len(s["ids"]) for s in states]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(batch.column("query").to_numpy(), n)),
                    pa.array(np.concatenate([np.zeros(0, np.int64), *[s["ids"] for s in states]])),
                    pa.array(np.concatenate([np.zeros(0), *[s["d"] for s in states]])),
                ],
                names=["query", "node", "dist"],
            )

    ended = done[0]
    for more in done[1:]:
        ended = ended.unionByName(more)
    return ended.select("query", "state").mapInArrow(results, "query long, node long, dist double")


def nearest(rows: DataFrame, is_query: Column, top: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 32, beam: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` nearest other rows found for each row that is_query (of id) holds for."""
    good = checkpointed(usable(rows, id_col, vector_col))
    top_number = good.agg(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0] or 1.0
    unit = 1.0 if 1e-100 < top_number < 1e100 else 2.0 ** math.frexp(top_number)[1]  # a power of two changes no digit
    if unit != 1.0:
        good = good.withColumn("vec", F.transform("vec", lambda x: x / unit))
    copies = good.groupBy("vec").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"))
    nodes = checkpointed(copies)
    vectors = nodes.select("node", "vec")
    named = good.join(nodes, "vec").select("node", "id", "n")
    few = named.where("n = 1").select("node", "id")
    # of a vector with many copies the first top + 1 suffice; they are cut down in parts
    some = named.where("n > 1").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    for keys in (["node", "part"], ["node"]):
        some = some.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("r") <= top + 1)
    members = few.unionByName(some.select("node", "id"))
    graph = build_graph(vectors, k)
    own = good.where(is_query).join(nodes, "vec").select(F.col("id").alias("query"), "vec", "node")
    # besides its own node each query starts at some that others share
    entry = graph.select("node").orderBy(F.xxhash64("node")).limit(6).agg(F.collect_list("node").alias("entries"))
    queries = checkpointed(own.join(F.broadcast(entry)).select("query", "vec", F.array_union(F.array("node"), "entries").alias("start")))
    found = search(graph, queries, beam)
    by_query = Window.partitionBy("query").orderBy("dist", "id")
    hits = found.join(members, "node").where("id <> query").withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= top)
    return hits.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), (F.col("dist") * unit).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("id") % 100 == 0)
