"""Divergence of sources within their language by terms, counted again through minimal perfect hashes.

First pass: each task counts in how many documents a term stands, by language, and sends what it has;
sums of `least` and more are kept, so the filter is exact. The kept terms of a language are dealt to
shards of at most about 4,096, each a minimal perfect hash with its keys (perfect_hash.py).

Second pass: shards are broadcast in batches of at most BATCH_BYTES, one scan of the documents for each batch; a task
counts words by (language, source), looks them up, compares them with the stored key and adds to dense slots of the
group, which it sends as (slot, count) bytes whenever SLOTS of them are held. Tasks then stream through the rows of
one (language, shard) after the other, with one dense matrix of groups by slots, which is small by the shards' size.

All arithmetic is in integers: p = 1 + floor(scale * (count + 1) / (N + V)), f = floor((p - q)^2 / q).

Cases: null text, lang or source is ''; a language without kept terms has groups and pairs of value 0; a group without
terms takes part with counts of 0; a text of any length is taken whole (a term may be as long); equal documents count
each; an empty table gives an empty table; other columns of docs don't come out.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import checkpointed, held, small_enough
from .hashing import buffers
from .perfect_hash import Shard, Shards, build, dealt

#: A-Z to a-z, letters and bytes of other characters as they are, the rest to spaces.
TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Distinct strings that a task counts before it sends them or looks them up.
HELD = 300_000
#: Bytes of shards that are broadcast at once, and dense slots that a task holds.
BATCH_BYTES, SLOTS = 32 << 20, 8 << 20
SCALE = 10**9


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[str, str, list[bytes]]]:
    texts = batch.column("text").cast(pa.large_binary())
    for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
        yield lang, source, text.as_py().translate(TERM).split()


def document_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, n): the documents of lang that have the term, as each task has counted them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)

        def send() -> Iterator[pa.RecordBatch]:
            for lang, terms in seen.items():
                names = list(terms)
                for i in range(0, len(names), 100_000):
                    part = names[i : i + 100_000]
                    yield pa.record_batch({"lang": pa.array([lang] * len(part)), "term": pa.array(part, pa.binary()), "n": pa.array([terms[x] for x in part], pa.int64())})
            seen.clear()

        n_held = 0
        for batch in batches:
            for lang, _, words in _rows(batch):
                mine = seen[lang]
                n_held -= len(mine)
                mine.update(set(words))
                n_held += len(mine)
                if n_held > HELD:
                    yield from send()
                    n_held = 0
        yield from send()

    return _texts(docs).mapInArrow(count, "lang string, term binary, n long")


def perfect_shards(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, n_shards, shard, seed, moves, keys, ends, bytes) of the kept (lang, term); sizes: (lang, n_shards)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = buffers(b.column("term"))
            shard = np.zeros(len(b), np.int32)
            n = b.column("n_shards").to_numpy()
            for k in np.unique(n):
                own = n == k
                shard[own] = dealt(data, at[:-1][own], at[1:][own], int(k))
            yield pa.record_batch({"lang": b.column("lang"), "n_shards": b.column("n_shards"), "shard": pa.array(shard), "term": b.column("term")})

    def make(rows: pa.Table) -> pa.Table:
        data, at = buffers(rows.column("term"))
        made = build(data, at[:-1], at[1:])
        parts = {"moves": made.moves.tobytes(), "keys": made.keys.tobytes(), "ends": made.ends.astype(np.int64).tobytes()}
        first = rows.slice(0, 1)
        return pa.table(
            {"lang": first.column("lang"), "n_shards": first.column("n_shards"), "shard": first.column("shard"), "seed": pa.array([made.seed], pa.int32())}
            | {k: pa.array([v], pa.binary()) for k, v in parts.items()}
            | {"bytes": pa.array([sum(map(len, parts.values()))], pa.int64())}
        )

    with_sizes = kept.join(small_enough(sizes, 300), "lang").select("lang", "n_shards", "term")
    dealt_rows = with_sizes.mapInArrow(deal, "lang string, n_shards int, shard int, term binary")
    return dealt_rows.groupBy("lang", "shard").applyInArrow(make, "lang string, n_shards int, shard int, seed int, moves binary, keys binary, ends binary, bytes long")


def _shard(row) -> Shard:
    return Shard(row["seed"], np.frombuffer(row["moves"], np.int32), np.frombuffer(row["keys"], np.uint8), np.frombuffer(row["ends"], np.int64))


COUNTS = "lang string, source string, shard int, slots binary, counts binary, total long"


def recounted(docs: DataFrame, shards: list) -> DataFrame:
    """COUNTS rows of the terms of the given shards (collected rows, within the bound)."""
    sent = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in shards])
    names, own = list(shards[0].asDict()), f"source-audit-{uuid.uuid4().hex}"

    def load() -> dict[str, Shards]:
        by_lang = defaultdict(list)
        for r in sent.value:
            by_lang[r[0]].append(dict(zip(names, r)))
        return {lang: Shards(rows[0]["n_shards"], [(r["shard"], _shard(r)) for r in rows]) for lang, rows in by_lang.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = held(own, load)
        words: dict[tuple[str, str], Counter] = defaultdict(Counter)
        dense: dict[tuple[str, str], dict[int, np.ndarray]] = defaultdict(dict)

        def look_up() -> None:
            for (lang, source), counter in words.items():
                table = found.get(lang)
                if table is None:
                    continue
                terms = list(counter)
                data, at = buffers(pa.array(terms, pa.large_binary()))
                slot = table.find(data, at[:-1], at[1:])
                n = np.fromiter(counter.values(), np.int64, len(terms))[slot >= 0]
                slot = slot[slot >= 0]
                place = np.searchsorted(table.base, slot, "right") - 1
                order = np.argsort(place, kind="stable")
                bounds = np.searchsorted(place[order], np.arange(len(table.base) + 1))
                for k in np.flatnonzero(np.diff(bounds)):
                    own = order[bounds[k] : bounds[k + 1]]
                    mine = dense[lang, source]
                    if k not in mine:
                        mine[k] = np.zeros(table.size[k], np.int64)
                    mine[k][slot[own] - table.base[k]] += n[own]
            words.clear()

        def send() -> Iterator[pa.RecordBatch]:
            for (lang, source), arrays in dense.items():
                rows = [(lang, source, int(found[lang].number[k]), *packed(x)) for k, x in arrays.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int64()])], names=["lang", "source", "shard", "slots", "counts", "total"])
            dense.clear()

        n_held = 0
        for batch in batches:
            for lang, source, terms in _rows(batch):
                if lang not in found:
                    continue
                counter = words[lang, source]
                n_held -= len(counter)
                counter.update(terms)
                n_held += len(counter)
                if n_held > HELD:
                    look_up()
                    n_held = 0
                    if sum(len(x) for arrays in dense.values() for x in arrays.values()) > SLOTS:
                        yield from send()
        look_up()
        yield from send()

    return _texts(docs).mapInArrow(count, COUNTS)


def packed(dense: np.ndarray) -> tuple[bytes, bytes, int]:
    """Slots with counts and the counts, each in the least integers that hold the largest, and the counts' sum."""
    at = np.flatnonzero(dense)
    least = lambda top: np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    n = dense[at]
    return at.astype(np.uint16 if len(dense) <= 1 << 16 else np.uint32).tobytes(), n.astype(least(int(n.max(initial=0)))).tobytes(), int(n.sum())


def _unpacked(slots: bytes, counts: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(slots, np.uint16 if size <= 1 << 16 else np.uint32)
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(counts) // max(len(at), 1) or 1]
    return at.astype(np.int64), np.frombuffer(counts, kind).astype(np.int64)


def shares(counts: np.ndarray, total: np.ndarray | int, size: int, scale_digits: int = 9) -> np.ndarray:
    """1 + floor(10^digits * (counts + 1) / (total + size)), exact while total + size is under 9 * 10^15."""
    of = np.asarray(total, np.int64) + size
    whole, left = np.divmod(counts + 1, of)
    for _ in range(scale_digits // 3):
        more, left = np.divmod(left * 1000, of)
        whole = whole * 1000 + more
    return whole + 1


SCORES = "lang string, source string, part string, item string, value long"


def scored(rows: DataFrame, ranks: int) -> DataFrame:
    """SCORES of each (lang, shard): sums of a pair of sources over its terms, and each group's first terms.

    rows: (lang, shard, kind, ...), for each (lang, shard) one row of kind 0 (keys, ends, groups, size), then its COUNTS.
    """

    def done(head: dict, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
        lang, groups, size = head["lang"], head["groups"], head["size"]
        names, totals = [g["source"] for g in groups], np.array([g["total"] for g in groups], np.int64)
        p = shares(matrix, totals[:, None], size)
        if len(names) > 1:
            for i, name in enumerate(names):
                value = ((p[i] - p) ** 2 // p).sum(1)
                others = [j for j in range(len(names)) if j != i]
                yield _scores(lang, name, "pair", [names[j] for j in others], value[others])
        q = shares(matrix.sum(0), int(totals.sum()), size)
        keys, ends = head["keys"], np.frombuffer(head["ends"], np.int64)
        starts = np.append(0, ends[:-1])
        for i, name in enumerate(names):
            at = np.flatnonzero((matrix[i] > 0) & (p[i] > q))
            value = (p[i][at] - q[at]) ** 2 // q[at]
            if len(at) > ranks:  # all that reach the value of the last rank; ties are ordered later
                top = value >= np.partition(value, len(value) - ranks)[len(value) - ranks]
                at, value = at[top], value[top]
            if len(at):
                yield _scores(lang, name, "term", [keys[starts[s] : ends[s]].decode() for s in at], value)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, matrix, number = None, None, {}
        for b in batches:
            for r in b.to_pylist():
                if r["kind"] == 0:
                    if head:
                        yield from done(head, matrix)
                    head, number = r, {g["source"]: i for i, g in enumerate(r["groups"])}
                    matrix = np.zeros((len(number), len(r["ends"]) // 8), np.int64)
                else:
                    at, n = _unpacked(r["slots"], r["counts"], matrix.shape[1])
                    matrix[number[r["source"]], at] += n
        if head:
            yield from done(head, matrix)

    return rows.mapInArrow(stream, SCORES)


def _scores(lang: str, source: str, part: str, items: list[str], value: np.ndarray) -> pa.RecordBatch:
    n = len(items)
    return pa.record_batch({"lang": pa.array([lang] * n), "source": pa.array([source] * n), "part": pa.array([part] * n), "item": pa.array(items, pa.string()), "value": pa.array(value, pa.int64())})


def audited(docs: DataFrame, least: int = 3, ranks: int = 200, batch_bytes: int = BATCH_BYTES, per_shard: int = 4096) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of a language lie from each other, and their own terms."""
    spark = docs.sparkSession
    groups = checkpointed(_texts(docs.withColumn("text", F.lit(""))).select("lang", "source").distinct())
    kept = document_counts(docs).groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term")
    kept = checkpointed(kept)
    n_sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"))
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    each = F.greatest(F.lit(64), F.least(F.lit(per_shard), F.floor(F.lit(1 << 22) / F.col("n_sources"))))  # a matrix of 32 MB at most, for up to 65,536 sources
    sizes = checkpointed(n_sources.join(size, "lang").select("lang", "size", F.ceil(F.col("size") / each).cast("int").alias("n_shards")))
    shards = checkpointed(perfect_shards(kept, sizes.select("lang", "n_shards")))
    batches, filled = [[]], 0
    for r in shards.select("lang", "shard", "bytes").orderBy("lang", "shard").toLocalIterator():  # three numbers for each 4,096 terms
        if filled and filled + r["bytes"] > batch_bytes:
            batches, filled = [*batches, []], 0
        batches[-1].append((r["lang"], r["shard"]))
        filled += r["bytes"]
    counts = []
    for first, last in [(b[0], b[-1]) for b in batches if b]:
        key = F.struct("lang", "shard")
        bounds = [F.struct(F.lit(lang).alias("lang"), F.lit(shard).alias("shard")) for lang, shard in (first, last)]
        counts.append(checkpointed(recounted(docs, shards.where(key.between(*bounds)).collect())))
    counts = reduce(DataFrame.union, counts) if counts else spark.createDataFrame([], COUNTS)
    totals = groups.join(counts.groupBy("lang", "source").agg(F.sum("total").alias("total")), ["lang", "source"], "left")
    totals = totals.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    by_lang = checkpointed(totals.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("groups")).join(sizes, "lang"))
    heads = shards.select("lang", "shard", "keys", "ends").join(F.broadcast(by_lang) if _small(by_lang) else by_lang, "lang")
    none = lambda kind: F.lit(None).cast(kind)
    heads = heads.select("lang", "shard", F.lit(0).alias("kind"), none("string").alias("source"), "groups", "size", "keys", "ends", none("binary").alias("slots"), none("binary").alias("counts"))
    rows = heads.unionByName(counts.select("lang", "shard", F.lit(1).alias("kind"), "source", "slots", "counts"), allowMissingColumns=True)
    scores = checkpointed(scored(rows.repartition("lang", "shard").sortWithinPartitions("lang", "shard", "kind"), ranks))
    sums = scores.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.join(groups.withColumnRenamed("source", "item"), "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    terms = scores.where("part = 'term'").select("*", rank).where(F.col("rank") <= ranks)
    return pairs.select("*", rank).unionByName(terms)


def _small(by_lang: DataFrame) -> bool:
    return by_lang.agg(F.coalesce(F.sum(F.size("groups")), F.lit(0))).first()[0] * 100 <= BATCH_BYTES


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT k, lang, source, unnest(w) AS term FROM d),
v AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM t JOIN v USING (lang, term) GROUP BY ALL),
gt AS (SELECT lang, source, v.term, coalesce(n.n, 0) AS n FROM g JOIN v USING (lang) LEFT JOIN n USING (lang, source, term)),
size AS (SELECT lang, count(*) AS size FROM v GROUP BY lang),
p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + size) AS p
  FROM gt JOIN size USING (lang)),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + size) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM gt GROUP BY lang, term) JOIN size USING (lang)),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""
