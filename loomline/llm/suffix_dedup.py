"""Removal of repeated byte strings by suffix order.

Every byte of each `width`-byte string of one document that also starts anywhere else is removed.
Each string has a key, the least hash of its 16-byte grams. Strings in a row with one key make a
segment. Shards sketch their keys; only segments whose key stands in more than one place go on, to
the bucket of the key, each distinct one once with its weight. There the suffixes of all segments
that have a key in common with another are put in order by external induced sorting, which carries
common prefixes (see induced_sort), without the strings whose sums stand nowhere else; neighbours that share `width` bytes form groups, and a group of
more than one occurrence is repeated. The suffixes of a segment that is alone with its key can only
meet its own copies and are decided by its weight, unless the key's gram stands there more than
once; then they are sorted as the others.

A key of very many different segments (a line that a third of all documents hold among other text)
would put them all into one task. The shards count the kinds of segments of each key; the strings of
keys of over CROWDED kinds are not sorted but dealt out and grouped by 128 bits of their bytes.

Cases: null and empty texts stay as they are; shorter documents than `width` lose nothing; equal
rows are separate documents; a text of any length is taken whole, by one task at a time; strings never cross documents; where removal splits a character, its
rest is dropped from kept_text (the digest is of the bytes); an empty table gives an empty table;
columns named like results are replaced, others pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import exchange
from .common import packed, text_size, unpacked
from .hashing import SEPARATORS, U, blocks, buffers, byte_grams, cell_of, distinct, found_in, joined, mixed, runs, sliding
from .induced_sort import suffix_order

SHARD_BYTES, BUCKET_BYTES, LEAST = 4 << 20, 24 << 20, 64
GRAM = 16
#: Bytes of text looked at together: eight times as many stay near the core, also beside other tasks.
BLOCK = 1 << 17
#: Bytes of segments whose suffixes are sorted together; at most 17 times as many are on disk meanwhile.
SORTED = 4 << 20
#: Kinds of segments, summed over shards, beyond which the strings of a key are not sorted in one place.
CROWDED = 4096
SENT = "bucket int, shard int, keys binary, checks binary, twice binary, bytes binary"
#: Two random 64-bit values for each byte.
_RNG = np.random.default_rng(11)
_BYTE = [_RNG.integers(0, 1 << 63, 256, dtype=U) * U(2) + U(1) for _ in range(2)]
_PARTS = np.isin(np.arange(256), list(SEPARATORS))
#: An odd number, and the one that takes a multiplication by it back.
_STEP = U(0x9E3779B97F4A7C15)
_BACK = U(pow(int(_STEP), -1, 1 << 64))


def _runs(data: np.ndarray, offsets: np.ndarray, width: int, sketched: bool) -> tuple[np.ndarray, ...]:
    """(key, first start, end of starts) of each run of strings with one key.

    If sketched, also a hash of what tells its bytes from others', and at last the key of each gram that is the least of a string.
    """
    if len(data) < width:
        return tuple(np.zeros(0, kind) for kind in ((U, np.int64, np.int64, U, U) if sketched else (U, np.int64, np.int64)))
    grams = byte_grams(data, 1)
    least = sliding(grams, width - GRAM + 1)
    sizes = np.diff(offsets)
    short = np.minimum(sizes, width - 1)
    whole = np.repeat(np.tile([True, False], len(sizes)), np.stack([sizes - short, short], 1).ravel())[: len(least)]
    edge = np.ones(len(least) + 1, bool)
    edge[1:-1] = (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    own = whole[start]
    key, start, end = cell_of(least[start[own]]), start[own], end[own]
    if not sketched:
        return key, start, end
    top = np.zeros(len(grams) + 2 * (width - GRAM), U)
    np.copyto(top[width - GRAM : width - GRAM + len(least)], least, where=whole)
    anchors = grams[(sliding(top, width - GRAM + 1, np.maximum)[: len(grams)] == grams) & (grams != 0)]
    kind = joined(joined(key, grams[start] + (end - start).astype(U)), grams[end + width - 1 - GRAM])
    return key, start, end, kind, cell_of(anchors)


def _each(table: pa.Table, width: int, sketched: bool):
    data, offsets = buffers(table.column("text"))
    for i, j in blocks(offsets, BLOCK):
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        yield i, j, part, own, *_runs(part, own, width, sketched)


def _sketch(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a shard, whether each stands there twice, and how many kinds of segments have it."""
    found = [x[4:] for x in _each(table, width, True)]
    key, kind, anchors = (np.concatenate([np.zeros(0, U), *(x[c] for x in found)]) for c in (0, 3, 4))
    kind_keys, n_kinds = np.unique(key[np.unique(kind, return_index=True)[1]], return_counts=True)
    keys, n = np.unique(anchors, return_counts=True)
    at = found_in(keys, kind_keys)
    return keys, n >= 2, np.where(at >= 0, n_kinds[at], 0) if len(n_kinds) else n * 0


def _segments(table: pa.Table, hot: np.ndarray, crowded: np.ndarray, width: int):
    """Distinct (key, bytes) in order with their number; 128 bits of crowded strings; for each block its occurrences.

    An occurrence of a segment is its place among the distinct ones and its start; crowded strings have starts.
    """
    seen: dict[tuple[int, bytes], int] = {}
    found, bits = [], [(np.zeros(0, U), np.zeros(0, U))]
    for i, j, data, offsets, key, start, end in _each(table, width, False):
        at = found_in(key, hot)
        own = np.flatnonzero((at >= 0) & ~crowded[at] if len(hot) else at >= 0)
        raw = data.tobytes()
        named = [(k, raw[s : e + width - 1]) for k, s, e in zip(key[own].tolist(), start[own].tolist(), end[own].tolist())]
        for x in named:
            seen[x] = seen.get(x, 0) + 1
        many = np.flatnonzero((at >= 0) & crowded[at]) if len(hot) else own[:0]
        n = (end - start)[many]
        places = np.repeat(start[many] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        if len(places):  # their bytes in a row; strings begin in all but the last width - 1 of each run
            size = n + width - 1
            last = np.cumsum(size)
            own_data = data[np.repeat(start[many] - (last - size), size) + np.arange(last[-1])]
            at_own = np.repeat(last - size - (np.cumsum(n) - n), n) + np.arange(len(places))
            bits.append(tuple(mixed(runs(x[own_data], width)[at_own]) for x in _BYTE))
        found.append((i, j, data, offsets, named, start[own], places))
    order = sorted(seen)
    place = {x: k for k, x in enumerate(order)}
    one, two = (np.concatenate(x) for x in zip(*bits))
    return order, [seen[x] for x in order], one, two, [(i, j, data, o, np.array([place[x] for x in named], np.int64), s, p) for i, j, data, o, named, s, p in found]


def _send(shard: int, order: list, weights: list, n_buckets: int) -> pa.Table:
    keys = np.array([k for k, _ in order], U)
    bounds = np.searchsorted(exchange.bucket_of(keys, n_buckets), np.arange(n_buckets + 1)).tolist()
    rows = [b for b in range(n_buckets) if bounds[b] < bounds[b + 1]]
    sizes, heavy = np.array([len(x) for _, x in order], np.int64), np.array(weights, np.int64)
    cut = lambda x: pa.array([x[bounds[b] : bounds[b + 1]].tobytes() for b in rows], pa.binary())
    return pa.table(
        {
            "bucket": pa.array(rows, pa.int32()),
            "shard": pa.array([shard] * len(rows), pa.int32()),
            "keys": cut(keys),
            "checks": cut(sizes),
            "twice": cut(heavy),
            "bytes": pa.array([b"".join(x for _, x in order[bounds[b] : bounds[b + 1]]) for b in rows], pa.binary()),
        }
    )


def _send_bits(shard: int, one: np.ndarray, two: np.ndarray, more: np.ndarray, n_buckets: int) -> pa.Table:
    """Rows for the buckets behind those of segments."""
    sent = exchange.send(shard, one, two, more, n_buckets)
    behind = pa.array(sent.column("bucket").to_numpy() + n_buckets, pa.int32())
    return sent.set_column(0, "bucket", behind).append_column("bytes", pa.nulls(sent.num_rows, pa.binary()))


def _sums_meet(text: np.ndarray, starts: np.ndarray, weight: np.ndarray, width: int) -> np.ndarray:
    """Whether a string's polynomial of 64 bits is another's too; equal strings' always are, and others' may be."""
    if not len(starts):
        return np.zeros(0, bool)
    power = np.full(len(text) + 1, _STEP)
    power[0] = 1
    total = np.append(U(0), np.cumsum(_BYTE[0][text] * np.multiply.accumulate(power, out=power)[:-1]))
    sums = total[starts + width] - total[starts]
    power[1:], power[0] = _BACK, 1
    sums *= np.multiply.accumulate(power, out=power)[starts]
    order = np.argsort(sums)
    first = np.flatnonzero(np.append(True, np.diff(sums[order]) != 0))
    out = np.empty(len(starts), bool)
    out[order] = np.repeat(np.add.reduceat(weight[order], first) >= 2, np.diff(np.append(first, len(starts))))
    return out


def repeated_starts(segments: list[bytes], weights: list[int], width: int, **sort) -> list[np.ndarray]:
    """For each distinct segment which of its strings occur twice or more in all, by suffix order."""
    text = np.frombuffer(b"\xff".join(segments), np.uint8)
    sizes = np.array([len(s) for s in segments])
    first = np.cumsum(sizes + 1) - sizes - 1
    n = sizes - width + 1
    starts = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    weight = np.repeat(np.minimum(weights, 2), n)
    open_ = _sums_meet(text, starts, weight, width)
    found, at, heavy = np.zeros(len(starts), bool), starts[open_], weight[open_]
    if len(at):
        run = np.flatnonzero(np.append(True, np.diff(at) != 1))
        n_run = np.diff(np.append(run, len(at)))
        text = np.concatenate([np.append(text[a : a + k + width - 1], np.uint8(255)) for a, k in zip(at[run].tolist(), n_run.tolist())])
        base = np.cumsum(n_run + width) - (n_run + width)
        at = np.repeat(base - run, n_run) + np.arange(len(at))
        order, prefix = suffix_order(text, width, **sort)
        apart = np.append(0, np.cumsum(prefix < width))[1:]  # suffixes that share width bytes are in a row
        place = np.full(len(text), -1)
        place[at] = np.arange(len(at))
        place = place[order]
        own = place >= 0
        place, apart = place[own], apart[own]
        group = np.flatnonzero(np.append(True, apart[1:] != apart[:-1]))
        total = np.add.reduceat(heavy[place], group)
        meets = np.zeros(len(at), bool)
        meets[place] = np.repeat(total >= 2, np.diff(np.append(group, len(place))))
        found[open_] = meets
    return np.split(found, np.cumsum(n)[:-1])


def _once(segment: bytes) -> bool:
    """Whether the key's gram stands once in the segment: then no two of its strings are equal."""
    grams = byte_grams(np.frombuffer(segment, np.uint8), 1)
    return np.count_nonzero(grams == grams.min()) == 1


def _answer(sent: pa.Table, width: int) -> pa.Table:
    total: dict[tuple[int, bytes], int] = {}
    rows = []
    for row in sent.to_pylist():
        at, own = 0, []
        for k, size, w in zip(*(np.frombuffer(row[c], t).tolist() for c, t in (("keys", U), ("checks", np.int64), ("twice", np.int64)))):
            x = (k, row["bytes"][at : at + size])
            at += size
            total[x] = total.get(x, 0) + w
            own.append(x)
        rows.append(own)
    by_key: dict[int, list[bytes]] = {}
    for k, x in total:
        by_key.setdefault(k, []).append(x)
    answer: dict[tuple[int, bytes], np.ndarray] = {}
    batch: list[tuple[int, bytes]] = []

    def flush() -> None:
        if batch:
            answer.update(zip(batch, repeated_starts([x for _, x in batch], [total[x] for x in batch], width)))
            batch.clear()

    held = 0
    for k, xs in by_key.items():
        if len(xs) == 1 and _once(xs[0]):
            answer[k, xs[0]] = np.full(len(xs[0]) - width + 1, total[k, xs[0]] >= 2)
            continue
        batch += [(k, x) for x in xs]
        held += sum(map(len, xs))
        if held > SORTED:
            flush()
            held = 0
    flush()
    return pa.table(
        {
            "shard": sent.column("shard"),
            "bucket": sent.column("bucket"),
            "repeated": pa.array([np.packbits(np.concatenate([answer[x] for x in own])).tobytes() for own in rows], pa.binary()),
        }
    )


def _without_short(gone: np.ndarray, data: np.ndarray, least_words: int) -> np.ndarray:
    """gone without the runs that hold fewer than least_words beginnings of words."""
    parts = _PARTS[data]
    begins = ~parts & np.append(True, parts[:-1] | ~gone[:-1])
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    so_far = np.append(0, np.cumsum(begins))[edge]
    out = gone.copy()
    for a, b in edge.reshape(-1, 2)[so_far[1::2] - so_far[::2] < least_words].tolist():
        out[a:b] = False
    return out


def _finish(table: pa.Table, sizes: np.ndarray, found: list, hits: np.ndarray, crowd: np.ndarray, width: int, least_words: int) -> pa.Table:
    """hits: which strings of the distinct segments, of so many strings each, are repeated; crowd: the same of the crowded strings."""
    n_bytes, removed, spans, kept, digests = [], [], [], [], []
    first, before, null = np.cumsum(sizes) - sizes, 0, table.column("text").is_null().to_pylist()
    for i, j, data, offsets, places, starts, many in found:
        raw = data.tobytes()
        edge = np.zeros(len(data) + 1, np.int32)
        many_hit = many[crowd[before : before + len(many)]]
        before += len(many)
        n = sizes[places]
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        nth, begin = nth[own := hits[np.repeat(first[places], n) + nth]], np.repeat(starts, n)[own]
        for at in (many_hit, begin + nth):
            edge[at] += 1
            edge[at + width] -= 1  # starts of different runs differ, so no place is added to twice at once
        covered = np.cumsum(edge[:-1]) > 0
        so_far = np.append(0, np.cumsum(covered))
        for d in range(j - i):
            a, b = int(offsets[d]), int(offsets[d + 1])
            text, count, n_spans = raw[a:b], int(so_far[b] - so_far[a]), 0
            if count:
                gone = covered[a:b]
                if least_words:
                    gone = _without_short(gone, data[a:b], least_words)
                    count = int(np.count_nonzero(gone))
                if count:
                    n_spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
                    text = data[a:b][~gone].tobytes()
            n_bytes.append(b - a)
            removed.append(count)
            spans.append(n_spans)
            kept.append(None if null[i + d] else text.decode("utf-8", "ignore").encode() if count else text)
            digests.append(hashlib.sha256(text).hexdigest())
    return pa.table(
        {
            "text": table.column("text"),
            "rest": table.column("rest"),
            "kept_text": pa.array(kept, pa.string()),
            "n_bytes": pa.array(n_bytes, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(spans, pa.int64()),
            "kept_sha256": pa.array(digests, pa.string()),
        }
    )


RESULTS = ["kept_text", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def remove_repeated_strings(docs: DataFrame, width: int = 400, text_col: str = "text", least_words: int = 0, crowded: int = CROWDED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with kept_text (null stays null), n_bytes, n_removed, n_spans and kept_sha256 (of the remaining bytes).

    least_words: runs of repeated bytes in which fewer words begin stay. crowded: see above; bucket_bytes: text whose keys
    one task sorts, about; neither changes the result.
    """
    if width < GRAM:
        raise ValueError(f"width must be at least {GRAM}")
    _, size = text_size(docs, text_col)
    n_shards, n_buckets = max(LEAST, size // SHARD_BYTES), max(LEAST, size // bucket_bytes)
    shards = packed(docs, text_col, n_shards)

    def keys_sent(table: pa.Table) -> pa.Table:
        keys, two, kinds = _sketch(table, width)
        return exchange.send(table.column("shard")[0].as_py(), keys, kinds.astype(U), two, n_buckets)

    def segments(table: pa.Table, hot: pa.Table):
        """Of the rows of `hot`: keys that stand in more than one place, and which of them are crowded."""
        own = hot.filter(pa.array(hot.column("step").to_numpy() == 0)) if "step" in hot.column_names else hot
        keys = np.concatenate([np.zeros(0, U), *(np.frombuffer(x, U) for x in own.column("repeated").to_pylist())])
        many = np.concatenate([np.zeros(0, bool), *(np.frombuffer(x, bool) for x in own.column("many").to_pylist())])
        by = np.argsort(keys)
        return _segments(table, keys[by], many[by], width)

    def segments_sent(table: pa.Table, hot: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _send(0, [], [], n_buckets)
        order, weights, one, two, _ = segments(table, hot)
        shard = table.column("shard")[0].as_py()
        first, second, more, _ = distinct(one, two)
        return pa.concat_tables([_send(shard, order, weights, n_buckets), _send_bits(shard, first, second, more, n_buckets)])

    def answered(sent: pa.Table) -> pa.Table:
        return _answer(sent, width) if sent.column("bucket")[0].as_py() < n_buckets else exchange.answer(sent)

    def finished(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _finish(table, np.zeros(0, np.int64), [], np.zeros(0, bool), np.zeros(0, bool), width, least_words)
        order, _, one, two, found = segments(table, answers)
        bits = dict(zip(*(answers.filter(pa.array(answers.column("step").to_numpy() == 1)).column(c).to_pylist() for c in ("bucket", "repeated"))))
        n = np.array([len(x) - width + 1 for _, x in order], np.int64)
        bucket = exchange.bucket_of(np.array([k for k, _ in order], U), n_buckets)
        hits = [np.zeros(0, bool)]  # buckets go up with the keys
        for b in np.unique(bucket).tolist():
            hits.append(np.unpackbits(np.frombuffer(bits[b], np.uint8), count=int(n[bucket == b].sum())).astype(bool))
        first, _, _, place = distinct(one, two)
        crowd = np.zeros(len(first), bool)
        at = exchange.bucket_of(first, n_buckets)
        for b in np.unique(at).tolist():
            crowd[at == b] = np.unpackbits(np.frombuffer(bits[b + n_buckets], np.uint8), count=int((at == b).sum())).astype(bool)
        return _finish(table, n, found, np.concatenate(hits), crowd[place], width, least_words)

    keys = exchange.repeated_keys(shards.groupBy("shard").applyInArrow(keys_sent, exchange.SENT), crowded)
    sent = shards.groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(segments_sent, SENT)
    found = sent.groupBy("bucket").applyInArrow(answered, exchange.ANSWER).withColumn("many", F.lit(None).cast("binary"))
    answers = keys.withColumn("step", F.lit(0)).unionByName(found.withColumn("step", F.lit(1)))
    long = [T.StructField(c, T.LongType()) for c in RESULTS[1:4]]
    schema = T.StructType([*shards.schema.fields[1:], T.StructField("kept_text", T.StringType()), *long, T.StructField("kept_sha256", T.StringType())])
    out = shards.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(finished, schema)
    return unpacked(out, docs, text_col, RESULTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeated_strings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
