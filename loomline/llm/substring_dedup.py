"""Removal of repeated word windows, with a count-min prefilter.

A window is `width` consecutive words of one document; every word of each window whose words also
start anywhere else is removed. Each window has an anchor, the least hash of its short grams, so a
window stands at most as often as its anchor does. First pass: each shard of documents counts its
anchors in a count-min sketch of ROWS rows; the shards' sketches are merged by adding cells, range by
range, and an anchor's estimate is the least of its cells, never less than its count. Second pass:
only windows whose anchor is estimated at two or more are grouped exactly, by 128 bits of their
words. Nothing repeated is lost. The sketch's width grows with the text (a cell for CELL_BYTES to
twice as many bytes), and shards send filled cells only.

Cases: null and empty texts have no words and stay as they are; documents of fewer words than a
window lose none; equal rows are separate documents, so their windows repeat; a text of any length is taken whole,
as one document of its shard; an empty table gives
an empty table; columns named like results are replaced, others pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import exchange
from .common import packed, text_size, unpacked
from .hashing import U, blocks, buffers, cell_of, distinct, found_in, mixed, runs, sliding, word_hashes, word_spans

#: Bytes of text that a shard, and that the hashes of a bucket, come from.
SHARD_BYTES, BUCKET_BYTES, LEAST = 4 << 20, 128 << 20, 64
GRAM = 8
ROWS, CELL_BYTES = 2, 16
SKETCH = "bucket int, shard int, cells binary, counts binary"
FULL = "shard int, bucket int, full binary"


class CountMin:
    """Where keys are counted: ROWS rows of 2^bits cells, each row in ranges of 2^part cells."""

    def __init__(self, text_bytes: int, n_ranges: int) -> None:
        self.bits = max(10, int(text_bytes // CELL_BYTES).bit_length())
        self.part = max(0, self.bits - (max(1, n_ranges) - 1).bit_length())
        self.ranges = 1 << self.bits - self.part

    def cells(self, keys: np.ndarray, row: int) -> np.ndarray:
        return cell_of(keys, row + 1) >> U(64 - self.bits)

    def sketch(self, keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The filled cells of each row, in order, and their counts."""
        return [np.unique(self.cells(keys, row), return_counts=True) for row in range(ROWS)]

    def send(self, shard: int, keys: np.ndarray) -> pa.Table:
        """Rows of SKETCH: a range of a row's cells each."""
        out: dict[str, list] = {"bucket": [], "shard": [], "cells": [], "counts": []}
        for row, (cells, counts) in enumerate(self.sketch(keys)):
            edge = np.searchsorted(cells >> U(self.part), np.arange(self.ranges + 1, dtype=U))
            for r in np.flatnonzero(np.diff(edge)).tolist():
                own = slice(edge[r], edge[r + 1])
                out["bucket"].append(row * self.ranges + r)
                out["shard"].append(shard)
                out["cells"].append((cells[own] & U((1 << self.part) - 1)).astype(np.uint32).tobytes())
                out["counts"].append(counts[own].astype(np.uint32).tobytes())
        kinds = {"bucket": pa.int32(), "shard": pa.int32(), "cells": pa.binary(), "counts": pa.binary()}
        return pa.table({c: pa.array(x, kinds[c]) for c, x in out.items()})

    def estimated_twice(self, keys: np.ndarray, full: pa.Table) -> np.ndarray:
        """Whether each key's estimate, the least of its merged cells, is two or more; full: rows of FULL."""
        bucket, held = full.column("bucket").to_pylist(), full.column("full").to_pylist()
        out = np.ones(len(keys), bool)
        for row in range(ROWS):
            own = sorted((b, x) for b, x in zip(bucket, held) if b // self.ranges == row)
            base = [np.frombuffer(x, np.uint32).astype(U) + U((b % self.ranges) << self.part) for b, x in own]
            out &= found_in(self.cells(keys, row), np.concatenate([np.zeros(0, U), *base])) >= 0
        return out


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Counts by cell of a range, of all shards' (cells, counts)."""
    cells, counts = (np.concatenate(x) for x in zip(*parts))
    return np.bincount(cells, counts.astype(float))


def merged(sketches: DataFrame) -> DataFrame:
    """For each row of SKETCH those of its cells whose merged count is two or more (FULL)."""

    def merge(sent: pa.Table) -> pa.Table:
        cells, counts = ([np.frombuffer(x, np.uint32) for x in sent.column(c).to_pylist()] for c in ("cells", "counts"))
        total = added(list(zip(cells, counts)))
        full = pa.array([c[total[c] >= 2].tobytes() for c in cells], pa.binary())
        return pa.table({"shard": sent.column("shard"), "bucket": sent.column("bucket"), "full": full})

    return sketches.groupBy("bucket").applyInArrow(merge, FULL)


class Block:
    """Words, windows and anchors of some documents. A document's windows are in one stretch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int) -> None:
        self.starts, self.ends, self.first = word_spans(data, offsets)
        self.width, gram = width, min(GRAM, width)
        self.words = word_hashes(data, self.starts, self.ends, 1)
        n = len(self.words)
        #: Windows are named by their first word; those that would cross into the next document don't count.
        whole = np.zeros(max(n - width + 1, 0), bool)
        doc_end = np.repeat(self.first[1:], np.diff(self.first))
        if len(whole):
            whole[:] = np.arange(len(whole)) + width <= doc_end[: len(whole)]
        self.windows = np.flatnonzero(whole)
        grams = mixed(runs(self.words, gram))
        self.least = sliding(grams, width - gram + 1)
        #: A gram is an anchor if it is the least of a window within its document.
        top = np.zeros(len(grams) + 2 * (width - gram), U)
        low = self.least.copy()
        low[~whole] = U(0)
        top[width - gram : width - gram + len(low)] = low
        self.anchors = grams[(sliding(top, width - gram + 1, np.maximum)[: len(grams)] == grams) & (grams != 0)]

    def window_hashes(self, at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the windows at the given first words."""
        other = word_hashes(data, self.starts, self.ends, 2)
        return mixed(runs(self.words, self.width))[at], mixed(runs(other, self.width))[at]


def _each(table: pa.Table, width: int):
    data, offsets = buffers(table.column("text"))
    for i, j in blocks(offsets):
        part = data[offsets[i] : offsets[j]]
        yield i, j, part, Block(part, offsets[i : j + 1] - offsets[i], width)


def _anchors(table: pa.Table, width: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, U), *(b.anchors for _, _, _, b in _each(table, width))])


def _candidates(table: pa.Table, sketch: CountMin, full: pa.Table, width: int):
    """For each block its documents, words, candidate windows and their 128 bits."""
    for i, j, data, block in _each(table, width):
        least = block.least[block.windows]
        head = np.flatnonzero(np.append(True, least[1:] != least[:-1])) if len(least) else np.zeros(0, np.int64)
        twice = sketch.estimated_twice(least[head], full)
        at = block.windows[np.repeat(twice, np.diff(np.append(head, len(least))))]
        one, two = block.window_hashes(at, data) if len(at) else (np.zeros(0, U), np.zeros(0, U))
        yield i, j, data, block, at, one, two


def _finish(table: pa.Table, windows: list, repeated: np.ndarray, width: int) -> pa.Table:
    """Each document of a shard with its words counted, and without the covered ones."""
    n_words, n_removed, kept, digests = [], [], [], []
    before = 0
    texts = table.column("text").to_pylist()
    for i, j, data, block, at, _, _ in windows:
        hit = at[repeated[before : before + len(at)]]
        before += len(at)
        edge = np.zeros(len(block.words) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + width, -1)
        covered = np.cumsum(edge[:-1]) > 0
        removed = np.concatenate([[0], np.cumsum(covered)])[block.first]
        for d in range(j - i):
            a, b = block.first[d], block.first[d + 1]
            gone = int(removed[d + 1] - removed[d])
            words = (texts[i + d] or "").encode("utf-8", "surrogatepass")
            if gone == b - a:
                text = b""
            else:
                words = words.split()
                text = b" ".join([words[x] for x in np.flatnonzero(~covered[a:b])] if gone else words)
            n_words.append(int(b - a))
            n_removed.append(gone)
            kept.append(text)
            digests.append(hashlib.sha256(text).hexdigest())
    return pa.table(
        {
            "text": table.column("text"),
            "rest": table.column("rest"),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept_sha256": pa.array(digests, pa.string()),
        }
    )


RESULTS = ["kept_text", "n_words", "n_removed", "kept_sha256"]


def remove_repeated_windows(docs: DataFrame, width: int = 35, text_col: str = "text") -> DataFrame:
    """docs with kept_text (kept words joined by one space), n_words, n_removed, kept_sha256."""
    _, size = text_size(docs, text_col)
    n_shards, n_buckets = max(LEAST, size // SHARD_BYTES), max(LEAST, size // BUCKET_BYTES)
    shards = packed(docs, text_col, n_shards)

    sketch = CountMin(size, n_buckets)

    def counted(table: pa.Table) -> pa.Table:
        return sketch.send(table.column("shard")[0].as_py(), _anchors(table, width))

    def windows_sent(table: pa.Table, full: pa.Table) -> pa.Table:
        if not table.num_rows:
            return exchange.send(0, np.zeros(0, U), np.zeros(0, U), np.zeros(0, bool), n_buckets)
        found = list(_candidates(table, sketch, full, width))
        one, two, more, _ = distinct(np.concatenate([x[5] for x in found]), np.concatenate([x[6] for x in found]))
        return exchange.send(table.column("shard")[0].as_py(), one, two, more, n_buckets)

    def finished(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _finish(table, [], np.zeros(0, bool), width)
        step = answers.column("step").to_numpy()
        found = list(_candidates(table, sketch, answers.filter(pa.array(step == 0)), width))
        one, _, _, place = distinct(np.concatenate([x[5] for x in found]), np.concatenate([x[6] for x in found]))
        repeated = exchange.read_answer(answers.filter(pa.array(step == 1)), one, n_buckets)
        return _finish(table, found, repeated[place], width)

    full = merged(shards.groupBy("shard").applyInArrow(counted, SKETCH))
    windows = exchange.answered(shards.groupBy("shard").cogroup(full.groupBy("shard")).applyInArrow(windows_sent, exchange.SENT))
    answers = full.withColumn("step", F.lit(0)).unionByName(windows.withColumn("step", F.lit(1)), allowMissingColumns=True)
    schema = T.StructType(
        [
            *shards.schema.fields[1:],
            T.StructField("kept_text", T.StringType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept_sha256", T.StringType()),
        ]
    )
    out = shards.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(finished, schema)
    return unpacked(out, docs, text_col, RESULTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeated_windows(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT k, p, array_to_string(w[p:p + 34], ' ') AS line FROM (SELECT k, w, unnest(range(1, len(w) - 33)) AS p FROM d)),
r AS (SELECT k, p FROM s WHERE line IN (SELECT line FROM s GROUP BY line HAVING count(*) > 1)),
c AS (SELECT DISTINCT k, unnest(range(p, p + 35)) AS p FROM r),
e AS (SELECT k, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
g AS (SELECT e.k, string_agg(word, ' ' ORDER BY e.p) FILTER (c.p IS NULL) AS kept, count(c.p) AS n FROM e LEFT JOIN c ON c.k = e.k AND c.p = e.p GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (k)
"""
