"""Decisions that depend on earlier decisions: per-group or per-row kernels inside Arrow batches."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import singledispatch

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .groups import each_group
from .seams import longest_subsequence

#: Bytes of phrases that are sent to all tasks at most.
SMALL_BYTES = 24 << 20
#: Lists of words that Python holds at once.
LISTS = 1024


def _per_row(rows: DataFrame, run, new: str) -> DataFrame:
    """rows with the columns `new` (DDL) that run gives for each row's record, in Arrow batches."""
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(new).fields])
    names = [f.name for f in T.StructType.fromDDL(new).fields]

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [run(r) for r in part.to_dict("records")]
            for i, name in enumerate(names):
                part[name] = [x[i] for x in found]
            yield part

    return rows.mapInPandas(batches, schema)


def select_marks(frames: DataFrame, key: str, frame: str, score: str, budget: int, least_gap: int) -> DataFrame:
    """Frames by score (earliest of equals), none nearer than least_gap to one taken, at most `budget` for a key; look: half way to the next, or to the key's last frame.

    Frames without a positive score can't be taken. Those that are least_gap or more apart from all others can't exclude each other: runs of near ones are
    settled apart, so a long recording is many small groups; the budget is then a rank by score, as frames are taken in that order.
    """
    w = Window.partitionBy(key).orderBy(frame)
    good = frames.where(F.col(score) > 0).select(key, frame, score)
    far = F.coalesce(F.col(frame) - F.lag(frame).over(w) >= least_gap, F.lit(True))
    good = good.withColumn("__new", far.cast("int")).withColumn("__run", F.sum("__new").over(w)).drop("__new")

    def pick(part: list[tuple]) -> list[tuple]:
        taken: list[int] = []
        for row in part:
            f, i = row[1], bisect_left(taken, row[1])
            if (i == 0 or f - taken[i - 1] >= least_gap) and (i == len(taken) or taken[i] - f >= least_gap):
                taken.insert(i, f)
        chosen = set(taken)
        return [r[:3] for r in part if r[1] in chosen]

    kind = dict(frames.dtypes)
    picked = each_group(good, [key, "__run"], [F.desc(score), frame], pick, f"{key} {kind[key]}, {frame} {kind[frame]}, {score} {kind[score]}")
    best = Window.partitionBy(key).orderBy(F.desc(score), frame)
    picked = picked.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= budget)
    ends = frames.groupBy(key).agg(F.max(frame).alias("__end"))
    return picked.join(ends, key).select(key, frame, ((F.col(frame) + F.coalesce(F.lead(frame).over(w), "__end")) / 2).alias("look"))


def keep_changed(frames: DataFrame, key: str, order: str, bits: str, least: int) -> DataFrame:
    """Frames that differ from the last kept one in over `least` bits; the first is kept."""

    def keep(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        kept, last = [], None
        for x in part[bits].tolist():
            kept.append(last is None or ((x ^ last) & (1 << 64) - 1).bit_count() > least)
            last = x if kept[-1] else last
        return part[kept]

    return frames.groupBy(key).applyInPandas(keep, frames.schema)


def differing(rows: DataFrame, a: str, b: str) -> DataFrame:
    """only_a and only_b: places of words of either that a longest common subsequence leaves out."""

    def find(r: dict) -> tuple[list[int], list[int]]:
        number: dict[str, int] = {}
        x, y = (np.array([number.setdefault(w, len(number)) for w in r[c]], int) for c in (a, b))
        pairs = longest_subsequence((x[:, None] == y)[::-1, ::-1].T) if len(x) and len(y) else []  # read from the start, rows first
        return sorted(set(range(len(x))) - {len(x) - 1 - i for _, i in pairs}), sorted(set(range(len(y))) - {len(y) - 1 - j for j, _ in pairs})

    return _per_row(rows, find, "only_a array<int>, only_b array<int>").drop(a, b)


@singledispatch
def repeats(words: list[str], times: list[float], within: float, least: int = 3) -> list[tuple[int, int]]:
    """(place, size) of runs that were said just before: `least` words or more, begun no later than `within` after
    the first saying, which they don't overlap. A word is part of one repeat at most; the earlier first saying goes first."""
    places: dict[tuple[str, ...], list[int]] = {}
    for j in range(len(words) - least + 1):
        places.setdefault(tuple(words[j : j + least]), []).append(j)
    found, taken = [], set()
    for i in range(len(words) - least + 1):
        mine = places[tuple(words[i : i + least])]
        for j in mine[bisect_left(mine, i + least) :]:
            if times[j] - times[i] > within:
                break
            room = range(min(j - i, len(words) - j))
            size = next((k for k in room if words[i + k] != words[j + k] or j + k in taken), len(room))
            if size >= least:
                taken.update(range(j, j + size))
                found.append((j, size))
                break
    return found


def echoes(rows: DataFrame, words: str, times: str, within: float) -> DataFrame:
    """echoes: the repeats in each row's words."""
    run = lambda r: ([{"place": j, "size": n} for j, n in repeats(list(r[words]), list(r[times]), within)],)
    return _per_row(rows, run, "echoes array<struct<place:int,size:int>>").drop(words, times)


def clips(spans: list[tuple[float, float]], frames: list[tuple[float, float]], most: float) -> list[tuple[float, float]]:
    """Spans as clips of at most `most`: longer ones are cut at the frame (time, score) of least score in the back
    half of the reach, the first of equals, or evenly where there is none; then neighbours are put together while they fit.
    """
    at = [t for t, _ in frames]
    starts: list[float] = []
    ends: list[float] = []
    for a, b in spans:
        edges = [a]
        while b - edges[-1] > most:
            a = edges[-1]
            reach = frames[bisect_left(at, a + most / 2) : bisect_right(at, a + most)]
            edges.append(min(reach, key=lambda f: f[1])[0] if reach else a + (b - a) / math.ceil((b - a) / most))
        starts += edges
        ends += [*edges[1:], b]
    out, k = [], 0
    while k < len(starts):  # ends rise, so the pieces that fit with this one are those up to a bound
        last = max(k + 1, bisect_right(ends, starts[k] + most))
        out.append((starts[k], ends[last - 1]))
        k = last
    return out


def speech_clips(spans: DataFrame, frames: DataFrame, key: str, most: float) -> DataFrame:
    """key, start, end of the clips of each key's spans (start, end), cut by its frames (t, value). A key is one recording."""

    def cut(own: pd.DataFrame, scored: pd.DataFrame) -> pd.DataFrame:
        own, scored = own.sort_values("start"), scored.sort_values(["t", "value"])
        found = clips(list(zip(own["start"], own["end"])), list(zip(scored["t"], scored["value"])), most)
        return pd.DataFrame({key: own[key].iloc[0] if len(own) else [], "start": [float(a) for a, _ in found], "end": [float(b) for _, b in found]})

    kind = dict(spans.dtypes)[key]
    return spans.groupBy(key).cogroup(frames.groupBy(key)).applyInPandas(cut, f"{key} {kind}, start double, end double")


def with_fnv(rows: DataFrame, text: str) -> DataFrame:
    """words_hash: 32-bit FNV-1a (hexadecimal) of the text with its spaces as one."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    bytes_ = F.regexp_extract_all(F.hex(F.encode(F.array_join(words, " "), "UTF-8")), F.lit(".."), F.lit(0))
    start = F.lit(0x811C9DC5).cast("long")
    h = F.aggregate(bytes_, start, lambda h, x: (h.bitwiseXOR(F.conv(x, 16, 10).cast("long")) * 0x01000193) % (1 << 32))
    return rows.withColumn("words_hash", F.lower(F.lpad(F.hex(h), 8, "0"))).drop(text)


def find_phrases(docs: DataFrame, phrases: DataFrame, text: str, most: int) -> DataFrame:
    """doc_id, first, size and entry of phrases (phrase, entry) in texts, the longest at each place, left to right.

    Places meet phrases by their first word and are compared at once, so only finds are shuffled; a document's finds are settled in one row.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    each = docs.select("doc_id", words.alias("w")).where(F.size("w") > 0).select("doc_id", F.explode(F.transform("w", lambda _, i: F.struct(i.alias("first"), F.slice("w", i + 1, F.lit(most)).alias("run")))).alias("x"))
    each = each.select("doc_id", "x.first", "x.run", F.get("x.run", F.lit(0)).alias("head"))
    listed = phrases.select("phrase", "entry", F.split("phrase", " ").alias("p")).select("phrase", "entry", F.size("p").alias("size"), F.get("p", F.lit(0)).alias("head")).where(F.col("size") <= most)
    rows, letters = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0))).first()
    listed = F.broadcast(listed) if 2 * letters + 64 * rows <= SMALL_BYTES else listed  # beyond, texts meet phrases by shuffles on the first word
    met = each.join(listed, "head").where(F.array_join(F.slice("run", 1, F.col("size")), " ") == F.col("phrase"))
    found = met.groupBy("doc_id", "first").agg(F.max(F.struct("size", "entry")).alias("m"))
    own = F.sort_array(F.collect_list(F.struct("first", F.col("m.size").alias("size"), F.col("m.entry").alias("entry"))))
    start = F.array().cast("array<struct<first:int,size:int,entry:bigint>>")
    free = lambda a, x: (F.size(a) == 0) | (F.element_at(a, -1)["first"] + F.element_at(a, -1)["size"] <= x["first"])
    kept = F.aggregate("all", start, lambda a, x: F.when(free(a, x), F.concat(a, F.array(x))).otherwise(a))
    out = found.groupBy("doc_id").agg(own.alias("all")).select("doc_id", F.explode(kept).alias("x"))
    return out.select("doc_id", F.col("x.first").cast("long").alias("first"), "x.size", "x.entry")


def _per_list(rows: DataFrame, words: str, run: Callable[[pa.RecordBatch, pa.Array, np.ndarray], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """What run gives for LISTS rows at once: their other columns, all their words as one array, and each row's first place there with the end behind."""
    rest = [c for c in rows.columns if c != words]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for i in range(0, whole.num_rows, LISTS):
                part = whole.slice(i, LISTS)
                lists = part.column(words)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                yield run(part.select(rest), pc.list_flatten(lists), np.append(0, np.cumsum(sizes)).astype(np.int64))

    return rows.mapInArrow(batches, schema)


def token_words(rows: DataFrame, words: str, size: int) -> DataFrame:
    """A row for each word of the lists: its number g (from 1), its n tokens of up to `size` letters, the first one's place in the row, and the word itself.

    Spaces before a word (space, tab, return) belong to its first token.
    """
    rest = [f for f in rows.schema.fields if f.name != words]
    schema = T.StructType([*rest, *T.StructType.fromDDL("g long, n long, first long, word string").fields])

    def run(others: pa.RecordBatch, flat: pa.Array, at: np.ndarray) -> pa.RecordBatch:
        letters = pc.utf8_length(pc.utf8_ltrim(flat, " \t\r")).to_numpy(zero_copy_only=False).astype(np.int64)
        n = -(-letters // size)
        before = np.append(0, np.cumsum(n))
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        g, first = np.arange(len(n)) - at[row] + 1, before[:-1] - before[at[row]]
        return pa.RecordBatch.from_arrays([*others.take(pa.array(row)).columns, *(pa.array(x, pa.int64()) for x in (g, n, first)), flat], names=schema.names)

    return _per_list(rows, words, run, schema)


def _longest(chain: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """The most members of a chain in each row, where chain says of each but the first member whether it goes on with the one before."""
    out = np.zeros(n_rows, np.int64)
    start = np.flatnonzero(np.append(True, ~chain)) if len(row) else np.zeros(0, np.int64)
    np.maximum.at(out, row[start], np.diff(np.append(start, len(row))))
    return out


@repeats.register(DataFrame)
def repeats_of_rows(rows: DataFrame, words: str) -> DataFrame:
    """rows with longest, the longest run of one word, and phrase, how often the first two words (the only one, of one) are said back to back at most,
    read from the left, in place of their lists of one word or more."""
    rest = [f for f in rows.schema.fields if f.name != words]
    schema = T.StructType([*rest, *T.StructType.fromDDL("longest long, phrase long").fields])

    def run(others: pa.RecordBatch, flat: pa.Array, at: np.ndarray) -> pa.RecordBatch:
        word = pc.dictionary_encode(flat).indices.to_numpy(zero_copy_only=False)
        sizes, n_rows = np.diff(at), len(at) - 1
        row = np.repeat(np.arange(n_rows), sizes)
        longest = _longest((word[1:] == word[:-1]) & (row[1:] == row[:-1]), row, n_rows)
        one, two = word[at[:-1]], word[np.minimum(at[:-1] + 1, len(word) - 1)]
        here = np.flatnonzero((word[:-1] == one[row[:-1]]) & (word[1:] == two[row[:-1]]) & (row[1:] == row[:-1]))
        pairs = _longest((here[1:] - here[:-1] == 2) & (row[here[1:]] == row[here[:-1]]), row[here], n_rows)
        own = np.flatnonzero(word == one[row])
        runs = _longest((own[1:] - own[:-1] == 1) & (row[own[1:]] == row[own[:-1]]), row[own], n_rows)
        phrase = np.where(sizes == 1, 1, np.where(one == two, runs // 2, pairs))  # a phrase of two equal words: each second place of a run
        return pa.RecordBatch.from_arrays([*others.columns, pa.array(longest), pa.array(phrase.astype(np.int64))], names=schema.names)

    return _per_list(rows, words, run, schema)
