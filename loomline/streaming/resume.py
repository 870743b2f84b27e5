"""Chunk readings of unbounded recordings merged as they come, with state by recording that survives a restart.

State is what a later chunk can still change, nothing more: the tokens within the overlap of the next chunk's beginning, how many
were given out before, where the next chunk begins, chunks that came too early, and the fingerprint of the run. A
restart from the same checkpoint folder goes on where the stream stopped. A chunk that begins before the next one is due
was merged already and is skipped; a chunk of another run (its fingerprint differs) starts the recording over, and a
row says what has changed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.seams import folded

#: What a fingerprint's parts are, for people; a part that isn't here is the engine's own.
PARTS = {
    "content_id": "the recording has other contents",
    "total_samples": "the audio has another length",
    "model_id": "another model",
    "chunk_s": "another length of chunks",
    "overlap_s": "another overlap of chunks",
    "language": "another language",
    "prompt": "another prompt",
}
ENGINE, FORMAT = "another engine", "written in another format"
OUT = "rec long, run long, place long, word string, start double, end double, note string"


def mismatch(stored: dict[str, str], expected: dict[str, str]) -> str | None:
    """What differs between two fingerprints, each part named; where the format (schema) does, only that."""
    odd = sorted(k for k in stored.keys() | expected.keys() if stored.get(k) != expected.get(k))
    if "schema" in odd:
        return f"{FORMAT} (schema)"
    return "; ".join(f"{PARTS.get(k, ENGINE)} ({k})" for k in odd) or None


def mismatch_of(stored: Column, expected: Column) -> Column:
    """mismatch() of two map<string,string> columns, null where they agree."""
    keys = F.array_sort(F.array_union(F.map_keys(stored), F.map_keys(expected)))
    odd = F.filter(keys, lambda k: ~F.equal_null(F.element_at(stored, k), F.element_at(expected, k)))
    names = F.create_map(*[F.lit(x) for pair in PARTS.items() for x in pair])
    said = F.array_join(F.transform(odd, lambda k: F.concat(F.coalesce(F.try_element_at(names, k), F.lit(ENGINE)), F.lit(" ("), k, F.lit(")"))), "; ")
    return F.when(F.array_contains(odd, "schema"), F.lit(f"{FORMAT} (schema)")).when(F.size(odd) > 0, said)


def reused(wanted: DataFrame, bank: DataFrame, key: str) -> DataFrame:
    """wanted (key, fingerprint) with the banked result of the same fingerprint, or the reason why there is none to use.

    bank: (key, fingerprint, result), at most one row for each key. reason: null with a result, else what differs, or 'nothing banked'.
    """
    b = bank.select(key, F.col("fingerprint").alias("__stored"), "result", F.lit(True).alias("__there"))
    why = F.when(F.col("__there").isNull(), F.lit("nothing banked")).otherwise(mismatch_of(F.col("__stored"), F.col("fingerprint")))
    joined = wanted.join(b, key, "left").withColumn("reason", why)
    return joined.withColumn("result", F.when(F.col("reason").isNull(), F.col("result"))).drop("__stored", "__there")


class ChunkMerger(StatefulProcessor):
    """See resumed_chunks."""

    def __init__(self, step: float, overlap: float, least: float):
        self.step, self.overlap, self.least = step, overlap, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("recording", "doc string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        held = json.loads(self.state.get()[0]) if self.state.exists() else {"run": 0, "print": None, "next": None, "given": 0, "tail": [], "early": []}
        out: list[tuple] = []
        come = [r for part in rows for r in part.to_dict("records")]
        for r in sorted(come, key=lambda r: (r["sent"], r["begins"])):
            own = dict(r["fingerprint"])
            if held["print"] is not None and (why := mismatch(held["print"], own)):
                out.append((key[0], held["run"], None, None, None, None, f"started over: {why}"))
                held = {"run": held["run"] + 1, "print": own, "next": None, "given": 0, "tail": [], "early": []}
            held["print"] = own
            tokens = [[t["word"], r["begins"] + t["at"], r["begins"] + t["until"]] for t in r["tokens"]]
            held["early"].append([float(r["begins"]), float(r["lasts"]), bool(r["last"]), tokens])
            self._merge(key[0], held, out)
        self.state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"place": "Int64"})

    def _merge(self, rec: int, held: dict[str, Any], out: list[tuple]) -> None:
        """Takes the chunks that are due, in order, and gives out the tokens that no later chunk can reach."""
        due = 0.0 if held["next"] is None else held["next"]
        while held["early"]:
            held["early"].sort(key=lambda c: c[0])
            begins, lasts, last, tokens = held["early"][0]
            if begins > due:
                return
            del held["early"][0]
            if begins < due:
                continue  # merged by an earlier run
            if lasts >= self.least:
                held["tail"] = [list(t) for t in folded([[tuple(t) for t in held["tail"]], [tuple(t) for t in tokens]], self.overlap)] if held["tail"] else tokens
            due = held["next"] = begins + self.step
            reach, final = float("-inf"), 0
            for t in held["tail"]:
                reach = max(reach, t[2])
                if not last and reach > due - self.overlap:
                    break
                final += 1
            for t in held["tail"][:final]:
                out.append((rec, held["run"], held["given"], *t, None))
                held["given"] += 1
            del held["tail"][:final]

    def close(self) -> None:
        pass


def resumed_chunks(chunks: DataFrame, step: float, overlap: float, least: float = 0) -> DataFrame:
    """A stream of OUT rows from a stream of chunk readings (rec, sent, begins, lasts, last, fingerprint, tokens).

    tokens are array<struct<word, at, until>>, timed from the chunk's beginning; chunks begin at 0 and every `step`; last marks a recording's
    last chunk, after which the rest is given out. sent orders what comes in one batch. Needs RocksDB as state store.
    """
    return chunks.groupBy("rec").transformWithStateInPandas(statefulProcessor=ChunkMerger(step, overlap, least), outputStructType=OUT, outputMode="Append", timeMode="None")
