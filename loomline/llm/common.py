"""Column handling, shared folders and size figures used by every operator of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


_HELD: dict[str, Any] = {}


def held(name: str, make: Callable[[], Any]) -> Any:
    """What make() gives, kept by a Python worker for its later tasks; the last one only."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def let_go() -> None:
    """What earlier operators have left with this Python worker goes."""
    _HELD.clear()
    pa.default_memory_pool().release_unused()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one, which only a local session can use."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return shared or held("shared-folder", lambda: tempfile.mkdtemp(prefix="loomline-shared-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder: its lineage is cut, and its size is the files' size.

    (checkpoint() would carry on the estimated sizes of its plan, which iterations multiply.)
    """
    path = f"{shared_folder(df.sparkSession)}/loomline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a table that is sent to all tasks, at most; beyond, Spark joins by shuffle.
BROADCAST_BYTES = 24 << 20


def small_enough(df: DataFrame, row_bytes: int) -> DataFrame:
    """df (a written table) with a broadcast hint if its rows, at most row_bytes each, stay under the bound together."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns that a result column of the same name (in any case) would clash with."""
    gone = {n.lower() for n in names}
    kept = [c for c in df.columns if c.lower() not in gone]
    return df.select(*[F.col(f"`{c}`") for c in kept])


def text_size(df: DataFrame, text_col: str) -> tuple[int, int]:
    """Rows of df and UTF-8 bytes of its text column, counted over all rows."""
    n, size = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(text_col)))).first()
    return n or 0, size or 0


def packed(df: DataFrame, text_col: str, n_shards: int) -> DataFrame:
    """(shard, text, rest) rows: shard from a hash of all plain columns, rest the other columns.

    Equal rows share a shard; rows that differ in any plain column spread, so that a
    hot source or a large group of copies under different ids doesn't meet in one shard.
    """
    plain = [f.name for f in df.schema if isinstance(f.dataType, T.AtomicType)]
    rest = [c for c in df.columns if c != text_col]
    key = F.xxhash64(*[F.col(f"`{c}`") for c in plain])
    return df.select(
        F.pmod(key, F.lit(n_shards)).cast("int").alias("shard"),
        F.col(f"`{text_col}`").alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(0).alias("none")]).alias("rest"),
    )


def unpacked(df: DataFrame, like: DataFrame, text_col: str, new: list[str]) -> DataFrame:
    """The columns of like, in order, from rows of packed(), and the new columns behind them."""
    taken = {n.lower() for n in new}
    old = [
        F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c)
        for c in like.columns
        if c.lower() not in taken
    ]
    return df.select(*old, *new)
