"""Small groups settled in Arrow batches, many of them in one call: a call of its own costs a group milliseconds."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a batch that goes back to Spark, if no single group has more.
ROWS = 10_000

#: Rows of a narrow table that one task takes, of those that grow on their way.
EACH = 50_000


def spread(rows: DataFrame, *keys: str, each: int = EACH) -> DataFrame:
    """rows dealt out by keys, about `each` of them to a task, however many there are.

    Adaptive execution puts parts together by the bytes that were shuffled, up to one part for each core; where rows grow behind the shuffle (exploded,
    sorted, collected), a task's memory then grows with the table. A number of parts that is asked for stays as it is, if joins by these keys
    needn't deal out again: they do where it is under the session's number of shuffle partitions.
    """
    return rows.repartition(parts_of(rows, each), *keys)


def parts_of(rows: DataFrame, each: int = EACH) -> int:
    """Into how many parts spread deals the rows."""
    session = rows.sparkSession
    least, parts = session.sparkContext.defaultParallelism, -(-rows.count() // each)
    return max(parts, int(session.conf.get("spark.sql.shuffle.partitions"))) if parts > least else least


#: Letters of texts that one task takes, of those whose words or runs of words are counted there first.
LETTERS = 16_000_000


def spread_letters(rows: DataFrame, text: str, *keys: str, letters: int = LETTERS) -> DataFrame:
    """rows dealt out by keys, about `letters` letters of their texts to a task, whatever the files' splits: what a task holds doesn't hang on them."""
    total = rows.agg(F.sum(F.length(text))).first()[0] or 0
    return rows.repartition(max(-(-total // letters), rows.sparkSession.sparkContext.defaultParallelism), *keys)


def kept(rows: DataFrame, *keys: str) -> DataFrame:
    """rows worked out once, onto the executors' disks (they go with their last reader), for what reads them many times, and dealt out by keys, if any."""
    once = rows.localCheckpoint(storageLevel=StorageLevel.DISK_ONLY)
    return spread(once, *keys) if keys else once


#: Bytes of a table that is sent to all tasks, at most.
BROADCAST_BYTES = 24 << 20


def small(rows: DataFrame, row_bytes: int) -> DataFrame:
    """rows with a broadcast hint if they, at most row_bytes each, stay under the bound together; what they are joined with isn't shuffled then."""
    return F.broadcast(rows) if rows.count() * row_bytes <= BROADCAST_BYTES else rows


def each_group(rows: DataFrame, keys: list[str], order: list[str | Column], run: Callable[[list[tuple]], Iterable[tuple]], kinds: str) -> DataFrame:
    """The rows (of columns `kinds`, DDL) that run gives for the rows of each group by keys, which it gets as tuples in the given order.

    Spark sorts the groups beside each other, so a task holds one of them at a time. Keys are never NaN.
    """
    schema = T.StructType.fromDDL(kinds)
    arrow = to_arrow_schema(schema)
    key = itemgetter(*[rows.columns.index(k) for k in keys])

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), arrow)], schema=arrow)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        group: list[tuple] = []
        for part in parts:
            for row in zip(*[c.to_pylist() for c in part.columns]):
                if group and key(row) != key(group[0]):
                    found.extend(run(group))
                    group = []
                    if len(found) >= ROWS:
                        yield batch(found)
                        found = []
                group.append(row)
        if group:
            found.extend(run(group))
        if found:
            yield batch(found)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(batches, schema)
