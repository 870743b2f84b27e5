"""Grids of tiles by frame: change, noise, connected regions, block means.

A frame is a row with an array of rows x columns tile values; what compares frames is a window of the JVM, what
looks inside one frame is numpy over the frames of an Arrow batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def changed_tiles(frames: DataFrame, key: str, order: str, tiles: str, delta: float) -> DataFrame:
    """key, order and changed (array<boolean>) of each frame but a recording's first: tiles that differ from the frame before by over delta."""
    before = F.lag(tiles).over(Window.partitionBy(key).orderBy(order))
    d = frames.select(key, order, tiles, before.alias("__before")).where("__before IS NOT NULL")
    return d.select(key, order, F.zip_with(tiles, "__before", lambda a, b: F.abs(a.cast("double") - b) > delta).alias("changed"))


def usable_tiles(changed: DataFrame, key: str, noisy: float, most: float) -> DataFrame:
    """key, usable (array<boolean>), masked: tiles that change in under `noisy` of the frames.

    Where over `most` of all tiles are noisy, none is left out, and masked is false.
    """
    each = changed.select(key, F.posexplode("changed").alias("tile", "c"))
    share = each.groupBy(key, "tile").agg((F.avg(F.when(F.col("c"), 1.0).otherwise(0.0)) >= noisy).alias("noisy"))
    g = share.groupBy(key).agg(F.avg(F.when(F.col("noisy"), 1.0).otherwise(0.0)).alias("part"), F.sort_array(F.collect_list(F.struct("tile", "noisy"))).alias("a"))
    return g.select(key, F.transform("a", lambda x: ~x["noisy"] | (F.col("part") > most)).alias("usable"), (F.col("part") <= most).alias("masked"))


def largest_regions(masks: np.ndarray) -> np.ndarray:
    """Tiles of the largest region of true tiles that touch by an edge, for each of N masks (N, rows, columns).

    Each tile takes the greatest number among its neighbours', then that number's own, until none changes.
    """
    n, rows, columns = masks.shape
    own = np.arange(1, rows * columns + 1).reshape(rows, columns)
    label = np.where(masks, own, 0)
    padded = np.zeros((n, rows + 2, columns + 2), label.dtype)
    while True:
        padded[:, 1:-1, 1:-1] = label
        near = np.maximum.reduce([padded[:, 1:-1, 1:-1], padded[:, :-2, 1:-1], padded[:, 2:, 1:-1], padded[:, 1:-1, :-2], padded[:, 1:-1, 2:]])
        new = np.where(masks, near, 0)
        flat = np.concatenate([np.zeros((n, 1), label.dtype), new.reshape(n, -1)], 1)
        new = np.take_along_axis(flat, new.reshape(n, -1), 1).reshape(new.shape)  # the number that stands where the number points
        new = np.where(masks, np.maximum(new, near), 0)
        if (new == label).all():
            break
        label = new
    size = rows * columns + 1
    counts = np.bincount((label.reshape(n, -1) + np.arange(n)[:, None] * size).ravel(), minlength=n * size).reshape(n, size)
    return counts[:, 1:].max(axis=1, initial=0)


def region_size(mask: Column, rows: int, columns: int) -> Column:
    """largest_regions of an array<boolean> column, row after row of tiles."""

    @F.pandas_udf("long")
    def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for masks in batches:
            grid = np.array([np.asarray(m, bool) for m in masks]).reshape(-1, rows, columns)
            yield pd.Series([int(s) for i in range(0, len(grid), 256) for s in largest_regions(grid[i : i + 256])], dtype="int64")

    return sizes(mask)


def frames_with_change(frames: DataFrame, key: str, order: str, tiles: str, rows: int, columns: int, delta: float, noisy: float, least: int, most: float = 0.25) -> DataFrame:
    """key, order, size, mark: the largest region of usable changed tiles of each frame; a mark if it has `least` tiles."""
    changed = changed_tiles(frames, key, order, tiles, delta)
    region = F.zip_with("changed", "usable", lambda c, u: c & u)
    sized = changed.join(usable_tiles(changed, key, noisy, most), key).select(key, order, region_size(region, rows, columns).alias("size"))
    return sized.withColumn("mark", F.col("size") >= least)


def coarser(tiles: Column, rows: int, columns: int, factor: int) -> Column:
    """Block means, cut to whole numbers; rows and columns behind the last whole block are left out."""
    places = lambda i, j: [(i * factor + a) * columns + j * factor + b for a in range(factor) for b in range(factor)]
    blocks = [places(i, j) for i in range(rows // factor) for j in range(columns // factor)]
    means = [sum((F.get(tiles, k).cast("double") for k in block[1:]), F.get(tiles, block[0]).cast("double")) / len(block) for block in blocks]
    return F.array(*[F.floor(m) for m in means])


def share_of(odd: Column) -> Column:
    """Share of true values in an array<boolean>."""
    return F.size(F.filter(odd, lambda x: x)) / F.size(odd)


def instability(frames: DataFrame, key: str, order: str, tiles: str, delta: float) -> DataFrame:
    """key, order, instability: how much of each frame changes to it and from it, on average; a recording's first and last frame take their neighbour's, and of under three frames it is null."""
    w = Window.partitionBy(key).orderBy(order)
    differs = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), share_of(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y) > delta)))
    d = frames.select(key, order, differs(F.lag(tiles).over(w), F.col(tiles)).alias("back")).withColumn("own", (F.col("back") + F.lead("back").over(w)) / 2)
    return d.select(key, order, F.coalesce("own", F.lead("own").over(w), F.lag("own").over(w)).alias("instability"))


def coverage(frames: DataFrame, segments: DataFrame, key: str, order: str, tiles: str, delta: float) -> DataFrame:
    """key, coverage: over all frames but a recording's first and last the average share of tiles that are as in the frame that stands for their segment.

    segments: (key, boundary, sample), places in order. A frame's segment is the last that begins by then, or the first; boundary and sample are told apart, as
    a segment may be shown by a frame in its middle.
    """
    w = Window.partitionBy(key).orderBy(order)
    f = frames.select(key, order, F.col(tiles).alias("own")).withColumns({"last": F.max(order).over(Window.partitionBy(key)), "first": F.min(order).over(Window.partitionBy(key))})
    first = segments.groupBy(key).agg(F.min_by("sample", "boundary").alias("opening"))
    both = f.select(key, F.col(order).alias("at"), "own", "first", "last", F.lit(1).alias("ask")).unionByName(segments.select(key, F.col("boundary").alias("at"), "sample", F.lit(0).alias("ask")), allowMissingColumns=True)
    told = both.withColumn("sample", F.last("sample", ignorenulls=True).over(Window.partitionBy(key).orderBy("at", "ask"))).where("ask = 1 AND at > first AND at < last")
    told = told.join(first, key).withColumn("sample", F.least(F.coalesce("sample", "opening"), "last"))
    shown = frames.select(key, F.col(order).alias("sample"), F.col(tiles).alias("shown"))
    same = share_of(F.zip_with("own", "shown", lambda a, b: F.abs(a.cast("double") - b) <= delta))
    return told.join(shown, [key, "sample"]).groupBy(key).agg(F.avg(same).alias("coverage"))
