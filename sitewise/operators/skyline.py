"""Rows not dominated on several maximised columns.

Every partition first drops what it can dominate itself. The survivors are cut into blocks by their column sums: a
dominator never has a smaller sum than what it dominates, so each block is compared with itself and the blocks above
it, all pairs of blocks in parallel. The first block, which dominates most, goes first and alone. No task holds more
than two blocks, or its partition's current skyline, and no row passes the driver.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..session import settle

BLOCK_ROWS = 4_000


def _dominated(points: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which points have one in ``by`` that is >= everywhere and > somewhere."""
    flags = np.zeros(len(points), dtype=bool)
    for start in range(0, len(by), 256):
        rivals = by[start:start + 256]
        open_ = np.flatnonzero(~flags)
        for chunk in range(0, len(open_), 1024):
            rows = open_[chunk:chunk + 1024]
            mine = points[rows][:, None, :]
            flags[rows] = ((rivals >= mine).all(axis=2) & (rivals > mine).any(axis=2)).any(axis=1)
    return flags


def _own_skyline(points: np.ndarray) -> np.ndarray:
    """Mask of the skyline of ``points``; equal rows stay together."""
    order = np.lexsort([-points[:, i] for i in reversed(range(points.shape[1]))] + [-points.sum(axis=1)])
    keep = np.zeros(len(points), dtype=bool)
    kept = np.empty((0, points.shape[1]))
    for start in range(0, len(order), 512):
        rows = order[start:start + 512]
        rows = rows[~_dominated(points[rows], kept)]
        rows = rows[~_dominated(points[rows], points[rows])]
        keep[rows] = True
        kept = np.vstack([kept, points[rows]])
    return keep


def skyline(df: DataFrame, key: str, columns: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key (unique) of every non-dominated row. Nulls count as 0; equal rows are all kept."""
    columns = list(columns)
    narrow = df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])

    def local(batches):
        kept = None
        for batch in batches:
            pool = batch if kept is None else pd_concat(kept, batch)
            kept = pool[_own_skyline(pool[columns].to_numpy())]
        if kept is not None:
            yield kept

    total = sum((F.col(c) for c in columns), F.lit(0.0))
    rest = settle(narrow.mapInPandas(local, narrow.schema).withColumn("_sum", total))
    for everything in (False, True):
        blocks = max(1, -(-rest.count() // block_rows))
        # settled, as the cut into ranges may differ if it is made again
        placed = settle(rest.repartitionByRange(blocks, F.col("_sum").desc(), *[F.col(c).desc() for c in columns], F.col(key))
                        .withColumn("_block", F.spark_partition_id()))
        rivals = placed if everything else placed.where("_block = 0")
        above = F.sequence(F.lit(0), F.col("_block") if everything else F.lit(0))
        left = placed.withColumn("_rival", F.explode(above))
        right = rivals.select(*columns, F.col("_block").alias("_rival"), F.explode(F.sequence("_block", F.lit(blocks - 1))).alias("_block"))

        def beaten(mine, theirs):
            return mine[[key]][_dominated(mine[columns].to_numpy(), theirs[columns].to_numpy())]

        lost = left.groupBy("_block", "_rival").cogroup(right.groupBy("_block", "_rival")).applyInPandas(beaten, df.select(key).schema)
        rest = settle(placed.drop("_block").join(lost.distinct(), key, "left_anti"))
        if blocks == 1:
            break
    return rest.select(key)


def pd_concat(a, b):
    import pandas as pd

    return pd.concat([a, b], ignore_index=True)


def flag_skyline(df: DataFrame, key: str, columns: Sequence[str], name: str) -> DataFrame:
    members = skyline(df, key, columns).withColumn(name, F.lit(True))
    return df.join(members, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
