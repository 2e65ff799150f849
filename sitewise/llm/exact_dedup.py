"""Exact duplicates with a heavy-hitter split.

Misra-Gries counters find the digests that may be frequent in one pass with bounded memory; an exact count verifies
them and settles which row stays. These few winners are sent to all tasks, so that the rows of frequent digests are
settled where they are, without a shuffle. All other digests, each with a small share of the rows, are shuffled.
"""
from __future__ import annotations

import hashlib
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewise.session import settle

from .words import slices, text_bytes

# Counters of a summary. At most so many digests are broadcast, and a digest that is not has at most 2 / COUNTERS of the rows.
COUNTERS = 4096


def trimmed(held: Counter, counters: int) -> Counter:
    """At most ``counters`` of the counts, all lowered alike: by no more than the rows counted / (counters + 1) in all."""
    if len(held) <= counters:
        return held
    cut = sorted(held.values(), reverse=True)[counters]
    return Counter({digest: c - cut for digest, c in held.items() if c > cut})


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """(key, keep_id, group_size, kept, digest) for every row: the row of the largest key stays in each group of equal texts.

    Texts are equal if they are after lower-casing A-Z (by SHA-256 of the UTF-8 bytes); null is empty. A null key
    is smaller than any other. Of rows that repeat the largest key of a group exactly one is kept. Extra columns are
    ignored. An empty table gives no rows.
    """
    kinds = dict(docs.dtypes)

    def digest(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            raw, at = text_bytes(batch.column("text"))
            low = memoryview(raw.tobytes().lower())  # of bytes: A-Z only
            found = [hashlib.sha256(low[a:b]).digest() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(found)), pa.int64()), batch.column("id"), pa.array(found, pa.binary())],
                                             names=["row", "id", "digest"])
            row += len(found)

    # row numbers hold for one reading only, so they are written
    rows = settle(docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
                  .mapInArrow(digest, f"row long, id {kinds[key]}, digest binary"))

    def frequent(batches):
        held = Counter()
        for batch in batches:
            held.update(batch.column("digest").to_pylist())
            if len(held) > 4 * counters:
                held = trimmed(held, counters)
        held = trimmed(held, counters)
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["digest", "least"])

    # counts of all tasks added up are at most n, so fewer than counters + 1 digests exceed n / (counters + 1)
    n = rows.count()
    suspects = (rows.select("digest").mapInArrow(frequent, "digest binary, least long").groupBy("digest").agg(F.sum("least").alias("least"))
                .where((F.col("least") > 1) & (F.col("least") * (counters + 1) > n)).select("digest"))
    best = F.struct(F.col("id").isNotNull().alias("known"), F.col("id").alias("id"), (-F.col("row")).alias("row"))
    winners = settle(rows.join(F.broadcast(settle(suspects)), "digest").groupBy("digest")
                     .agg(F.max(best).alias("best"), F.count("*").alias("group_size")))
    frequent_rows = rows.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    others = (rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
              .withColumns({"best": F.max(best).over(group), "group_size": F.count("*").over(group)}))
    return frequent_rows.unionByName(others).select(
        F.col("id").alias(key), F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == -F.col("best.row")).alias("kept"), "digest")
