"""Shards of near equal bytes from a k-d tree over metadata.

A node that stands for s shards is split so that s // 2 shards' share of its bytes lies below the cut. The cut is a
weighted quantile along the dimension in which the node is widest; rows with the same coordinate are told apart by a
hash of the row, so that a value held by a third of all rows can be split. Quantiles come from histograms of
bytes that are refined until a bin is small: rows never move, and a few thousand sums per node reach the driver.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.session import settle

COORDINATE_BITS = 20
TIE_BITS = 40
BIN_BITS = 12
# A cut may miss its share of the node's bytes by this much.
TOLERANCE = 1e-5
SLOT_ROWS = 20_000


def _coordinates(rows: DataFrame, dimensions: list[str]) -> dict[str, Column]:
    """Numbers are scaled between their extremes, other values take the place their hash gives; nulls come first."""
    kinds = dict(rows.dtypes)
    numeric = [d for d in dimensions if kinds[d] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[d].startswith("decimal")]
    span = (1 << COORDINATE_BITS) - 1
    ends = rows.agg(*[f(F.when(~F.isnan(F.col(d).cast("double")), F.col(d).cast("double"))).alias(f"{n}_{i}")
                      for i, d in enumerate(numeric) for n, f in (("lo", F.min), ("hi", F.max))]).first() if numeric else {}
    out = {}
    for d in dimensions:
        if d in numeric:
            lo, hi = ends[f"lo_{numeric.index(d)}"], ends[f"hi_{numeric.index(d)}"]
            wide = (hi - lo) if lo is not None and hi > lo and hi - lo != float("inf") else 1.0
            value = (F.col(d).cast("double") - F.lit(lo or 0.0)) / F.lit(wide) * span
            out[d] = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(float(span)), value)).cast("long"), F.lit(0))
        else:
            out[d] = F.when(F.col(d).isNull(), 0).otherwise(F.xxhash64(F.col(d).cast("string")).bitwiseAND(F.lit(span)))
    return out


def kd_shards(docs: DataFrame, shards: int, dimensions: tuple[str, ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot) for every row: shards of near equal sums of size.

    size is the text's UTF-8 bytes (null: none) plus 1; text_crc32 of a null text is 0. slot numbers the rows of a
    shard from 0 without gaps. Dimensions that ``docs`` lacks are passed over; equal rows may lie in different shards
    and are told apart by the order in which they were written. An empty table gives no rows.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    dims = [d for d in dimensions if d in docs.columns]
    rows = settle(docs.select(F.col(key).alias("_key"), (F.octet_length(body) + 1).cast("long").alias("_size"), F.crc32(body).alias("_crc"),
                              *[F.col(d).alias(f"_d{i}") for i, d in enumerate(dims)]))
    axes = _coordinates(rows, [f"_d{i}" for i in range(len(dims))])
    # the row's own number: settled, so it stays the same whenever a task runs again
    rows = settle(rows.select("_key", "_size", "_crc", *[axes[f"_d{i}"].cast("long").alias(f"_c{i}") for i in range(len(dims))],
                              F.lit(0).alias("_node"), F.xxhash64("_key", "_crc", F.monotonically_increasing_id()).alias("_tie")))
    tie = F.col("_tie").bitwiseAND(F.lit((1 << TIE_BITS) - 1))
    # node: (first shard, number of shards)
    nodes = {0: (0, shards)}
    while any(n > 1 for _, n in nodes.values()):
        wide = {r["_node"]: r for r in rows.groupBy("_node").agg(
            F.sum("_size").alias("size"), *[(F.max(f"_c{i}") - F.min(f"_c{i}")).alias(f"w{i}") for i in range(len(dims))]).collect()}
        axis = {n: max(range(len(dims)), key=lambda i: (wide[n][f"w{i}"], -i)) if dims else None for n in wide}
        place = F.lit(0)
        for n, a in axis.items():
            if a is not None:
                place = F.when(F.col("_node") == n, F.col(f"_c{a}")).otherwise(place)
        split = {n: v for n, v in nodes.items() if v[1] > 1 and n in wide}
        if not split:
            break
        keyed = settle(rows.withColumn("_at", place.cast("long") * (1 << TIE_BITS) + tie))
        cut = _quantiles(keyed, {n: (wide[n]["size"], (v[1] // 2) / v[1]) for n, v in split.items()})
        number, after = F.col("_node"), {}
        for n, (first, many) in nodes.items():
            if n in split:
                after[2 * n + 1], after[2 * n + 2] = (first, many // 2), (first + many // 2, many - many // 2)
                number = F.when(F.col("_node") == n, F.when(F.col("_at") < cut[n], 2 * n + 1).otherwise(2 * n + 2)).otherwise(number)
            else:
                after[n] = (first, 1) if n not in wide else (first, many)
        nodes, rows = after, keyed.withColumn("_node", number.cast("int")).drop("_at")
    shard = F.lit(0)
    for n, (first, _) in nodes.items():
        shard = F.when(F.col("_node") == n, first).otherwise(shard)
    rows = settle(rows.select("_key", "_size", "_crc", "_tie", shard.cast("int").alias("shard")))
    # slots: numbers within small groups of a shard's rows, after the rows of the groups before
    groups = max(1, rows.count() // SLOT_ROWS)
    grouped = rows.withColumn("_group", F.pmod("_tie", F.lit(groups)))
    before = grouped.groupBy("shard", "_group").agg(F.count("*").alias("n")).withColumn(
        "_before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("shard", "_group").orderBy("_tie", "_key")) - 1
    return grouped.withColumn("_within", within).join(before.drop("n"), ["shard", "_group"]).select(
        F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard",
        (F.col("_before") + F.col("_within")).cast("long").alias("slot"))


def _quantiles(rows: DataFrame, wanted: dict[int, tuple[int, float]]) -> dict[int, int]:
    """Per node the key below which the given share of its bytes lies, as nearly as TOLERANCE or single rows allow."""
    top = COORDINATE_BITS + TIE_BITS
    state = {n: (0, top, 0) for n in wanted}  # lower end, bits left, bytes below
    cut: dict[int, int] = {}
    while state:
        expression = F.lit(None).cast("long")
        for n, (low, bits, _) in state.items():
            shift = max(0, bits - BIN_BITS)
            inside = (F.col("_node") == n) & (F.col("_at") >= low) & (F.col("_at") < low + (1 << bits))
            expression = F.when(inside, F.shiftright(F.col("_at") - low, shift)).otherwise(expression)
        sums: dict[int, list] = {}
        for r in rows.withColumn("_bin", expression).where("_bin is not null").groupBy("_node", "_bin").agg(
                F.sum("_size").alias("size")).orderBy("_node", "_bin").collect():  # 2 ** BIN_BITS rows a node at most
            sums.setdefault(r["_node"], []).append((r["_bin"], r["size"]))
        following = {}
        for n, (low, bits, below) in state.items():
            shift, (size, share) = max(0, bits - BIN_BITS), wanted[n]
            for b, held in sums.get(n, [(0, 0)]):
                if below + held >= size * share:
                    break
                below += held
            start = low + (b << shift)
            if shift and held > TOLERANCE * size:
                following[n] = (start, shift, below)
            else:
                cut[n] = start if size * share - below <= below + held - size * share else start + (1 << shift)
        state = following
    return cut
