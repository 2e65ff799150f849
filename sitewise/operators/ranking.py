"""Exact ranks, percentiles and quantiles without a single-task sort.

Everything rests on one table: the distinct values in order, with the number of rows
below each. Distinct values are pre-aggregated, range-partitioned and settled together
with their slice number, so the prefix sums need one row per slice and never put all
values, or all rows of a group, into one task.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import as_column, finite
from ..session import BROADCAST_ROWS, settle

HOT_ROWS = 200_000


def _slice_starts(sliced: DataFrame, groups: Sequence[str], weight: Column) -> DataFrame:
    """One row per (slice, group): rows before it within the group, and the group's total.

    Ranges are contiguous, so there are at most slices + groups rows here and at most one
    row per slice in any window partition.
    """
    group_cols = list(groups)
    part = sliced.groupBy("slice", *group_cols).agg(
        F.sum(weight).alias("slice_rows"), F.count("*").alias("slice_entries"))
    everything = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy(F.lit(0))
    before = everything.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return part.select(
        "slice", *group_cols,
        F.coalesce(F.sum("slice_rows").over(before), F.lit(0)).alias("slice_start"),
        F.sum("slice_rows").over(everything).alias("group_rows"),
        F.sum("slice_entries").over(everything).alias("group_entries"),
    )


def _with_starts(sliced: DataFrame, groups: Sequence[str], weight: Column) -> DataFrame:
    starts = _slice_starts(sliced, groups, weight)
    if not groups:
        starts = F.broadcast(starts)  # one row per shuffle partition
    return join_null_safe(sliced, starts, ["slice", *groups])


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; the key columns are kept once, from the left."""
    named = right.select(*[F.col(c).alias(f"_right_{c}") if c in on else F.col(c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on]
    return left.join(named, same, how).drop(*[f"_right_{c}" for c in on])


def cumulative_counts(df: DataFrame, value: Column | str, groups: Sequence[str] = ()) -> DataFrame:
    """groups, value, rows, below, group_rows, group_entries - one row per distinct value."""
    groups = list(groups)
    counts = (
        df.select(*groups, finite(value).alias("value"))
        .where(F.col("value").isNotNull())
        .groupBy(*groups, "value").agg(F.count("*").alias("rows"))
    )
    sliced = settle(
        counts.repartitionByRange(*groups, "value").withColumn("slice", F.spark_partition_id()))
    inside = Window.partitionBy("slice", *groups).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return _with_starts(sliced, groups, F.col("rows")).select(
        *groups, "value", "rows",
        (F.col("slice_start") + F.coalesce(F.sum("rows").over(inside), F.lit(0))).alias("below"),
        "group_rows", "group_entries",
    )


def lookup_by_value(facts: DataFrame, lookup: DataFrame, on: Sequence[str], weight: str,
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of facts to a unique lookup that survives a value held by many fact rows.

    ``weight`` is the number of fact rows behind each lookup row. Rows of heavy values meet a
    broadcast copy of just those lookup rows (their number is checked), the others shuffle.
    """
    on = list(on)
    while True:
        hot = lookup.where(F.col(weight) > hot_rows)
        found = hot.limit(BROADCAST_ROWS + 1).count()
        if found == 0:
            return join_null_safe(facts, lookup, on)
        if found <= BROADCAST_ROWS:
            break
        hot_rows *= 2
    hot_keys = hot.select(*on)
    heavy = join_null_safe(facts, F.broadcast(hot), on)
    light = join_null_safe(join_null_safe(facts, F.broadcast(hot_keys), on, "left_anti"), lookup.where(F.col(weight) <= hot_rows), on)
    return heavy.unionByName(light)


def percentile_scores(df: DataFrame, key: str, scores: Mapping[str, Column], groups: Sequence[str] = (),
                      inverted: Sequence[str] = (), policy: str = "keep") -> DataFrame:
    """key (unique) plus one average-rank percentile per entry of ``scores`` (rank / non-null rows).

    policy "keep": null stays null. "zero": null becomes 0. "half_constant": null becomes 0 and a
    column with a single distinct value scores 0.5. All scores are ranked in one pass: the values
    are unpivoted, ranked per metric and pivoted back.
    """
    names = list(scores)
    groups = list(groups)
    cells = df.select(
        key, *groups,
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("metric"),
                     finite(-scores[name].cast("double") if name in inverted else scores[name]).alias("value"))
            for name in names
        ])).alias("cell"),
    ).select(key, *groups, "cell.metric", "cell.value").where(F.col("value").isNotNull())
    ladder = cumulative_counts(cells, "value", [*groups, "metric"])
    rank = (F.col("below") + (F.col("rows") + 1) / 2) / F.col("group_rows")
    if policy == "half_constant":
        rank = F.when(F.col("group_entries") <= 1, F.lit(0.5)).otherwise(rank)
    table = settle(ladder.select(*groups, "metric", "value", "rows", rank.alias("score")))  # counted and read several times
    ranked = (
        lookup_by_value(cells, table, [*groups, "metric", "value"], "rows")
        .groupBy(key).agg(*[F.max(F.when(F.col("metric") == name, F.col("score"))).alias(name) for name in names])
    )
    result = df.select(key).join(ranked, key, "left")
    if policy != "keep":
        result = result.select(key, *[F.coalesce(F.col(name), F.lit(0.0)).alias(name) for name in names])
    return result


def add_percentiles(df: DataFrame, key: str, scores: Mapping[str, Column], **options) -> DataFrame:
    """``percentile_scores`` joined onto the frame. ``df`` is read twice: settle it first if dear."""
    return df.join(percentile_scores(df, key, scores, **options), key)


def ordered_rank(df: DataFrame, key: str, order: Sequence[tuple[str, bool]], name: str,
                 groups: Sequence[str] = ()) -> DataFrame:
    """key and its 1-based position within the group.

    ``order`` lists (column, descending). It must be total, so end it with a unique column.
    Works for groups of any size: a group spans as many slices as it needs.
    """
    groups = list(groups)
    ordering = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]
    columns = list(dict.fromkeys([key, *groups, *[c for c, _ in order]]))
    sliced = settle(
        df.select(*columns)
        .repartitionByRange(*[F.col(g) for g in groups], *ordering)
        .withColumn("slice", F.spark_partition_id()))
    inside = Window.partitionBy("slice", *groups).orderBy(*ordering)
    return _with_starts(sliced, groups, F.lit(1)).select(
        key, (F.col("slice_start") + F.row_number().over(inside)).cast("int").alias(name))


def add_rank(df: DataFrame, key: str, order: Sequence[tuple[str, bool]], name: str,
             groups: Sequence[str] = ()) -> DataFrame:
    return df.join(ordered_rank(df, key, order, name, groups), key)


def values_at(ladder: DataFrame, position: Column, groups: Sequence[str] = (), name: str = "value_at") -> DataFrame:
    """Value at a 0-based position of the sorted rows, from a ``cumulative_counts`` table."""
    hit = (F.col("below") <= position) & (position < F.col("below") + F.col("rows"))
    return ladder.groupBy(*groups).agg(F.max(F.when(hit, F.col("value"))).alias(name))


def quantiles(df: DataFrame, value: Column | str, fractions: Sequence[float],
              groups: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolated quantiles, columns q0, q1, ... (null for an empty input)."""
    ladder = cumulative_counts(df, value, groups)
    picks = []
    for i, fraction in enumerate(fractions):
        spot = (F.col("group_rows") - 1) * F.lit(float(fraction))
        for side, position in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            hit = (F.col("below") <= position) & (position < F.col("below") + F.col("rows"))
            picks.append(F.max(F.when(hit, F.col("value"))).alias(f"{side}{i}"))
    found = ladder.groupBy(*groups).agg(F.max("group_rows").alias("n"), *picks)
    outputs = []
    for i, fraction in enumerate(fractions):
        spot = (F.col("n") - 1) * F.lit(float(fraction))
        step = spot - F.floor(spot)
        outputs.append((F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * step).alias(f"q{i}"))
    return found.select(*groups, *outputs)


def top_of_each(df: DataFrame, groups: Sequence[Column | str], order: Sequence[Column], keep: int) -> DataFrame:
    """Best ``keep`` rows per group. The rank filter runs before the shuffle too, so a group of
    any size sends at most ``keep`` rows per map task."""
    w = Window.partitionBy(*[as_column(g) for g in groups]).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= keep).drop("_place")


def apportion(df: DataFrame, group: str, item_order: str, value: str, total: Column, name: str) -> DataFrame:
    """Whole numbers proportional to ``value`` that add up to ``total`` per group (largest remainder).

    Meant for groups of a handful of shares; a non-positive sum gives zeros.
    """
    sums = Window.partitionBy(group)
    exact = F.round(F.col(value) / F.col("_sum") * F.col("_total"), 9)
    w = Window.partitionBy(group).orderBy(F.col("_rest").desc(), F.col(item_order))
    return (
        df.withColumn("_total", total)
        .withColumn("_sum", F.sum(value).over(sums))
        .withColumn("_exact", F.when(F.col("_sum") > 0, exact).otherwise(F.lit(0.0)))
        .withColumn("_whole", F.floor("_exact"))
        .withColumn("_rest", F.col("_exact") - F.col("_whole"))
        .withColumn("_left", F.when(F.col("_sum") > 0, F.col("_total") - F.sum("_whole").over(sums)).otherwise(F.lit(0)))
        .withColumn(name, (F.col("_whole") + (F.row_number().over(w) <= F.col("_left")).cast("long")).cast("long"))
        .drop("_total", "_sum", "_exact", "_whole", "_rest", "_left")
    )
