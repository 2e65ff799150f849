"""Older radius-coverage optimizer: uncovered people, distance saved, shortage, cost."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.geo import EARTH_MILES_ROUNDED
from ..operators import ranking, spatial, spread
from ..session import settle


def with_nearest(areas: DataFrame, hospitals: DataFrame, key: str) -> DataFrame:
    """Miles to the nearest hospital that counts for coverage."""
    counted = hospitals.where("counts_for_coverage").select(
        "facility_id", F.col("latitude").alias("to_latitude"), F.col("longitude").alias("to_longitude"))
    miles = spatial.nearest_miles(areas, counted, key, "facility_id", "nearest_hospital_mi", radius=EARTH_MILES_ROUNDED)
    return areas.join(miles, key)


def robust_scale(df: DataFrame, value: str) -> DataFrame:
    """One row: the value at position int(0.95 n) among the sorted positive values, 1 when there are none."""
    ladder = ranking.cumulative_counts(df.where(F.col(value) > 0), value)
    spot = F.least(F.floor(F.lit(0.95) * F.col("group_rows")), F.col("group_rows") - 1)
    return ranking.values_at(ladder, spot, name="scale").select(F.coalesce("scale", F.lit(1.0)).alias(f"{value}_scale"))


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """One row: the value at position n // 2, 0 for no values."""
    ladder = ranking.cumulative_counts(df, value)
    return ranking.values_at(ladder, F.floor(F.col("group_rows") / 2), name="median").select(
        F.coalesce("median", F.lit(0.0)).alias(f"{value}_median"))


def coverage_factors(areas: DataFrame, key: str, radius: float, state: str | None = None) -> DataFrame:
    """Per candidate area the four factors in 0..1.

    Candidates may be limited to a state; uncovered demand is counted across state lines.
    """
    candidates = areas if state is None else areas.where(F.col("state") == state)
    uncovered = areas.where((F.col("nearest_hospital_mi") > radius) & (F.col("population") > 0)).groupBy(
        F.col("latitude").alias("to_latitude"), F.col("longitude").alias("to_longitude"), F.col("nearest_hospital_mi").alias("now")
    ).agg(F.sum("population").alias("people"))
    pairs = spatial.radius_pairs(candidates.select(key, "latitude", "longitude"), uncovered, radius, radius=EARTH_MILES_ROUNDED)
    sums = pairs.groupBy(key).agg(F.sum("people").alias("uncovered_pop"), F.sum(F.col("people") * (F.col("now") - F.col("miles"))).alias("saved"))
    median = upper_median(candidates, "density")
    rows = settle(
        candidates.join(sums, key, "left").crossJoin(F.broadcast(median)).withColumns({  # one row
            "uncovered_pop": F.coalesce("uncovered_pop", F.lit(0)),
            "avg_reduction_mi": F.expr("CASE WHEN coalesce(uncovered_pop, 0) > 0 THEN saved / uncovered_pop ELSE 0D END"),
            "density_imputed": F.col("density").isNull(),
            "density_used": F.coalesce("density", "density_median"),
        }).withColumn("log_density", F.log1p(F.greatest("density_used", F.lit(0.0)))).drop("saved", "density_median"))
    scales = robust_scale(rows, "uncovered_pop").crossJoin(robust_scale(rows, "avg_reduction_mi")).crossJoin(
        rows.agg(F.min("log_density").alias("lo"), F.max("log_density").alias("hi")))
    return rows.crossJoin(F.broadcast(scales)).withColumns({  # one row
        "f_population": F.least(F.lit(1.0), F.col("uncovered_pop") / F.col("uncovered_pop_scale")),
        "f_distance": F.least(F.lit(1.0), F.col("avg_reduction_mi") / F.col("avg_reduction_mi_scale")),
        "f_shortage": F.col("mua").cast("double") * 0.5 + F.col("hpsa").cast("double") * 0.5,
        "f_cost": F.expr("1 - (log_density - lo) / CASE WHEN hi - lo = 0 THEN 1D ELSE hi - lo END"),
    }).drop("uncovered_pop_scale", "avg_reduction_mi_scale", "lo", "hi", "log_density")


def scored_placements(factors: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """score = weighted mean of the factors; all-zero weights count equally."""
    if sum(weights.values()) <= 0:
        weights = {name: 1.0 for name in weights}
    total = float(sum(weights.values()))
    summed = sum((F.lit(float(w)) * F.col(f"f_{name}") for name, w in weights.items()), F.lit(0.0))
    return factors.withColumn("score", summed / F.lit(total))


def top_placements(factors: DataFrame, key: str, weights: Mapping[str, float], radius: float, k: int) -> DataFrame:
    """The best k areas with at least ``radius`` miles between them, of all areas."""
    order = [("score", True), ("uncovered_pop", True), (key, False)]
    ranked = settle(ranking.add_rank(settle(scored_placements(factors, weights)), key, order, "_place"))
    picks = spread.spread(ranked, key, "_place", [radius], k)
    return ranked.drop("_place").join(F.broadcast(picks), key).withColumnRenamed("pick", "rank")  # <= k rows


def placement_meta(factors: DataFrame) -> DataFrame:
    return factors.agg(F.count("*").alias("candidates_considered"),
                       F.count_if(F.col("uncovered_pop") > 0).alias("candidates_adding_coverage"))


def state_boxes(areas: DataFrame, hospitals: DataFrame) -> DataFrame:
    """Bounding box per state with eastern longitudes shifted west, area and hospital counts."""
    lon = F.when(F.col("longitude") > 0, F.col("longitude") - 360).otherwise(F.col("longitude"))
    boxes = areas.groupBy("state").agg(
        F.round(F.min(lon), 3).alias("west"), F.round(F.min("latitude"), 3).alias("south"),
        F.round(F.max(lon), 3).alias("east"), F.round(F.max("latitude"), 3).alias("north"), F.count("*").alias("tracts"))
    counted = hospitals.groupBy("state").agg(F.count("*").alias("hospitals"))
    return boxes.join(counted, "state", "left").withColumn("hospitals", F.coalesce("hospitals", F.lit(0)))


def shortage_flags(areas: DataFrame, components: DataFrame, key: str, county: str, name: str) -> DataFrame:
    """True where the area or its whole county is designated.

    ``components`` holds (geo_type, geo_id) with types "Census Tract" and "Single County".
    """
    def ids(kind: str, width: int, column: str) -> DataFrame:
        return components.where(F.col("geo_type") == kind).select(
            F.lpad("geo_id", width, "0").alias(column)).distinct().withColumn(f"_{column}", F.lit(True))

    flagged = areas.join(ids("Census Tract", 11, key), key, "left").join(ids("Single County", 5, county), county, "left")
    return flagged.withColumn(name, F.col(f"_{key}").isNotNull() | F.col(f"_{county}").isNotNull()).drop(f"_{key}", f"_{county}")


def with_density(areas: DataFrame, ruca: DataFrame, key: str) -> DataFrame:
    """Commuting code and density by area code; areas without a row keep null."""
    table = ruca.select(F.lpad("tract_code", 11, "0").alias(key), F.col("primary_code").try_cast("int").alias("ruca"),
                        F.col("pop_density").try_cast("double").alias("density")).dropDuplicates([key])
    return areas.join(table, key, "left")
