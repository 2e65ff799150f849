"""Area features: demographic rates, facility access, need scores."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import clip01, finite, numeric, pct, row_max, row_mean, row_sum, safe_divide
from ..functions.geo import EARTH_KM, KM_PER_MILE
from ..operators import ranking, spatial
from ..session import settle

RADIUS_MILES = EARTH_KM / KM_PER_MILE

# Survey columns that add up to the two age groups.
AGE_65_PLUS = [f"acs_b01001_e{line:03d}" for line in (*range(20, 26), *range(44, 50))]
UNDER_18 = [f"acs_b01001_e{line:03d}" for line in (*range(3, 7), *range(27, 31))]

# Need scores ranked over the areas, and the composite means.
RANKED_NEEDS = {
    "population_need_score": "population",
    "elderly_need_score": "population_age_65_plus_pct",
    "poverty_need_score": "poverty_pct",
    "uninsured_need_score": "uninsured_pct",
    "disability_need_score": "disability_pct",
    "transport_need_score": "households_no_vehicle_pct",
    "distance_access_need_score": "distance_to_nearest_hospital_miles",
    "nearby_capacity_need_score": "nearby_known_beds_25mi",
}
DEMOGRAPHIC_NEEDS = ["elderly_need_score", "poverty_need_score", "uninsured_need_score",
                     "disability_need_score", "transport_need_score"]
ACCESS_NEEDS = ["distance_access_need_score", "nearby_capacity_need_score"]
SCREENING_NEEDS = ["population_need_score", "demographic_need_score", "access_gap_score", "shortage_area_need_score"]


def phrase_columns(dictionary: DataFrame, table: str, phrase: str) -> list[str]:
    """Estimate columns of a table whose label or label path contains a phrase, sorted.

    The dictionary has one row per column of the wide table, so its size is a schema's size."""
    text = F.lower(F.concat_ws(" | ", F.coalesce("label", F.lit("")), F.coalesce("label_path", F.lit(""))))
    rows = dictionary.where(
        (F.col("table") == table) & (F.col("kind") == "estimate") & text.contains(phrase.lower())
    ).select("column").distinct().collect()
    return sorted(r["column"] for r in rows)


def demographic_rates(df: DataFrame, uninsured: list[str], disabled: list[str]) -> DataFrame:
    """Totals and percentages from wide survey columns; absent columns give null."""
    return (
        df.withColumns({
            "population": numeric(df, "acs_b01001_e001"),
            "median_household_income": numeric(df, "acs_b19013_e001"),
            "population_age_65_plus": row_sum(df, AGE_65_PLUS),
            "population_under_18": row_sum(df, UNDER_18),
            "poverty_universe_population": numeric(df, "acs_b17001_e001"),
            "population_below_poverty": numeric(df, "acs_b17001_e002"),
            "vehicle_households": numeric(df, "acs_b08201_e001"),
            "households_no_vehicle": numeric(df, "acs_b08201_e002"),
            "uninsured_population": row_sum(df, uninsured),
            "health_insurance_universe_population": numeric(df, "acs_b27001_e001"),
            "disabled_population": row_sum(df, disabled),
            "disability_universe_population": numeric(df, "acs_b18101_e001"),
            "existing_facility_count": numeric(df, "located_registry_facility_count"),
            "existing_hospital_count": numeric(df, "located_registry_hospital_count"),
            "existing_hospital_known_beds": numeric(df, "located_hospital_known_beds_sum"),
            "existing_hospitals_missing_beds": numeric(df, "located_hospitals_missing_beds"),
            "mua_coverage_fraction": numeric(df, "mua_boundary_area_fraction"),
            "mup_coverage_fraction": numeric(df, "mup_boundary_area_fraction"),
        }).withColumns({
            "population_age_65_plus_pct": pct("population_age_65_plus", "population"),
            "population_under_18_pct": pct("population_under_18", "population"),
            "poverty_pct": pct("population_below_poverty", "poverty_universe_population"),
            "households_no_vehicle_pct": pct("households_no_vehicle", "vehicle_households"),
            "uninsured_pct": pct("uninsured_population", "health_insurance_universe_population"),
            "disability_pct": pct("disabled_population", "disability_universe_population"),
            "known_beds_per_1000_residents": safe_divide("existing_hospital_known_beds", "population") * 1000.0,
            "shortage_area_coverage_fraction": row_max(["mua_coverage_fraction", "mup_coverage_fraction"]),
        })
    )


def facility_access(areas: DataFrame, facilities: DataFrame, key: str,
                    at: tuple[str, str] = ("centroid_latitude", "centroid_longitude"),
                    miles: tuple[int, ...] = (10, 25, 50)) -> DataFrame:
    """Nearest hospital, nearest emergency hospital, hospitals and known beds within each radius."""
    hospitals = settle(facilities.where(
        (F.col("facility_type") == "hospital") & F.col("longitude").isNotNull() & F.col("latitude").isNotNull()
    ).select("facility_id", F.col("latitude").cast("double").alias("to_latitude"),
             F.col("longitude").cast("double").alias("to_longitude"),
             F.col("bed_count").cast("double").alias("bed_count"),
             F.coalesce(F.col("emergency_services"), F.lit(False)).alias("emergency_services")))
    options = {"left_at": at, "radius": RADIUS_MILES}
    closest = spatial.nearest_miles(areas, hospitals, key, "facility_id", "distance_to_nearest_hospital_miles", **options)
    emergency = spatial.nearest_miles(areas, hospitals.where("emergency_services"), key, "facility_id",
                                      "distance_to_nearest_emergency_hospital_miles", **options)
    around = spatial.radius_totals(areas, hospitals, key, list(miles), {"hospitals": None, "beds": "bed_count"}, **options)
    if hospitals.isEmpty():
        around = around.select(key, *[F.lit(None).cast(t).alias(c) for c, t in around.dtypes if c != key])
    return closest.join(emergency, key).join(around.select(key, *[
        F.col(f"{short}_{m}").alias(f"nearby_{long}_{m}mi")
        for m in miles for short, long in (("hospitals", "hospitals"), ("beds", "known_beds"))]), key)


def need_scores(df: DataFrame, key: str) -> DataFrame:
    """Percentile needs (all ranked in one pass) and their means; missing parts are skipped."""
    ranked = ranking.percentile_scores(
        df, key, {name: numeric(df, source) for name, source in RANKED_NEEDS.items()},
        inverted=["nearby_capacity_need_score"])
    return (
        df.join(ranked, key)
        .withColumn("shortage_area_need_score", clip01(finite("shortage_area_coverage_fraction")))
        .withColumn("demographic_need_score", row_mean(DEMOGRAPHIC_NEEDS))
        .withColumn("access_gap_score", row_mean(ACCESS_NEEDS))
        .withColumn("screening_need_score", row_mean(SCREENING_NEEDS))
    )


def area_features(areas: DataFrame, facilities: DataFrame, dictionary: DataFrame, key: str,
                  at: tuple[str, str] = ("centroid_latitude", "centroid_longitude")) -> DataFrame:
    """All features of one area table, one row per area."""
    rates = demographic_rates(areas, phrase_columns(dictionary, "B27001", "no health insurance coverage"),
                              phrase_columns(dictionary, "B18101", "with a disability"))
    # Ranks read their input twice, so the joined frame is settled first.
    return need_scores(settle(rates.join(facility_access(areas, facilities, key, at), key)), key)
