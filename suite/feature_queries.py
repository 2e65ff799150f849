"""Area features from wide survey columns; demand and hospital builders; shortlist join."""
from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.functions import road
from sitewise.plans import catchment, features, screen

from .registry import case
from .tables import role, sql_miles, table, with_roles

_AGE = [f"acs_b01001_e{i:03d}" for i in range(1, 50)]


def _survey_expr(div: str) -> dict[str, str]:
    """Wide survey columns from the demand role, same text in both engines."""
    out = {"acs_b01001_e001": "cast(population AS double)"}
    for i in range(2, 50):
        out[f"acs_b01001_e{i:03d}"] = f"CASE WHEN demand_id % 29 = 0 THEN NULL ELSE cast(demand_id * {i} % 31 AS double) END"
    out |= {"acs_b19013_e001": "cast(demand_id % 90000 AS double)", "acs_b17001_e001": "cast(demand_id % 500 AS double)", "acs_b17001_e002": "cast(demand_id % 83 AS double)",
            "acs_b08201_e001": "cast(demand_id % 300 AS double)", "acs_b08201_e002": "cast(demand_id % 57 AS double)", "acs_b27001_e001": "cast(demand_id % 700 AS double)",
            "acs_b27001_e005": "cast(demand_id % 41 AS double)", "acs_b27001_e008": "CASE WHEN demand_id % 3 = 0 THEN NULL ELSE cast(demand_id % 43 AS double) END",
            "acs_b18101_e001": "cast(demand_id % 900 AS double)", "acs_b18101_e004": "cast(demand_id % 37 AS double)",
            "located_hospital_known_beds_sum": "CASE WHEN demand_id % 4 = 0 THEN NULL ELSE cast(demand_id % 350 AS double) END",
            "mua_boundary_area_fraction": "CASE WHEN demand_id % 6 = 0 THEN NULL ELSE (demand_id % 11) / cast(10 AS double) END", "mup_boundary_area_fraction": "(demand_id % 8) / cast(10 AS double)"}
    return out


def _areas(spark, folder):
    return role(spark, folder, "demand").selectExpr("demand_id", "latitude AS centroid_latitude", "longitude AS centroid_longitude",
                                                    *[f"{sql} AS {name}" for name, sql in _survey_expr("div").items()])


def _dictionary(spark):
    """Three rows of a data dictionary decide which columns are summed."""
    return spark.createDataFrame([
        ("acs_b27001_e005", "B27001", "estimate", "No health insurance coverage", "Under 19 > No health insurance coverage"),
        ("acs_b27001_e008", "B27001", "estimate", "No Health Insurance coverage", None), ("acs_b27001_m008", "B27001", "margin_of_error", "No health insurance coverage", None),
        ("acs_b18101_e004", "B18101", "estimate", "With a disability", "Male > With a disability")], "column string, table string, kind string, label string, label_path string")


def _hospitals(spark, folder):
    return role(spark, folder, "facilities").withColumn("facility_type", F.lit("hospital"))


_SUM_65 = " + ".join(features.AGE_65_PLUS)
_SUM_18 = " + ".join(features.UNDER_18)


def _pct(v, order="ASC"):
    return f"CASE WHEN {v} IS NOT NULL THEN (rank() OVER (ORDER BY {v} {order} NULLS LAST) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0::double) / count({v}) OVER () END"


def _div(a, b):
    return f"CASE WHEN {b} > 0 THEN {a} / {b} * 100 END"


FEATURE_SQL = with_roles("demand", "facilities") + f""",
a AS (SELECT demand_id, latitude, longitude, {", ".join(f"{sql} AS {name}" for name, sql in _survey_expr("//").items())} FROM demand),
fa AS (SELECT demand_id, min(m) AS nearest, min(m) FILTER (er) AS emergency, coalesce(sum(beds) FILTER (m <= 25), 0) AS beds25, count(*) FILTER (m <= 50) AS hospitals50
  FROM (SELECT a.demand_id, f.emergency_services AS er, coalesce(f.bed_count, 0) AS beds, {sql_miles('a.latitude', 'a.longitude', 'f.latitude', 'f.longitude', 6371.0088 / 1.609344)} AS m FROM a CROSS JOIN facilities f) GROUP BY 1),
r AS (SELECT a.demand_id, acs_b01001_e001 AS population, {_div(f'({_SUM_65})', 'acs_b01001_e001')} AS elderly_pct, {_div(f'({_SUM_18})', 'acs_b01001_e001')} AS under18_pct, {_div('acs_b17001_e002', 'acs_b17001_e001')} AS poverty_pct,
  {_div('acs_b08201_e002', 'acs_b08201_e001')} AS no_vehicle_pct, {_div('(acs_b27001_e005 + coalesce(acs_b27001_e008, 0))', 'acs_b27001_e001')} AS uninsured_pct, {_div('acs_b18101_e004', 'acs_b18101_e001')} AS disability_pct,
  CASE WHEN acs_b01001_e001 > 0 THEN located_hospital_known_beds_sum / acs_b01001_e001 * 1000 END AS beds_per_1000, greatest(coalesce(mua_boundary_area_fraction, 0), mup_boundary_area_fraction) AS shortage,
  nearest, emergency, beds25::double AS beds25, hospitals50 FROM a JOIN fa USING (demand_id)),
s AS (SELECT *, {_pct('population')} AS n_pop, {_pct('elderly_pct')} AS n_eld, {_pct('poverty_pct')} AS n_pov, {_pct('uninsured_pct')} AS n_uni, {_pct('disability_pct')} AS n_dis, {_pct('no_vehicle_pct')} AS n_veh,
  {_pct('nearest')} AS n_dist, {_pct('beds25', 'DESC')} AS n_cap FROM r),
c AS (SELECT *, list_avg(list_filter([n_eld, n_pov, n_uni, n_dis, n_veh], lambda x: x IS NOT NULL)) AS demographic, (n_dist + n_cap) / 2 AS gap FROM s)"""


@case("typ23_typ24_demographic_rates", FEATURE_SQL + """ SELECT demand_id, round(elderly_pct, 6) AS elderly_pct, round(under18_pct, 6) AS under18_pct, round(poverty_pct, 6) AS poverty_pct, round(no_vehicle_pct, 6) AS no_vehicle_pct,
  round(uninsured_pct, 6) AS uninsured_pct, round(disability_pct, 6) AS disability_pct, round(beds_per_1000, 4) AS beds_per_1000, shortage FROM r""")
def rates(spark, folder):
    dictionary = _dictionary(spark)
    found = features.demographic_rates(_areas(spark, folder), features.phrase_columns(dictionary, "B27001", "no health insurance coverage"),
                                       features.phrase_columns(dictionary, "B18101", "with a disability"))
    names = {"population_age_65_plus_pct": "elderly_pct", "population_under_18_pct": "under18_pct", "poverty_pct": "poverty_pct", "households_no_vehicle_pct": "no_vehicle_pct",
             "uninsured_pct": "uninsured_pct", "disability_pct": "disability_pct"}
    return found.select("demand_id", *[F.round(c, 6).alias(n) for c, n in names.items()], F.round("known_beds_per_1000_residents", 4).alias("beds_per_1000"),
                        F.col("shortage_area_coverage_fraction").alias("shortage"))


@case("md03_typ25_area_features", FEATURE_SQL + """ SELECT demand_id, round(nearest, 6) AS nearest, round(emergency, 6) AS emergency, beds25, hospitals50, round(demographic, 6) AS demographic_need_score, round(gap, 7) AS access_gap_score,
  round(n_pop, 6) AS population_need_score, round((n_pop + coalesce(demographic, 0) + gap + least(greatest(shortage, 0), 1)) / (3 + (demographic IS NOT NULL)::int), 8) AS screening_need_score FROM c""")
def area_features(spark, folder):
    found = features.area_features(_areas(spark, folder), _hospitals(spark, folder), _dictionary(spark), "demand_id")
    return found.select(
        "demand_id", F.round("distance_to_nearest_hospital_miles", 6).alias("nearest"), F.round("distance_to_nearest_emergency_hospital_miles", 6).alias("emergency"),
        F.col("nearby_known_beds_25mi").alias("beds25"), F.col("nearby_hospitals_50mi").alias("hospitals50"), F.round("demographic_need_score", 6).alias("demographic_need_score"),
        F.round("access_gap_score", 7).alias("access_gap_score"), F.round("population_need_score", 6).alias("population_need_score"), F.round("screening_need_score", 8).alias("screening_need_score"))


@case("md06_demand_points", with_roles("demand") + """ SELECT lpad(demand_id::varchar, 11, '0') AS demand_id, left(lpad(demand_id::varchar, 11, '0'), 2) AS state_fips, round(1.2::double + rurality * 0.14::double, 6) AS road_detour_factor,
  round(29 + rurality * 23, 6) AS effective_speed_mph, population::double AS population, elderly::double AS elderly FROM demand WHERE population > 0""")
def demand_points(spark, folder):
    areas = role(spark, folder, "demand").withColumn("demand_id", F.lpad(F.col("demand_id").cast("string"), 11, "0"))
    found = catchment.demand_points(areas, "demand_id", road.rurality(areas), {"population": "population", "elderly": "elderly"}, at=("latitude", "longitude"))
    return found.select("demand_id", "state_fips", F.round("road_detour_factor", 6).alias("road_detour_factor"), F.round("effective_speed_mph", 6).alias("effective_speed_mph"), "population", "elderly")


@case("md06_typ26_hospital_points", """SELECT p_partkey::varchar AS facility_id, CASE WHEN p_partkey % 4 = 0 OR p_size < 5 THEN 0 ELSE p_size::double END AS bed_count, p_partkey % 5 IN (1, 2) AS emergency_services
FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 7 <> 0""")
def hospital_points(spark, folder):
    facilities = table(spark, folder, "part").selectExpr(
        "p_partkey AS facility_id", "CASE WHEN p_partkey % 3 = 0 THEN 'Hospital' ELSE 'hospice' END AS facility_type", "CASE WHEN p_partkey % 7 = 0 THEN 'unknown' ELSE '30.5' END AS latitude", "'-90.25' AS longitude",
        "CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_size < 5 THEN '-3' ELSE string(p_size) END AS bed_count", "CASE p_partkey % 5 WHEN 1 THEN 'TRUE' WHEN 2 THEN 'yes' WHEN 3 THEN 'no' END AS emergency_services")
    return catchment.hospital_points(facilities).select("facility_id", "bed_count", "emergency_services")


@case("jn07_shortlist_join", """SELECT c_custkey AS tract_geoid, c_acctbal AS population, s_acctbal AS stage6a_score FROM customer JOIN supplier ON s_suppkey = c_custkey""")
def shortlist_join(spark, folder):
    areas = table(spark, folder, "customer").selectExpr("c_custkey AS tract_geoid", "c_acctbal AS population")
    shortlist = table(spark, folder, "supplier").selectExpr("s_suppkey AS tract_geoid", "s_acctbal AS stage6a_score", "s_nationkey")
    return screen.shortlist_sites(areas, shortlist, "tract_geoid", ["stage6a_score"])


@case("md01_percent_rurality", with_roles("demand") + """, p AS (SELECT demand_id, rurality * 100 AS pct FROM demand)
SELECT demand_id, round(least(greatest(CASE WHEN (SELECT quantile_cont(pct, 0.95) FROM p) > 1.5 THEN pct / 100 ELSE pct END, 0), 1), 6) AS rurality FROM p""")
def percent_rurality(spark, folder):
    areas = role(spark, folder, "demand").selectExpr("demand_id", "rurality * 100 AS rural_pct")
    return areas.select("demand_id", F.round(road.rurality(areas, "rural_pct", percent=road.column_is_percent(areas, "rural_pct")), 6).alias("rurality"))
