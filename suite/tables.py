"""The provided tables in the roles this library works on, in Spark and in SQL.

Coordinates and attributes are integer arithmetic on the keys, so both engines agree on them.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# One definition per role, in a dialect both engines accept after INTDIV/DOUBLE substitution:
# {div} is integer division, {d} marks a double literal.
_ROLES = {
    "demand": ("customer", """
        SELECT c_custkey AS demand_id,
               lpad(cast(c_nationkey + 1 AS {text}), 2, '0') AS state_fips,
               25 + ((c_custkey * 7919) % 24000) / cast(1000 AS double) AS latitude,
               -67 - ((c_custkey * 104729) % 57000) / cast(1000 AS double) AS longitude,
               cast(floor(greatest(c_acctbal, 0)) AS bigint) AS population,
               (c_custkey % 10) / cast(9 AS double) AS rurality,
               cast(floor(floor(greatest(c_acctbal, 0)) * (5 + c_custkey % 7) / 100) AS bigint) AS elderly,
               cast(floor(floor(greatest(c_acctbal, 0)) * (3 + c_custkey % 11) / 100) AS bigint) AS poverty,
               cast(floor(floor(greatest(c_acctbal, 0)) * (2 + c_custkey % 5) / 100) AS bigint) AS uninsured,
               cast(floor(floor(greatest(c_acctbal, 0)) * (4 + c_custkey % 6) / 100) AS bigint) AS disabled,
               (c_custkey % 100) / cast(100 AS double) AS demographic_need_score,
               (c_custkey % 97) / cast(97 AS double) AS screening_need_score,
               (c_custkey % 89) / cast(89 AS double) AS access_gap_score,
               (c_custkey % 5) / cast(4 AS double) AS shortage_area_coverage_fraction
        FROM customer"""),
    "facilities": ("supplier", """
        SELECT s_suppkey AS facility_id,
               lpad(cast(s_nationkey + 1 AS {text}), 2, '0') AS state_fips,
               25 + (((s_suppkey + 100003) * 7919) % 24000) / cast(1000 AS double) AS latitude,
               -67 - (((s_suppkey + 100003) * 104729) % 57000) / cast(1000 AS double) AS longitude,
               CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE cast(s_suppkey % 300 AS bigint) END AS bed_count,
               s_suppkey % 3 <> 0 AS emergency_services
        FROM supplier"""),
    "sites": ("part", """
        SELECT p_partkey AS site_id,
               CASE WHEN p_partkey % 11 = 0 THEN 'T999999'
                    ELSE 'T' || lpad(cast(p_partkey % 500 AS {text}), 6, '0') END AS source_tract_geoid,
               lpad(cast(p_partkey % 50 + 1 AS {text}), 2, '0') AS state_fips,
               25 + (((p_partkey + 50021) * 7919) % 24000) / cast(1000 AS double) AS latitude,
               -67 - (((p_partkey + 50021) * 104729) % 57000) / cast(1000 AS double) AS longitude,
               (p_partkey % 8) / cast(7 AS double) AS rurality,
               cast(p_size AS bigint) AS proposed_beds,
               p_retailprice AS cost,
               p_type AS site_type
        FROM part"""),
    "scored": ("part", """
        SELECT p_partkey AS site_id,
               'T' || lpad(cast(p_partkey % 500 AS {text}), 6, '0') AS source_tract_geoid,
               lpad(cast(p_partkey % 50 + 1 AS {text}), 2, '0') AS state_fips,
               25 + (((p_partkey + 50021) * 7919) % 24000) / cast(1000 AS double) AS latitude,
               -67 - (((p_partkey + 50021) * 104729) % 57000) / cast(1000 AS double) AS longitude,
               (p_partkey % 8) / cast(7 AS double) AS rurality,
               cast(p_partkey % 41 AS double) AS source_population_under_18_pct,
               cast((p_partkey * 7919) % 20000 AS double) AS population_within_15min,
               cast((p_partkey * 7919) % 20000 + (p_partkey * 31) % 60000 AS double) AS population_within_30min,
               cast((p_partkey * 7919) % 20000 + (p_partkey * 31) % 60000 + (p_partkey * 17) % 90000 AS double) AS population_within_45min,
               cast((p_partkey * 7919) % 20000 + (p_partkey * 31) % 60000 + (p_partkey * 17) % 190000 AS double) AS population_within_60min,
               cast((p_partkey * 613) % 5000 AS double) AS newly_accessible_population_15min,
               cast((p_partkey * 613) % 15000 AS double) AS newly_accessible_population_30min,
               cast((p_partkey * 613) % 25000 AS double) AS newly_accessible_population_45min,
               cast((p_partkey * 613) % 35000 AS double) AS newly_accessible_population_60min,
               cast(p_partkey % 2 AS bigint) AS existing_hospitals_15min, cast(p_partkey % 3 AS bigint) AS existing_hospitals_30min,
               cast(p_partkey % 5 AS bigint) AS existing_hospitals_45min, cast(p_partkey % 9 AS bigint) AS existing_hospitals_60min,
               cast((p_partkey % 2) * (p_partkey % 90) AS double) AS existing_beds_15min,
               cast((p_partkey % 3) * (p_partkey % 110) AS double) AS existing_beds_30min,
               cast((p_partkey % 5) * (p_partkey % 120) AS double) AS existing_beds_45min,
               cast((p_partkey % 9) * (p_partkey % 130) AS double) AS existing_beds_60min,
               cast((p_partkey * 7919) % 8000 AS double) AS elderly_population_30min,
               cast((p_partkey * 7919) % 5000 AS double) AS poverty_population_30min,
               cast((p_partkey * 7919) % 4000 AS double) AS uninsured_population_30min,
               cast((p_partkey * 7919) % 3000 AS double) AS disabled_population_30min,
               cast((p_partkey * 104729) % 1000003 AS double) AS weighted_drive_minutes_saved,
               (p_partkey % 400) / cast(10 AS double) AS population_weighted_mean_minutes_saved,
               cast((p_partkey * 71) % 9000 AS double) AS population_saving_20plus_minutes,
               CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE ((p_partkey * 37) % 900) / cast(10 AS double) END AS nearest_existing_hospital_minutes,
               ((p_partkey * 7919) % 1009) / cast(1009 AS double) AS access_improvement_score,
               ((p_partkey * 613) % 1013) / cast(1013 AS double) AS new_access_score,
               ((p_partkey * 379) % 1019) / cast(1019 AS double) AS capacity_gap_score,
               ((p_partkey * 211) % 1021) / cast(1021 AS double) AS vulnerability_catchment_score,
               ((p_partkey * 101) % 1031) / cast(1031 AS double) AS stage6_access_score,
               p_partkey % 17 = 0 AS routing_refined
        FROM part"""),
    "final": ("part", """
        SELECT p_partkey AS site_id,
               CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE 'T' || lpad(cast(p_partkey % 900 AS {text}), 6, '0') END AS source_tract_geoid,
               CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE cast(p_partkey % 56 + 1 AS {text}) END AS state_fips,
               CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE 25 + (((p_partkey + 50021) * 7919) % 24000) / cast(1000 AS double) END AS latitude,
               -67 - (((p_partkey + 50021) * 104729) % 57000) / cast(1000 AS double) AS longitude,
               CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE cast(p_size * 6 AS bigint) END AS proposed_beds,
               CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_partkey % 17 = 0 END AS routing_refined,
               ((p_partkey * 7919) % 1009) / cast(1009 AS double) AS access_score,
               CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE ((p_partkey * 379) % 1019) / cast(1019 AS double) END AS capacity_score,
               ((p_partkey * 211) % 1021) / cast(1021 AS double) AS vulnerability_score,
               ((p_partkey * 613) % 1013) / cast(1013 AS double) AS configuration_fit_score,
               ((p_partkey * 101) % 1031) / cast(1031 AS double) AS cost_efficiency_score,
               ((p_partkey * 367) % 1033) / cast(1033 AS double) AS drive_access_score,
               ((p_partkey * 733) % 1039) / cast(1039 AS double) AS service_fit_score,
               CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE ((p_partkey * 509) % 1049) / cast(1049 AS double) END AS stage8_new_access_30min_score,
               CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE ((p_partkey * 307) % 1051) / cast(1051 AS double) END AS new_access_score,
               ((p_partkey * 911) % 9973) / cast(9973 AS double) AS stage8_score,
               cast(p_partkey % 6 AS bigint) AS recommended_service_count,
               {services}
        FROM part"""),
}

SERVICE_IDS = ("emergency", "icu", "general_surgery", "maternity", "cardiology", "stroke", "behavioral_health", "pediatrics",
               "advanced_imaging", "oncology", "dialysis")
_SERVICE_SQL = ",\n".join(
    f"CASE WHEN p_partkey % {i + 11} = 5 THEN NULL ELSE p_partkey % {i + 2} = 0 END AS service_{s}_recommended, "
    f"p_partkey % {2 * i + 5} = 0 AS service_{s}_gap, ((p_partkey * {i + 3}) % 1061) / cast(1061 AS double) AS service_{s}_score"
    for i, s in enumerate(SERVICE_IDS))


def role_sql(role: str) -> str:
    """The role's SELECT for the oracle."""
    return _ROLES[role][1].format(text="varchar", services=_SERVICE_SQL)


def role(spark: SparkSession, folder: str, name: str) -> DataFrame:
    source, sql = _ROLES[name]
    return spark.sql(sql.format(text="string", services=_SERVICE_SQL).replace(f"FROM {source}", f"FROM {{{source}}}"),
                     **{source: table(spark, folder, source)})


def with_roles(*names: str) -> str:
    """Opening WITH list of role definitions for an oracle."""
    return "WITH " + ",\n".join(f"{n} AS ({role_sql(n)})" for n in names)


# Fixed value: great-circle distance in SQL, arguments (lat1, lon1, lat2, lon2, radius).
def sql_miles(lat1: str, lon1: str, lat2: str, lon2: str, radius: float = 3958.7613) -> str:
    return (f"(2 * {radius}::double * asin(least(1.0, sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + "
            f"cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))")
