"""Baseline access, candidate catchments, screening and national scores."""
from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.functions import road
from sitewise.plans import catchment, screen
from sitewise.session import settle

from .registry import case
from .tables import role, sql_miles, with_roles

T4 = (15, 30, 45, 60)


def _demand(spark, folder):
    d = role(spark, folder, "demand").where("population > 0")
    return d.withColumns({"road_detour_factor": road.detour_factor("rurality"),
                          "effective_speed_mph": road.effective_mph("rurality")})


def _hospitals(spark, folder):
    return role(spark, folder, "facilities").withColumn("bed_count", F.coalesce("bed_count", F.lit(0)))


def _sites(spark, folder, demand):
    areas = demand.select(F.format_string("T%06d", "demand_id").alias("tract_geoid"), "road_detour_factor", "effective_speed_mph")
    return catchment.with_source_roads(role(spark, folder, "sites").drop("rurality"), areas, "tract_geoid")


def _features(spark, folder):
    demand, hospitals = _demand(spark, folder), _hospitals(spark, folder)
    baseline = settle(catchment.existing_access(demand, hospitals))
    return catchment.site_features(_sites(spark, folder, demand), demand, baseline, hospitals)


DEMAND_SQL = f"""
d AS (SELECT *, 1.2::double + rurality * 0.14::double AS detour, greatest(29 + rurality * 23, 10) AS mph FROM demand WHERE population > 0),
h AS (SELECT facility_id, latitude, longitude, coalesce(bed_count, 0) AS beds, emergency_services FROM facilities),
dh AS (SELECT d.demand_id, h.*, detour, mph, {sql_miles('d.latitude', 'd.longitude', 'h.latitude', 'h.longitude')} AS miles FROM d CROSS JOIN h),
dm AS (SELECT *, miles * detour / greatest(mph, 10) * 60 AS minutes FROM dh),
base AS (SELECT demand_id, arg_min(facility_id, miles) AS nearest_id, min(minutes) AS base_minutes, min(miles * detour) AS base_miles,
    arg_min(facility_id, miles) FILTER (emergency_services) AS emergency_id, min(minutes) FILTER (emergency_services) AS emergency_minutes,
    {", ".join(f"count(*) FILTER (minutes <= {t}) AS hospitals_within_{t}min, coalesce(sum(beds) FILTER (minutes <= {t}), 0)::bigint AS beds_within_{t}min" for t in T4)}
  FROM dm GROUP BY demand_id)"""

SITE_SQL = f"""
s AS (SELECT sites.*, coalesce(a.detour, 1.25) AS site_detour, coalesce(a.mph, 40) AS site_mph
      FROM sites LEFT JOIN d a ON source_tract_geoid = 'T' || lpad(a.demand_id::varchar, 6, '0')),
sd AS (SELECT s.site_id, d.*, b.base_minutes, site_detour, site_mph,
              {sql_miles('s.latitude', 's.longitude', 'd.latitude', 'd.longitude')} AS miles
       FROM s CROSS JOIN d JOIN base b USING (demand_id)),
sm AS (SELECT *, miles * (0.5::double * (site_detour + detour)) / greatest(0.5::double * (site_mph + mph), 10) * 60 AS minutes FROM sd WHERE miles <= 70),
sv AS (SELECT *, greatest(0, base_minutes - minutes) AS saved FROM sm),
reach AS (SELECT site_id, count(*) AS modeled_demand_points, round(sum((population * saved)::DECIMAL(28, 10)), 6) AS weighted_drive_minutes_saved,
    coalesce(sum(population) FILTER (saved > 0), 0) AS population_with_any_access_improvement,
    {", ".join(f"coalesce(sum(population) FILTER (saved >= {t}), 0) AS population_saving_{t}plus_minutes" for t in (10, 20, 30))},
    {", ".join(f"coalesce(sum(population) FILTER (minutes <= {t}), 0) AS population_within_{t}min, coalesce(sum(population) FILTER (minutes <= {t} AND base_minutes > {t}), 0) AS newly_accessible_population_{t}min, coalesce(sum(population * demographic_need_score) FILTER (minutes <= {t}), 0) AS vulnerability_weighted_population_{t}min" for t in T4)},
    {", ".join(f"coalesce(sum({g}) FILTER (minutes <= {t}), 0) AS {g}_population_{t}min" for t in T4 for g in ('elderly', 'poverty', 'uninsured', 'disabled'))}
  FROM sv GROUP BY site_id),
sh AS (SELECT s.site_id, h.beds, site_detour, site_mph, {sql_miles('s.latitude', 's.longitude', 'h.latitude', 'h.longitude')} AS miles FROM s CROSS JOIN h),
supply AS (SELECT site_id, min(minutes) AS nearest_existing_hospital_minutes,
    {", ".join(f"count(*) FILTER (minutes <= {t}) AS existing_hospitals_{t}min, coalesce(sum(beds) FILTER (minutes <= {t}), 0) AS existing_beds_{t}min" for t in T4)}
  FROM (SELECT *, miles * site_detour / greatest(site_mph, 10) * 60 AS minutes FROM sh WHERE miles <= 110) GROUP BY site_id)"""

_REACH_INTS = (["modeled_demand_points", "population_with_any_access_improvement"]
               + [f"population_saving_{t}plus_minutes" for t in (10, 20, 30)]
               + [f"{n}_{t}min" for t in T4 for n in ("population_within", "newly_accessible_population", "elderly_population",
                                                      "poverty_population", "uninsured_population", "disabled_population")])
_SUPPLY_INTS = [f"{n}_{t}min" for t in T4 for n in ("existing_hospitals", "existing_beds")]


@case("sp10_existing_access", with_roles("demand", "facilities") + "," + DEMAND_SQL + f"""
SELECT demand_id, nearest_id::varchar AS nearest_hospital_id, round(base_minutes, 6) AS minutes, round(base_miles, 6) AS drive_miles,
  emergency_id::varchar AS emergency_id, round(emergency_minutes, 6) AS emergency_minutes,
  {", ".join(f"hospitals_within_{t}min, beds_within_{t}min" for t in T4)} FROM base""")
def existing_access(spark, folder):
    found = catchment.existing_access(_demand(spark, folder), _hospitals(spark, folder))
    return found.select(
        "demand_id", F.col("nearest_hospital_id").cast("string").alias("nearest_hospital_id"),
        F.round("nearest_hospital_drive_minutes", 6).alias("minutes"), F.round("nearest_hospital_drive_miles", 6).alias("drive_miles"),
        F.col("nearest_emergency_hospital_id").cast("string").alias("emergency_id"),
        F.round("nearest_emergency_drive_minutes", 6).alias("emergency_minutes"),
        *[F.col(f"{n}_within_{t}min").cast("long").alias(f"{n}_within_{t}min") for t in T4 for n in ("hospitals", "beds")])


@case("sp11_sp12_site_features", with_roles("demand", "facilities", "sites") + "," + DEMAND_SQL + "," + SITE_SQL + f"""
SELECT site_id, round(coalesce(weighted_drive_minutes_saved, 0), 2)::DOUBLE AS weighted_drive_minutes_saved,
  {", ".join(f"round(coalesce(vulnerability_weighted_population_{t}min, 0), 3) AS vulnerability_weighted_population_{t}min" for t in T4)},
  {", ".join(f"coalesce({c}, 0)::bigint AS {c}" for c in _REACH_INTS + _SUPPLY_INTS)},
  round(nearest_existing_hospital_minutes, 6) AS nearest_existing_hospital_minutes
FROM s LEFT JOIN reach USING (site_id) LEFT JOIN supply USING (site_id)""")
def site_features(spark, folder):
    return _features(spark, folder).select(
        "site_id", F.round("weighted_drive_minutes_saved", 2).alias("weighted_drive_minutes_saved"),
        *[F.round(f"vulnerability_weighted_population_{t}min", 3).alias(f"vulnerability_weighted_population_{t}min") for t in T4],
        *[F.col(c).cast("long").alias(c) for c in _REACH_INTS + _SUPPLY_INTS],
        F.round("nearest_existing_hospital_minutes", 6).alias("nearest_existing_hospital_minutes"))


NATIONAL_SQL = """
f AS (SELECT s.*, coalesce(weighted_drive_minutes_saved::DOUBLE, 0) AS weighted_saved, coalesce(population_with_any_access_improvement, 0) AS improved,
        coalesce(population_saving_20plus_minutes, 0) AS saving20, coalesce(newly_accessible_population_30min, 0) AS newly30,
        coalesce(population_within_30min, 0) AS pop30, coalesce(population_within_45min, 0) AS pop45, coalesce(existing_beds_30min, 0) AS beds30,
        coalesce(vulnerability_weighted_population_30min, 0) AS vuln30, nearest_existing_hospital_minutes AS nearest_minutes,
        coalesce(elderly_population_30min, 0) AS elderly30, coalesce(poverty_population_30min, 0) AS poverty30,
        coalesce(uninsured_population_30min, 0) AS uninsured30, coalesce(disabled_population_30min, 0) AS disabled30
      FROM s LEFT JOIN reach USING (site_id) LEFT JOIN supply USING (site_id)),
p AS (SELECT *, CASE WHEN beds30 > 0 THEN pop30 / beds30 END AS pressure0, CASE WHEN pop30 > 0 THEN round(vuln30, 6) / pop30 END AS vmean FROM f),
q AS (SELECT coalesce(quantile_cont(pressure0, 0.995), 1) AS ceiling FROM p),
p2 AS (SELECT p.*, CASE WHEN beds30 <= 0 AND pop30 > 0 THEN CASE WHEN ceiling > 0 THEN ceiling * 1.25 ELSE 1e9 END ELSE pressure0 END AS pressure FROM p, q),
r AS (SELECT *,
   (rank() OVER (ORDER BY weighted_saved) + (count(*) OVER (PARTITION BY weighted_saved) - 1) / 2.0::double) / count(*) OVER () AS access_improvement_score,
   (rank() OVER (ORDER BY newly30) + (count(*) OVER (PARTITION BY newly30) - 1) / 2.0::double) / count(*) OVER () AS new_access_score,
   CASE WHEN pressure IS NULL THEN 0 ELSE (rank() OVER (ORDER BY pressure NULLS LAST) + (count(*) OVER (PARTITION BY pressure) - 1) / 2.0::double) / count(pressure) OVER () END AS capacity_gap_score,
   CASE WHEN vmean IS NULL THEN 0 ELSE (rank() OVER (ORDER BY vmean NULLS LAST) + (count(*) OVER (PARTITION BY vmean) - 1) / 2.0::double) / count(vmean) OVER () END AS vulnerability_catchment_score
  FROM p2),
nat AS (SELECT *, (access_improvement_score + new_access_score + capacity_gap_score + vulnerability_catchment_score) / 4 AS stage6_access_score FROM r)"""


def scored_sites(spark, folder):
    """National scores. Sums of products are rounded first: their last bits depend on the summation order."""
    features = settle(_features(spark, folder).withColumns({
        "vulnerability_weighted_population_30min": F.round("vulnerability_weighted_population_30min", 6)}))
    return catchment.national_scores(features)


@case("md07_national_scores", with_roles("demand", "facilities", "sites") + "," + DEMAND_SQL + "," + SITE_SQL + "," + NATIONAL_SQL + """
SELECT site_id, """ + ", ".join(f"round({c}::DECIMAL(18, 12), 6)::DOUBLE AS {c}" for c in (
    "access_improvement_score", "new_access_score", "capacity_gap_score", "vulnerability_catchment_score")) + """,
  round(stage6_access_score::DECIMAL(18, 12), 8)::DOUBLE AS stage6_access_score,
  row_number() OVER (ORDER BY round(stage6_access_score, 12) DESC, site_id)::int AS stage6_rank FROM nat""")
def national_scores(spark, folder):
    return scored_sites(spark, folder).select(
        "site_id", "stage6_rank", F.round(F.round("stage6_access_score", 12), 8).alias("stage6_access_score"), *[F.round(c, 6).alias(c) for c in (
            "access_improvement_score", "new_access_score", "capacity_gap_score", "vulnerability_catchment_score")])


def screened(spark, folder):
    from sitewise.operators import spatial
    demand = role(spark, folder, "demand")
    hospitals = _hospitals(spark, folder).withColumnsRenamed({"latitude": "to_latitude", "longitude": "to_longitude"})
    near = spatial.nearest_miles(demand, hospitals, "demand_id", "facility_id", "nearest_miles")
    beds = spatial.radius_totals(demand, hospitals, "demand_id", [25], {"beds": "bed_count"}).withColumnRenamed(
        "beds_25", "nearby_known_beds_25mi")
    areas = settle(screen.with_estimated_minutes(demand.join(near, "demand_id").join(beds, "demand_id"), "rurality"))
    gated = screen.screening_catchment(screen.broad_gate(areas), areas, "demand_id")
    gated = gated.withColumn("approx_weighted_drive_minutes_saved", F.round("approx_weighted_drive_minutes_saved", 6))
    return screen.screening_scores(settle(gated), "demand_id", cfg=screen.ScreenConfig(top_n_per_state=20))


_T3 = (30, 45, 60)
SCREEN_SQL = f"""
nb AS (SELECT d.demand_id, min(miles) AS nearest_miles, coalesce(sum(coalesce(bed_count, 0)) FILTER (miles <= 25), 0) AS beds25
       FROM (SELECT d.demand_id, f.bed_count, {sql_miles('d.latitude', 'd.longitude', 'f.latitude', 'f.longitude')} AS miles FROM demand d CROSS JOIN facilities f) d GROUP BY d.demand_id),
a AS (SELECT demand.*, nearest_miles, beds25, 1.22::double + rurality * 0.08::double AS detour, 28 + rurality * 18 AS mph FROM demand JOIN nb USING (demand_id)),
am AS (SELECT *, nearest_miles * detour / mph * 60 AS existing_minutes FROM a),
g AS (SELECT * FROM am WHERE (population >= 1000 AND (screening_need_score >= 0.45::double OR nearest_miles >= 10)) OR (existing_minutes >= 35 AND population >= 750)),
gp AS (SELECT g.demand_id, t.population, t.poverty, t.uninsured, t.elderly, t.disabled, t.existing_minutes AS base,
        g.detour AS gd, g.mph AS gm, t.detour AS td, t.mph AS tm, {sql_miles('g.latitude', 'g.longitude', 't.latitude', 't.longitude')} AS miles
       FROM g CROSS JOIN (SELECT * FROM am WHERE population > 0) t),
gm AS (SELECT *, miles * (0.5::double * (gd + td)) / greatest(0.5::double * (gm + tm), 5) * 60 AS minutes FROM gp WHERE miles <= least(70, gm / gd)),
gs AS (SELECT *, greatest(0, base - minutes) AS saved FROM gm),
gsum AS (SELECT demand_id, round(sum(population * saved), 6) AS weighted_saved,
   coalesce(sum(population) FILTER (saved >= 10), 0) AS saving10, coalesce(sum(population) FILTER (saved >= 20), 0) AS saving20,
   {", ".join(f"coalesce(sum(population) FILTER (minutes <= {t}), 0) AS pop{t}, coalesce(sum(population) FILTER (minutes <= {t} AND base > {t}), 0) AS new{t}, coalesce(sum(poverty) FILTER (minutes <= {t}), 0) AS poverty{t}, coalesce(sum(uninsured) FILTER (minutes <= {t}), 0) AS uninsured{t}, coalesce(sum(elderly) FILTER (minutes <= {t}), 0) AS elderly{t}, coalesce(sum(disabled) FILTER (minutes <= {t}), 0) AS disabled{t}" for t in _T3)}
  FROM gs GROUP BY demand_id)"""


@case("sp13_md04_screening_catchment", with_roles("demand", "facilities") + "," + SCREEN_SQL + f"""
SELECT demand_id, round(existing_minutes, 6) AS existing_minutes, round(weighted_saved, 2) AS weighted_saved, saving10::bigint AS saving10, saving20::bigint AS saving20,
   {", ".join(f"{c}{t}::bigint AS {c}{t}" for t in _T3 for c in ('pop', 'new', 'poverty', 'uninsured', 'elderly', 'disabled'))}
FROM g JOIN gsum USING (demand_id)""")
def screening_catchment(spark, folder):
    s = screened(spark, folder)
    names = {"pop": "approx_population", "new": "approx_newly_accessible_population", "poverty": "approx_poverty_population",
             "uninsured": "approx_uninsured_population", "elderly": "approx_elderly_population", "disabled": "approx_disabled_population"}
    return s.select(
        "demand_id", F.round("existing_minutes", 6).alias("existing_minutes"),
        F.round("approx_weighted_drive_minutes_saved", 2).alias("weighted_saved"),
        F.col("approx_population_saving_10plus_minutes").cast("long").alias("saving10"),
        F.col("approx_population_saving_20plus_minutes").cast("long").alias("saving20"),
        *[F.col(f"{long}_{t}min").cast("long").alias(f"{short}{t}") for t in _T3 for short, long in names.items()])


def _avg_rank(v: str, over: str = "") -> str:
    part = f"PARTITION BY {over} " if over else ""
    both = f"{over}, {v}" if over else v
    return (f"(rank() OVER ({part}ORDER BY {v}) + (count(*) OVER (PARTITION BY {both}) - 1) / 2.0::double) / count(*) OVER ({part})")


@case("md05_wn04_screening_shortlist", with_roles("demand", "facilities") + "," + SCREEN_SQL + f""",
c AS (SELECT g.*, gsum.* EXCLUDE (demand_id), -(beds25 / greatest(population, 1)) AS spare FROM g JOIN gsum USING (demand_id)),
c2 AS (SELECT *, {_avg_rank('weighted_saved')} AS benefit, {_avg_rank('new30')} AS fresh, {_avg_rank('spare')} AS gap,
       {_avg_rank('poverty30')} AS pov, {_avg_rank('uninsured30')} AS unins FROM c),
c3 AS (SELECT *, least(greatest(0.35::double * demographic_need_score + 0.25::double * shortage_area_coverage_fraction + 0.2::double * pov + 0.2::double * unins, 0), 1) AS vul FROM c2),
c4 AS (SELECT *, least(greatest(0.3::double * benefit + 0.2::double * fresh + 0.15::double * gap + 0.15::double * vul + 0.1::double * screening_need_score + 0.1::double * access_gap_score, 0), 1) AS score FROM c3),
c5 AS (SELECT *, row_number() OVER (PARTITION BY state_fips ORDER BY round(score, 12) DESC, demand_id)::int AS state_rank, {_avg_rank('round(score, 12)', 'state_fips')} AS state_percentile FROM c4)
SELECT demand_id, state_fips, round(score, 6) AS score, state_rank, round(state_percentile, 6) AS state_percentile,
   existing_minutes >= 35 AND population >= 1500 AS severe,
   state_rank <= 20 OR state_percentile >= 0.92::double OR (existing_minutes >= 35 AND population >= 1500) AS shortlisted FROM c5""")
def shortlist(spark, folder):
    return screened(spark, folder).select(
        "demand_id", "state_fips", F.round("stage6a_score", 6).alias("score"), "state_rank",
        F.round("state_percentile", 6).alias("state_percentile"), F.col("severe_access_keep").alias("severe"), "shortlisted")


# A crowd: all areas and sites within about forty miles, a third of the areas and a fifth of the sites at one location each.
_CROWD = {
    "areas": "CASE WHEN c_custkey % 3 = 0 THEN {x} ELSE {x} + ((c_custkey * {p}) % {m}) / {s} END",
    "sites": "CASE WHEN p_partkey % 5 = 0 THEN {x} ELSE {x} + ((p_partkey * {p}) % {m}) / {s} END",
}


def _crowded(side: str, key: str, div: str) -> str:
    lat = _CROWD[side].format(x=f"cast(39 AS {div})", p=7919, m=24000, s=f"cast(40000 AS {div})")
    lon = _CROWD[side].format(x=f"cast(-95 AS {div})", p=104729, m=57000, s=f"cast(80000 AS {div})")
    return (f"SELECT {key} AS id, {lat} AS latitude, {lon} AS longitude, cast(1.2 AS {div}) + {key} % 4 * cast(0.04 AS {div}) AS detour, "
            f"cast(29 AS {div}) + {key} % 4 * 7 AS mph")


def _crowd_sql(side: str, div: str) -> str:
    if side == "areas":
        return _crowded("areas", "c_custkey", div) + f", cast(c_custkey % 40 AS {div}) AS base, cast(floor(greatest(c_acctbal, 0)) AS {div}) AS people FROM customer"
    return _crowded("sites", "p_partkey", div) + " FROM part"


@case("sp11_crowded_catchment", f"""WITH a AS ({_crowd_sql('areas', 'double')}), s AS ({_crowd_sql('sites', 'double')}),
p AS (SELECT s.id AS site_id, a.people, a.base, s.detour AS sd, s.mph AS sm, a.detour AS ad, a.mph AS am, {sql_miles('s.latitude', 's.longitude', 'a.latitude', 'a.longitude')} AS miles FROM s CROSS JOIN a),
m AS (SELECT *, miles * (0.5::double * (sd + ad)) / greatest(0.5::double * (sm + am), 10) * 60 AS minutes FROM p WHERE miles <= 70)
SELECT site_id, count(*) AS areas, {", ".join(f"coalesce(sum(people) FILTER (minutes <= {t}), 0)::bigint AS people_{t}min" for t in T4)},
  round(sum(people * greatest(0, base - minutes)), 2) AS minutes_saved, coalesce(sum(people) FILTER (base > minutes), 0)::bigint AS people_gaining,
  round(min(minutes), 6) AS nearest_minutes FROM m GROUP BY site_id""")
def crowded_catchment(spark, folder):
    from sitewise.operators.reach import reach_totals

    from .tables import table
    for name in ("customer", "part"):
        table(spark, folder, name).createOrReplaceTempView(f"crowd_{name}")
    areas = spark.sql(_crowd_sql("areas", "double").replace("FROM customer", "FROM crowd_customer"))
    sites = spark.sql(_crowd_sql("sites", "double").replace("FROM part", "FROM crowd_part"))
    targets = areas.groupBy(F.col("latitude").alias("to_latitude"), F.col("longitude").alias("to_longitude"), F.col("detour").alias("to_detour"),
                            F.col("mph").alias("to_mph"), "base").agg(F.count("*").alias("areas"), F.sum("people").alias("people"))
    sums = {"areas": ("areas", None)} | {f"people_{t}min": ("people", t) for t in T4}
    found = reach_totals(sites, targets, "id", sums, miles=70, right_roads=("to_detour", "to_mph"), base="base", saving={
        "minutes_saved": ("people", None), "people_gaining": ("people", 0)}, closest="nearest_minutes")
    return found.select(
        F.col("id").alias("site_id"), "areas", *[F.coalesce(f"people_{t}min", F.lit(0)).cast("long").alias(f"people_{t}min") for t in T4],
        F.round(F.col("minutes_saved").cast("double"), 2).alias("minutes_saved"), F.coalesce("people_gaining", F.lit(0)).cast("long").alias("people_gaining"),
        F.round("nearest_minutes", 6).alias("nearest_minutes"))
