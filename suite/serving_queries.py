"""Requests on the final candidates: filters, weighted ranking, diversification, lookups."""
from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.operators import spread
from sitewise.plans import serving
from sitewise.plans.serving import CandidateFilter

from .registry import case
from .tables import SERVICE_IDS, role, sql_miles, with_roles

FINAL = with_roles("final")
_WEIGHTS = {"access": 3, "capacity": 1, "vulnerability": 0, "configuration_fit": 2, "cost_efficiency": 1, "drive_access": 2, "service_fit": 1}
_SCORE_SQL = " + ".join(f"{w / 10!r}::double * coalesce({serving.COMPONENTS[k]}, 0)" for k, w in _WEIGHTS.items() if w)
_LOCATED = "latitude IS NOT NULL AND longitude IS NOT NULL"


@case("md16_tk01_weighted_top", FINAL + f""",
s AS (SELECT *, {_SCORE_SQL} AS query_score FROM final WHERE {_LOCATED})
SELECT site_id, round(query_score, 6) AS score, row_number() OVER (ORDER BY query_score DESC NULLS LAST, site_id)::int AS rank
FROM s WHERE query_score >= 0.3 ORDER BY query_score DESC NULLS LAST, site_id LIMIT 100""")
def weighted_top(spark, folder):
    top = serving.top_candidates(role(spark, folder, "final"), CandidateFilter(min_score=0.3),
                                 score=serving.weighted_score(_WEIGHTS), limit=100, diversify=False)
    return top.select("site_id", F.round("query_score", 6).alias("score"), "rank")


@case("md17_four_weight_top", FINAL + f""",
s AS (SELECT *, 0.4::double * coalesce(stage8_new_access_30min_score, new_access_score, access_score, 0) + 0.3::double * coalesce(drive_access_score, 0)
        + 0.2::double * ((coalesce(capacity_score, 0) + coalesce(vulnerability_score, 0)) / 2) + 0.1::double * coalesce(cost_efficiency_score, 0) AS query_score FROM final WHERE {_LOCATED}),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY coalesce(source_tract_geoid, site_id::varchar) ORDER BY query_score DESC NULLS LAST, site_id) = 1)
SELECT site_id, round(query_score, 6) AS score FROM t""")
def four_weight(spark, folder):
    scored = serving.scored_candidates(role(spark, folder, "final"), CandidateFilter(), serving.four_weight_score(0.4, 0.3, 0.2, 0.1))
    return serving.per_tract(scored).select("site_id", F.round("query_score", 6).alias("score"))


@case("typ30_filters_any_service", FINAL + f"""
SELECT site_id FROM final WHERE {_LOCATED} AND lpad(state_fips, 2, '0') = '06' AND coalesce(proposed_beds, 0) >= 20 AND coalesce(proposed_beds, 0) <= 280
  AND coalesce(routing_refined, false) = false AND (coalesce(service_icu_recommended, false) OR coalesce(service_stroke_recommended, false))""")
def filter_any(spark, folder):
    where = CandidateFilter(state="CA", min_beds=20, max_beds=280, routing_refined=False, services=["ICU", "stroke"])
    return role(spark, folder, "final").where(where.predicate()).select("site_id")


@case("typ29_filters_all_services_bbox", FINAL + """
SELECT site_id FROM final WHERE latitude IS NOT NULL AND longitude BETWEEN -110 AND -80 AND latitude BETWEEN 30 AND 45
  AND coalesce(service_emergency_recommended, false) AND coalesce(service_maternity_recommended, false)""")
def filter_all(spark, folder):
    where = CandidateFilter(bbox="-110,30,-80,45", services=["emergency", "maternity"], require_all_services=True)
    return role(spark, folder, "final").where(where.predicate()).select("site_id")


@case("wn09_grid_diversified", FINAL + f""",
d AS (SELECT * FROM final WHERE {_LOCATED} QUALIFY row_number() OVER (PARTITION BY floor(longitude / 1.25::double), floor(latitude / 1.25::double) ORDER BY stage8_score DESC NULLS LAST, site_id) <= 2)
SELECT site_id, row_number() OVER (ORDER BY stage8_score DESC NULLS LAST, site_id)::int AS rank, round(stage8_score, 6) AS score FROM d ORDER BY stage8_score DESC NULLS LAST, site_id LIMIT 100""")
def grid(spark, folder):
    return serving.top_candidates(role(spark, folder, "final"), zoom=6, limit=serving.default_limit(6)).select("site_id", "rank", F.round("query_score", 6).alias("score"))


@case("wn10_one_per_tract", FINAL + f"""
SELECT site_id, source_tract_geoid FROM final WHERE {_LOCATED}
QUALIFY row_number() OVER (PARTITION BY coalesce(source_tract_geoid, site_id::varchar) ORDER BY stage8_score DESC NULLS LAST, site_id) = 1""")
def tract(spark, folder):
    scored = serving.scored_candidates(role(spark, folder, "final"), CandidateFilter(), F.col("stage8_score"))
    return serving.per_tract(scored).select("site_id", "source_tract_geoid")


def greedy_sql(source: str, thresholds: str, limit: int, radius: float = 3958.8) -> str:
    """The greedy walk as a fold over (threshold, rank): a row joins the picks unless one is too near."""
    near = sql_miles("p.latitude", "p.longitude", "x[1].latitude", "x[1].longitude", radius)
    return f"""
steps AS (SELECT list([{{'site_id': site_id, 'latitude': latitude, 'longitude': longitude, 't': t}}] ORDER BY t DESC, place) AS todo FROM {source}, {thresholds}),
folded AS (SELECT list_reduce(todo, lambda acc, x: CASE WHEN len(acc) < {limit} AND len(list_filter(acc, lambda p: p.site_id = x[1].site_id OR (x[1].t > 0 AND {near} < x[1].t))) = 0
    THEN list_concat(acc, x) ELSE acc END) AS picks FROM steps),
picked AS (SELECT unnest(list_transform(picks, lambda p: p.site_id)) AS site_id, generate_subscripts(picks, 1)::int AS rank FROM folded)"""


_DEFAULT_SCORE_SQL = " + ".join(f"{w!r}::double * coalesce({serving.COMPONENTS[k]}, 0)" for k, w in serving.normalized_weights(serving.DEFAULT_WEIGHTS).items())


@case("md18_tk02_distance_diversified", FINAL + f""",
s AS (SELECT *, {_DEFAULT_SCORE_SQL} AS query_score FROM final WHERE {_LOCATED}),
u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY coalesce(source_tract_geoid, site_id::varchar) ORDER BY query_score DESC NULLS LAST, site_id) = 1),
pool AS (SELECT *, row_number() OVER (ORDER BY query_score DESC NULLS LAST, site_id) AS place FROM u),
thresholds AS (SELECT unnest([75.0::double, 56.25, 37.5, 18.75, 7.5, 0.0]) AS t),""" + greedy_sql("pool", "thresholds", 60) + """
SELECT site_id, rank, round(query_score, 6) AS score FROM picked JOIN pool USING (site_id)""")
def diversified(spark, folder):
    return serving.top_candidates(role(spark, folder, "final"), score=serving.weighted_score(serving.DEFAULT_WEIGHTS), limit=60).select(
        "site_id", "rank", F.round("query_score", 6).alias("score"))


@case("tk02_result_meta", FINAL + f"""
SELECT least(count(*), 40) AS count, count(*) >= 40 AS truncated FROM final WHERE {_LOCATED} AND lpad(state_fips, 2, '0') = '05'""")
def meta(spark, folder):
    top = serving.top_candidates(role(spark, folder, "final"), CandidateFilter(state="5"), limit=40, diversify=False)
    return serving.result_meta(top, 40)


@case("md18_tk02_search_meta", FINAL + f"""
SELECT least(60, count(DISTINCT coalesce(source_tract_geoid, site_id::varchar))) AS count, count(DISTINCT coalesce(source_tract_geoid, site_id::varchar)) >= 60 AS truncated,
  'tract_then_great_circle' AS diversification_method, 40.0::double AS initial_separation_miles, count(*) AS ranked_pool_size
FROM final WHERE {_LOCATED} AND lpad(state_fips, 2, '0') = '05'""")
def search_meta(spark, folder):
    final, where = role(spark, folder, "final"), CandidateFilter(state="5")
    ranked = serving.scored_candidates(final, where, F.col("stage8_score"))
    return serving.search_meta(serving.top_candidates(final, where, limit=60), ranked, 60, where)


@case("ag02_national_summary", FINAL + """
SELECT count(*) AS sites, count(DISTINCT state_fips) AS states, count(*) FILTER (coalesce(routing_refined, false)) AS routing_refined_sites,
  round(avg(stage8_score), 6) AS mean_score, max(stage8_score) AS max_score, round(avg(proposed_beds), 6) AS mean_beds, round(avg(recommended_service_count), 6) AS mean_services FROM final""")
def national(spark, folder):
    return serving.national_summary(role(spark, folder, "final")).withColumns({
        c: F.round(c, 6) for c in ("mean_score", "mean_beds", "mean_services")})


@case("ag03_state_summary", FINAL + """
SELECT lpad(state_fips, 2, '0') AS state_fips, count(*) AS candidate_count, min(longitude) AS west, min(latitude) AS south, max(longitude) AS east, max(latitude) AS north,
  max(stage8_score) AS best_score, round(avg(stage8_score), 6) AS mean_score FROM final WHERE state_fips IS NOT NULL GROUP BY 1""")
def states(spark, folder):
    return serving.state_summary(role(spark, folder, "final")).drop("state", "name").withColumn("mean_score", F.round("mean_score", 6))


@case("ag04_service_summary", FINAL + " " + " UNION ALL ".join(f"""
SELECT '{s}' AS service_id, count(*) FILTER (coalesce(service_{s}_recommended, false)) AS recommended_sites, count(*) FILTER (coalesce(service_{s}_gap, false)) AS gap_sites,
  round(avg(service_{s}_score), 6) AS mean_score FROM final WHERE {_LOCATED}""" for s in SERVICE_IDS))
def service_summary(spark, folder):
    return serving.service_summary(role(spark, folder, "final")).select(
        "service_id", "recommended_sites", "gap_sites", F.round("mean_score", 6).alias("mean_score"))


@case("md20_preset_scores", FINAL + " " + " UNION ALL ".join(
    f"SELECT site_id, '{name}' AS preset, round(" + " + ".join(f"{w!r}::double * coalesce({serving.COMPONENTS[k]}, 0)" for k, w in serving.normalized_weights(mix).items())
    + ", 6) AS score FROM final" for name, mix in serving.presets().items()))
def preset_scores(spark, folder):
    return serving.preset_scores(role(spark, folder, "final")).withColumn("score", F.round("score", 6))


_BREAKDOWN = FINAL + ", c AS (" + " UNION ALL ".join(
    f"SELECT site_id, {i} AS ordinal, '{k}' AS component, least(greatest(coalesce({col}, 0), 0), 1) AS factor, {serving.DEFAULT_WEIGHTS[k] / sum(serving.DEFAULT_WEIGHTS.values())!r}::double AS share FROM final"
    for i, (k, col) in enumerate(serving.COMPONENTS.items())) + """),
r AS (SELECT *, share * factor * 100 AS raw FROM c),
t AS (SELECT *, floor(sum(raw) OVER (PARTITION BY site_id) + 0.5) AS total, sum(raw) OVER (PARTITION BY site_id) AS summed FROM r),
e AS (SELECT *, CASE WHEN summed > 0 THEN round(raw / summed * total, 9) ELSE 0 END AS exact FROM t),
p AS (SELECT *, floor(exact) AS whole, CASE WHEN summed > 0 THEN total - sum(floor(exact)) OVER (PARTITION BY site_id) ELSE 0 END AS left_over FROM e),
q AS (SELECT *, (whole + CASE WHEN row_number() OVER (PARTITION BY site_id ORDER BY exact - whole DESC, ordinal) <= left_over THEN 1 ELSE 0 END)::bigint AS points FROM p)"""


@case("md21_ag12_score_breakdown", _BREAKDOWN + " SELECT site_id, component, round(factor, 6) AS factor, round(raw, 6) AS raw, points FROM q")
def breakdown(spark, folder):
    return serving.score_breakdown(role(spark, folder, "final"), serving.DEFAULT_WEIGHTS).select(
        "site_id", "component", F.round("factor", 6).alias("factor"), F.round("raw", 6).alias("raw"), "points")


@case("md21_top_reasons", _BREAKDOWN + """
SELECT site_id, component, points FROM q WHERE factor >= 0.5 AND raw > 0 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY raw DESC, ordinal) <= 2""")
def reasons(spark, folder):
    return serving.top_reasons(serving.score_breakdown(role(spark, folder, "final"), serving.DEFAULT_WEIGHTS)).select("site_id", "component", "points")


_POINTS = """WITH f AS (SELECT s_suppkey AS facility_id, CASE WHEN s_suppkey % 4 <> 0 THEN 25 + (s_suppkey * 7919 % 24000) / 1000.0::double END AS latitude,
    CASE WHEN s_suppkey % 4 <> 0 THEN -67 - (s_suppkey * 104729 % 57000) / 1000.0::double END AS longitude,
    CASE WHEN s_suppkey % 8 <> 0 THEN 30.5::double END AS fallback_latitude, CASE WHEN s_suppkey % 8 <> 0 THEN -90.25::double END AS fallback_longitude,
    CASE WHEN s_suppkey % 5 = 0 THEN 'Clinic' ELSE 'Hospital' END AS facility_type, s_suppkey % 3 = 0 AS emergency_services FROM supplier)"""


@case("md23_src23_hospital_points", _POINTS + """
SELECT facility_id, coalesce(latitude, fallback_latitude) AS display_latitude, coalesce(longitude, fallback_longitude) AS display_longitude,
  latitude IS NOT NULL AND longitude IS NOT NULL AS counts_for_distance_model FROM f
WHERE lower(facility_type) = 'hospital' AND coalesce(latitude, fallback_latitude) BETWEEN 26 AND 48 AND coalesce(longitude, fallback_longitude) BETWEEN -120 AND -70
  AND emergency_services """)
def hospital_points(spark, folder):
    from .tables import table
    f = table(spark, folder, "supplier").selectExpr(
        "s_suppkey AS facility_id", "CASE WHEN s_suppkey % 4 <> 0 THEN 25 + (s_suppkey * 7919 % 24000) / 1000D END AS latitude",
        "CASE WHEN s_suppkey % 4 <> 0 THEN -67 - (s_suppkey * 104729 % 57000) / 1000D END AS longitude",
        "CASE WHEN s_suppkey % 8 <> 0 THEN 30.5D END AS fallback_latitude", "CASE WHEN s_suppkey % 8 <> 0 THEN -90.25D END AS fallback_longitude",
        "CASE WHEN s_suppkey % 5 = 0 THEN 'Clinic' ELSE 'Hospital' END AS facility_type", "s_suppkey % 3 = 0 AS emergency_services")
    return serving.hospital_points(f, bbox="-120,26,-70,48", emergency_only=True).select(
        "facility_id", "display_latitude", "display_longitude", "counts_for_distance_model")


@case("md24_md22_population_points", with_roles("demand") + """
SELECT latitude, longitude, population, round(least(population / 8000.0::double, 1), 6) AS weight,
  round(CASE WHEN coalesce(demand_id % 70, 0) > 30 THEN least(population / 8000.0::double, 1) ELSE 0 END, 6) AS uncovered_weight
FROM demand WHERE population > 0 AND state_fips = '07'""")
def population_points(spark, folder):
    areas = role(spark, folder, "demand").withColumns({
        "geoid": F.concat("state_fips", F.format_string("%09d", "demand_id")), "nearest_hospital_miles": F.expr("cast(demand_id % 70 AS double)")})
    points = serving.population_points(areas, state="07")
    weight = lambda uncovered: F.round(serving.heat_weight(F.col("population"), F.col("distance_to_nearest_hospital_miles"), 30, uncovered), 6)
    return points.select("latitude", "longitude", "population", weight(False).alias("weight"), weight(True).alias("uncovered_weight"))


@case("ag06_type_counts", with_roles("sites") + " SELECT site_type, count(*) AS points FROM sites GROUP BY 1")
def type_counts(spark, folder):
    return serving.type_counts(role(spark, folder, "sites"), "site_type")


@case("tk03_max_sites", FINAL + " SELECT site_id FROM final ORDER BY stage8_score DESC, site_id LIMIT 25")
def max_sites(spark, folder):
    from sitewise.plans.services import FinalConfig, first_sites
    return first_sites(role(spark, folder, "final").withColumn("overall_score", F.col("stage8_score")), FinalConfig(max_sites=25)).select("site_id")


@case("typ28_state_codes", """SELECT s_suppkey, lpad(CASE WHEN s_nationkey % 9 + 4 = 7 THEN 8 ELSE s_nationkey % 9 + 4 END::varchar, 2, '0') AS fips FROM supplier""")
def state_codes(spark, folder):
    from .tables import table
    names = F.create_map(*[F.lit(x) for fips, abbr in serving.ABBR_OF.items() for x in (fips, abbr)])
    rows = table(spark, folder, "supplier").withColumn("code", F.expr("CASE WHEN s_nationkey % 9 + 4 = 7 THEN 8 ELSE s_nationkey % 9 + 4 END"))
    text = F.when(F.col("s_suppkey") % 2 == 0, F.lower(names[F.lpad(F.col("code").cast("string"), 2, "0")])).otherwise(F.col("code").cast("string"))
    return rows.select("s_suppkey", serving.state_column(text).alias("fips"))


@case("jn11_site_detail", FINAL + """
SELECT f.site_id, 2 AS services, 3 AS bands, (SELECT count(*) FROM part p WHERE p.p_partkey % 100 = 7) AS configurations FROM final f WHERE site_id = 7""")
def site_detail(spark, folder):
    from .tables import table
    final = role(spark, folder, "final")
    part = table(spark, folder, "part")
    services = final.select("site_id", F.explode(F.array(F.lit(2), F.lit(1))).alias("service_rank_within_site"))
    access = final.select("site_id", F.explode(F.array(F.lit(45), F.lit(15), F.lit(30))).alias("minutes"))
    configurations = part.selectExpr("p_partkey % 100 AS site_id", "p_retailprice AS overall_score", "p_partkey AS configuration_id")
    detail = serving.site_detail(final, services, access, configurations, 7)
    return detail.select("site_id", F.size("services").alias("services"), F.size("access").alias("bands"),
                         F.size("configurations").cast("long").alias("configurations"))
