"""Radius-coverage optimizer, quantiles, geometry of points, expression queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.functions import exprs, geo, road
from sitewise.operators import ranking, spatial
from sitewise.plans import coverage
from sitewise.session import settle

from .registry import case
from .serving_queries import greedy_sql
from .tables import role, sql_miles, table, with_roles

R = 3958.8
RADIUS = 60

_AREAS = f"""
a AS (SELECT *, CASE WHEN demand_id % 9 = 0 THEN NULL ELSE ((demand_id * 37) % 5000) / 10.0::double END AS density, demand_id % 3 = 0 AS mua, demand_id % 4 = 0 AS hpsa FROM demand),
n AS (SELECT a.*, (SELECT min({sql_miles('a.latitude', 'a.longitude', 'f.latitude', 'f.longitude', R)}) FROM facilities f WHERE facility_id % 5 <> 0) AS now FROM a),
p AS (SELECT c.demand_id, u.population, u.now, {sql_miles('u.latitude', 'u.longitude', 'c.latitude', 'c.longitude', R)} AS miles
      FROM n c CROSS JOIN (SELECT * FROM n WHERE now > {RADIUS} AND population > 0) u),
s AS (SELECT demand_id, sum(population) AS pop, round(sum(population * (now - miles)), 6) AS saved FROM p WHERE miles <= {RADIUS} GROUP BY 1),
d AS (SELECT list_sort(list(density) FILTER (density IS NOT NULL)) AS l FROM a),
r AS (SELECT n.*, coalesce(pop, 0) AS uncovered_pop, CASE WHEN coalesce(pop, 0) > 0 THEN saved / pop ELSE 0 END AS reduction,
        ln(1 + greatest(coalesce(density, l[len(l) // 2 + 1]), 0)) AS log_density FROM n LEFT JOIN s USING (demand_id), d),
q AS (SELECT list_sort(list(uncovered_pop) FILTER (uncovered_pop > 0)) AS lp, list_sort(list(reduction) FILTER (reduction > 0)) AS lr, min(log_density) AS lo, max(log_density) AS hi FROM r),
f AS (SELECT r.*, least(1, uncovered_pop / coalesce(lp[least(floor(0.95::double * len(lp))::int, len(lp) - 1) + 1], 1)) AS f_population,
        least(1, reduction / coalesce(lr[least(floor(0.95::double * len(lr))::int, len(lr) - 1) + 1], 1)) AS f_distance,
        0.5::double * mua::int + 0.5::double * hpsa::int AS f_shortage, 1 - (log_density - lo) / (hi - lo) AS f_cost FROM r, q),
sc AS (SELECT *, 0.4::double * f_population + 0.3::double * f_distance + 0.2::double * f_shortage + 0.1::double * f_cost AS score FROM f)"""


def _factors(spark, folder):
    areas = role(spark, folder, "demand").withColumns({
        "density": F.expr("CASE WHEN demand_id % 9 = 0 THEN NULL ELSE ((demand_id * 37) % 5000) / 10D END"),
        "mua": F.expr("demand_id % 3 = 0"), "hpsa": F.expr("demand_id % 4 = 0")})
    hospitals = role(spark, folder, "facilities").withColumn("counts_for_coverage", F.expr("facility_id % 5 <> 0"))
    return coverage.coverage_factors(settle(coverage.with_nearest(areas, hospitals, "demand_id")), "demand_id", RADIUS)


_W = {"population": 0.4, "distance": 0.3, "shortage": 0.2, "cost": 0.1}


@case("sp16_ag08_ag09_coverage_factors", with_roles("demand", "facilities") + "," + _AREAS + """
SELECT demand_id, round(now, 6) AS nearest_hospital_mi, uncovered_pop::bigint AS uncovered_pop, round(reduction, 5) AS avg_reduction_mi, round(f_population, 6) AS f_population,
  round(f_distance, 6) AS f_distance, f_shortage, round(f_cost, 6) AS f_cost FROM f""")
def factors(spark, folder):
    return _factors(spark, folder).select(
        "demand_id", F.round("nearest_hospital_mi", 6).alias("nearest_hospital_mi"), "uncovered_pop", F.round("avg_reduction_mi", 5).alias("avg_reduction_mi"),
        F.round("f_population", 6).alias("f_population"), F.round("f_distance", 6).alias("f_distance"), "f_shortage", F.round("f_cost", 6).alias("f_cost"))


@case("md19_tk04_top_placements", with_roles("demand", "facilities") + "," + _AREAS + f""",
pool AS (SELECT demand_id AS site_id, *, row_number() OVER (ORDER BY score DESC, uncovered_pop DESC, demand_id) AS place FROM sc),
thresholds AS (SELECT {RADIUS}::double AS t),""" + greedy_sql("pool", "thresholds", 15) + """
SELECT demand_id, rank, round(score, 6) AS score FROM picked JOIN pool USING (site_id)""")
def placements(spark, folder):
    return coverage.top_placements(_factors(spark, folder), "demand_id", _W, RADIUS, 15).select("demand_id", "rank", F.round("score", 6).alias("score"))


@case("md19_placement_meta", with_roles("demand", "facilities") + "," + _AREAS + """
SELECT count(*) AS candidates_considered, count(*) FILTER (uncovered_pop > 0) AS candidates_adding_coverage FROM f""")
def placement_meta(spark, folder):
    return coverage.placement_meta(_factors(spark, folder))


@case("ag05_state_boxes", """WITH d AS (SELECT c_nationkey AS state, (c_custkey * 7919 % 24000) / 1000.0::double + 25 AS lat, (c_custkey * 104729 % 57000) / 1000.0::double - 20 AS lon FROM customer),
b AS (SELECT state, min(CASE WHEN lon > 0 THEN lon - 360 ELSE lon END) AS w, min(lat) AS s, max(CASE WHEN lon > 0 THEN lon - 360 ELSE lon END) AS e, max(lat) AS n, count(*) AS tracts FROM d GROUP BY 1)
SELECT state, round(w, 3) AS west, round(s, 3) AS south, round(e, 3) AS east, round(n, 3) AS north, tracts, coalesce(h, 0) AS hospitals
FROM b LEFT JOIN (SELECT s_nationkey AS state, count(*) AS h FROM supplier GROUP BY 1) USING (state)""")
def state_boxes(spark, folder):
    areas = table(spark, folder, "customer").selectExpr(
        "c_nationkey AS state", "(c_custkey * 7919 % 24000) / 1000D + 25 AS latitude", "(c_custkey * 104729 % 57000) / 1000D - 20 AS longitude")
    return coverage.state_boxes(areas, table(spark, folder, "supplier").selectExpr("s_nationkey AS state"))


@case("jn12_shortage_flags", """WITH a AS (SELECT lpad(c_custkey::varchar, 11, '0') AS tract, lpad((c_custkey % 300)::varchar, 5, '0') AS county FROM customer)
SELECT tract, county, (EXISTS (SELECT 1 FROM supplier WHERE s_suppkey % 2 = 0 AND lpad((s_suppkey * 3)::varchar, 11, '0') = tract)
  OR EXISTS (SELECT 1 FROM supplier WHERE s_suppkey % 2 = 1 AND lpad(s_suppkey::varchar, 5, '0') = county)) AS mua, d AS density
FROM a LEFT JOIN (SELECT lpad((p_partkey + CASE WHEN p_partkey % 3 = 0 THEN 90000000 ELSE 0 END)::varchar, 11, '0') AS tract, p_retailprice AS d FROM part) USING (tract)""")
def shortage(spark, folder):
    areas = table(spark, folder, "customer").selectExpr("lpad(string(c_custkey), 11, '0') AS tract", "lpad(string(c_custkey % 300), 5, '0') AS county")
    parts = table(spark, folder, "supplier").selectExpr(
        "CASE WHEN s_suppkey % 2 = 0 THEN 'Census Tract' ELSE 'Single County' END AS geo_type",
        "string(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 3 ELSE s_suppkey END) AS geo_id")
    flagged = coverage.shortage_flags(areas, parts, "tract", "county", "mua")
    ruca = table(spark, folder, "part").selectExpr(
        "string(p_partkey + CASE WHEN p_partkey % 3 = 0 THEN 90000000 ELSE 0 END) AS tract_code", "string(p_size) AS primary_code", "string(p_retailprice) AS pop_density")
    return coverage.with_density(flagged, ruca, "tract").select("tract", "county", "mua", "density")


@case("ag07_exact_quantiles", """SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.95), 6) AS q95, round(quantile_cont(o_totalprice, 0.98), 6) AS q98,
  round(quantile_cont(o_totalprice, 0.995), 6) AS q995 FROM orders GROUP BY 1""")
def quantiles(spark, folder):
    found = ranking.quantiles(table(spark, folder, "orders"), "o_totalprice", [0.95, 0.98, 0.995], ["o_orderpriority"])
    return found.select("o_orderpriority", *[F.round(c, 6).alias(n) for c, n in (("q0", "q95"), ("q1", "q98"), ("q2", "q995"))])


@case("ag08_robust_scale", """WITH v AS (SELECT list_sort(list(l_discount * l_quantity) FILTER (l_discount * l_quantity > 0)) AS l FROM lineitem)
SELECT round(coalesce(l[least(floor(0.95::double * len(l))::bigint, len(l) - 1) + 1], 1), 6) AS scale FROM v""")
def robust(spark, folder):
    rows = table(spark, folder, "lineitem").selectExpr("l_discount * l_quantity AS v")
    return coverage.robust_scale(rows, "v").select(F.round("v_scale", 6).alias("scale"))


def _pct(v, order="ASC"):
    return (f"(rank() OVER (ORDER BY {v} {order} NULLS LAST) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0::double) / count({v}) OVER ()")


_LINE = """WITH l AS (SELECT o_orderkey AS line, o_totalprice AS price, (o_custkey % 50)::double AS quantity,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 11) / 100.0::double END AS discount, 7.0::double AS fixed FROM orders)"""


@case("wn01_percentiles_keep", _LINE + f""" SELECT line, round({_pct('price')}, 6) AS price, round({_pct('quantity', 'DESC')}, 6) AS quantity,
  CASE WHEN discount IS NOT NULL THEN round({_pct('discount')}, 6) END AS discount FROM l""")
def keep(spark, folder):
    return _percentiles(spark, folder, ["price", "quantity", "discount"], inverted=["quantity"])


@case("wn02_percentiles_half_constant", _LINE + f""" SELECT line, round({_pct('price')}, 6) AS price,
  CASE WHEN discount IS NOT NULL THEN round({_pct('discount')}, 6) ELSE 0 END AS discount, 0.5::double AS fixed FROM l""")
def half_constant(spark, folder):
    return _percentiles(spark, folder, ["price", "discount", "fixed"], policy="half_constant")


@case("wn03_percentiles_zero", _LINE + f""" SELECT line, CASE WHEN discount IS NOT NULL THEN round({_pct('discount')}, 6) ELSE 0 END AS discount,
  round((count(*) OVER () + 1) / 2.0::double / count(*) OVER (), 6) AS fixed FROM l""")
def zero(spark, folder):
    return _percentiles(spark, folder, ["discount", "fixed"], policy="zero")


def _percentiles(spark, folder, columns, **options):
    lines = table(spark, folder, "orders").selectExpr(
        "o_orderkey AS line", "o_totalprice AS price", "double(o_custkey % 50) AS quantity",
        "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 11) / 100D END AS discount", "7D AS fixed")
    scored = ranking.percentile_scores(lines, "line", {c: F.col(c) for c in columns}, **options)
    return scored.select("line", *[F.round(c, 6).alias(c) for c in columns])


@case("wn04_wn08_group_rank", """SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)::int AS place FROM orders""")
def group_rank(spark, folder):
    orders = table(spark, folder, "orders")
    ranked = ranking.add_rank(orders, "o_orderkey", [("o_totalprice", True), ("o_orderkey", False)], "place", ["o_orderpriority"])
    return ranked.select("o_orderkey", "o_orderpriority", "place")


@case("wn05_global_rank", """SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::int AS place FROM orders""")
def global_rank(spark, folder):
    return ranking.ordered_rank(table(spark, folder, "orders"), "o_orderkey", [("o_totalprice", True), ("o_orderkey", False)], "place")


@case("sp01_sp02_distances", with_roles("demand") + f""" SELECT demand_id, round({sql_miles('latitude', 'longitude', '39.5', '-98.25')}, 6) AS miles,
  round({sql_miles('latitude', 'longitude', '39.5', '-98.25', 6371.0088)}, 6) AS km, round(cos(radians(latitude)) * cos(radians(longitude)), 9) AS x,
  round(cos(radians(latitude)) * sin(radians(longitude)), 9) AS y, round(sin(radians(latitude)), 9) AS z FROM demand""")
def distances(spark, folder):
    return role(spark, folder, "demand").select(
        "demand_id", F.round(geo.haversine("latitude", "longitude", F.lit(39.5), F.lit(-98.25)), 6).alias("miles"),
        F.round(geo.haversine("latitude", "longitude", F.lit(39.5), F.lit(-98.25), geo.EARTH_KM), 6).alias("km"),
        F.round(geo.sphere_x("latitude", "longitude"), 9).alias("x"), F.round(geo.sphere_y("latitude", "longitude"), 9).alias("y"),
        F.round(geo.sphere_z("latitude"), 9).alias("z"))


@case("sp06_near_any", with_roles("demand", "facilities") + f"""
SELECT demand_id FROM demand d WHERE EXISTS (SELECT 1 FROM facilities f WHERE f.emergency_services AND {sql_miles('d.latitude', 'd.longitude', 'f.latitude', 'f.longitude')} <= 40)""")
def near_any(spark, folder):
    seeds = role(spark, folder, "facilities").where("emergency_services")
    return spatial.near_any(role(spark, folder, "demand"), seeds, "demand_id", 40).select("demand_id")


@case("sp06_neighbour_lists", with_roles("demand", "facilities") + f"""
SELECT demand_id, list_aggregate(list_sort(list(facility_id)), 'string_agg', ',') AS neighbours FROM demand d JOIN facilities f
  ON {sql_miles('d.latitude', 'd.longitude', 'f.latitude', 'f.longitude')} <= 80 GROUP BY 1""")
def neighbour_lists(spark, folder):
    right = role(spark, folder, "facilities").selectExpr("facility_id", "latitude AS to_latitude", "longitude AS to_longitude")
    pairs = spatial.radius_pairs(role(spark, folder, "demand").select("demand_id", "latitude", "longitude"), right, 80)
    return pairs.groupBy("demand_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("facility_id")), lambda x: x.cast("string"))).alias("neighbours"))


@case("sp15_radius_neighbours", with_roles("demand", "facilities") + f"""
SELECT demand_id, count(*) AS facilities, round(min(miles), 6) AS closest, round(max(miles), 6) AS farthest FROM (
  SELECT demand_id, {sql_miles('d.latitude', 'd.longitude', 'f.latitude', 'f.longitude', R)} AS miles FROM demand d CROSS JOIN facilities f) WHERE miles <= 90 GROUP BY 1""")
def radius_neighbours(spark, folder):
    right = role(spark, folder, "facilities").selectExpr("facility_id", "latitude AS to_latitude", "longitude AS to_longitude")
    pairs = spatial.radius_pairs(role(spark, folder, "demand").select("demand_id", "latitude", "longitude"), right, 90, radius=R)
    return pairs.groupBy("demand_id").agg(F.count("*").alias("facilities"), F.round(F.min("miles"), 6).alias("closest"), F.round(F.max("miles"), 6).alias("farthest"))


@case("sp17_coverage_rings", with_roles("facilities") + """,
v AS (SELECT facility_id, i, radians(latitude) AS phi, longitude, 30 / 3958.8::double AS d, i * (2 * pi() / 64) AS b FROM facilities, generate_series(0, 64) t(i)),
w AS (SELECT *, asin(sin(phi) * cos(d) + cos(phi) * sin(d) * cos(b)) AS lat2 FROM v)
SELECT facility_id, i::int AS step, round(longitude + degrees(atan2(sin(b) * sin(d) * cos(phi), cos(d) - sin(phi) * sin(lat2))), 6) AS x, round(degrees(lat2), 6) AS y FROM w""")
def rings(spark, folder):
    ring = geo.coverage_ring("longitude", "latitude", F.lit(30.0))
    return role(spark, folder, "facilities").select("facility_id", F.posexplode(ring).alias("step", "p")).select(
        "facility_id", "step", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@case("md01_md02_road_model", with_roles("demand") + """ SELECT demand_id, round(least(greatest((demand_id % 12 - 1) / 9.0::double, 0), 1), 6) AS ruca_rurality,
  round(1.2::double + rurality * 0.14::double, 6) AS detour, round(greatest(29 + rurality * 23, 10), 6) AS mph,
  round(12.5::double * (1.2::double + rurality * 0.14::double) / (29 + rurality * 23) * 60, 6) AS minutes FROM demand""")
def road_model(spark, folder):
    d = role(spark, folder, "demand").withColumn("ruca_code", F.expr("demand_id % 12"))
    return d.select(
        "demand_id", F.round(road.rurality_from_ruca("ruca_code"), 6).alias("ruca_rurality"),
        F.round(road.detour_factor(road.rurality(d)), 6).alias("detour"), F.round(road.effective_mph(road.rurality(d)), 6).alias("mph"),
        F.round(road.drive_minutes(F.lit(12.5), road.detour_factor("rurality"), road.effective_mph("rurality")), 6).alias("minutes"))


@case("typ21_typ27_numeric_expressions", """WITH t AS (SELECT p_partkey AS k, p_size::double AS a, (p_partkey % 5 - 1)::double AS b, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END AS c FROM part)
SELECT k, round(CASE WHEN b > 0 THEN a / b END, 6) AS ratio, round(CASE WHEN b > 0 THEN a / b * 100 END, 6) AS pct, CASE WHEN c IS NULL THEN a + b ELSE round(a + b + c, 6) END AS total,
  NULL::double AS partial, round((a + b + coalesce(c, 0)) / (2 + (c IS NOT NULL)::int), 6) AS mean, round(greatest(a, b, coalesce(c, -1e300)), 6) AS highest, round(a / (a + 25), 6) AS sat,
  CASE WHEN c IS NOT NULL THEN least(greatest(c / 1000, 0), 1) END AS clipped, CASE WHEN b <> 0 THEN least(greatest(a / b, 0), 1) ELSE 0 END AS share, k % 4 IN (0, 1) AS truthy FROM t""")
def numeric_expressions(spark, folder):
    t = table(spark, folder, "part").selectExpr(
        "p_partkey AS k", "double(p_size) AS a", "double(p_partkey % 5 - 1) AS b", "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END AS c",
        "CASE p_partkey % 4 WHEN 0 THEN ' Yes' WHEN 1 THEN 'TRUE' WHEN 2 THEN 'no' END AS word")
    return t.select(
        "k", F.round(exprs.safe_divide("a", "b"), 6).alias("ratio"), F.round(exprs.pct("a", "b"), 6).alias("pct"),
        F.round(exprs.row_sum(t, ["a", "b", "c"]), 6).alias("total"), exprs.row_sum(t, ["a", "missing"]).alias("partial"),
        F.round(exprs.row_mean(["a", "b", "c"]), 6).alias("mean"), F.round(exprs.row_max(["a", "b", "c"]), 6).alias("highest"),
        F.round(exprs.saturate("a", 25), 6).alias("sat"), exprs.clip01(F.col("c") / 1000).alias("clipped"), exprs.share("a", "b").alias("share"),
        exprs.boolish("word").alias("truthy"))
