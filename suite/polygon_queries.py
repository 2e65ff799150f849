"""Points in polygons, centroids, candidate points, designation overlays."""
from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.operators import polygons
from sitewise.operators.polygons import A, E2, K0, QP
from sitewise.plans import designations

from .registry import case
from .tables import table

# Tract rectangles tile the plane, a county is four tracts wide, designations overlap freely.
_RECTS = {
    "tract": ("supplier", "s_suppkey", "-124 + ({k} % 40 * 14) / {t}", "25 + ({k} {div} 40 * 5) / {t}", "-124 + ({k} % 40 * 14 + 14) / {t}", "25 + ({k} {div} 40 * 5 + 5) / {t}"),
    "designation": ("customer", "c_custkey", "-124 + ({k} * 37 % 540) / {t}", "25 + ({k} * 11 % 130) / {t}",
                    "-124 + ({k} * 37 % 540 + ({k} % 5 + 1) * 3) / {t}", "25 + ({k} * 11 % 130 + ({k} % 4 + 1) * 2) / {t}"),
}


def _rect_sql(name: str, key: str) -> str:
    source, k, *bounds = _RECTS[name]
    parts = [b.format(k=k, t="10.0::double", div="//") for b in bounds]
    return f"SELECT {key}, {k} AS k, " + ", ".join(f"{p} AS {n}" for p, n in zip(parts, ("x0", "y0", "x1", "y1"))) + f" FROM {source}"


def _rects(spark, folder, name, *columns):
    source, k, *bounds = _RECTS[name]
    parts = [b.format(k=k, t="10D", div="div") for b in bounds]
    boxed = table(spark, folder, source).selectExpr(f"{k} AS k", *columns, *[f"{p} AS {n}" for p, n in zip(parts, ("x0", "y0", "x1", "y1"))])
    corners = ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")))
    return boxed.withColumn("rings", F.expr(f"array(array({corners}))"))


_POINT_SQL = """SELECT p_partkey AS facility_id, CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE 25 + (p_partkey * 13 % 130) / 10.0::double END AS latitude, -124 + (p_partkey * 7 % 561) / 10.0::double AS longitude FROM part"""


def _points(spark, folder):
    return table(spark, folder, "part").selectExpr(
        "p_partkey AS facility_id", "CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE 25 + (p_partkey * 13 % 130) / 10D END AS latitude", "-124 + (p_partkey * 7 % 561) / 10D AS longitude")


def _tracts(spark, folder):
    return _rects(spark, folder, "tract", "lpad(string(s_suppkey), 11, '0') AS tract_geoid", "lpad(string(s_suppkey div 4), 5, '0') AS county_geoid")


def _counties(spark, folder):
    grouped = _tracts(spark, folder).groupBy("county_geoid").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    corners = ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")))
    return grouped.withColumn("rings", F.expr(f"array(array({corners}))"))


_AREAS = f"""WITH t AS ({_rect_sql('tract', "lpad(s_suppkey::varchar, 11, '0') AS tract_geoid, lpad((s_suppkey // 4)::varchar, 5, '0') AS county_geoid")}),
c AS (SELECT county_geoid, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM t GROUP BY 1), p AS ({_POINT_SQL})"""


@case("sp07_point_in_polygon", _AREAS + """,
h AS (SELECT facility_id, min(tract_geoid) AS t, count(DISTINCT tract_geoid) AS n FROM p JOIN t ON longitude BETWEEN x0 AND x1 AND latitude BETWEEN y0 AND y1 GROUP BY 1),
g AS (SELECT facility_id, min(county_geoid) AS c, count(DISTINCT county_geoid) AS n FROM p JOIN c ON longitude BETWEEN x0 AND x1 AND latitude BETWEEN y0 AND y1 GROUP BY 1)
SELECT p.facility_id, CASE WHEN h.n = 1 THEN t END AS tract_geoid, CASE WHEN g.n = 1 THEN c END AS county_geoid,
  CASE WHEN h.n = 1 AND g.n = 1 THEN 'point_in_2023_polygons' WHEN h.n > 1 OR g.n > 1 THEN 'ambiguous_boundary' WHEN latitude IS NOT NULL THEN 'outside_reference_or_partial_match' ELSE 'unlocated' END AS geography_assignment
FROM p LEFT JOIN h USING (facility_id) LEFT JOIN g USING (facility_id)""")
def point_in_polygon(spark, folder):
    return polygons.assign_areas(_points(spark, folder), _tracts(spark, folder), _counties(spark, folder), "facility_id").select(
        "facility_id", "tract_geoid", "county_geoid", "geography_assignment")


def _q(phi: str) -> str:
    s = f"sin(radians({phi}))"
    e = E2 ** 0.5
    return f"({1 - E2!r}::double * ({s} / (1 - {E2!r}::double * {s} * {s}) - {1 / (2 * e)!r}::double * ln((1 - {e!r}::double * {s}) / (1 + {e!r}::double * {s}))))"


def _px(lon: str) -> str:
    return f"({A * K0!r}::double * radians({lon}))"


def _py(lat: str) -> str:
    return f"({A / (2 * K0)!r}::double * {_q(lat)})"


@case("sp03_equal_area_centroid", _AREAS + f""",
m AS (SELECT tract_geoid, (x0 + x1) / 2 AS lon, asin(({_py('y0')} + {_py('y1')}) / 2 * {2 * K0 / (A * QP)!r}::double) AS b FROM t)
SELECT tract_geoid, round(lon, 7) AS longitude, round(degrees(b + {E2 / 3 + 31 * E2 ** 2 / 180 + 517 * E2 ** 3 / 5040!r}::double * sin(2 * b)
  + {23 * E2 ** 2 / 360 + 251 * E2 ** 3 / 3780!r}::double * sin(4 * b) + {761 * E2 ** 3 / 45360!r}::double * sin(6 * b)), 7) AS latitude FROM m""")
def centroid(spark, folder):
    return polygons.with_equal_area_centroid(_tracts(spark, folder), "rings", "longitude", "latitude").select(
        "tract_geoid", F.round("longitude", 7).alias("longitude"), F.round("latitude", 7).alias("latitude"))


@case("sp14_candidate_points", _AREAS + """,
f(o, fx, fy) AS (VALUES (0, 0.5::double, 0.5::double), (1, 0.5, 0.5), (2, 0.35, 0.35), (3, 0.65, 0.65), (4, 0.35, 0.65)),
q AS (SELECT tract_geoid, o AS candidate_ordinal, y0 + (y1 - y0) * fy AS y, x0 + (x1 - x0) * fx AS x FROM t, f)
SELECT tract_geoid, candidate_ordinal, round(y, 6) AS latitude, round(x, 6) AS longitude,
  'S6F-' || left(sha1(tract_geoid || '|' || candidate_ordinal || '|' || printf('%.6f', y) || '|' || printf('%.6f', x)), 14) AS site_id FROM q""")
def candidate_points(spark, folder):
    found = polygons.site_ids(polygons.candidate_points(_tracts(spark, folder), "tract_geoid", count=5), "tract_geoid")
    return found.select("tract_geoid", "candidate_ordinal", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), "site_id")


# The shown identifier has five characters, which many customers share beyond 99,999: operators get ten.
_SHOWN = "lpad(string(bigint(designation_id)), 5, '0') AS designation_id"


def _designations(spark, folder, width=10):
    return _rects(spark, folder, "designation", f"lpad(string(c_custkey), {width}, '0') AS designation_id", "CASE WHEN c_custkey % 2 = 0 THEN 'mua' ELSE 'mup' END AS designation_kind")


_OVER = _AREAS + f""", d AS ({_rect_sql('designation', "lpad(c_custkey::varchar, 5, '0') AS designation_id, CASE WHEN c_custkey % 2 = 0 THEN 'mua' ELSE 'mup' END AS designation_kind")}),
o AS (SELECT tract_geoid, designation_id, designation_kind, greatest({_px('t.x0')}, {_px('d.x0')}) AS a0, least({_px('t.x1')}, {_px('d.x1')}) AS a1,
   greatest({_py('t.y0')}, {_py('d.y0')}) AS b0, least({_py('t.y1')}, {_py('d.y1')}) AS b1, ({_px('t.x1')} - {_px('t.x0')}) * ({_py('t.y1')} - {_py('t.y0')}) AS area
  FROM t JOIN d ON t.x0 < d.x1 AND d.x0 < t.x1 AND t.y0 < d.y1 AND d.y0 < t.y1)"""


@case("sp09_overlay_links", _OVER + """ SELECT tract_geoid, designation_id, designation_kind, round((a1 - a0) * (b1 - b0) / 1000000, 3) AS overlap_km2, round((a1 - a0) * (b1 - b0) / area, 6) AS fraction FROM o""")
def overlay_links(spark, folder):
    links, _ = polygons.overlay(_tracts(spark, folder), _designations(spark, folder), "tract_geoid")
    return links.select("tract_geoid", F.expr(_SHOWN), "designation_kind", F.round(F.col("overlap_area_m2") / 1e6, 3).alias("overlap_km2"),
                        F.round("boundary_area_fraction", 6).alias("fraction"))


@case("sp09_union_coverage", _OVER + """,
xs AS (SELECT tract_geoid, designation_kind, x, lead(x) OVER (PARTITION BY tract_geoid, designation_kind ORDER BY x) AS nx FROM (SELECT DISTINCT tract_geoid, designation_kind, unnest([a0, a1]) AS x FROM o)),
ys AS (SELECT tract_geoid, designation_kind, y, lead(y) OVER (PARTITION BY tract_geoid, designation_kind ORDER BY y) AS ny FROM (SELECT DISTINCT tract_geoid, designation_kind, unnest([b0, b1]) AS y FROM o)),
cells AS (SELECT * FROM xs JOIN ys USING (tract_geoid, designation_kind) WHERE nx IS NOT NULL AND ny IS NOT NULL),
u AS (SELECT tract_geoid, designation_kind, sum((nx - x) * (ny - y)) AS covered FROM cells c WHERE EXISTS (SELECT 1 FROM o WHERE o.tract_geoid = c.tract_geoid AND o.designation_kind = c.designation_kind
   AND a0 <= x AND a1 >= nx AND b0 <= y AND b1 >= ny) GROUP BY 1, 2),
w AS (SELECT tract_geoid, designation_kind, count(DISTINCT designation_id) AS n, max(area) AS area FROM o GROUP BY 1, 2)
SELECT t.tract_geoid, coalesce(max(w.n) FILTER (w.designation_kind = 'mua'), 0) AS mua_designation_count, coalesce(max(w.n) FILTER (w.designation_kind = 'mup'), 0) AS mup_designation_count,
  round(coalesce(max(covered / area) FILTER (w.designation_kind = 'mua'), 0), 6) AS mua_fraction, round(coalesce(max(covered / area) FILTER (w.designation_kind = 'mup'), 0), 6) AS mup_fraction
FROM t LEFT JOIN w USING (tract_geoid) LEFT JOIN u ON u.tract_geoid = w.tract_geoid AND u.designation_kind = w.designation_kind GROUP BY 1""")
def union_coverage(spark, folder):
    # counted by the shown identifier
    covered = designations.area_coverage(_tracts(spark, folder), _designations(spark, folder, 5), "tract_geoid")
    return covered.select("tract_geoid", "mua_designation_count", "mup_designation_count", F.round("mua_boundary_area_fraction", 6).alias("mua_fraction"),
                          F.round("mup_boundary_area_fraction", 6).alias("mup_fraction"))


@case("sp08_facility_designation_links", _OVER + """ SELECT facility_id, designation_id, designation_kind FROM p JOIN d ON longitude BETWEEN x0 AND x1 AND latitude BETWEEN y0 AND y1""")
def facility_links(spark, folder):
    # shown once for each designation, not for each link
    shown = _designations(spark, folder).withColumn("shown", F.expr(_SHOWN))
    return designations.facility_links(_points(spark, folder), shown, carry=["shown"]).select("facility_id", F.col("shown").alias("designation_id"), "designation_kind")


@case("sp08_membership_flags", _OVER + """, l AS (SELECT facility_id, designation_kind FROM p JOIN d ON longitude BETWEEN x0 AND x1 AND latitude BETWEEN y0 AND y1)
SELECT facility_id, CASE WHEN latitude IS NOT NULL THEN facility_id IN (SELECT facility_id FROM l WHERE designation_kind = 'mua') END AS inside_mua_boundary,
  CASE WHEN latitude IS NOT NULL THEN facility_id IN (SELECT facility_id FROM l WHERE designation_kind = 'mup') END AS inside_mup_boundary FROM p""")
def membership(spark, folder):
    return designations.membership(_points(spark, folder), _designations(spark, folder)).select("facility_id", "inside_mua_boundary", "inside_mup_boundary")


@case("src16_load_designations", """WITH c AS (SELECT c_custkey % 300 AS d, c_custkey FROM customer WHERE c_custkey % 300 % 10 <> 9)
SELECT lpad(d::varchar, 5, '0') AS designation_id, CASE WHEN d % 4 IN (0, 2) THEN 'mua' ELSE 'mup' END AS designation_kind, (d % 62)::double AS imu_score,
  count(DISTINCT (c_custkey * 37 % 540, c_custkey * 11 % 130, c_custkey % 5, c_custkey % 4)) AS components FROM c GROUP BY d""")
def load(spark, folder):
    parts = _rects(spark, folder, "designation", "c_custkey % 300 AS d").selectExpr(
        "concat(' ', lpad(string(d), 5, '0')) AS designation_id", "CASE WHEN d % 10 = 9 THEN 'Withdrawn' ELSE 'Designated ' END AS designation_status", "double(d % 62) AS imu_score", "rings",
        """CASE d % 4 WHEN 0 THEN 'Medically Underserved Area' WHEN 1 THEN 'medically underserved population' WHEN 2 THEN "Medically Underserved Area-Governor's Exception" ELSE "Medically Underserved Population-Governor's Exception" END AS designation_type""")
    return designations.dissolved_count(designations.load_designations(parts))


@case("src16_sp09_overlapping_components", _OVER.replace("lpad(c_custkey::varchar, 5, '0') AS designation_id, CASE WHEN c_custkey % 2 = 0 THEN 'mua' ELSE 'mup' END AS designation_kind",
                                                        "lpad((c_custkey % 40)::varchar, 5, '0') AS designation_id, CASE WHEN c_custkey % 2 = 0 THEN 'mua' ELSE 'mup' END AS designation_kind") + """,
xs AS (SELECT tract_geoid, designation_id, x, lead(x) OVER (PARTITION BY tract_geoid, designation_id ORDER BY x) AS nx FROM (SELECT DISTINCT tract_geoid, designation_id, unnest([a0, a1]) AS x FROM o)),
ys AS (SELECT tract_geoid, designation_id, y, lead(y) OVER (PARTITION BY tract_geoid, designation_id ORDER BY y) AS ny FROM (SELECT DISTINCT tract_geoid, designation_id, unnest([b0, b1]) AS y FROM o)),
cells AS (SELECT * FROM xs JOIN ys USING (tract_geoid, designation_id) WHERE nx IS NOT NULL AND ny IS NOT NULL)
SELECT tract_geoid, designation_id, round(sum((nx - x) * (ny - y)) / 1000000, 3) AS overlap_km2 FROM cells c
WHERE EXISTS (SELECT 1 FROM o WHERE o.tract_geoid = c.tract_geoid AND o.designation_id = c.designation_id AND a0 <= x AND a1 >= nx AND b0 <= y AND b1 >= ny) GROUP BY 1, 2""")
def overlapping_components(spark, folder):
    parts = _rects(spark, folder, "designation", "lpad(string(c_custkey % 40), 5, '0') AS designation_id", "c_custkey").selectExpr(
        "designation_id", "'Designated' AS designation_status", "double(int(designation_id)) AS imu_score", "rings",
        "CASE WHEN c_custkey % 2 = 0 THEN 'Medically Underserved Area' ELSE 'Medically Underserved Population' END AS designation_type")
    links, _ = polygons.overlay(_tracts(spark, folder), designations.load_designations(parts), "tract_geoid")
    return links.select("tract_geoid", "designation_id", F.round(F.col("overlap_area_m2") / 1e6, 3).alias("overlap_km2"))


@case("src16_designations_without_record", """SELECT DISTINCT lpad((c_custkey % 300)::varchar, 5, '0') AS designation_id FROM customer WHERE c_custkey % 300 NOT IN (SELECT s_suppkey FROM supplier)""")
def without_record(spark, folder):
    shapes = _rects(spark, folder, "designation", "lpad(string(c_custkey % 300), 5, '0') AS designation_id")
    records = spark.read.parquet(f"{folder}/supplier.parquet").selectExpr("lpad(string(s_suppkey), 5, '0') AS designation_id")
    return designations.without_record(shapes, records)


@case("src15_reference_problems", """WITH t AS (SELECT CASE WHEN s_suppkey % 17 = 3 THEN s_suppkey::varchar ELSE lpad((s_suppkey // 2 * 2)::varchar, 11, '0') END AS g, lpad((s_suppkey // 4)::varchar, 5, '0') AS c, s_suppkey AS k FROM supplier),
c AS (SELECT DISTINCT c FROM t WHERE k % 8 < 4)
SELECT 'malformed_tract' AS "check", count(*) FILTER (k % 17 = 3) AS violations FROM t UNION ALL SELECT 'malformed_county', 0 UNION ALL SELECT 'duplicate_tract', count(*) FROM (SELECT g FROM t GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'duplicate_county', 0 UNION ALL SELECT 'tract_without_county', count(*) FROM t WHERE c NOT IN (SELECT c FROM c) UNION ALL SELECT 'invalid_rings', count(*) FROM t WHERE k % 5 = 0""")
def reference_problems(spark, folder):
    t = _tracts(spark, folder).withColumns({
        "tract_geoid": F.expr("CASE WHEN k % 17 = 3 THEN string(k) ELSE lpad(string(k div 2 * 2), 11, '0') END"),
        "rings": F.expr("CASE WHEN k % 5 = 0 THEN transform(rings, r -> slice(r, 1, 4)) ELSE rings END")})
    counties = t.where("k % 8 < 4").select("county_geoid").distinct()
    return designations.reference_problems(t, counties)
