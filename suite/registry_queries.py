"""Facility registry, cached geocoder answers, address resolution."""
from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.functions import text
from sitewise.plans import addresses, registry
from sitewise.plans.registry import Source

from .registry import case
from .tables import role, sql_miles, table, with_roles


def _sources(spark, folder):
    part, supplier = table(spark, folder, "part"), table(spark, folder, "supplier")
    state = "CASE {k} % 5 WHEN 0 THEN 'ZZ' WHEN 1 THEN ' tx' ELSE 'CA' END"
    general = part.where("p_partkey % 2 = 0").withColumn("m", F.expr("p_partkey % 300")).selectExpr(
        "p_partkey AS _stage2_source_row", "concat('h', m) AS facility_id", "concat(m, ' Main  St') AS address", "concat('Town', m % 7) AS city_town",
        state.format(k="m") + " AS state", "concat(lpad(string(m), 5, '0'), '-1234') AS zip_code", "concat('Hospital ', p_partkey % 3) AS facility_name",
        "p_partkey % 4 = 0 AS emergency_services", "int(p_partkey % 5 + 1) AS hospital_overall_rating")
    enrolled = part.where("p_partkey % 2 = 1").withColumn("m", F.expr("p_partkey % 300")).selectExpr(
        "p_partkey AS _stage2_source_row", "concat('H', m) AS ccn", "concat(m, ' Main St') AS address_line_1", "concat('town', m % 7) AS city",
        state.format(k="m") + " AS state", "lpad(string(m), 5, '0') AS zip_code", "concat('Org ', p_partkey % 2) AS organization_name", "string(p_partkey) AS npi")
    other = supplier.withColumn("m", F.expr("s_suppkey % 300")).selectExpr(
        "s_suppkey AS _stage2_source_row", "concat('h', m) AS prvdr_num", "CASE WHEN s_suppkey % 9 = 0 THEN ' ' ELSE concat(m, ' Main St') END AS st_adr",
        "concat('TOWN', m % 7) AS city_name", state.format(k="m") + " AS state_cd", "lpad(string(m), 5, '0') AS zip_cd", "'Fac' AS fac_name",
        "s_suppkey % 4 * 10 AS bed_cnt", "'00' AS pgm_trmntn_cd")
    return [Source("CMSHospital", "CMSHospital/general.csv", general), Source("CMSFacilities", "CMSFacilities/Hospital_Enrollments_x.csv", enrolled),
            Source("CMSFacilities", "CMSFacilities/Hospital_and_other.csv", other)]


_REG = """WITH raw AS (
  SELECT 0 AS pr, 'CMSHospital/general.csv' AS tab, p_partkey AS k, p_partkey % 300 AS m, 'hospital' AS kind, 'Hospital ' || (p_partkey % 3) AS name, (p_partkey % 5 + 1)::double AS rating,
     NULL::bigint AS beds, (p_partkey % 4 = 0) AS er, false AS nostreet, 'Town' AS town FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT 1, 'CMSFacilities/Hospital_Enrollments_x.csv', p_partkey, p_partkey % 300, 'hospital', 'Org ' || (p_partkey % 2), NULL, NULL, NULL, false, 'town' FROM part WHERE p_partkey % 2 = 1
  UNION ALL SELECT 2, 'CMSFacilities/Hospital_and_other.csv', s_suppkey, s_suppkey % 300, 'unclassified_provider', 'Fac', NULL, s_suppkey % 4 * 10, NULL, s_suppkey % 9 = 0, 'TOWN' FROM supplier),
r AS (SELECT *, CASE m % 5 WHEN 1 THEN 'TX' ELSE 'CA' END AS st, CASE WHEN nostreet THEN tab || '::' || k
     ELSE 'ccn:H' || m || '|' || m || ' MAIN ST||TOWN' || (m % 7) || '|' || CASE m % 5 WHEN 1 THEN 'TX' ELSE 'CA' END || '|' || lpad(m::varchar, 5, '0') END AS key FROM raw WHERE m % 5 <> 0),
f AS (SELECT *, 'facility_' || left(sha256(key), 24) AS facility_id, row_number() OVER (PARTITION BY key ORDER BY pr, tab, k) AS ord FROM r),
nm AS (SELECT facility_id, name, min(ord) AS o FROM f GROUP BY 1, 2),
g AS (SELECT facility_id, count(*) AS source_record_count, arg_min(name, ord) AS name, max(m) AS m,
   CASE WHEN count(DISTINCT beds) <= 1 THEN max(beds)::double END AS bed_count, arg_min(rating, ord) FILTER (rating IS NOT NULL) AS rating,
   count(DISTINCT rating) AS ratings, count(DISTINCT beds) AS bedvals, count(DISTINCT er) AS ers, count(DISTINCT town) AS towns, count(DISTINCT CASE WHEN pr = 0 THEN m || ' Main  St' ELSE m || ' Main St' END) FILTER (NOT nostreet) AS streets,
   count(DISTINCT name) AS names, bool_or(kind = 'hospital') AS hosp, bool_or(nostreet) AS nostreet FROM f GROUP BY 1)"""


@case("reg02_to_reg06_registry", _REG + """
SELECT g.facility_id, source_record_count, name, 'H' || m AS ccn, bed_count, rating, CASE WHEN hosp THEN 'hospital' ELSE 'unclassified_provider' END AS facility_type,
  CASE WHEN hosp THEN 'reported_care_site' ELSE 'office_or_service_site_unresolved' END AS care_site_role, CASE WHEN nostreet THEN 'unmerged_source_record' ELSE 'exact_ccn_and_address' END AS match_method,
  ((names > 1)::int + (ratings > 1)::int + (bedvals > 1)::int + (ers > 1)::int + (towns > 1)::int + (streets > 1)::int) AS conflicts,
  CASE WHEN names > 1 THEN (SELECT string_agg(nm.name, ';' ORDER BY o) FROM nm WHERE nm.facility_id = g.facility_id) END AS name_conflict,
  count(*) OVER (PARTITION BY m) > 1 AS ccn_multiple_locations FROM g""")
def registry_query(spark, folder):
    merged = registry.merge_records(registry.source_records(_sources(spark, folder), ["CA", "TX"]))
    return merged.select(
        "facility_id", "source_record_count", "name", "ccn", "bed_count", F.col("hospital_overall_rating").alias("rating"), "facility_type", "care_site_role",
        "match_method", F.coalesce(F.size("field_conflicts"), F.lit(0)).alias("conflicts"),
        F.array_join(F.try_element_at("field_conflicts", F.lit("name")), ";").alias("name_conflict"), "ccn_multiple_locations")


@case("reg07_record_links", _REG + " SELECT facility_id, tab AS source_table, k AS source_row FROM f")
def record_links(spark, folder):
    return registry.record_links(registry.source_records(_sources(spark, folder), ["CA", "TX"])).drop("match_method")


def _geocoded(spark, folder):
    """Hospitals from part, cached answers for most of their addresses."""
    part = table(spark, folder, "part")
    facilities = part.selectExpr(
        "p_partkey AS facility_id", "CASE WHEN p_partkey % 6 = 0 THEN 'clinic' ELSE 'hospital' END AS facility_type",
        "CASE WHEN p_partkey % 13 = 0 THEN 'P.O. BOX 12' WHEN p_partkey % 17 = 0 THEN '' ELSE concat(p_partkey % 400, ' Oak St') END AS street",
        "'Town' AS city", "'TX' AS state", "'75001' AS zip")
    numbers = part.selectExpr("p_partkey % 400 AS m").distinct().where("m % 3 <> 0")
    cache = numbers.select(
        registry.cache_key(F.concat("m", F.lit(" Oak St")), F.lit("Town"), F.lit("TX"), F.lit("75001")).alias("key"),
        F.expr("CASE m % 5 WHEN 0 THEN 'Tie' WHEN 1 THEN 'No_Match' ELSE 'Match' END AS status"),
        F.expr("CASE WHEN m % 5 > 1 THEN -90 - m / 100D END AS longitude"), F.expr("CASE WHEN m % 5 > 1 THEN 30 + m / 100D END AS latitude"),
        F.lit("2026-01-01").alias("geocode_fetched_utc"))
    return registry.with_cache_key(facilities), cache


_GEO = """WITH f AS (SELECT p_partkey AS facility_id, p_partkey % 6 = 0 AS clinic, p_partkey % 13 = 0 AS box, p_partkey % 13 <> 0 AND p_partkey % 17 = 0 AS blank, p_partkey % 400 AS m FROM part),
c AS (SELECT DISTINCT p_partkey % 400 AS m, CASE p_partkey % 400 % 5 WHEN 0 THEN 'Tie' WHEN 1 THEN 'No_Match' ELSE 'Match' END AS status FROM part WHERE p_partkey % 400 % 3 <> 0),
j AS (SELECT f.*, c.status FROM f LEFT JOIN c ON c.m = f.m AND NOT clinic AND NOT box AND NOT blank)"""


@case("reg08_src18_pending_addresses", _GEO + """ SELECT DISTINCT m || ' Oak St' AS street FROM j WHERE status IS NULL AND NOT clinic AND NOT box AND NOT blank""")
def pending(spark, folder):
    facilities, cache = _geocoded(spark, folder)
    return registry.pending_addresses(facilities, cache).select("street")


@case("reg10_cached_answers", _GEO + """ SELECT facility_id, coalesce(status, 'not_geocoded') AS geocode_status, CASE WHEN status = 'Match' THEN 'census_street_interpolation' END AS geocode_method,
  CASE WHEN status = 'Match' THEN -90 - m / 100.0::double END AS longitude, CASE WHEN status = 'Match' THEN 30 + m / 100.0::double END AS latitude FROM j""")
def answers(spark, folder):
    facilities, cache = _geocoded(spark, folder)
    return registry.apply_answers(facilities, cache).select("facility_id", "geocode_status", "geocode_method", "longitude", "latitude")


@case("reg09_reply_problems", """WITH asked AS (SELECT p_partkey + CASE WHEN p_partkey % 10 = 9 THEN 10000000 ELSE 0 END AS id FROM part),
back AS (SELECT p_partkey + CASE WHEN p_partkey % 7 = 0 THEN 20000000 ELSE 0 END AS id, CASE WHEN p_partkey % 11 = 0 THEN 2 ELSE 1 END AS n FROM part)
SELECT id, 'omitted' AS problem FROM asked WHERE id NOT IN (SELECT id FROM back) UNION ALL SELECT id, 'not requested' FROM back WHERE id NOT IN (SELECT id FROM asked)
UNION ALL SELECT id, 'duplicate' FROM back WHERE n > 1 AND id IN (SELECT id FROM asked)""")
def reply_problems(spark, folder):
    part = table(spark, folder, "part")
    asked = part.selectExpr("p_partkey + CASE WHEN p_partkey % 10 = 9 THEN 10000000 ELSE 0 END AS id")
    back = part.selectExpr("p_partkey + CASE WHEN p_partkey % 7 = 0 THEN 20000000 ELSE 0 END AS id",
                           "explode(sequence(1, CASE WHEN p_partkey % 11 = 0 THEN 2 ELSE 1 END)) AS n").select("id")
    return registry.reply_problems(asked, back, "id")


@case("ag01_area_counts", """WITH f AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_partkey % 120 END AS area, p_partkey % 3 <> 0 AS hospital, CASE WHEN p_partkey % 4 = 0 OR p_partkey % 120 < 12 THEN NULL ELSE p_size::double END AS beds FROM part)
SELECT s_suppkey AS area, count(p_partkey) AS facilities, count(*) FILTER (hospital) AS hospitals, count(*) FILTER (hospital AND beds IS NULL) AS missing_beds, sum(beds) FILTER (hospital) AS known_beds
FROM supplier LEFT JOIN f ON area = s_suppkey GROUP BY 1""")
def area_counts(spark, folder):
    facilities = table(spark, folder, "part").selectExpr(
        "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_partkey % 120 END AS area", "CASE WHEN p_partkey % 3 <> 0 THEN 'hospital' ELSE 'hospice' END AS facility_type",
        "CASE WHEN p_partkey % 4 = 0 OR p_partkey % 120 < 12 THEN NULL ELSE double(p_size) END AS bed_count")
    counted = registry.area_counts(table(spark, folder, "supplier").selectExpr("s_suppkey AS area"), facilities, "area")
    return counted.selectExpr("area", "located_registry_facility_count AS facilities", "located_registry_hospital_count AS hospitals",
                              "located_hospitals_missing_beds AS missing_beds", "located_hospital_known_beds_sum AS known_beds")


_STREETS = """CASE {k} % 8 WHEN 0 THEN concat('P.O. Box 12, ', {k}, ' Main St') WHEN 1 THEN concat({k}, ' Main St Suite 4-B') WHEN 2 THEN 'One  Hospital Dr,' WHEN 3 THEN concat('two Oak Ave, Floor 3')
  WHEN 4 THEN concat({k}, ' N  Elm St # 12') WHEN 5 THEN 'BOX 9' WHEN 6 THEN concat(' ', {k}, ' West Pine Rd Bldg 2 ') ELSE NULL END"""


@case("adr01_clean_addresses", """SELECT s_suppkey AS k, CASE s_suppkey % 8 WHEN 0 THEN s_suppkey || ' Main St' WHEN 1 THEN s_suppkey || ' Main St' WHEN 2 THEN '1 Hospital Dr' WHEN 3 THEN '2 Oak Ave'
  WHEN 4 THEN s_suppkey || ' N Elm St # 12' WHEN 5 THEN '' WHEN 6 THEN s_suppkey || ' West Pine Rd' ELSE '' END AS address,
  CASE s_suppkey % 8 WHEN 0 THEN s_suppkey || ' MAIN ST' WHEN 1 THEN s_suppkey || ' MAIN ST' WHEN 2 THEN '1 HOSPITAL DR' WHEN 3 THEN '2 OAK AVE'
  WHEN 4 THEN s_suppkey || ' N ELM ST' WHEN 5 THEN '' WHEN 6 THEN s_suppkey || ' WEST PINE RD' ELSE '' END AS street, s_suppkey % 8 IN (0, 5) AS box FROM supplier""")
def clean_addresses(spark, folder):
    rows = table(spark, folder, "supplier").selectExpr("s_suppkey AS k", _STREETS.format(k="s_suppkey") + " AS raw")
    return rows.select("k", text.clean_address("raw").alias("address"), text.clean_street("raw").alias("street"), text.has_po_box("raw").alias("box"))


@case("adr02_name_tokens", """WITH t AS (SELECT p_partkey, list_sort(list_distinct(list_filter(string_split(upper(p_name), ' '), lambda w: len(w) > 1))) AS words FROM part)
SELECT p_partkey, array_to_string(words, ' ') AS tokens, round(len(list_intersect(words, ['RED', 'RING'])) / len(list_distinct(list_concat(words, ['RED', 'RING']))), 6) AS similarity FROM t""")
def name_tokens(spark, folder):
    named = table(spark, folder, "part").select("p_partkey", text.name_tokens(F.concat(F.lit("The "), "p_name", F.lit(" & Medical Center, Inc."))).alias("words"))
    return named.select("p_partkey", F.concat_ws(" ", "words").alias("tokens"),
                        F.round(text.jaccard("words", F.array(F.lit("RED"), F.lit("RING"))), 6).alias("similarity"))


def _unplaced(spark, folder):
    facilities = role(spark, folder, "facilities")
    names = table(spark, folder, "part").selectExpr("p_partkey", "p_name")
    return facilities.join(names, F.expr("p_partkey = facility_id * 3")).selectExpr(
        "facility_id", "CASE WHEN facility_id % 2 = 0 THEN substring_index(p_name, ' ', 1) ELSE concat(p_name, ' Hospital') END AS name",
        "latitude AS anchor_lat", "longitude AS anchor_lon")


def _places(spark, folder):
    return table(spark, folder, "part").join(role(spark, folder, "sites"), F.expr("p_partkey = site_id")).selectExpr(
        "concat('node/', p_partkey) AS place_id", "latitude", "longitude", "array(p_name, concat(split(p_name, ' ')[1], ' Medical Center')) AS names")


_NAMES = with_roles("facilities", "sites") + f""",
u AS (SELECT f.facility_id, f.latitude, f.longitude, CASE WHEN f.facility_id % 2 = 0 THEN [upper(string_split(p_name, ' ')[1])] ELSE list_distinct(string_split(upper(p_name), ' ')) END AS wanted
      FROM facilities f JOIN part ON p_partkey = f.facility_id * 3),
l AS (SELECT 'node/' || p_partkey AS place_id, s.latitude, s.longitude, unnest([p_name, string_split(p_name, ' ')[2] || ' Medical Center']) AS label,
      unnest([list_distinct(string_split(upper(p_name), ' ')), [upper(string_split(p_name, ' ')[2])]]) AS got FROM part JOIN sites s ON p_partkey = site_id),
x AS (SELECT facility_id, wanted, place_id, label, {sql_miles('u.latitude', 'u.longitude', 'l.latitude', 'l.longitude', 3958.8)} AS miles,
      len(list_intersect(wanted, got)) / len(list_distinct(list_concat(wanted, got))) AS similarity FROM u CROSS JOIN l),
b AS (SELECT * FROM x WHERE miles <= 150 AND similarity >= 0.5 QUALIFY row_number() OVER (PARTITION BY facility_id ORDER BY similarity DESC, miles, place_id, label) = 1),
cl AS (SELECT *, count(DISTINCT list_sort(wanted)) OVER (PARTITION BY place_id) AS identities, row_number() OVER (PARTITION BY place_id ORDER BY similarity DESC, miles, facility_id) AS place FROM b)"""


@case("adr06_adr19_name_matches", _NAMES + " SELECT facility_id, place_id, label, round(miles, 6) AS miles, round(similarity, 6) AS similarity FROM b")
def name_matches(spark, folder):
    found = addresses.name_matches(_unplaced(spark, folder), _places(spark, folder), "facility_id", miles=150)
    return found.select("facility_id", "place_id", "label", F.round("miles", 6).alias("miles"), F.round("similarity", 6).alias("similarity"))


@case("adr07_claim_conflicts", _NAMES.replace("count(DISTINCT list_sort(wanted)) OVER (PARTITION BY place_id)", "(SELECT count(DISTINCT list_sort(i.wanted)) FROM b i WHERE i.place_id = b.place_id)") + """
SELECT facility_id, place_id, identities > 1 AND place > 1 AS conflict FROM cl""")
def claim_conflicts(spark, folder):
    unplaced = _unplaced(spark, folder)
    found = addresses.name_matches(unplaced, _places(spark, folder), "facility_id", miles=150)
    identities = unplaced.select("facility_id", text.name_tokens("name").alias("identity"))
    return addresses.settle_claims(found, identities, "facility_id").select("facility_id", "place_id", "conflict")


_TIES = with_roles("facilities") + f""",
t AS (SELECT facility_id, latitude, longitude FROM facilities WHERE facility_id % 2 = 0),
o AS (SELECT p_partkey % 60 AS a, 25 + (p_partkey * 7919 % 24000) / 1000.0::double AS la, -67 - (p_partkey * 104729 % 57000) / 1000.0::double AS lo, p_name FROM part),
m AS (SELECT facility_id, p_name, la, lo, {sql_miles('latitude', 'longitude', 'la', 'lo', 3958.8)} AS miles FROM t JOIN o ON a = facility_id % 60)"""


@case("adr03_adr04_tie_resolution", _TIES + """ SELECT facility_id, round(miles, 6) AS miles, p_name AS matched_address FROM m WHERE miles <= 300
QUALIFY row_number() OVER (PARTITION BY facility_id ORDER BY miles, la, lo, p_name) = 1""")
def ties(spark, folder):
    # a code has five digits: facilities beyond 99,999 are areas of further books, each with codes of its own
    zcta = role(spark, folder, "facilities").selectExpr(
        "facility_id div 100000 AS book", "lpad(string(facility_id % 100000), 5, '0') AS zcta5", "concat('POINT (', longitude, ' ', latitude, ')') AS geolocation")
    anchors = addresses.zip_anchors(zcta, "zcta5", "geolocation", by=["book"]).withColumn("facility_id", F.expr("book * 100000 + int(zip)"))
    tied = anchors.where("facility_id % 2 = 0").selectExpr("facility_id", "facility_id % 60 AS address", "anchor_lat", "anchor_lon")
    options = table(spark, folder, "part").selectExpr(
        "p_partkey % 60 AS address", "25 + (p_partkey * 7919 % 24000) / 1000D AS latitude", "-67 - (p_partkey * 104729 % 57000) / 1000D AS longitude", "p_name AS matched_address")
    return addresses.resolve_ties(tied, options, "facility_id", 300).select("facility_id", F.round("miles", 6).alias("miles"), "matched_address")


@case("adr05_alternate_addresses", """WITH f AS (SELECT p_partkey AS id, p_partkey % 500 AS ccn, CASE WHEN p_partkey % 3 = 0 THEN 'PO BOX 5' WHEN p_partkey % 3 = 1 THEN (p_partkey % 500) || ' Main St' ELSE (p_partkey % 500 + CASE WHEN p_partkey % 500 % 4 = 0 THEN 1 ELSE 0 END) || ' Main St' END AS street FROM part),
one AS (SELECT ccn, min(street) AS street FROM f WHERE street NOT LIKE 'PO%' GROUP BY 1 HAVING count(DISTINCT street) = 1)
SELECT id AS facility_id, one.street FROM f JOIN one USING (ccn) WHERE f.street LIKE 'PO%'""")
def alternates(spark, folder):
    rows = table(spark, folder, "part").selectExpr(
        "p_partkey AS facility_id", "'hospital' AS facility_type", "string(p_partkey % 500) AS ccn", "double(NULL) AS longitude", "'Town' AS city", "'TX' AS state", "'75001-1234' AS zip",
        """CASE WHEN p_partkey % 3 = 0 THEN 'PO BOX 5' WHEN p_partkey % 3 = 1 THEN concat(p_partkey % 500, ' Main St') ELSE concat(p_partkey % 500 + CASE WHEN p_partkey % 500 % 4 = 0 THEN 1 ELSE 0 END, ' Main St') END AS street""")
    return addresses.alternate_addresses(rows).select("facility_id", "street")


@case("adr08_fallback_method_counts", """WITH f AS (SELECT p_partkey AS id, p_partkey % 5 AS step FROM part)
SELECT count(*) FILTER (step = 0) AS census_street_interpolation, count(*) FILTER (step = 1) AS census_tie_resolved, count(*) FILTER (step = 2) AS census_alternate_address,
  count(*) FILTER (step = 3) AS openstreetmap_hospital, count(*) FILTER (step <= 3) AS hospitals_located, count(*) FILTER (step = 4) AS hospitals_unlocated, count(*) FILTER (step > 0) AS approximate_display_fallbacks FROM f""")
def fallback_counts(spark, folder):
    """Every part is a hospital that one step of the chain places: cache, tie, alternate address, name; the fifth stays.

    The ZIP is the key in base 36, so that its five characters stay unique beyond 99,999 parts."""
    base = table(spark, folder, "part").withColumn("step", F.expr("p_partkey % 5")).selectExpr(
        "p_partkey AS id", "step", "25 + (p_partkey * 7919 % 24000) / 1000D AS lat", "-67 - (p_partkey * 104729 % 57000) / 1000D AS lon")
    hospitals = base.selectExpr(
        "concat('f', id) AS facility_id", "'hospital' AS facility_type", "concat('c', id) AS ccn", "concat('Xq', id, ' Hospital') AS name",
        "CASE WHEN step = 2 THEN 'PO BOX 7' ELSE concat(id, ' Main St') END AS street", "'Town' AS city", "'TX' AS state", "lpad(conv(id, 10, 36), 5, '0') AS zip",
        "CASE WHEN step = 0 THEN lon END AS longitude", "CASE WHEN step = 0 THEN lat END AS latitude",
        "CASE step WHEN 0 THEN 'Match' WHEN 1 THEN 'Tie' ELSE 'No_Match' END AS geocode_status", "CASE WHEN step = 0 THEN 'census_street_interpolation' END AS geocode_method")
    # A second, located record under the same number gives the alternate address; it is not a hospital to place.
    twins = base.where("step = 2").selectExpr(
        "concat('t', id) AS facility_id", "'hospital' AS facility_type", "concat('c', id) AS ccn", "'Twin' AS name", "concat(id, ' Side St') AS street", "'Town' AS city",
        "'TX' AS state", "'' AS zip", "lon AS longitude", "lat AS latitude", "'Match' AS geocode_status", "'twin' AS geocode_method")
    anchors = base.selectExpr("lpad(conv(id, 10, 36), 5, '0') AS zip", "lon AS anchor_lon", "lat AS anchor_lat")
    options = base.where("step = 1").selectExpr("concat(id, ' Main St, Town, TX ', lpad(conv(id, 10, 36), 5, '0')) AS address", "lat + 0.01 AS latitude", "lon AS longitude", "'tie' AS matched_address")
    cache = base.where("step = 2").select(
        registry.cache_key(F.concat("id", F.lit(" Side St")), F.lit("Town"), F.lit("TX"), F.lit("")).alias("key"), F.lit("Match").alias("status"), F.col("lon").alias("longitude"), F.col("lat").alias("latitude"))
    places = base.where("step = 3").selectExpr("concat('way/', id) AS place_id", "lat + 0.02 AS latitude", "lon AS longitude", "array(concat('XQ', id)) AS names")
    placed = addresses.with_fallbacks(hospitals.unionByName(twins), anchors, options, cache, places)
    return addresses.method_counts(placed.where("geocode_method IS NULL OR geocode_method <> 'twin'"))


_PROVIDERS = """CASE p_partkey % 6 WHEN 0 THEN '12' WHEN 1 THEN '21' WHEN 2 THEN '33' ELSE '01' END AS category, CASE p_partkey % 4 WHEN 0 THEN '01' WHEN 1 THEN '11' WHEN 2 THEN '20' ELSE '06' END AS subtype, p_partkey % 5 <> 0 AS active"""


@case("adr09_facility_set", f"""WITH p AS (SELECT p_partkey AS k, p_name, {_PROVIDERS} FROM part),
t AS (SELECT *, CASE WHEN category = '01' THEN CASE subtype WHEN '01' THEN 'Acute Care Hospitals' WHEN '11' THEN 'Critical Access Hospitals' WHEN '06' THEN 'Childrens' END WHEN category = '21' THEN 'Federally Qualified Health Center' WHEN category = '12' THEN 'Rural Health Clinic' END AS ty FROM p),
h AS (SELECT p_partkey + CASE WHEN p_partkey % 9 = 0 THEN p_partkey % 3 ELSE 5 END * 10000000 AS k, p_brand FROM part)
SELECT k AS ccn, CASE WHEN h.p_brand IS NOT NULL OR category = '01' THEN 'hospital' ELSE 'other' END AS facility_class, coalesce(h.p_brand, p_name) AS name,
  CASE WHEN h.p_brand IS NOT NULL THEN 'VA' ELSE ty END AS type, h.p_brand IS NOT NULL AS in_hgi, coalesce(active AND ty IS NOT NULL, false) AS in_pos_active
FROM t FULL JOIN h USING (k) WHERE h.p_brand IS NOT NULL OR (active AND ty IS NOT NULL)""")
def facility_set(spark, folder):
    part = table(spark, folder, "part")
    providers = part.selectExpr(
        "p_partkey AS ccn", "p_name AS name", "'TX' AS state", "CASE p_partkey % 6 WHEN 0 THEN '12' WHEN 1 THEN '21' WHEN 2 THEN '33' ELSE '01' END AS category",
        "CASE p_partkey % 4 WHEN 0 THEN '01' WHEN 1 THEN '11' WHEN 2 THEN '20' ELSE '06' END AS subtype", "p_partkey % 5 <> 0 AS active", "'' AS county_fips", "p_size AS beds")
    general = part.selectExpr("p_partkey + CASE WHEN p_partkey % 9 = 0 THEN p_partkey % 3 ELSE 5 END * 10000000 AS ccn", "p_brand AS name", "'TX' AS state", "'VA' AS hospital_type", "'' AS county")
    return addresses.facility_set(providers, general).select("ccn", "facility_class", "name", "type", "in_hgi", "in_pos_active")


@case("adr10_modal_fips", """WITH c AS (SELECT c_mktsegment AS state, lpad(c_nationkey::varchar, 2, '0') AS f, count(*) AS n FROM customer WHERE c_custkey % 7 <> 0 GROUP BY 1, 2)
SELECT state, f AS state_fips FROM c QUALIFY row_number() OVER (PARTITION BY state ORDER BY n DESC, f) = 1""")
def modal_fips(spark, folder):
    return addresses.modal_fips(table(spark, folder, "customer").selectExpr(
        "c_mktsegment AS state_cd", "CASE WHEN c_custkey % 7 = 0 THEN '' ELSE lpad(string(c_nationkey), 2, '0') END AS fips_state_cd"))


def _candidates(spark, folder):
    part = table(spark, folder, "part")
    def source(name, keep, street):
        facility = f"p_partkey % 700 + CASE WHEN {keep} THEN 0 ELSE 1000 END"  # the others have facilities of their own
        return part.selectExpr(f"{facility} AS ccn", f"'{name}' AS source", f"{street} AS street", "' town ' AS city", "'TX' AS state", f"string({facility}) AS zip")
    return addresses.candidate_addresses([
        source("hgi", "p_partkey % 2 = 0", "concat(p_partkey % 700, ' Main St Suite 3')"), source("pos", "p_partkey % 3 = 0", "concat(p_partkey % 700, ' main st')"),
        source("enrollment", "p_partkey % 5 = 0", "CASE WHEN p_partkey % 10 = 0 THEN 'PO BOX 9' ELSE concat(p_partkey % 40, ' Oak Ave') END")])


_CANDIDATES = """WITH r AS (SELECT p_partkey % 700 + CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1000 END AS ccn, 0 AS o, 'hgi' AS source, (p_partkey % 700) || ' MAIN ST' AS street FROM part
  UNION ALL SELECT p_partkey % 700 + CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1000 END, 1, 'pos', (p_partkey % 700) || ' MAIN ST' FROM part
  UNION ALL SELECT p_partkey % 700 + CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1000 END, 2, 'enrollment', (p_partkey % 40) || ' OAK AVE' FROM part WHERE p_partkey % 10 <> 0),
u AS (SELECT ccn, street, arg_min(source, o) AS source, lpad(ccn::varchar, 5, '0') AS zip FROM r GROUP BY 1, 2)"""


@case("adr11_candidate_addresses", _CANDIDATES + " SELECT ccn, street, source, zip, left(md5(street || '|TOWN|TX|' || zip), 12) AS addr_id FROM u")
def candidate_addresses(spark, folder):
    return _candidates(spark, folder).select("ccn", "street", "source", "zip", "addr_id")


@case("adr11_addresses_per_facility", _CANDIDATES + " SELECT n AS addresses, count(*) AS facilities FROM (SELECT ccn, count(*) AS n FROM u GROUP BY 1) GROUP BY 1")
def per_facility(spark, folder):
    return addresses.addresses_per_facility(_candidates(spark, folder))


_REPLY = """SELECT p_partkey AS k, p_partkey % 300 AS ccn, CASE p_partkey % 4 WHEN 0 THEN 'hgi' WHEN 1 THEN 'pos' WHEN 2 THEN 'enrollment' ELSE 'osm' END AS source,
  CASE p_partkey % 9 WHEN 0 THEN 'No_Match' WHEN 1 THEN 'Tie' ELSE 'Match' END AS match_status, CASE WHEN p_partkey % 3 = 0 THEN 'Exact' ELSE 'Non_Exact' END AS match_type,
  concat(25 + p_partkey % 20, ' ', CASE p_partkey % 5 WHEN 0 THEN 'SOUTH' ELSE 'N' END, ' MAIN ST') AS street, '75001' AS zip,
  concat(25 + p_partkey % 20 + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END, ' N MAIN ST, TOWN, TX, ', CASE WHEN p_partkey % 2 = 0 THEN '75001' ELSE '75002' END) AS matched_address,
  CASE WHEN p_partkey % 11 = 0 THEN '06' ELSE '48' END AS reply_state, '48' AS facility_state, CASE WHEN p_partkey % 13 = 0 THEN '48003' ELSE '48001' END AS reply_county,
  CASE WHEN p_partkey % 6 = 0 THEN '' ELSE '48001' END AS facility_county, concat(-90 - (p_partkey % 300) / {d}, ',', 30 + p_partkey % 4 / {d}) AS coordinates FROM part"""
_VERDICT = "WITH r AS (" + _REPLY.format(d="100.0::double") + """),
v AS (SELECT *, CASE WHEN match_status <> 'Match' THEN lower(match_status) WHEN reply_state <> facility_state THEN 'wrong_state'
  WHEN facility_county <> '' AND reply_county <> facility_county AND NOT (match_type = 'Exact' AND k % 2 = 0) THEN 'wrong_county' WHEN match_type = 'Exact' THEN 'ok'
  WHEN k % 7 = 0 THEN 'non_exact_house_number' WHEN k % 5 = 0 THEN 'non_exact_direction' ELSE 'ok' END AS verdict0,
  string_split(coordinates, ',')[1]::double AS lon, string_split(coordinates, ',')[2]::double AS lat, left(md5(k::varchar), 12) AS addr_id FROM r),
w AS (SELECT *, CASE verdict0 WHEN 'no_match' THEN 'no_match' ELSE verdict0 END AS verdict, CASE source WHEN 'hgi' THEN 0 WHEN 'pos' THEN 1 WHEN 'enrollment' THEN 2 ELSE 3 END + CASE WHEN match_type = 'Exact' THEN 0 ELSE 10 END AS rnk FROM v)"""


def _attempts(spark, folder):
    rows = spark.sql(_REPLY.format(d="100D").replace("FROM part", "FROM {part}"), part=table(spark, folder, "part"))
    rows = addresses.reply_coordinates(rows).withColumn("addr_id", F.left(F.md5(F.col("k").cast("string")), F.lit(12)))
    return rows.withColumn("verdict", addresses.verdict(
        status="match_status", match_type="match_type", lat="lat", reply_state="reply_state", facility_state="facility_state", facility_county="facility_county",
        reply_county="reply_county", matched_address="matched_address", street="street", postal="zip"))


@case("adr12_src19_verdicts", _VERDICT + " SELECT k, verdict, lon, lat FROM w")
def verdicts(spark, folder):
    return _attempts(spark, folder).select("k", "verdict", "lon", "lat")


@case("adr15_best_locations", _VERDICT + f""",
ok AS (SELECT * FROM w WHERE verdict = 'ok'), b AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY ccn ORDER BY rnk, addr_id) = 1)
SELECT b.ccn, b.lat, b.lon, b.source AS geocode_source, b.match_type, count(DISTINCT ok.source) AS n_accurate_sources,
  round(max({sql_miles('ok.lat', 'ok.lon', 'b.lat', 'b.lon', 3958.8)}), 2) AS source_spread_mi FROM b JOIN ok USING (ccn) GROUP BY ALL""")
def best(spark, folder):
    return addresses.best_locations(_attempts(spark, folder)).drop("matched_address")


@case("adr16_outliers", _VERDICT + """,
fo AS (SELECT *, CASE verdict WHEN 'wrong_county' THEN 0 WHEN 'wrong_state' THEN 1 WHEN 'non_exact_house_number' THEN 2 WHEN 'non_exact_direction' THEN 3 WHEN 'tie' THEN 4 WHEN 'no_match' THEN 5 ELSE 6 END AS fo FROM w)
SELECT c_custkey AS ccn, coalesce(arg_min(verdict, fo * 1000000 + hash_order), 'no_usable_address') AS reason, count(DISTINCT addr_id) AS addresses_tried
FROM customer LEFT JOIN (SELECT *, row_number() OVER (ORDER BY addr_id) AS hash_order FROM fo) f ON ccn = c_custkey
WHERE c_custkey NOT IN (SELECT ccn FROM w WHERE verdict = 'ok') GROUP BY 1""")
def outliers(spark, folder):
    attempts = _attempts(spark, folder)
    facilities = table(spark, folder, "customer").selectExpr("c_custkey AS ccn")
    return addresses.outliers(facilities, attempts, addresses.best_locations(attempts)).select("ccn", "reason", "addresses_tried")


@case("adr17_match_rate", _VERDICT + " SELECT count(*) AS replies, count(*) FILTER (match_status = 'Match') AS matched, round(avg((match_status = 'No_Match')::int), 6) AS no_match_rate FROM w")
def match_rate(spark, folder):
    return addresses.match_rate(_attempts(spark, folder)).withColumn("no_match_rate", F.round("no_match_rate", 6))


@case("adr13_ties_by_county", """WITH t AS (SELECT s_suppkey AS k, s_suppkey AS address, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE '480' || lpad((s_suppkey % 6)::varchar, 2, '0') END AS county FROM supplier),
o AS (SELECT p_partkey // 20 AS address, CASE WHEN p_partkey % 2 = 0 THEN '06001' ELSE '480' || lpad((p_partkey % 23)::varchar, 2, '0') END AS oc, p_partkey AS id FROM part),
h AS (SELECT k, id FROM t JOIN o USING (address) WHERE CASE WHEN county <> '' THEN oc = county ELSE left(oc, 2) = '48' END)
SELECT k, max('m' || id) AS matched FROM h GROUP BY 1 HAVING count(*) = 1""")
def ties_by_county(spark, folder):
    tied = table(spark, folder, "supplier").selectExpr("s_suppkey AS k", "s_suppkey AS address", "'48' AS state_fips",
                                                       "CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE concat('480', lpad(string(s_suppkey % 6), 2, '0')) END AS county_fips")
    options = table(spark, folder, "part").selectExpr(
        "p_partkey div 20 AS address", "CASE WHEN p_partkey % 2 = 0 THEN '06001' ELSE concat('480', lpad(string(p_partkey % 23), 2, '0')) END AS county",
        "double(p_partkey) AS lat", "double(p_partkey) AS lon", "concat('m', p_partkey) AS matched")
    return addresses.ties_by_county(tied, options, "k").select("k", "matched")


@case("adr14_name_match_verdicts", _NAMES + """ SELECT facility_id AS ccn, CASE WHEN CASE WHEN facility_id % 3 = 0 THEN lpad((substr(place_id, 6)::bigint % 2)::varchar, 2, '0') = '01' ELSE substr(place_id, 6)::bigint % 4 = 1 END
    OR (similarity = 1 AND substr(place_id, 6)::bigint % 2 = 1) THEN 'ok' ELSE 'wrong_county' END AS verdict FROM b""")
def name_verdicts(spark, folder):
    found = addresses.name_matches(_unplaced(spark, folder), _places(spark, folder), "facility_id", miles=150).withColumnRenamed("facility_id", "ccn")
    facilities = role(spark, folder, "facilities").selectExpr("facility_id AS ccn", "CASE WHEN facility_id % 3 = 0 THEN '' ELSE '01001' END AS county_fips", "'01' AS state_fips")
    counties = table(spark, folder, "part").selectExpr("concat('node/', p_partkey) AS place_id", "CASE p_partkey % 4 WHEN 1 THEN '01001' WHEN 3 THEN '01003' ELSE '00001' END AS county")
    return addresses.name_match_verdicts(found, facilities, counties).select("ccn", "verdict")


_ZIP = """WITH h AS (SELECT p_partkey AS id, lpad((p_partkey * 37 % 99000)::varchar, 5, '0') AS zip, 'S' || (p_partkey % 9) AS st, 'C' || (p_partkey % 50) AS co FROM part),
z AS (SELECT DISTINCT lpad((c_custkey * 61 % 99000)::varchar, 5, '0') AS zip FROM customer),
n AS (SELECT h.id, min(abs(z.zip::int - h.zip::int) * 100000 + z.zip::int) AS g FROM h JOIN z ON left(z.zip, 3) = left(h.zip, 3) GROUP BY 1),
k AS (SELECT 'S' || (s_suppkey % 9) AS st, 'C' || (s_suppkey % 40) AS co, min(s_suppkey) AS v FROM supplier GROUP BY 1, 2)"""


@case("adr18_zip_placement", _ZIP + """ SELECT id AS facility_id, h.zip, CASE WHEN z.zip IS NOT NULL THEN z.zip::double WHEN g IS NOT NULL THEN (g % 100000)::double ELSE v::double END AS lon,
  CASE WHEN z.zip IS NOT NULL THEN 'zcta' WHEN g IS NOT NULL THEN 'zip3' WHEN v IS NOT NULL THEN 'county' ELSE 'unplaced' END AS loc_quality
FROM h LEFT JOIN z USING (zip) LEFT JOIN n USING (id) LEFT JOIN k ON k.st = h.st AND k.co = h.co""")
def zip_placement(spark, folder):
    hospitals = table(spark, folder, "part").selectExpr("p_partkey AS facility_id", "string(p_partkey * 37 % 99000) AS zip", "concat('S', p_partkey % 9) AS state", "concat('c', p_partkey % 50) AS county")
    zcta = table(spark, folder, "customer").selectExpr("lpad(string(c_custkey * 61 % 99000), 5, '0') AS zip").distinct().selectExpr("zip", "double(zip) AS lon", "double(zip) AS lat")
    counties = table(spark, folder, "supplier").selectExpr("concat('S', s_suppkey % 9) AS state", "concat('C', s_suppkey % 40) AS county", "double(s_suppkey) AS k").groupBy("state", "county").agg(
        F.min("k").alias("lon"), F.min("k").alias("lat"))
    return addresses.zip_placement(hospitals, zcta, counties).select("facility_id", "zip", "lon", "loc_quality")


@case("snk06_location_rows", """SELECT s_suppkey AS ccn, round(25 + s_suppkey / 7.0::double, 6) AS lat, s_suppkey % 4 = 0 AND s_suppkey % 3 <> 0 AS counts_for_coverage FROM supplier""")
def location_rows(spark, folder):
    located = table(spark, folder, "supplier").selectExpr(
        "s_suppkey AS ccn", "25 + s_suppkey / 7D AS lat", "-90D AS lon", "'hospital' AS facility_class", "'TX' AS state",
        "CASE WHEN s_suppkey % 4 = 0 THEN 'Critical Access Hospitals' ELSE 'Psychiatric' END AS type", "s_suppkey % 3 <> 0 AS in_hgi")
    return addresses.location_rows(located).select("ccn", "lat", "counts_for_coverage")
