"""Typing with quality flags, survey tables, exact-id alignment, integrity reports."""
from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.functions import parsing
from sitewise.operators import checks
from sitewise.plans import align, survey, typing

from .registry import case
from .tables import table

_RAW_COLUMNS = {
    "bed_cnt": ("CMSFacilities", """CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN ' 5.0 ' WHEN 2 THEN 'not available' WHEN 3 THEN 'abc' WHEN 4 THEN '1e3'
        WHEN 5 THEN '9223372036854775808' WHEN 6 THEN '-4' ELSE cast(o_orderkey AS string) END"""),
    "of_population_below_100_poverty": ("HPSA", "CASE o_orderkey % 5 WHEN 0 THEN '101.5' WHEN 1 THEN 'NaN' WHEN 2 THEN '12.25' WHEN 3 THEN '   ' ELSE '.5' END"),
    "m_pop": ("SVI", "CASE o_orderkey % 4 WHEN 0 THEN '-555555555' WHEN 1 THEN '-999.0' WHEN 2 THEN '7' ELSE cast(o_orderkey AS string) END"),
    "designation_date": ("MUAP", """CASE o_orderkey % 6 WHEN 0 THEN '1/2/2020' WHEN 1 THEN '2020/03/04' WHEN 2 THEN '2020-05-06' WHEN 3 THEN '2020-07-08T01:02:03'
        WHEN 4 THEN '12/31/2019 23:59:59' ELSE '31/12/2019' END"""),
    "casthma_crude95ci": ("PLACES", "CASE o_orderkey % 4 WHEN 0 THEN '(1.5, 2.5)' WHEN 1 THEN '3,4' WHEN 2 THEN '(5, 1)' ELSE '1,5)' END"),
    "emergency_services": ("CMSHospital", "CASE o_orderkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'Y' WHEN 3 THEN 'Not Applicable' ELSE 'maybe' END"),
    "note": ("RUCA", "CASE o_orderkey % 3 WHEN 0 THEN ' keep ' WHEN 1 THEN ' ' ELSE o_orderstatus END"),
}


def _cells(spark, folder):
    raw = table(spark, folder, "orders").selectExpr("o_orderkey AS _stage2_source_row", *[f"{sql} AS {c}" for c, (_, sql) in _RAW_COLUMNS.items()])
    rules = {c: typing.rule_for(source, c) for c, (source, _) in _RAW_COLUMNS.items()}
    return typing.parse_cells(raw, rules), rules


_TYPED = """WITH o AS (SELECT o_orderkey AS k, o_orderstatus FROM orders)"""


@case("typ02_to_typ12_typed_values", _TYPED + """
SELECT k AS source_row, CASE k % 8 WHEN 1 THEN 5 WHEN 4 THEN 1000 WHEN 7 THEN k END AS bed_cnt, CASE k % 5 WHEN 2 THEN 12.25::double WHEN 4 THEN 0.5 END AS poverty,
  CASE k % 4 WHEN 2 THEN 7 WHEN 3 THEN k END AS m_pop,
  CASE k % 6 WHEN 0 THEN '2020-01-02' WHEN 1 THEN '2020-03-04' WHEN 2 THEN '2020-05-06' WHEN 3 THEN '2020-07-08' WHEN 4 THEN '2019-12-31' END AS day,
  CASE k % 4 WHEN 0 THEN 1.5::double WHEN 1 THEN 3 WHEN 3 THEN 1 END AS ci_lower, CASE k % 4 WHEN 0 THEN 2.5::double WHEN 1 THEN 4 WHEN 3 THEN 5 END AS ci_upper,
  CASE k % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS emergency, CASE k % 3 WHEN 0 THEN ' keep ' WHEN 2 THEN o_orderstatus END AS note,
  nullif(concat_ws(';', CASE k % 5 WHEN 0 THEN 'of_population_below_100_poverty|101.5|invalid_value|Above configured maximum' WHEN 1 THEN 'of_population_below_100_poverty|NaN|invalid_value|Non-finite number' END,
    CASE WHEN k % 4 = 0 THEN 'm_pop|-555555555|controlled_estimate_moe' END), '') AS flags FROM o""")
def typed_values(spark, folder):
    cells, rules = _cells(spark, folder)
    flag = lambda f: F.concat_ws("|", f["column"], f["raw_value"], f["reason"], f["error"])
    return typing.typed_table(cells, rules).select(
        F.col("_stage2_source_row").alias("source_row"), "bed_cnt", F.col("of_population_below_100_poverty").alias("poverty"), "m_pop",
        F.col("designation_date").cast("string").alias("day"), F.col("casthma_crude95ci.lower").alias("ci_lower"),
        F.col("casthma_crude95ci.upper").alias("ci_upper"), F.col("emergency_services").alias("emergency"), "note",
        F.when(F.col("_stage2_quality_flags").isNotNull(), F.array_join(F.transform("_stage2_quality_flags", flag), ";")).alias("flags"))


_STATUS = {
    "bed_cnt": (8, ["blank", "present", "sentinel", "invalid", "present", "invalid", "invalid", "present"]),
    "of_population_below_100_poverty": (5, ["invalid_warned", "invalid_warned", "present", "blank", "present"]),
    "m_pop": (4, ["controlled_estimate_moe", "sentinel", "present", "present"]),
    "designation_date": (6, ["present"] * 5 + ["invalid"]),
    "casthma_crude95ci": (4, ["present", "present", "invalid", "present"]),
    "emergency_services": (5, ["present", "present", "present", "sentinel", "invalid"]),
    "note": (3, ["present", "blank", "present"]),
}


@case("typ13_cell_counts", _TYPED + " SELECT col AS column, status, count(*) AS cells FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, [" + ", ".join(f"'{s}'" for s in names) + f"][k % {n} + 1] AS status FROM o" for c, (n, names) in _STATUS.items()) + ") GROUP BY 1, 2")
def cell_counts(spark, folder):
    cells, rules = _cells(spark, folder)
    return typing.cell_counts(cells, list(rules))


_BAD = {"bed_cnt": (8, {3: "Invalid numeric value", 5: "Value is not an int64", 6: "Below configured minimum"}),
        "designation_date": (6, {5: "Unrecognized date format"}),
        "casthma_crude95ci": (4, {2: "Confidence interval must satisfy 0 <= lower <= upper <= 100"}),
        "emergency_services": (5, {4: "Expected Yes/No or Y/N"})}


@case("typ14_problem_samples", _TYPED + ", e AS (" + " UNION ALL ".join(
    f"SELECT k AS row, {list(_RAW_COLUMNS).index(c)} AS ordinal, '{c}' AS col, '{error}' AS error FROM o WHERE k % {n} = {r}"
    for c, (n, errors) in _BAD.items() for r, error in errors.items()) + ") SELECT row, col AS \"column\", error FROM e ORDER BY row, ordinal LIMIT 100")
def samples(spark, folder):
    cells, rules = _cells(spark, folder)
    return typing.problem_samples(cells, list(rules)).select("row", "column", "error")


@case("typ11_typ16_publishable_table", """SELECT count(*) AS rows, sum(p_size) AS size, count(*) FILTER (p_partkey % 4 = 0) AS missing FROM part""")
def publishable(spark, folder):
    raw = table(spark, folder, "part").selectExpr("string(p_size) AS population", "CASE WHEN p_partkey % 4 = 0 THEN '' ELSE string(p_retailprice) END AS landarea")
    rules = typing.rules_for(raw, "RUCA")
    typed = typing.publishable(typing.parse_cells(raw, rules), rules)
    return typed.agg(F.count("*").alias("rows"), F.sum("population").alias("size"), F.count_if(F.col("landarea").isNull()).alias("missing"))


@case("typ15_override_problems", """WITH c AS (SELECT DISTINCT p_type AS source, p_brand AS tab, p_name AS col FROM part),
v AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'sources' ELSE 'tables' END AS scope, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS name,
  CASE WHEN p_partkey % 7 = 0 THEN 'no such column' ELSE p_name END AS col, CASE WHEN p_partkey % 11 = 0 THEN 'typ' ELSE 'minimum' END AS property FROM part)
SELECT id, 'unknown column' AS problem FROM v WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.col = v.col AND v.name = CASE WHEN scope = 'sources' THEN c.source ELSE c.tab END)
UNION ALL SELECT id, 'unknown property' FROM v WHERE property = 'typ'""")
def override_problems(spark, folder):
    part = table(spark, folder, "part")
    catalog = part.selectExpr("p_type AS source", "p_brand AS table", "p_name AS column").distinct()
    overrides = part.selectExpr(
        "p_partkey AS id", "CASE WHEN p_partkey % 2 = 0 THEN 'sources' ELSE 'tables' END AS scope", "CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS name",
        "CASE WHEN p_partkey % 7 = 0 THEN 'no such column' ELSE p_name END AS column", "CASE WHEN p_partkey % 11 = 0 THEN 'typ' ELSE 'minimum' END AS property")
    return typing.override_problems(catalog, overrides).select("id", "problem")


_TOKENS = "CASE o_orderkey % 9 WHEN 0 THEN '-666666666' WHEN 1 THEN '(X)' WHEN 2 THEN ' ' WHEN 3 THEN '250,000+' WHEN 4 THEN '**' ELSE cast(o_custkey AS {t}) END"


@case("typ17_survey_values", f"""WITH r AS (SELECT o_orderkey AS k, trim({_TOKENS.format(t='varchar')}) AS raw FROM orders)
SELECT k, CASE WHEN k % 9 > 4 THEN raw::double END AS value, CASE WHEN k % 9 IN (0, 1, 3, 4) THEN raw END AS annotation FROM r""")
def survey_values(spark, folder):
    raw = table(spark, folder, "orders").selectExpr("o_orderkey AS GEO_ID", f"{_TOKENS.format(t='string')} AS B01001_E001")
    survey.require_expected(raw, ["B01001_E001"])
    return survey.survey_columns(raw, ["B01001_E001"]).selectExpr("GEO_ID AS k", "acs_b01001_e001 AS value", "acs_b01001_e001_annotation AS annotation")


@case("typ20_special_counts", f"""SELECT 'B01001_E001' AS column, trim({_TOKENS.format(t='varchar')}) AS token, count(*) AS cells FROM orders WHERE o_orderkey % 9 <= 4 GROUP BY 2""")
def special_counts(spark, folder):
    raw = table(spark, folder, "orders").selectExpr("o_orderkey AS GEO_ID", f"{_TOKENS.format(t='string')} AS B01001_E001")
    return survey.special_counts(raw, ["B01001_E001"])


@case("typ18_unpaired_columns", """WITH c AS (SELECT DISTINCT 'B' || lpad(p_partkey::varchar, 5, '0') || '_' || kind || '001' AS col, 'B' || lpad(p_partkey::varchar, 5, '0') || '_' || CASE kind WHEN 'E' THEN 'M' ELSE 'E' END || '001' AS partner
  FROM part, (VALUES ('E'), ('M')) v(kind) WHERE NOT (kind = 'M' AND p_partkey % 6 = 0) AND NOT (kind = 'E' AND p_partkey % 10 = 0))
SELECT col AS column, partner FROM c WHERE partner NOT IN (SELECT col FROM c)""")
def unpaired(spark, folder):
    columns = table(spark, folder, "part").select("p_partkey", F.explode(F.array(F.lit("E"), F.lit("M"))).alias("kind")).where(
        "NOT (kind = 'M' AND p_partkey % 6 = 0) AND NOT (kind = 'E' AND p_partkey % 10 = 0)")
    return survey.unpaired_columns(columns.select(F.format_string("B%05d_%s001", "p_partkey", "kind").alias("column")).distinct())


@case("typ19_label_paths", """WITH l AS (SELECT o_custkey AS tab, o_orderkey AS line, (o_orderkey * 7 % 5)::int AS indent, 'L' || o_orderkey AS label FROM orders),
anc AS (SELECT c.tab, c.line, a.line AS aline, a.label FROM l c JOIN l a ON a.tab = c.tab AND a.line <= c.line AND a.indent <= c.indent
  WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.tab = c.tab AND b.line > a.line AND b.line <= c.line AND b.indent <= a.indent))
SELECT tab AS "table", line, string_agg(label, ' > ' ORDER BY aline) AS label_path FROM anc GROUP BY 1, 2""")
def label_paths(spark, folder):
    lines = table(spark, folder, "orders").selectExpr("o_custkey AS table", "o_orderkey AS line", "int(o_orderkey * 7 % 5) AS indent", "concat('L', o_orderkey) AS label")
    return survey.label_paths(lines).select("table", "line", "label_path")


@case("src14_component_mismatches", """SELECT c_custkey FROM customer WHERE c_custkey % 8 = 3 OR c_custkey % 10 = 9""")
def component_mismatches(spark, folder):
    rows = table(spark, folder, "customer").selectExpr(
        "c_custkey", "lpad(string(c_nationkey), 2, '0') AS STATE", "lpad(string(c_custkey % 300), 3, '0') AS COUNTY", "lpad(string(c_custkey), 6, '0') AS TRACT").selectExpr(
        "*", """CASE WHEN c_custkey % 10 = 9 THEN concat('0500000US', STATE, COUNTY, '1') WHEN c_custkey % 8 = 3 THEN concat('1400000US', STATE, COUNTY, '999999')
        WHEN c_custkey % 2 = 0 THEN concat('0500000US', STATE, COUNTY) ELSE concat('1400000US', STATE, COUNTY, TRACT) END AS GEO_ID""")
    return survey.component_mismatches(rows).select("c_custkey")


_ASSEMBLY = """WITH g AS (SELECT '1400000US' || lpad(c_custkey::varchar, 11, '0') AS id, c_custkey AS k FROM customer)"""


@case("jn04_survey_assembly", _ASSEMBLY + """
SELECT lpad(g.k::varchar, 11, '0') AS tract_geoid, a.v AS a, a.v IS NOT NULL AS a_present, b.v AS b, b.v IS NOT NULL AS b_present,
  2019 AS first_year, 2023 AS last_year FROM g LEFT JOIN (SELECT max(k) AS k, sum(k)::double AS v FROM g GROUP BY k // 3) a ON a.k = g.k
  LEFT JOIN (SELECT max(k) AS k, sum(k)::double AS v FROM g GROUP BY k // 4) b ON b.k = g.k""")
def assembly(spark, folder):
    geo = table(spark, folder, "customer").selectExpr("concat('1400000US', lpad(string(c_custkey), 11, '0')) AS GEO_ID", "c_custkey AS k")
    a = geo.groupBy(F.expr("k div 3")).agg(F.max("GEO_ID").alias("GEO_ID"), F.sum("k").cast("double").alias("a")).select("GEO_ID", "a")
    b = geo.groupBy(F.expr("k div 4")).agg(F.max("GEO_ID").alias("GEO_ID"), F.sum("k").cast("double").alias("b")).select("GEO_ID", "b")
    tracts, _ = survey.split_areas(survey.assemble(survey.area_rows(geo), {"b01001": a, "b17001": b}, 2023))
    return tracts.selectExpr("tract_geoid", "a", "acs_b01001_record_present AS a_present", "b", "acs_b17001_record_present AS b_present",
                             "acs_period_start AS first_year", "acs_period_end AS last_year")


_ENRICH = """WITH b AS (SELECT lpad((c_nationkey * 1000000000 + c_custkey)::varchar, 11, '0') AS geoid FROM customer),
a AS (SELECT lpad((c_nationkey * 1000000000 + c_custkey + CASE WHEN c_custkey % 6 = 0 THEN 700000000 ELSE 0 END)::varchar, 11, '0') AS geoid, c_acctbal AS value FROM customer
  UNION ALL SELECT lpad((s_nationkey * 1000000000 + 500000000 + s_suppkey)::varchar, 11, '0'), s_acctbal FROM supplier)"""


def _enriched(spark, folder):
    customer, supplier = table(spark, folder, "customer"), table(spark, folder, "supplier")
    base = customer.selectExpr("lpad(string(c_nationkey * 1000000000L + c_custkey), 11, '0') AS tract_geoid")
    attributes = customer.selectExpr("lpad(string(c_nationkey * 1000000000L + c_custkey + CASE WHEN c_custkey % 6 = 0 THEN 700000000 ELSE 0 END), 11, '0') AS tract_geoid", "c_acctbal AS value").unionByName(
        supplier.selectExpr("lpad(string(s_nationkey * 1000000000L + 500000000 + s_suppkey), 11, '0') AS tract_geoid", "s_acctbal AS value"))
    return survey.enrich(base, attributes, "tract_geoid", 11)


@case("jn05_enrichment", _ENRICH.replace("c_nationkey * 1000000000", "c_nationkey::bigint * 1000000000").replace("s_nationkey * 1000000000", "s_nationkey::bigint * 1000000000") + """
SELECT b.geoid AS tract_geoid, value, a.geoid IS NOT NULL AS acs_geography_matched FROM b LEFT JOIN a USING (geoid)""")
def enrichment(spark, folder):
    return _enriched(spark, folder)[0]


@case("jn05_snk03_unmatched_both_sides", _ENRICH.replace("c_nationkey * 1000000000", "c_nationkey::bigint * 1000000000").replace("s_nationkey * 1000000000", "s_nationkey::bigint * 1000000000") + """
SELECT geoid AS tract_geoid, 'without_attributes' AS side FROM b WHERE geoid NOT IN (SELECT geoid FROM a)
UNION ALL SELECT geoid, 'without_reference' FROM a WHERE geoid NOT IN (SELECT geoid FROM b) AND left(geoid, 2) IN (SELECT left(geoid, 2) FROM b)""")
def unmatched(spark, folder):
    _, missing, unused = _enriched(spark, folder)
    return missing.withColumn("side", F.lit("without_attributes")).unionByName(unused.withColumn("side", F.lit("without_reference")))


_ALIGN = """WITH base AS (SELECT st || lpad(c_custkey::varchar, 9, '0') AS geoid, st FROM (SELECT c_custkey, lpad((c_nationkey + CASE WHEN c_nationkey >= 20 THEN 40 ELSE 0 END)::varchar, 2, '0') AS st FROM customer)),
src AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 'bad' || p_partkey WHEN c.c_custkey IS NULL THEN lpad((p_partkey % 30)::varchar, 2, '0') || lpad((p_partkey + 500000000)::varchar, 9, '0')
      ELSE lpad(c_nationkey::varchar, 2, '0') || lpad(c_custkey::varchar, 9, '0') END AS raw, p_size FROM part LEFT JOIN customer c ON c_custkey = p_partkey),
x AS (SELECT *, CASE WHEN id % 10 = 1 AND EXISTS (SELECT 1 FROM base WHERE geoid = raw) THEN 'moved' END AS moved FROM src),
m AS (SELECT *, regexp_full_match(raw, '[0-9]{11}') AS valid, EXISTS (SELECT 1 FROM base WHERE geoid = raw) AS known, left(raw, 2) IN (SELECT st FROM base) AS in_scope FROM x)"""


def _alignment(spark, folder):
    customer = table(spark, folder, "customer")
    geoid = F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    # the last states of the base have other codes than in the source
    state = F.expr("lpad(string(c_nationkey + CASE WHEN c_nationkey >= 20 THEN 40 ELSE 0 END), 2, '0')")
    base = customer.select(F.concat(state, F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("tract_geoid"), state.alias("state_fips"))
    source = table(spark, folder, "part").join(customer, F.col("c_custkey") == F.col("p_partkey"), "left").select(
        "p_partkey", "p_size", F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("bad"), "p_partkey")).when(
            F.col("c_custkey").isNull(), F.concat(F.lpad((F.col("p_partkey") % 30).cast("string"), 2, "0"), F.lpad((F.col("p_partkey") + 500000000).cast("string"), 9, "0"))
        ).otherwise(F.concat(F.lit(" "), geoid, F.lit(" "))).alias("fips"))
    return align.align(base, source, "fips", "tract_geoid", "svi", 2022, ["p_partkey", "p_size"])


@case("jn01_alignment", _ALIGN + """ SELECT geoid AS tract_geoid, id AS svi_p_partkey, p_size AS svi_p_size, id IS NOT NULL AS svi_matched,
  CASE WHEN id IS NOT NULL THEN 'exact_identifier_no_reallocation' END AS svi_match_method FROM base LEFT JOIN (SELECT * FROM m WHERE valid AND known) ON raw = geoid""")
def alignment(spark, folder):
    return _alignment(spark, folder).joined.select("tract_geoid", "svi_p_partkey", "svi_p_size", "svi_matched", "svi_match_method")


@case("jn03_unmatched_reasons", _ALIGN + """ SELECT id AS p_partkey, CASE WHEN NOT valid THEN 'malformed_identifier' WHEN in_scope THEN 'no_exact_2023_identifier' ELSE 'outside_selected_states' END AS reason
  FROM m WHERE NOT (valid AND known)""")
def reasons(spark, folder):
    return _alignment(spark, folder).unmatched.selectExpr("p_partkey", "_stage3_alignment_reason AS reason")


@case("jn03_reconciliation", _ALIGN + """ SELECT count(*) FILTER (valid AND known) AS matched, count(*) FILTER (valid AND in_scope AND NOT known) AS unmatched_in_scope, count(*) FILTER (NOT valid) AS malformed_identifiers,
  (SELECT count(*) FROM base WHERE geoid NOT IN (SELECT raw FROM m WHERE valid AND known)) AS reference_without_source FROM m""")
def reconciliation(spark, folder):
    return align.reconciliation(_alignment(spark, folder), "svi")


@case("jn02_crosswalk", """WITH base AS (SELECT lpad((c_custkey + 100000)::varchar, 11, '0') AS geoid FROM customer),
s AS (SELECT c_custkey AS id, lpad((c_custkey + CASE WHEN c_custkey % 4 = 0 THEN 900000 ELSE 100000 END)::varchar, 11, '0') AS raw, lpad((c_custkey + 100000)::varchar, 11, '0') AS target FROM customer)
SELECT geoid AS tract_geoid, id AS ruca_c_custkey, CASE WHEN raw = target THEN 'exact_identifier_no_reallocation' ELSE 'reviewed_identifier_equivalence' END AS ruca_match_method
FROM base JOIN s ON target = geoid""")
def crosswalk(spark, folder):
    customer = table(spark, folder, "customer")
    base = customer.selectExpr("lpad(string(c_custkey + 100000), 11, '0') AS tract_geoid", "'00' AS state_fips")
    source = customer.selectExpr("c_custkey", "lpad(string(c_custkey + CASE WHEN c_custkey % 4 = 0 THEN 900000 ELSE 100000 END), 11, '0') AS fips")
    reviewed = customer.where("c_custkey % 4 = 0").selectExpr(
        "lpad(string(c_custkey + 900000), 11, '0') AS source_geoid", "lpad(string(c_custkey + 100000), 11, '0') AS target_geoid", "'renumbered' AS evidence")
    return align.align(base, source, "fips", "tract_geoid", "ruca", 2020, ["c_custkey"], reviewed).joined.select(
        "tract_geoid", "ruca_c_custkey", "ruca_match_method")


@case("jn06_integrity_report", """WITH t AS (SELECT c_custkey % 1000 AS tract, c_custkey % 40 AS county FROM customer), co AS (SELECT DISTINCT s_suppkey % 35 AS county FROM supplier),
f AS (SELECT p_partkey AS id, p_partkey % 1100 AS tract, p_partkey % 37 AS county FROM part)
SELECT 'duplicate_tract' AS "check", (SELECT count(*) FROM (SELECT tract FROM t GROUP BY 1 HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'duplicate_county', (SELECT count(*) FROM (SELECT county FROM co GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'duplicate_facility', 0
UNION ALL SELECT 'tract_without_county', (SELECT count(*) FROM t WHERE county NOT IN (SELECT county FROM co))
UNION ALL SELECT 'facility_without_tract', (SELECT count(*) FROM f WHERE tract NOT IN (SELECT tract FROM t))
UNION ALL SELECT 'facility_without_county', (SELECT count(*) FROM f WHERE county NOT IN (SELECT county FROM co))
UNION ALL SELECT 'facility_tract_county_disagree', (SELECT count(*) FROM f JOIN t USING (tract) WHERE f.county <> t.county)""")
def integrity(spark, folder):
    tracts = table(spark, folder, "customer").selectExpr("c_custkey % 1000 AS tract_geoid", "c_custkey % 40 AS county_geoid")
    counties = table(spark, folder, "supplier").selectExpr("s_suppkey % 35 AS county_geoid").distinct()
    facilities = table(spark, folder, "part").selectExpr("p_partkey AS facility_id", "p_partkey % 1100 AS tract_geoid", "p_partkey % 37 AS county_geoid")
    return checks.integrity_report(tracts, counties, facilities)


@case("so01_so02_so03_set_operations", """WITH a AS (SELECT c_nationkey AS n, c_mktsegment AS seg FROM customer), b AS (SELECT s_nationkey AS n, 'SUPPLIER' AS seg FROM supplier)
SELECT DISTINCT n, seg FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE n NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 5 = 0)""")
def set_operations(spark, folder):
    a = table(spark, folder, "customer").selectExpr("c_nationkey AS n", "c_mktsegment AS seg")
    b = table(spark, folder, "supplier").selectExpr("s_nationkey AS n", "'SUPPLIER' AS seg")
    banned = table(spark, folder, "supplier").where("s_suppkey % 5 = 0").selectExpr("s_nationkey AS n")
    return a.unionByName(b).distinct().join(banned, "n", "left_anti")


@case("typ03_typ09_white_space", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size::bigint END AS value, CASE WHEN p_partkey % 4 = 0 THEN 'blank' ELSE 'present' END AS status FROM part""")
def white_space(spark, folder):
    cell = F.expr("CASE p_partkey % 4 WHEN 0 THEN '\\t\\u00A0\\n' WHEN 1 THEN concat(string(p_size), '\\t') WHEN 2 THEN concat('\\u00A0', string(p_size), '\\u2003') ELSE concat(string(p_size), '\\u3000 ') END")
    rows = table(spark, folder, "part").select("p_partkey", cell.alias("size"))
    parsed = parsing.parsed_cells(rows, {"size": parsing.Rule(type="int64")})
    return parsed.select("p_partkey", F.col("size.value").alias("value"), F.col("size.status").alias("status"))
