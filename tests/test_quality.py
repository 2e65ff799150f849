import datetime

import pytest
from pyspark.sql import Observation, functions as F

from sitewise.functions import text
from sitewise.functions.parsing import Rule, parsed_cells
from sitewise.operators import checks
from sitewise.operators.checks import ContractError
from sitewise.plans import addresses, align, registry, survey, typing
from sitewise.sources import sinks, staging


def parse(spark, value, rule):
    return parsed_cells(spark.createDataFrame([(value,)], "v string"), {"v": rule}).first()["v"]


@pytest.mark.parametrize("value,rule,want", [
    (None, Rule("int64"), (None, "blank")), ("  ", Rule(), (None, "blank")), (" x ", Rule(), (" x ", "present")),
    ("9223372036854775807", Rule("int64"), (9223372036854775807, "present")), ("9223372036854775808", Rule("int64"), (None, "invalid")),
    ("1e3", Rule("int64"), (1000, "present")), ("1.5", Rule("int64"), (None, "invalid")), ("Infinity", Rule("float64"), (None, "invalid")),
    ("1e400", Rule("float64"), (None, "invalid")), ("-7.25", Rule("float64"), (-7.25, "present")), ("na", Rule("int64", missing=("NA",)), (None, "sentinel")),
    ("2/29/2024", Rule("date"), (datetime.date(2024, 2, 29), "present")), ("2/30/2024", Rule("date"), (None, "invalid")),
    ("Y", Rule("bool"), (True, "present")), ("1", Rule("bool"), (None, "invalid")),
])
def test_cells(spark, value, rule, want):
    cell = parse(spark, value, rule)
    assert (cell["value"], cell["status"]) == want


def test_rules_are_layered():
    over = {"sources": {"SVI": {"e_pop": {"minimum": 5}}}, "tables": {"SVI/a.csv": {"e_pop": {"type": "float64"}}}}
    rule = typing.rule_for("SVI", "e_pop", "SVI/a.csv", over)
    assert (rule.type, rule.minimum, rule.origin) == ("float64", 5, "configured")
    assert typing.rule_for("SVI", "epl_x").maximum == 1 and typing.rule_for("SVI", "m_x").missing_reasons
    assert typing.rule_for("RUCA", "tract").review_required and not typing.rule_for("RUCA", "population").review_required
    with pytest.raises(ValueError):
        Rule("money")


def test_rejecting_rule_stops_the_table(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x")], "_stage2_source_row long, population string")
    rules = typing.rules_for(df, "RUCA")
    with pytest.raises(ContractError):
        typing.publishable(typing.parse_cells(df, rules), rules)


def test_headers():
    assert staging.normalize_headers(["A b", " a-B ", "", "Ä", None, "a_b"]) == ["a_b", "a_b__2", "column_3", "column_4", "column_5", "a_b__3"]


def write(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data)
    return str(path)


def test_quoted_line_breaks_and_blanks(spark, tmp_path):
    path = write(tmp_path, "a.csv", '﻿Key,Note\r\n1,"two\nlines, ""q"""\r\n2,\r\n'.encode("utf-8"))
    rows = [tuple(r) for r in staging.stage_csv(spark, path).orderBy("key").collect()]
    assert rows == [("1", 'two\nlines, "q"'), ("2", "")]


@pytest.mark.parametrize("body", [b"Key,Name\n1,a\n2\n", b"Key,Name\n1,a\n2,b,c\n", b"Key,Name\n1,\xff\xfe\n"])
def test_bad_files_fail(spark, tmp_path, body):
    with pytest.raises(ContractError):
        staging.stage_csv(spark, write(tmp_path, "b.csv", body))


def test_blank_tail_must_be_blank(spark, tmp_path):
    good = write(tmp_path, "c.csv", b"Key,Name,\n1,a,\n2,b\n")
    assert staging.stage_csv(spark, good, drop_blank_tail=True).count() == 2
    with pytest.raises(ContractError):
        staging.stage_csv(spark, write(tmp_path, "d.csv", b"Key,Name,\n1,a,x\n"), drop_blank_tail=True)


def test_duplicate_zip_members(spark):
    members = spark.createDataFrame([("a.zip", "x.csv", 1), ("a.zip", "x.csv", 2), ("b.zip", "x.csv", 1)], "archive string, member string, bytes long")
    assert [r["archive"] for r in staging.duplicate_members(members).collect()] == ["a.zip"]


def test_latest_run_ignores_unfinished(spark, tmp_path):
    root = str(tmp_path / "runs")
    df = spark.createDataFrame([(1,)], "v int")
    with pytest.raises(Exception):
        sinks.latest_run(spark, root, "t")
    sinks.publish(df, root, "t", "r1")
    sinks.note_run(spark, root, "t", "r2", "failed", df.agg(F.count("*").alias("rows")))
    assert sinks.latest_run(spark, root, "t").collect()[0]["v"] == 1


def test_align_contracts(spark):
    base = spark.createDataFrame([("01001000001", "01")], "tract_geoid string, state_fips string")
    twice = spark.createDataFrame([("01001000001", 1), (" 01001000001 ", 2)], "fips string, v int")
    with pytest.raises(ContractError):
        align.align(base, twice, "fips", "tract_geoid", "x", 2020)
    walk = spark.createDataFrame([("a", "01001000001", None)], "source_geoid string, target_geoid string, evidence string")
    with pytest.raises(ContractError):
        align.align(base, twice.limit(1), "fips", "tract_geoid", "x", 2020, crosswalk=walk)


def test_enrichment_contracts(spark):
    base = spark.createDataFrame([("01001",)], "county_geoid string")
    with pytest.raises(ContractError):
        survey.enrich(base, spark.createDataFrame([("1001", 1)], "county_geoid string, v int"), "county_geoid", 5)
    with pytest.raises(ValueError):
        survey.enrich(base.withColumn("v", F.lit(1)), spark.createDataFrame([("01001", 1)], "county_geoid string, v int"), "county_geoid", 5)


def test_row_floor_and_conservation(spark):
    df = spark.range(3)
    checks.require_rows(df, 3, "rows")
    with pytest.raises(ContractError):
        checks.require_rows(df, 4, "rows")
    with pytest.raises(ContractError):
        checks.conserved(df, df.limit(2), "step")


def test_cache_key_matches_json_form(spark):
    import hashlib
    import json

    address = ['1 "Q" St', "Town", "TX", "75001"]
    row = spark.createDataFrame([tuple(address)], "a string, b string, c string, d string").select(
        registry.cache_key(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("k")).first()
    assert row["k"] == hashlib.sha256(json.dumps(["Public_AR_Current", address]).encode()).hexdigest()


def test_street_parts(spark):
    row = spark.createDataFrame([("123 North Main ST SW", "Suite 5, PO BOX 12")], "a string, b string").select(
        text.house_number("a").alias("n"), text.directions("a").alias("d"), text.clean_street("b").alias("c")).first()
    assert (row["n"], row["d"], row["c"]) == ("123", ["N", "SW"], "")


def test_claims_between_identical_names_are_shared(spark):
    matches = spark.createDataFrame([(1, "p", .9, 1.0), (2, "p", .9, 2.0), (3, "q", .6, 1.0), (4, "q", .7, 3.0)], "k int, place_id string, similarity double, miles double")
    identities = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z")], "k int, identity string")
    assert {r["k"]: r["conflict"] for r in addresses.settle_claims(matches, identities, "k").collect()} == {1: False, 2: False, 3: True, 4: False}


def test_checks_are_counted_during_the_one_write(spark, tmp_path, monkeypatch):
    """A file that is known to hold no line breaks in quotes is parsed, and its raw lines are never read."""
    path = write(tmp_path, "once.csv", "Key,Name\n1,é\n2,\n".encode())
    monkeypatch.setattr(staging, "undecodable_lines", lambda *a: pytest.fail("raw lines were read"))
    monkeypatch.setattr(staging, "spans_lines", lambda *a: pytest.fail("raw lines were read"))
    assert sorted(map(tuple, staging.stage_csv(spark, path, multi_line=False).collect())) == [("1", "é"), ("2", "")]


def test_a_true_replacement_character_is_no_fault(spark, tmp_path):
    good = write(tmp_path, "mark.csv", "Key,Name\n1,�\n".encode())
    assert staging.stage_csv(spark, good, multi_line=False).first()["name"] == "�"
    with pytest.raises(ContractError, match="not valid"):
        staging.stage_csv(spark, write(tmp_path, "bad.csv", b"Key,Name\n1,\xff\n"), multi_line=False)


def test_legacy_encoding_leaves_the_session_as_it_was(spark, tmp_path):
    before = spark.conf.get("spark.sql.legacy.javaCharsets", None)
    staged = staging.stage_csv(spark, write(tmp_path, "legacy.csv", "Key,Name\n1,Niño\n".encode("windows-1252")), staging.LEGACY)
    assert spark.conf.get("spark.sql.legacy.javaCharsets", None) == before and staged.first()["name"] == "Niño"


def test_written_rows_are_compared_with_the_files(spark, tmp_path, monkeypatch):
    back = sinks.write_table(spark.range(10).selectExpr("id", "id % 3 AS part"), str(tmp_path / "t"), ["part"])
    assert back.count() == 10


    class Wrong(Observation):
        get = {"rows": 6}

    monkeypatch.setattr(sinks, "Observation", Wrong)
    with pytest.raises(ContractError, match="6 rows written, 5 rows"):
        sinks.write_table(spark.range(5), str(tmp_path / "u"))


def test_registry_cells_are_hashed_not_sorted(spark, monkeypatch):
    rows = [("h1", "hospital", "B", 1, "a.csv", 2), ("h1", "hospital", "A", 0, "z.csv", 9), ("h1", "hospital", "C", 1, "a.csv", None), ("h1", "hospital", "A", 1, "a.csv", 1),
            ("h2", "unclassified_provider", "", 2, "b.csv", 1)]
    records = spark.createDataFrame(rows, "facility_id string, facility_type string, name string, priority int, source_table string, source_row long").withColumns(
        {"match_method": F.lit("exact"), **{c: F.lit(None).cast("string") for c in registry.MERGED_FIELDS if c != "name"}})
    plans, settle = [], registry.settle
    monkeypatch.setattr(registry, "settle", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or settle(df))
    merged = {r["facility_id"]: r for r in registry.merge_records(records).collect()}
    assert merged["h1"]["name"] == "A" and merged["h1"]["field_conflicts"] == {"name": ["A", "C", "B"]} and merged["h1"]["source_record_count"] == 4
    assert merged["h2"]["name"] is None and merged["h2"]["source_record_count"] == 1
    lines = plans[0].splitlines()
    below = [i for i, line in enumerate(lines) if "Generate" in line]
    assert below
    for i in below:  # what meets the cells first must not sort all of them
        assert "HashAggregate" in next(line for line in reversed(lines[:i]) if "Aggregate" in line)


def test_ties_of_a_shared_address_are_not_compared_with_all_options(spark, monkeypatch):
    tied = spark.range(600).selectExpr("id", "if(id % 3 = 0, 'a', 'b') AS address", "30 + id % 25 / 4D AS anchor_lat", "-100 + id div 25 / 4D AS anchor_lon")
    options = spark.range(2000).selectExpr("if(id % 2 = 0, 'a', 'b') AS address", "CASE WHEN id % 99 <> 0 THEN 30 + id % 50 / 8D END AS latitude", "-100 + id div 50 / 8D AS longitude",
                                           "concat('m', id % 7) AS matched_address")
    met, joined = [], addresses.spatial._joined
    monkeypatch.setattr(addresses.spatial, "_joined", lambda *a: met.append(joined(*a)) or met[-1])
    got = {tuple(r) for r in addresses.resolve_ties(tied, options, "id", 20).collect()}
    pairs = tied.join(options.where("latitude IS NOT NULL"), "address").withColumn(
        "miles", addresses.haversine("anchor_lat", "anchor_lon", "latitude", "longitude", addresses.EARTH_MILES_ROUNDED)).where("miles <= 20")
    want = {tuple(r) for r in pairs.groupBy("id").agg(F.min(F.struct("miles", "latitude", "longitude", "matched_address")).alias("b")).select("id", "b.*").collect()}
    assert got == want and 0 < len(want) < 600
    assert sum(m.count() for m in met) < 0.1 * 600 * 1000


def test_postal_codes_of_several_books_stay_apart(spark):
    zcta = spark.createDataFrame([(0, "00007", "POINT (-90 40)"), (1, "00007", "POINT (-80 30)")], "book int, code string, at string")
    got = {(r["book"], r["zip"], r["anchor_lon"]) for r in addresses.zip_anchors(zcta, "code", "at", by=["book"]).collect()}
    assert got == {(0, "00007", -90.0), (1, "00007", -80.0)}
