"""One facility registry out of several source tables, with conflicts kept visible."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import first_nonblank, strip
from ..functions.text import ANY_PO_BOX_PATTERN, normalized, text, zip5
from ..operators.ranking import lookup_by_value
from ..session import settle

# For each registry field, the source columns that may hold it, in order.
ALIASES = {
    "state": ("state", "enrollment_state", "state_cd"), "ccn": ("facility_id", "ccn", "prvdr_num"),
    "street": ("address", "address_line_1", "st_adr"), "street2": ("address_line_2",), "city": ("city_town", "city", "city_name"),
    "zip": ("zip_code", "zip_cd"), "npi": ("npi",), "enrollment_id": ("enrollment_id",),
    "name": ("facility_name", "organization_name", "fac_name"), "ownership": ("hospital_ownership", "proprietary_nonprofit"),
    "emergency_services": ("emergency_services",), "hospital_overall_rating": ("hospital_overall_rating",), "bed_count": ("bed_cnt",),
    "source_status_code": ("pgm_trmntn_cd", "cmplnc_stus_cd"), "source_category_code": ("prvdr_ctgry_cd", "prvdr_type_id"),
    "source_provider_type_text": ("provider_type_text",),
}
# Table-name fragments that give the facility type.
TYPE_FRAGMENTS = (("Hospital_Enrollments", "hospital"), ("FQHC_", "fqhc"), ("SNF_", "skilled_nursing"),
                  ("RHC_", "rural_health_clinic"), ("Hospice_", "hospice"), ("HHA_", "home_health"))
MERGED_FIELDS = ("ccn", "name", "street", "street2", "city", "state", "zip", "ownership", "emergency_services",
                 "hospital_overall_rating", "bed_count")
UNCLASSIFIED = "unclassified_provider"
BENCHMARK = "Public_AR_Current"


@dataclass(frozen=True)
class Source:
    name: str      # "CMSHospital" or "CMSFacilities"
    table: str     # table identity
    rows: DataFrame


def _field(df: DataFrame, name: str) -> Column:
    present = [F.col(c).cast("string") for c in ALIASES[name] if c in df.columns]
    return first_nonblank(*present) if present else F.lit(None).cast("string")


def source_records(sources: Sequence[Source], states: Sequence[str]) -> DataFrame:
    """All source rows of the selected states in one shape, each with its deterministic facility id.

    Rows merge only on certification number plus full address; any other row stays by itself.
    """
    records = None
    for source in sources:
        df = source.rows
        fields = {f"_{name}": _field(df, name) for name in ALIASES}
        label = next((kind for fragment, kind in reversed(TYPE_FRAGMENTS) if fragment in source.table), UNCLASSIFIED)
        if source.name == "CMSHospital":
            label = "hospital"
        priority = 0 if source.name == "CMSHospital" else (1 if "Enrollments" in source.table else 2)
        part = df.select(F.col("_stage2_source_row").cast("long").alias("source_row"), *[c.alias(n) for n, c in fields.items()]).select(
            F.lit(source.table).alias("source_table"), "source_row", normalized("_ccn").alias("ccn"), text("_street").alias("street"),
            text("_street2").alias("street2"), text("_city").alias("city"), normalized("_state").alias("state"), zip5("_zip").alias("zip"),
            text("_name").alias("name"), *[F.when(text(f"_{c}") != "", text(f"_{c}")).alias(c) for c in (
                "npi", "enrollment_id", "ownership", "emergency_services", "hospital_overall_rating", "bed_count",
                "source_status_code", "source_category_code", "source_provider_type_text")],
            F.lit(label).alias("facility_type"), F.lit(priority).alias("priority"))
        records = part if records is None else records.unionByName(part)
    records = records.where(F.col("state").isin(*states))
    address = F.concat_ws("|", *[normalized(c) for c in ("street", "street2", "city", "state", "zip")])
    identified = (F.col("ccn") != "") & (F.col("street") != "") & (F.col("city") != "") & (F.col("zip") != "")
    key = F.when(identified, F.concat(F.lit("ccn:"), "ccn", F.lit("|"), address)).otherwise(
        F.concat("source_table", F.lit("::"), F.col("source_row").cast("string")))
    return records.withColumns({
        "facility_id": F.concat(F.lit("facility_"), F.left(F.sha2(key, 256), F.lit(24))),
        "match_method": F.when(identified, F.lit("exact_ccn_and_address")).otherwise(F.lit("unmerged_source_record")),
        "ccn": F.when(F.col("ccn") != "", F.col("ccn"))})


def merge_records(records: DataFrame) -> DataFrame:
    """One row per facility: first non-blank value per field, conflicting values, type consensus.

    Values are reduced to one row per (facility, field, value) before they are gathered, so a
    facility with many source rows costs only its distinct values.
    """
    order = F.struct("priority", "source_table", "source_row")
    source = ["priority", "source_table"]
    first_row = F.min(F.coalesce("source_row", F.lit(-(1 << 63)))).alias("source_row")  # unnumbered rows come first
    cells = records.select("facility_id", *source, "source_row", F.explode(F.array(*[
        F.struct(F.lit(name).alias("field"), strip(name).alias("value")) for name in MERGED_FIELDS])).alias("c")
    ).select("facility_id", *source, "source_row", "c.*").where(F.coalesce(F.col("value"), F.lit("")) != "")
    # The first row of each source table is a number, which is hashed; the least struct of all rows would sort every cell.
    values = cells.groupBy("facility_id", "field", "value", *source).agg(first_row)
    values = values.groupBy("facility_id", "field", "value").agg(F.min(order).alias("order"))
    fields = values.groupBy("facility_id", "field").agg(
        F.min_by("value", "order").alias("first"),
        F.transform(F.array_sort(F.collect_list(F.struct("order", "value"))), lambda x: x["value"]).alias("distinct"))
    merged = fields.groupBy("facility_id").agg(
        *[F.max(F.when(F.col("field") == name, F.col("first"))).alias(name) for name in MERGED_FIELDS],
        F.collect_list(F.when(F.size("distinct") > 1, F.struct("field", "distinct"))).alias("_conflicts"))
    heads = records.groupBy("facility_id", *source, "match_method", "facility_type").agg(
        F.count("*").alias("_rows"), first_row)
    heads = heads.groupBy("facility_id").agg(
        F.sum("_rows").alias("source_record_count"), F.min_by("match_method", order).alias("match_method"),
        F.array_sort(F.collect_set(F.when(F.col("facility_type") != UNCLASSIFIED, F.col("facility_type")))).alias("_kinds"))
    frame = heads.join(merged, "facility_id", "left")
    several = F.size("_kinds") > 1
    conflicts = F.coalesce(F.col("_conflicts"), F.array())
    conflicts = F.when(several, F.concat(conflicts, F.array(F.struct(F.lit("facility_type").alias("field"), F.col("_kinds").alias("distinct"))))
                       ).otherwise(conflicts)
    bed_conflict = F.exists(F.coalesce(F.col("_conflicts"), F.array()), lambda x: x["field"] == "bed_count")
    frame = frame.withColumns({
        "facility_type": F.when(F.size("_kinds") == 1, F.col("_kinds")[0]).otherwise(F.lit(UNCLASSIFIED)),
        "field_conflicts": F.when(F.size(conflicts) > 0, F.map_from_entries(conflicts)),
        "bed_count": F.when(~bed_conflict, F.col("bed_count")).try_cast("double"),
        "hospital_overall_rating": F.col("hospital_overall_rating").try_cast("double"),
        "emergency_services": F.lower("emergency_services").try_cast("boolean"),
        "operating_status": F.lit("not_adjudicated")}).drop("_kinds", "_conflicts")
    office = F.col("facility_type").isin("hospice", "home_health", UNCLASSIFIED)
    frame = frame.withColumn("care_site_role", F.when(office, F.lit("office_or_service_site_unresolved")).otherwise(F.lit("reported_care_site")))
    return with_shared_ccn(settle(frame))  # read several times below


def with_shared_ccn(facilities: DataFrame) -> DataFrame:
    """Flag certification numbers used at several addresses."""
    used = facilities.where(F.col("ccn").isNotNull()).groupBy("ccn").agg(F.count("*").alias("_uses"))
    flags = lookup_by_value(facilities.where(F.col("ccn").isNotNull()).select("facility_id", "ccn"), used, ["ccn"], "_uses").select(
        "facility_id", (F.col("_uses") > 1).alias("ccn_multiple_locations"))
    return facilities.join(flags, "facility_id", "left").withColumn(
        "ccn_multiple_locations", F.coalesce("ccn_multiple_locations", F.lit(False)))


def record_links(records: DataFrame) -> DataFrame:
    """Which source row went into which facility."""
    return records.select("facility_id", "source_table", "source_row", "match_method")


# --- cached geocoder answers -----------------------------------------------------------------

def _json_text(value: Column) -> Column:
    listed = F.to_json(F.array(value))
    return listed.substr(F.lit(2), F.length(listed) - 2)


def cache_key(street: Column, city: Column, state: Column, postal: Column, benchmark: str = BENCHMARK) -> Column:
    """sha256 of the JSON list [benchmark, [street, city, state, zip]] with ", " separators."""
    parts = F.concat_ws(", ", *[_json_text(text(c)) for c in (street, city, state, postal)])
    return F.sha2(F.concat(F.lit(f'["{benchmark}", ['), parts, F.lit("]]")), 256)


def with_cache_key(facilities: DataFrame) -> DataFrame:
    """Hospitals get the key of their address."""
    key = cache_key(F.col("street"), F.col("city"), F.col("state"), F.col("zip"))
    return facilities.withColumn("geocode_cache_key", F.when(F.col("facility_type") == "hospital", key))


def invalid_answers(cache: DataFrame) -> DataFrame:
    """Matched answers with missing or impossible coordinates."""
    inside = F.col("longitude").between(-180, 180) & F.col("latitude").between(-90, 90)
    return cache.where((F.col("status") == "Match") & ~F.coalesce(inside, F.lit(False)))


def pending_addresses(facilities: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct addresses to look up: not cached, with a street, not a PO box."""
    wanted = facilities.where(F.col("geocode_cache_key").isNotNull() & (text("street") != "") & ~F.col("street").rlike(ANY_PO_BOX_PATTERN))
    return wanted.join(cache.select(F.col("key").alias("geocode_cache_key")), "geocode_cache_key", "left_anti").groupBy("geocode_cache_key").agg(
        *[F.first(c).alias(c) for c in ("street", "city", "state", "zip")])


def reply_problems(requested: DataFrame, returned: DataFrame, key: str = "geocode_cache_key") -> DataFrame:
    """Requested ids that did not come back exactly once, and ids nobody asked for."""
    back = returned.groupBy(key).agg(F.count("*").alias("returned"))
    both = requested.select(key).distinct().withColumn("asked", F.lit(True)).join(back, key, "full")
    return both.withColumn("problem", F.when(F.col("asked").isNull(), F.lit("not requested")).when(
        F.col("returned").isNull(), F.lit("omitted")).when(F.col("returned") > 1, F.lit("duplicate"))
    ).where(F.col("problem").isNotNull()).select(key, "problem")


def apply_answers(facilities: DataFrame, cache: DataFrame) -> DataFrame:
    """Status, method and coordinates from the cache."""
    answers = cache.select(F.col("key").alias("geocode_cache_key"), F.col("status").alias("geocode_status"), "longitude", "latitude", "geocode_fetched_utc")
    joined = facilities.join(answers, "geocode_cache_key", "left")
    return joined.withColumns({
        "geocode_method": F.when(F.col("geocode_status") == "Match", F.lit("census_street_interpolation")),
        "geocode_status": F.coalesce("geocode_status", F.lit("not_geocoded"))})


def area_counts(areas: DataFrame, facilities: DataFrame, key: str) -> DataFrame:
    """Facilities, hospitals, hospitals without beds (0 when none) and known beds (null when none) per area."""
    hospital = F.col("facility_type") == "hospital"
    counted = facilities.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("located_registry_facility_count"), F.count_if(hospital).alias("located_registry_hospital_count"),
        F.count_if(hospital & F.col("bed_count").isNull()).alias("located_hospitals_missing_beds"),
        F.sum(F.when(hospital, F.col("bed_count"))).alias("located_hospital_known_beds_sum"))
    zero = ("located_registry_facility_count", "located_registry_hospital_count", "located_hospitals_missing_beds")
    return areas.join(counted, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})
