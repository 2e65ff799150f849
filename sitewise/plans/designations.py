"""Shortage designations: loading, area coverage, facility membership."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.exprs import strip
from ..operators import spatial
from ..operators.checks import require_none, require_rows
from ..operators.polygons import overlay, points_in_polygons, ring_problems, with_shape
from ..session import settle

# Designation types and the kind they belong to; the form of an identifier.
KINDS = {
    "medically underserved area": "mua", "medically underserved population": "mup",
    "medically underserved area-governor's exception": "mua", "medically underserved population-governor's exception": "mup"}
ID_PATTERN = r"^([0-9]{5}|[0-9]{10})$"
# Links that a task makes, and the most tasks for them.
TASK_LINKS, MOST_TASKS = 20_000_000, 2_000


def load_designations(components: DataFrame) -> DataFrame:
    """Active components, one row each: designation_id, designation_kind, imu_score, component, rings.

    A designation is the union of its components, which may overlap or lie within one another: operators test and
    measure each component and join what belongs to one id. Equal components of an id are one.
    components: designation_id, designation_status, designation_type, imu_score, rings.
    Unknown ids, unknown active types and components that disagree are errors.
    """
    rows = components.withColumn("designation_id", strip("designation_id"))
    require_none(rows.where(~F.coalesce(F.col("designation_id").rlike(ID_PATTERN), F.lit(False))).select("designation_id"), "Unexpected designation ids")
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    active = rows.where(F.lower(strip("designation_status")) == "designated").withColumn(
        "designation_kind", kinds[F.lower(strip("designation_type"))])
    require_rows(active, 1, "active designation components")
    require_none(active.where(F.col("designation_kind").isNull()).select("designation_type"), "Unknown designation type")
    require_none(ring_problems(active, "designation_id", "rings"), "Invalid designation rings")
    merged = active.groupBy("designation_id").agg(
        F.min("designation_kind").alias("designation_kind"), F.max("designation_kind").alias("_kind"),
        F.min("imu_score").alias("imu_score"), F.max("imu_score").alias("_score"), F.count("imu_score").alias("_scores"), F.count("*").alias("_rows"))
    disagree = (F.col("designation_kind") != F.col("_kind")) | (F.col("imu_score") != F.col("_score")) | (
        (F.col("_scores") > 0) & (F.col("_scores") < F.col("_rows")))
    require_none(merged.where(disagree).select("designation_id"), "Components disagree on kind or score")
    shapes = active.select("designation_id", F.xxhash64("rings").alias("component"), "rings").groupBy("designation_id", "component").agg(
        F.first("rings").alias("rings"))
    return shapes.join(merged.select("designation_id", "designation_kind", "imu_score"), "designation_id")


def dissolved_count(components: DataFrame) -> DataFrame:
    """designation_id, designation_kind, imu_score, components: one row per designation."""
    return components.groupBy("designation_id", "designation_kind", "imu_score").agg(F.count("*").alias("components"))


def without_record(designations: DataFrame, records: DataFrame) -> DataFrame:
    """Ids with a boundary but no row in the table of records."""
    return designations.select("designation_id").distinct().join(records.select("designation_id"), "designation_id", "left_anti")


def area_coverage(areas: DataFrame, designations: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """Areas with designation count and covered fraction per kind; 0 where nothing overlaps."""
    _, coverage = overlay(areas, designations, key, rings)
    wide = coverage.groupBy(key).agg(*[
        F.max(F.when(F.col("designation_kind") == k, F.col(c))).alias(f"{k}_{c}")
        for k in ("mua", "mup") for c in ("designation_count", "boundary_area_fraction")])
    return areas.join(wide, key, "left").withColumns({
        **{f"{k}_designation_count": F.coalesce(f"{k}_designation_count", F.lit(0)) for k in ("mua", "mup")},
        **{f"{k}_boundary_area_fraction": F.coalesce(f"{k}_boundary_area_fraction", F.lit(0.0)) for k in ("mua", "mup")},
        "muap_spatial_evaluated": F.lit(True)})


def _places_in_shapes(facilities: DataFrame, designations: DataFrame, carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(latitude, longitude, _form) of places inside shapes, and designations with the _form of their shape.

    Facilities at one spot, and equal shapes, are tested once."""
    shapes = with_shape(designations).select("_shape", "designation_id", "designation_kind", *carry, "rings")
    forms = settle(shapes.groupBy("rings").agg(F.concat_ws("/", F.min("_shape"), F.xxhash64("rings")).alias("_form")))
    members = shapes.join(forms, "rings").select("designation_id", "designation_kind", *carry, "_form").distinct()
    places = facilities.where("latitude IS NOT NULL AND longitude IS NOT NULL").select("latitude", "longitude").distinct().withColumn(
        "_place", F.struct("latitude", "longitude"))
    return points_in_polygons(places, forms, "_place", "_form").select("_place.latitude", "_place.longitude", "_form"), members


def facility_links(facilities: DataFrame, designations: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Distinct facility_id, designation_id, designation_kind of facilities (one place each) inside designations.

    ``carry`` names further columns of a designation, which are returned too. Designations of the same shapes are a family:
    a place lies in all of them or in none. Links are few between places and families; they become as many as facilities
    and designations make them in the last join only, after which no row moves.
    """
    hits, members = _places_in_shapes(facilities, designations, carry)
    own, place = ["designation_id", "designation_kind", *carry], ["latitude", "longitude"]
    units = members.groupBy(*own).agg(F.array_sort(F.collect_set("_form")).alias("_forms"))
    families = settle(units.groupBy("_forms").agg(F.count("*").alias("_units")).withColumn("_family", F.monotonically_increasing_id()))
    units = settle(units.join(families.select("_forms", "_family"), "_forms").select(*own, "_family"))
    sites = facilities.select("facility_id", *place).where("latitude IS NOT NULL AND longitude IS NOT NULL").distinct()
    inside = settle(hits.join(families.select("_family", "_units", F.explode("_forms").alias("_form")), "_form")
                    .select(*place, "_family", "_units").distinct().join(sites.groupBy(*place).agg(F.count("*").alias("_sites")), place))
    by_site, by_unit, links = inside.agg(F.sum("_sites"), F.sum("_units"), F.sum(F.col("_sites") * F.col("_units"))).first()
    # what gives fewer rows is joined first: the other join makes the links
    if (by_site or 0) <= (by_unit or 0):
        key, left, right = ["_family"], sites.join(inside.select(*place, "_family"), place).select("facility_id", "_family"), units
        counts = inside.groupBy(*key).agg(F.sum("_sites").alias("l"), F.first("_units").alias("r"))
    else:
        key, left, right = place, inside.select(*place, "_family").join(units, "_family").select(*place, *own), sites
        counts = inside.groupBy(*key).agg(F.sum("_units").alias("l"), F.first("_sites").alias("r"))
    return spatial._cell_join(left, right, spatial.CROWDED_ROWS, key, counts=counts, tasks=min(MOST_TASKS, (links or 0) // TASK_LINKS)).select("facility_id", *own)


def membership(facilities: DataFrame, designations: DataFrame) -> DataFrame:
    """``with_membership`` of all links, without listing them: the kinds of the shapes around each place suffice."""
    hits, members = _places_in_shapes(facilities, designations)
    flags = hits.join(members.select("_form", "designation_kind").distinct(), "_form").groupBy("latitude", "longitude").agg(*[
        F.max(F.col("designation_kind") == k).alias(f"_{k}") for k in ("mua", "mup")])
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return facilities.join(flags, ["latitude", "longitude"], "left").withColumns({
        f"inside_{k}_boundary": F.when(located, F.coalesce(f"_{k}", F.lit(False))) for k in ("mua", "mup")}).drop("_mua", "_mup")


def with_membership(facilities: DataFrame, links: DataFrame) -> DataFrame:
    """inside_mua_boundary, inside_mup_boundary: null for facilities without coordinates."""
    flags = links.groupBy("facility_id").agg(*[
        F.max(F.col("designation_kind") == k).alias(f"_{k}") for k in ("mua", "mup")])
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return facilities.join(flags, "facility_id", "left").withColumns({
        f"inside_{k}_boundary": F.when(located, F.coalesce(f"_{k}", F.lit(False))) for k in ("mua", "mup")}).drop("_mua", "_mup")


def reference_problems(tracts: DataFrame, counties: DataFrame) -> DataFrame:
    """check, violations for the reference polygons: key form, uniqueness, foreign key, ring validity."""
    from ..operators.checks import duplicate_keys, malformed_keys, orphans

    rules = {
        "malformed_tract": malformed_keys(tracts, "tract_geoid", 11), "malformed_county": malformed_keys(counties, "county_geoid", 5),
        "duplicate_tract": duplicate_keys(tracts, ["tract_geoid"]), "duplicate_county": duplicate_keys(counties, ["county_geoid"]),
        "tract_without_county": orphans(tracts, counties, "county_geoid", "county_geoid"),
        "invalid_rings": ring_problems(tracts, "tract_geoid", "rings")}
    report = None
    for name, bad in rules.items():
        row = bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        report = row if report is None else report.unionByName(row)
    return report
