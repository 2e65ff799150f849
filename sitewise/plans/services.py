"""Travel metrics, service-line scores, final ranking."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import road
from ..functions.exprs import clip01, col_or_default, numeric, saturate, share
from ..operators import ranking
from ..operators.checks import require_columns
from ..session import parallel_tasks, settle

BANDS = (15, 30, 45, 60)

# Service lines with minimum beds, recommendation threshold and description.
SERVICES = [
    ("emergency", "Emergency Department", 0, 0.48, "Emergency access proxy emphasizing isolation, new access, and local need."),
    ("icu", "Intensive Care Unit", 25, 0.55, "ICU proxy emphasizing population, elderly demand, capacity gap, and access."),
    ("general_surgery", "General Surgery", 25, 0.52, "Surgical-service proxy emphasizing market size, access, and bed-capacity gap."),
    ("maternity", "Maternity / Labor & Delivery", 50, 0.56, "Maternity proxy using local youth share, market size, insurance vulnerability, and access."),
    ("cardiology", "Cardiology", 100, 0.58, "Cardiology proxy emphasizing elderly demand, regional market size, and capacity gap."),
    ("stroke", "Stroke Capability", 50, 0.56, "Stroke-service proxy emphasizing elderly demand, isolation, access improvement, and population."),
    ("behavioral_health", "Behavioral Health", 25, 0.52, "Behavioral-health proxy using socioeconomic vulnerability, population, and access."),
    ("pediatrics", "Pediatrics", 25, 0.53, "Pediatric proxy using local under-18 share, population, vulnerability, and access."),
    ("advanced_imaging", "Advanced Imaging", 25, 0.50, "Imaging proxy emphasizing population, capacity gap, access, and hospital scale."),
    ("oncology", "Oncology", 100, 0.61, "Oncology proxy emphasizing regional population, older population, and hospital scale."),
    ("dialysis", "Dialysis", 25, 0.55, "Dialysis proxy emphasizing older/vulnerable population, isolation, and capacity gap."),
]
SERVICE_IDS = [s[0] for s in SERVICES]

# Weight of each input in each service score.
SERVICE_WEIGHTS = {
    "emergency": {"isolation": 0.30, "drive": 0.25, "pop30": 0.20, "vulnerability": 0.15, "capacity": 0.10},
    "icu": {"pop45": 0.25, "elderly_share": 0.25, "capacity": 0.20, "drive": 0.15, "beds": 0.15},
    "general_surgery": {"pop30": 0.30, "capacity": 0.25, "access": 0.20, "drive": 0.15, "beds": 0.10},
    "maternity": {"under18_share": 0.35, "pop30": 0.25, "uninsured_share": 0.15, "drive": 0.15, "access": 0.10},
    "cardiology": {"elderly_share": 0.30, "pop45": 0.25, "capacity": 0.20, "beds": 0.15, "drive": 0.10},
    "stroke": {"elderly_share": 0.30, "isolation": 0.25, "drive": 0.20, "pop30": 0.15, "capacity": 0.10},
    "behavioral_health": {"poverty_share": 0.20, "uninsured_share": 0.20, "vulnerability": 0.20, "pop30": 0.20, "drive": 0.20},
    "pediatrics": {"under18_share": 0.40, "pop30": 0.25, "vulnerability": 0.15, "drive": 0.10, "access": 0.10},
    "advanced_imaging": {"pop30": 0.30, "capacity": 0.20, "access": 0.20, "beds": 0.15, "drive": 0.15},
    "oncology": {"pop45": 0.30, "elderly_share": 0.25, "beds": 0.20, "capacity": 0.15, "access": 0.10},
    "dialysis": {"elderly_share": 0.25, "poverty_share": 0.15, "disabled_share": 0.15, "drive": 0.20, "capacity": 0.15, "pop30": 0.10},
}

# Which design column says that a service comes with the design.
INCLUDED_BY = {"emergency": "has_emergency", "icu": "proposed_icu_beds > 0", "general_surgery": "has_surgery",
               "maternity": "has_maternity", "cardiology": "has_cardiology"}


@dataclass(frozen=True)
class FinalConfig:
    weight_scenario: float = 0.55
    weight_drive: float = 0.25
    weight_service: float = 0.20
    threshold_shift: float = 0.0
    max_services: int = 8
    max_sites: int = 0
    roads: road.RoadModel = field(default_factory=road.RoadModel)


REQUIRED = ["site_id", "latitude", "longitude", "source_tract_geoid", "overall_score", "proposed_beds",
            "population_within_30min", "newly_accessible_population_30min", "nearest_existing_hospital_minutes"]


def one_row_per_site(sites: DataFrame) -> DataFrame:
    """Keep the best scenario where a site appears more than once."""
    require_columns(sites, REQUIRED)
    tie = "configuration_ordinal" if "configuration_ordinal" in sites.columns else "candidate_id"
    return ranking.top_of_each(sites, ["site_id"], [F.col("overall_score").desc_nulls_last(), F.col(tie)], 1)


def attach_demographics(sites: DataFrame, areas: DataFrame, area_key: str = "tract_geoid") -> DataFrame:
    """Source-area percentages under a source_ prefix, rural columns as they are."""
    shares = ["population_under_18_pct", "population_age_65_plus_pct", "poverty_pct", "uninsured_pct", "disability_pct"]
    rural = [c for c in areas.columns if ("ruca" in c.lower() or "rural" in c.lower()) and c not in sites.columns]
    picked = areas.select(F.col(area_key).alias("source_tract_geoid"),
                          *[F.col(c).alias(f"source_{c}") for c in shares if c in areas.columns], *rural)
    return sites.join(picked.dropDuplicates(["source_tract_geoid"]), "source_tract_geoid", "left")


def first_sites(sites: DataFrame, cfg: FinalConfig) -> DataFrame:
    return sites.orderBy(F.col("overall_score").desc(), "site_id").limit(cfg.max_sites) if cfg.max_sites > 0 else sites


def travel_metrics(sites: DataFrame, rural: Column, cfg: FinalConfig = FinalConfig()) -> DataFrame:
    """Reach in miles per time band and the drive-access score. Pass a settled frame."""
    framed = sites.withColumns({
        "stage8_rurality_proxy": rural, "stage8_detour_factor": road.detour_factor(rural, cfg.roads),
        "stage8_effective_speed_mph": road.effective_mph(rural, cfg.roads, floored=False),
    })
    minutes = numeric(framed, "nearest_existing_hospital_minutes")
    framed = framed.withColumns({
        "nearest_existing_hospital_estimated_drive_miles": minutes * F.col("stage8_effective_speed_mph") / 60.0,
        **{f"modeled_drive_miles_{t}min": F.col("stage8_effective_speed_mph") * F.lit(t / 60.0) for t in BANDS},
    }).withColumns({
        "nearest_existing_hospital_estimated_straightline_miles": F.expr(
            "CASE WHEN stage8_detour_factor <> 0 THEN nearest_existing_hospital_estimated_drive_miles / stage8_detour_factor END"),
        **{f"modeled_straightline_radius_miles_{t}min": F.col(f"modeled_drive_miles_{t}min") / F.col("stage8_detour_factor") for t in BANDS},
        "stage8_isolation_score": saturate(minutes, 25.0),
        "stage8_mean_time_saved_score": saturate(numeric(framed, "population_weighted_mean_minutes_saved"), 12.0),
    })
    scored = ranking.add_percentiles(framed, "site_id", {
        "stage8_population_saved_20min_score": numeric(sites, "population_saving_20plus_minutes", 0),
        "stage8_new_access_30min_score": numeric(sites, "newly_accessible_population_30min", 0)}, policy="zero")
    return scored.withColumn("drive_access_score", clip01(F.expr(
        "0.30D * stage8_isolation_score + 0.25D * stage8_mean_time_saved_score "
        "+ 0.20D * stage8_population_saved_20min_score + 0.25D * stage8_new_access_30min_score"))).withColumns({
            "travel_time_model": col_or_default(sites, "travel_time_model", F.lit("unknown_stage6_model")),
            "routing_refined": col_or_default(sites, "routing_refined", F.lit(False))})


def travel_bands(sites: DataFrame) -> DataFrame:
    """One row per site and time band."""
    def band(t: int) -> Column:
        return F.struct(
            F.lit(t).alias("minutes"),
            *[numeric(sites, f"{source}_{t}min").alias(source) for source in ("modeled_drive_miles", "modeled_straightline_radius_miles")],
            *[numeric(sites, source.format(t), 0).alias(name) for source, name in (
                ("population_within_{}min", "population"), ("newly_accessible_population_{}min", "newly_accessible_population"),
                ("existing_hospitals_{}min", "existing_hospitals"), ("existing_beds_{}min", "existing_beds"))])

    ids = ["site_id", col_or_default(sites, "candidate_id", F.col("site_id").cast("string")).alias("candidate_id"), "latitude", "longitude",
           "travel_time_model", "routing_refined"]
    return sites.select(*ids, F.explode(F.array(*[band(t) for t in BANDS])).alias("band")).select(
        *[c if isinstance(c, str) else "candidate_id" for c in ids], "band.*")


def service_inputs(sites: DataFrame) -> dict[str, Column]:
    """The thirteen 0..1 inputs of the service scores."""
    pop30 = numeric(sites, "population_within_30min", 0)

    def score(name: str, fallback: str) -> Column:
        return clip01(F.coalesce(numeric(sites, name), numeric(sites, fallback, 0)) if name in sites.columns else numeric(sites, fallback, 0))

    return {
        "pop30": saturate(pop30, 50_000), "pop45": saturate(numeric(sites, "population_within_45min", 0), 100_000),
        **{f"{g}_share": share(numeric(sites, f"{g}_population_30min", 0), pop30) for g in ("elderly", "poverty", "uninsured", "disabled")},
        "under18_share": clip01(numeric(sites, "source_population_under_18_pct", 0) / 100.0),
        "access": score("access_score", "stage6_access_score"), "capacity": score("capacity_score", "capacity_gap_score"),
        "vulnerability": score("vulnerability_score", "vulnerability_catchment_score"),
        "drive": clip01(numeric(sites, "drive_access_score", 0)), "isolation": clip01(numeric(sites, "stage8_isolation_score", 0)),
        "beds": saturate(numeric(sites, "proposed_beds", 0), 100.0),
    }


def _included(sites: DataFrame, service: str) -> Column:
    rule = INCLUDED_BY.get(service)
    if rule is None or rule.split()[0] not in sites.columns:
        return F.lit(False)
    return F.coalesce(F.expr(rule), F.lit(False))


def service_recommendations(sites: DataFrame, cfg: FinalConfig = FinalConfig()) -> DataFrame:
    """Sites with an array of eleven service structs, ranked and capped within the site.

    The cap ranks every service of the site by score (ties in service order), then keeps the
    recommended ones among the first ``max_services``. Eleven elements per row, so the rank is
    a sort of an array and nothing is shuffled.
    """
    # Eleven scores and a sort per row: more work than bytes, so the task count is set here.
    sites = sites.repartition(parallel_tasks(sites.sparkSession), "site_id")
    inputs = {f"_in_{name}": value for name, value in service_inputs(sites).items()}
    framed = sites.withColumns(inputs)
    entries = []
    for ordinal, (sid, name, min_beds, threshold, description) in enumerate(SERVICES):
        limit = min(1.0, max(0.0, threshold + cfg.threshold_shift))
        score = "least(greatest(" + " + ".join(f"{w}D * _in_{x}" for x, w in SERVICE_WEIGHTS[sid].items()) + ", 0D), 1D)"
        entries.append(F.struct(
            (-F.expr(score)).alias("order"), F.lit(ordinal).alias("ordinal"), F.lit(sid).alias("service_id"), F.lit(name).alias("service_name"),
            F.expr(score).alias("service_score"), F.lit(limit).alias("recommendation_threshold"), F.lit(min_beds).alias("minimum_beds"),
            (numeric(sites, "proposed_beds", 0) >= min_beds).alias("size_eligible"), _included(sites, sid).alias("archetype_includes"),
            F.lit(description).alias("description")))
    final = (
        "transform(_sorted, (s, i) -> named_struct('service_id', s.service_id, 'service_name', s.service_name, 'ordinal', s.ordinal, "
        "'service_score', s.service_score, 'recommendation_threshold', s.recommendation_threshold, 'minimum_beds', s.minimum_beds, "
        "'size_eligible', s.size_eligible, "
        f"'recommended', s.service_score >= s.recommendation_threshold AND s.size_eligible AND i < {cfg.max_services}, "
        "'archetype_includes', s.archetype_includes, "
        f"'service_gap', s.service_score >= s.recommendation_threshold AND s.size_eligible AND i < {cfg.max_services} AND NOT s.archetype_includes, "
        "'description', s.description, 'service_rank_within_site', i + 1))")
    return (framed.withColumn("_sorted", F.array_sort(F.array(*entries)))
            .withColumn("services", F.expr(final)).drop("_sorted", *inputs))


def services_long(recommended: DataFrame) -> DataFrame:
    """One row per site and service."""
    keys = ["site_id", *[c for c in ("candidate_id", "configuration_id") if c in recommended.columns]]
    return recommended.select(*keys, F.explode("services").alias("service")).select(*keys, "service.*").drop("ordinal")


def services_wide(recommended: DataFrame) -> DataFrame:
    """Score, recommended, included and gap columns per service, counts, name list and service fit."""
    wide = {}
    # Back in service order, so that a service is found by position.
    ordered = "array_sort(transform(services, s -> named_struct('o', s.ordinal, 's', s)))"
    recommended = recommended.withColumn("_ordered", F.expr(ordered))
    for position, sid in enumerate(SERVICE_IDS):
        one = f"_ordered[{position}].s"
        for field_, name in (("service_score", "score"), ("recommended", "recommended"),
                             ("archetype_includes", "archetype_includes"), ("service_gap", "gap")):
            wide[f"service_{sid}_{name}"] = F.expr(f"{one}.{field_}")
    return recommended.withColumns(wide).withColumns({
        "recommended_service_count": F.expr("size(filter(services, s -> s.recommended))"),
        "service_gap_count": F.expr("size(filter(services, s -> s.service_gap))"),
        "service_fit_score": F.expr(
            "aggregate(slice(transform(services, s -> s.service_score), 1, 3), 0D, (a, x) -> a + x) / 3"),
        "recommended_services": F.expr(
            "array_join(transform(filter(_ordered, o -> o.s.recommended), o -> o.s.service_name), ', ')"),
    }).drop("_ordered")


def final_scores(wide: DataFrame, cfg: FinalConfig = FinalConfig()) -> DataFrame:
    """Final score, national and state rank, display priority, routing-priority flag. Pass a settled frame."""
    scored = wide.withColumn("stage8_score", clip01(
        clip01(numeric(wide, "overall_score", 0)) * cfg.weight_scenario
        + clip01(numeric(wide, "drive_access_score", 0)) * cfg.weight_drive
        + clip01(numeric(wide, "service_fit_score", 0)) * cfg.weight_service))
    # Ranks need a few columns only; the wide rows are joined once at the end.
    keys = scored.select("site_id", "state_fips", "stage8_score", "service_fit_score", numeric(wide, "newly_accessible_population_30min", 0).alias("_new_people"))
    full = wide
    scored = settle(ranking.add_percentiles(keys, "site_id", {"_new": F.col("_new_people")}, policy="zero"))
    order = [("stage8_score", True), ("site_id", False)]
    scored = (scored.join(ranking.ordered_rank(scored, "site_id", order, "stage8_rank"), "site_id")
              .join(ranking.ordered_rank(scored, "site_id", order, "stage8_state_rank", ["state_fips"]), "site_id"))
    cut = ranking.quantiles(scored, "stage8_score", [0.98]).select(F.col("q0").alias("_cut"))  # one row
    final = scored.crossJoin(F.broadcast(cut)).withColumns({
        "frontend_priority_score": clip01(F.expr("0.65D * stage8_score + 0.20D * _new + 0.15D * coalesce(service_fit_score, 0D)")),
        "precise_routing_priority": (F.col("stage8_score") >= F.col("_cut")) | (F.col("stage8_state_rank") <= 3),
    }).drop("_new", "_new_people", "_cut", "state_fips", "service_fit_score")
    return full.join(final, "site_id")


def service_definitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, *s) for i, s in enumerate(SERVICES)],
        "ordinal int, service_id string, service_name string, minimum_beds int, recommendation_threshold double, description string")


def run_summary(final: DataFrame) -> DataFrame:
    """One row: sites, priority sites, refined sites, mean services, best score."""
    return final.agg(
        F.count("*").alias("sites"), F.count_if("precise_routing_priority").alias("precise_routing_priority_sites"),
        F.count_if(F.coalesce("routing_refined", F.lit(False))).alias("routing_refined_sites"),
        F.avg("recommended_service_count").alias("mean_recommended_services"), F.max("stage8_score").alias("top_stage8_score"))
