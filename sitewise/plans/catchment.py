"""Who reaches what: baseline access, candidate catchments, national scores."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import road
from ..functions.exprs import boolish, clip, clip01, finite, numeric, row_mean
from ..functions.geo import arc_of
from ..operators import ranking, spatial
from ..operators.checks import require_rows
from ..operators.reach import reach_totals
from ..session import settle

# Fixed value: parameters of a site whose source area is unknown.
UNKNOWN_DETOUR, UNKNOWN_MPH = 1.25, 40.0


@dataclass(frozen=True)
class CatchmentConfig:
    demand_miles: float = 70.0
    hospital_miles: float = 110.0
    access_minutes: tuple[int, ...] = (15, 30, 45, 60)
    saving_minutes: tuple[int, ...] = (10, 20, 30)
    roads: road.RoadModel = field(default_factory=road.RoadModel)


SUBGROUPS = ("elderly", "poverty", "uninsured", "disabled")


def demand_points(areas: DataFrame, key: str, rural: Column, columns: dict[str, str],
                  at: tuple[str, str] = ("centroid_latitude", "centroid_longitude"),
                  roads: road.RoadModel = road.CATCHMENT_ROADS) -> DataFrame:
    """Populated, located areas with their road parameters. ``columns``: output -> input."""
    return areas.select(
        F.col(key).alias("demand_id"),
        F.lpad(F.col(key).cast("string"), 11, "0").substr(1, 2).alias("state_fips"),
        F.col(at[0]).cast("double").alias("latitude"), F.col(at[1]).cast("double").alias("longitude"),
        rural.alias("rurality_proxy"), road.detour_factor(rural, roads).alias("road_detour_factor"),
        road.effective_mph(rural, roads).alias("effective_speed_mph"),
        *[numeric(areas, source, 0).alias(name) for name, source in columns.items()],
    ).where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & (F.col("population") > 0))


def hospital_points(facilities: DataFrame) -> DataFrame:
    """Located hospitals; unknown beds count as 0, unreadable emergency flags as false."""
    return facilities.where(F.lower("facility_type") == "hospital").select(
        F.col("facility_id").cast("string").alias("facility_id"),
        F.col("latitude").try_cast("double").alias("latitude"), F.col("longitude").try_cast("double").alias("longitude"),
        F.greatest(F.coalesce(F.col("bed_count").try_cast("double"), F.lit(0.0)), F.lit(0.0)).alias("bed_count"),
        boolish("emergency_services").alias("emergency_services"),
    ).where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def _hospital_targets(hospitals: DataFrame) -> DataFrame:
    """One row per hospital location: hospitals and beds there."""
    return hospitals.groupBy(F.col("latitude").alias("to_latitude"), F.col("longitude").alias("to_longitude")).agg(
        F.count("*").alias("_hospitals"), F.sum("bed_count").alias("_beds"))


def existing_access(demand: DataFrame, hospitals: DataFrame, cfg: CatchmentConfig = CatchmentConfig()) -> DataFrame:
    """Per demand point: nearest (emergency) hospital, minutes, supply within each threshold.

    The demand point's own road parameters hold for all its hospitals, so nearest in miles is
    nearest in minutes.
    """
    require_rows(hospitals, 1, "located hospitals")
    at = hospitals.withColumnsRenamed({"latitude": "to_latitude", "longitude": "to_longitude"})
    closest = spatial.nearest(demand, at, "demand_id", "facility_id").select(
        "demand_id", F.col("facility_id").alias("nearest_hospital_id"), arc_of("chord").alias("nearest_miles"))
    emergency = spatial.nearest(demand, at.where("emergency_services"), "demand_id", "facility_id").select(
        "demand_id", F.col("facility_id").alias("nearest_emergency_hospital_id"), arc_of("chord").alias("emergency_miles"))
    longest = max(cfg.access_minutes)
    widest = min(cfg.hospital_miles, longest / 60 * max(cfg.roads.rural_mph, cfg.roads.urban_mph, cfg.roads.floor_mph)
                 / max(min(cfg.roads.urban_detour, cfg.roads.rural_detour), 0.01))
    reach = f"least({cfg.hospital_miles}D, {longest / 60!r}D * effective_speed_mph / greatest(road_detour_factor, 0.01D))"
    supply = reach_totals(
        demand, _hospital_targets(hospitals), "demand_id",
        {f"{name}_within_{t}min": (source, t) for t in cfg.access_minutes for name, source in (("hospitals", "_hospitals"), ("beds", "_beds"))},
        miles=widest, reach=reach, left_roads=("road_detour_factor", "effective_speed_mph"), floor_mph=cfg.roads.floor_mph)
    base = demand.select("demand_id", "road_detour_factor", "effective_speed_mph")

    def timed(miles: str) -> Column:
        return road.drive_minutes(miles, "road_detour_factor", "effective_speed_mph", cfg.roads.floor_mph)

    return (
        base.join(closest, "demand_id").join(emergency, "demand_id").join(supply, "demand_id", "left").select(
            "demand_id", "nearest_hospital_id",
            timed("nearest_miles").alias("nearest_hospital_drive_minutes"),
            (F.col("nearest_miles") * F.col("road_detour_factor")).alias("nearest_hospital_drive_miles"),
            "nearest_emergency_hospital_id", timed("emergency_miles").alias("nearest_emergency_drive_minutes"),
            *[F.expr(f"coalesce({n}_within_{t}min, 0) AS {n}_within_{t}min")
              for t in cfg.access_minutes for n in ("hospitals", "beds")],
            F.lit(False).alias("routing_refined"),
        )
    )


def with_source_roads(sites: DataFrame, areas: DataFrame, area_key: str, site_area: str = "source_tract_geoid") -> DataFrame:
    """Road parameters of each site's source area, or the defaults when it has none."""
    roads = areas.select(F.col(area_key).alias(site_area), F.col("road_detour_factor").alias("site_detour"),
                         F.col("effective_speed_mph").alias("site_mph"))
    return sites.join(roads, site_area, "left").withColumns({
        "site_detour": F.coalesce("site_detour", F.lit(UNKNOWN_DETOUR)),
        "site_mph": F.coalesce("site_mph", F.lit(UNKNOWN_MPH))})


def _site_points(sites: DataFrame) -> DataFrame:
    return sites.select("site_id", "latitude", "longitude", "site_detour", "site_mph")


def demand_catchment(sites: DataFrame, demand: DataFrame, baseline: DataFrame,
                     cfg: CatchmentConfig = CatchmentConfig()) -> DataFrame:
    """Per site with any demand in range: populations reached, newly reached and minutes saved."""
    base = demand.join(baseline.select("demand_id", F.col("nearest_hospital_drive_minutes").alias("base_minutes")), "demand_id")
    weights = {"population": "greatest(coalesce(population, 0D), 0D)"}
    weights |= {g: f"greatest(coalesce({g}, 0D), 0D)" for g in SUBGROUPS}
    weights["vulnerable"] = f"{weights['population']} * least(greatest(coalesce(demographic_need_score, 0D), 0D), 1D)"
    # Areas that share location, roads and baseline act as one.
    targets = base.groupBy(
        F.col("latitude").alias("to_latitude"), F.col("longitude").alias("to_longitude"),
        "road_detour_factor", "effective_speed_mph", "base_minutes",
    ).agg(F.count("*").alias("points"), *[F.expr(f"sum({w}) AS w_{name}") for name, w in weights.items()])
    sums: dict[str, tuple[str, float | None]] = {"modeled_demand_points": ("points", None)}
    for t in cfg.access_minutes:
        sums[f"population_within_{t}min"] = ("w_population", t)
        sums[f"newly_accessible_population_{t}min"] = (f"w_new_{t}", t)
        sums |= {f"{g}_population_{t}min": (f"w_{g}", t) for g in SUBGROUPS}
        sums[f"vulnerability_weighted_population_{t}min"] = ("w_vulnerable", t)
    targets = targets.selectExpr("*", *[f"CASE WHEN base_minutes > {t} THEN w_population END AS w_new_{t}" for t in cfg.access_minutes])
    # Minutes saved are decimals, which add up to the same sum in any order.
    saving = {"weighted_drive_minutes_saved": ("w_population", None), "population_with_any_access_improvement": ("w_population", 0)}
    saving |= {f"population_saving_{t}plus_minutes": ("w_population", t) for t in cfg.saving_minutes}
    reached = reach_totals(
        _site_points(sites), targets, "site_id", sums, miles=cfg.demand_miles, left_roads=("site_detour", "site_mph"),
        right_roads=("road_detour_factor", "effective_speed_mph"), floor_mph=cfg.roads.floor_mph, base="base_minutes", saving=saving)
    return reached.withColumn("weighted_drive_minutes_saved", F.round("weighted_drive_minutes_saved", 6).cast("double"))


def hospital_supply(sites: DataFrame, hospitals: DataFrame, cfg: CatchmentConfig = CatchmentConfig()) -> DataFrame:
    """Per site with any hospital in range: nearest minutes, hospitals and beds per threshold."""
    return reach_totals(
        _site_points(sites), _hospital_targets(hospitals), "site_id",
        {f"existing_{name}_{t}min": (source, t) for t in cfg.access_minutes for name, source in (("hospitals", "_hospitals"), ("beds", "_beds"))},
        miles=cfg.hospital_miles, left_roads=("site_detour", "site_mph"), floor_mph=cfg.roads.floor_mph,
        closest="nearest_existing_hospital_minutes")


def site_features(sites: DataFrame, demand: DataFrame, baseline: DataFrame, hospitals: DataFrame,
                  cfg: CatchmentConfig = CatchmentConfig()) -> DataFrame:
    """All sites with their catchment and supply; empty neighbourhoods give 0, no hospital gives null minutes."""
    reached = demand_catchment(sites, demand, baseline, cfg)
    supply = hospital_supply(sites, hospitals, cfg)
    zero = [c for c in reached.columns + supply.columns if c not in ("site_id", "nearest_existing_hospital_minutes")]
    return (
        sites.join(reached, "site_id", "left").join(supply, "site_id", "left")
        .withColumns({c: F.expr(f"coalesce({c}, 0)") for c in zero})
        .withColumns({
            "population_weighted_mean_minutes_saved": F.expr(
                "CASE WHEN population_with_any_access_improvement > 0 "
                "THEN weighted_drive_minutes_saved / population_with_any_access_improvement ELSE 0D END"),
            "population_per_existing_bed_30min": F.expr(
                "CASE WHEN existing_beds_30min > 0 THEN population_within_30min / existing_beds_30min END"),
            "no_existing_beds_30min": F.expr("existing_beds_30min <= 0 AND population_within_30min > 0"),
            "routing_refined": F.lit(False),
        })
    )


def national_scores(features: DataFrame) -> DataFrame:
    """Percentile components, their mean and the national rank. Pass a settled frame."""
    ceiling = ranking.quantiles(features, "population_per_existing_bed_30min", [0.995]).select(F.col("q0").alias("_ceiling"))
    # One row, attached to every site.
    framed = features.crossJoin(F.broadcast(ceiling)).withColumn(
        "_ceiling", F.coalesce("_ceiling", F.lit(1.0)))
    no_beds = F.when(F.col("_ceiling") > 0, F.col("_ceiling") * 1.25).otherwise(F.lit(1e9))
    pressure = F.when(F.col("no_existing_beds_30min"), no_beds).otherwise(F.col("population_per_existing_bed_30min"))
    framed = framed.withColumn("_pressure", pressure).drop("_ceiling").withColumn(
        "vulnerability_catchment_mean",
        F.expr("CASE WHEN population_within_30min > 0 THEN vulnerability_weighted_population_30min / population_within_30min END"))
    framed = settle(framed)
    scored = ranking.percentile_scores(framed, "site_id", {
        "access_improvement_score": F.col("weighted_drive_minutes_saved"),
        "new_access_score": F.col("newly_accessible_population_30min"),
        "capacity_gap_score": F.col("_pressure"),
        "vulnerability_catchment_score": F.col("vulnerability_catchment_mean"),
    }, policy="zero")
    scored = settle(scored.withColumn("stage6_access_score", row_mean(
        ["access_improvement_score", "new_access_score", "capacity_gap_score", "vulnerability_catchment_score"])))
    # Means of equal sums are ties, whatever the last bits of their addition.
    ranks = ranking.ordered_rank(scored.withColumn("_mean", F.round("stage6_access_score", 12)), "site_id", [("_mean", True), ("site_id", False)], "stage6_rank")
    return framed.drop("_pressure").join(scored, "site_id").join(ranks, "site_id")
