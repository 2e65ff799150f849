"""Permissive first screen: gate, coarse catchments, composite score, per-state shortlist."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions import road
from ..functions.exprs import clip01
from ..operators import ranking
from ..operators.reach import reach_totals
from ..session import settle


@dataclass(frozen=True)
class ScreenConfig:
    min_population: float = 1000
    min_screening_score: float = 0.45
    min_nearest_miles: float = 10.0
    catchment_minutes: tuple[int, ...] = (30, 45, 60)
    top_n_per_state: int = 150
    top_fraction_per_state: float = 0.08
    severe_minutes: float = 35.0
    severe_min_population: int = 1500
    max_miles: float = 70.0
    roads: road.RoadModel = field(default_factory=lambda: road.SCREENING_ROADS)


SUBGROUPS = ("poverty", "uninsured", "elderly", "disabled")


def with_estimated_minutes(areas: DataFrame, rural: str, cfg: ScreenConfig = ScreenConfig()) -> DataFrame:
    """Road parameters and estimated minutes to the nearest facility of every area."""
    return areas.withColumns({
        "detour": road.detour_factor(rural, cfg.roads), "mph": road.effective_mph(rural, cfg.roads, floored=False),
    }).withColumn("existing_minutes", F.expr("CASE WHEN mph > 0 THEN nearest_miles * detour / mph * 60D END"))


def broad_gate(areas: DataFrame, cfg: ScreenConfig = ScreenConfig()) -> DataFrame:
    """Populated areas with need or distance, or areas with severe minutes."""
    severe_floor = max(500, cfg.severe_min_population // 2)
    return areas.where(
        ((F.col("population") >= cfg.min_population)
         & ((F.col("screening_need_score") >= cfg.min_screening_score) | (F.col("nearest_miles") >= cfg.min_nearest_miles)))
        | ((F.col("existing_minutes") >= cfg.severe_minutes) & (F.col("population") >= severe_floor)))


def screening_catchment(gated: DataFrame, areas: DataFrame, key: str, cfg: ScreenConfig = ScreenConfig()) -> DataFrame:
    """Coarse catchment sums per gated area, each with its own search radius."""
    longest = max(cfg.catchment_minutes)
    reach = f"least({cfg.max_miles}D, {longest / 60!r}D * mph / greatest(detour, 0.01D))"
    widest = min(cfg.max_miles, longest / 60 * max(cfg.roads.urban_mph, cfg.roads.rural_mph)
                 / max(min(cfg.roads.urban_detour, cfg.roads.rural_detour), 0.01))
    targets = areas.where(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & (F.col("population") > 0)
    ).groupBy(F.col("latitude").alias("to_latitude"), F.col("longitude").alias("to_longitude"),
              F.col("detour").alias("to_detour"), F.col("mph").alias("to_mph"), F.col("existing_minutes").alias("base")
              ).agg(*[F.sum(c).alias(f"w_{c}") for c in ("population", *SUBGROUPS)])
    saving = {"approx_weighted_drive_minutes_saved": ("w_population", None),
              "approx_population_saving_10plus_minutes": ("w_population", 10), "approx_population_saving_20plus_minutes": ("w_population", 20)}
    sums: dict[str, tuple[str, float | None]] = {}
    for t in cfg.catchment_minutes:
        sums[f"approx_population_{t}min"] = ("w_population", t)
        sums[f"approx_newly_accessible_population_{t}min"] = (f"w_new_{t}", t)
        sums |= {f"approx_{g}_population_{t}min": (f"w_{g}", t) for g in SUBGROUPS}
    targets = targets.selectExpr("*", *[f"CASE WHEN base > {t} THEN w_population END AS w_new_{t}" for t in cfg.catchment_minutes])
    totals = reach_totals(
        gated.select(key, "latitude", "longitude", "detour", "mph"), targets, key, sums, miles=widest, reach=reach,
        right_roads=("to_detour", "to_mph"), floor_mph=cfg.roads.floor_mph, base="base", saving=saving)
    totals = totals.withColumn("approx_weighted_drive_minutes_saved", F.col("approx_weighted_drive_minutes_saved").cast("double"))
    return gated.join(totals, key, "left").withColumns({name: F.expr(f"coalesce({name}, 0)") for name in [*saving, *sums]})


def screening_scores(screened: DataFrame, key: str, state: str = "state_fips", cfg: ScreenConfig = ScreenConfig()) -> DataFrame:
    """Composite score, rank and percentile within the state, shortlist flag. Pass a settled frame."""
    parts = ranking.percentile_scores(screened, key, {
        "approx_access_benefit_score": F.col("approx_weighted_drive_minutes_saved"),
        "approx_new_access_score": F.col("approx_newly_accessible_population_30min"),
        "approx_capacity_gap_score": F.col("nearby_known_beds_25mi") / F.greatest(F.col("population").cast("double"), F.lit(1.0)),
        "_poverty_score": F.col("approx_poverty_population_30min"),
        "_uninsured_score": F.col("approx_uninsured_population_30min"),
    }, inverted=["approx_capacity_gap_score"], policy="zero")
    scored = screened.join(parts, key).withColumn("approx_vulnerability_score", clip01(F.expr(
        "0.35D * demographic_need_score + 0.25D * least(greatest(shortage_area_coverage_fraction, 0D), 1D) "
        "+ 0.20D * _poverty_score + 0.20D * _uninsured_score"))).withColumn("stage6a_score", clip01(F.expr(
            "0.30D * approx_access_benefit_score + 0.20D * approx_new_access_score + 0.15D * approx_capacity_gap_score "
            "+ 0.15D * approx_vulnerability_score + 0.10D * screening_need_score + 0.10D * access_gap_score"))
    ).drop("_poverty_score", "_uninsured_score")
    scored = settle(scored)
    rank = ranking.ordered_rank(scored, key, [("stage6a_score", True), (key, False)], "state_rank", [state])
    local = ranking.percentile_scores(scored, key, {"state_percentile": F.col("stage6a_score")}, groups=[state])
    return scored.join(rank, key).join(local, key).withColumn(
        "severe_access_keep",
        (F.col("existing_minutes") >= cfg.severe_minutes) & (F.col("population") >= cfg.severe_min_population),
    ).withColumn("shortlisted", (F.col("state_rank") <= cfg.top_n_per_state)
                 | (F.col("state_percentile") >= 1.0 - cfg.top_fraction_per_state) | F.col("severe_access_keep"))


def shortlist_sites(areas: DataFrame, shortlist: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Areas on the shortlist with its score columns."""
    return areas.join(shortlist.select(key, *columns), key)
