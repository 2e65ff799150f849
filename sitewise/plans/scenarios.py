"""Sites crossed with facility designs: fit, cost, scores, ranks."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.exprs import clip01, numeric
from ..operators import ranking, skyline
from ..operators.checks import duplicate_keys, require_columns, require_none
from ..session import parallel_tasks, settle

# The facility designs. Capital cost = fixed + beds * per bed (million USD).
DESIGN_COLUMNS = (
    "configuration_id string, configuration_name string, proposed_beds int, proposed_icu_beds int, proposed_ed_bays int, "
    "has_emergency boolean, has_surgery boolean, has_maternity boolean, has_cardiology boolean, "
    "min_catchment_population_45min int, fixed_cost_musd double, cost_per_bed_musd double, operating_cost_index double")
DESIGNS = [
    ("rural_25", "Rural / critical-access proxy", 25, 4, 8, True, True, False, False, 10_000, 55.0, 1.15, 0.45),
    ("community_50", "Small community hospital", 50, 6, 12, True, True, False, False, 20_000, 85.0, 1.05, 0.60),
    ("community_100", "Community hospital", 100, 12, 20, True, True, True, False, 45_000, 135.0, 0.95, 0.78),
    ("regional_200", "Regional hospital", 200, 24, 32, True, True, True, True, 90_000, 220.0, 0.90, 1.00),
    ("regional_300", "Large regional hospital", 300, 36, 44, True, True, True, True, 150_000, 310.0, 0.88, 1.20),
]


@dataclass(frozen=True)
class ScenarioConfig:
    beds_per_1000: float = 2.5
    weights: Mapping[str, float] = None
    minimum_fit: float = 0.05
    low_fit_factor: float = 0.25

    def score_weights(self) -> Mapping[str, float]:
        return self.weights or {
            "access_score": 0.30, "capacity_score": 0.25, "vulnerability_score": 0.15,
            "configuration_fit_score": 0.20, "cost_efficiency_score": 0.10}


REQUIRED = ["site_id", "source_tract_geoid", "latitude", "longitude", "population_within_30min", "population_within_45min",
            "newly_accessible_population_30min", "existing_beds_30min", "access_improvement_score", "capacity_gap_score",
            "vulnerability_catchment_score", "stage6_access_score"]

# What the scores are computed from. Scenarios are five times the sites, so only these columns are
# carried through them; ``with_site_columns`` brings the rest back where it is wanted.
INPUTS = ["site_id", "source_tract_geoid", "state_fips", "population_within_30min", "population_within_45min", "existing_beds_30min",
          "nearest_existing_hospital_minutes", "new_access_score", "capacity_gap_score", "access_improvement_score",
          "vulnerability_catchment_score", "weighted_drive_minutes_saved", "newly_accessible_population_30min"]
DESIGN_LABELS = ["configuration_name", "proposed_icu_beds", "proposed_ed_bays", "has_emergency", "has_surgery", "has_maternity",
                 "has_cardiology", "operating_cost_index"]

SKYLINE_COLUMNS = ["access_score", "capacity_score", "vulnerability_score", "configuration_fit_score", "cost_efficiency_score"]


def designs(spark: SparkSession) -> DataFrame:
    """The design table with its derived capital cost and ordinal."""
    frame = spark.createDataFrame([(i, *row) for i, row in enumerate(DESIGNS)], "configuration_ordinal int, " + DESIGN_COLUMNS)
    return frame.withColumn("estimated_capital_cost_musd",
                            F.col("fixed_cost_musd") + F.col("proposed_beds") * F.col("cost_per_bed_musd"))


def checked_sites(sites: DataFrame) -> DataFrame:
    require_columns(sites, REQUIRED)
    require_none(duplicate_keys(sites, ["site_id"]), "Duplicate site_id")
    return sites


def weighted_mean(df: DataFrame, weights: Mapping[str, float]) -> Column:
    """Weighted mean of scores clipped to 0..1; missing scores count as 0."""
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("Score weights must sum to a positive value")
    summed = F.lit(0.0)
    for name, weight in weights.items():
        summed = summed + clip01(numeric(df, name, 0)) * F.lit(float(weight))
    return clip01(summed / F.lit(float(total)))


def with_fit(sites: DataFrame, cfg: ScenarioConfig = ScenarioConfig(), null_isolation: str = "zero") -> DataFrame:
    """Every site with every design (five rows per site) and how well the design fits.

    A site with no hospital in range has null minutes. ``null_isolation="zero"`` treats that as
    not isolated, ``"max"`` as fully isolated.
    """
    # Five rows and some thirty expressions per site: far more work than bytes, so the task count is set here.
    sites = sites.select(*[c for c in INPUTS if c in sites.columns]).repartition(parallel_tasks(sites.sparkSession), "site_id")
    minutes = numeric(sites, "nearest_existing_hospital_minutes")
    isolation = F.coalesce(clip01(F.greatest(minutes, F.lit(0.0)) / 45.0) if null_isolation == "max" else
                           clip01(F.greatest(F.coalesce(minutes, F.lit(0.0)), F.lit(0.0)) / 45.0),
                           F.lit(1.0 if null_isolation == "max" else 0.0))
    base = sites.withColumns({
        "_pop30": F.greatest(numeric(sites, "population_within_30min", 0), F.lit(0.0)),
        "_pop45": F.greatest(numeric(sites, "population_within_45min", 0), F.lit(0.0)),
        "_beds30": F.greatest(numeric(sites, "existing_beds_30min", 0), F.lit(0.0)),
        "_isolation": isolation,
        "_fresh": clip01(numeric(sites, "new_access_score", 0)),
        "_gap": clip01(numeric(sites, "capacity_gap_score", 0)),
    }).withColumn("target_beds_30min", F.col("_pop30") * F.lit(cfg.beds_per_1000) / 1000.0).withColumn(
        "modeled_unmet_beds_30min", F.greatest(F.col("target_beds_30min") - F.col("_beds30"), F.lit(0.0)))
    crossed = base.crossJoin(F.broadcast(designs(sites.sparkSession).drop("fixed_cost_musd", "cost_per_bed_musd", *DESIGN_LABELS)))  # 5 rows
    return (
        crossed.withColumns({
            "modeled_remaining_bed_gap_30min": F.expr("greatest(0D, modeled_unmet_beds_30min - proposed_beds)"),
            "modeled_capacity_added_pct_of_gap": F.expr(
                "CASE WHEN modeled_unmet_beds_30min > 0 THEN least(1D, proposed_beds / modeled_unmet_beds_30min) ELSE 0D END"),
            "bed_gap_fit_score": F.expr(
                "CASE WHEN greatest(modeled_unmet_beds_30min, proposed_beds) > 0 "
                "THEN least(modeled_unmet_beds_30min, proposed_beds) / greatest(modeled_unmet_beds_30min, proposed_beds) ELSE 0D END"),
            "market_support_score": F.expr(
                "CASE WHEN min_catchment_population_45min <= 0 THEN 1D ELSE least(1D, _pop45 / min_catchment_population_45min) END"),
            "access_alignment_score": F.expr(
                "CASE WHEN proposed_beds <= 50 THEN 0.65D * _isolation + 0.35D * _fresh ELSE 0.35D * _isolation + 0.65D * _gap END"),
        })
        .withColumn("configuration_fit_score", clip01(F.expr(
            "(0.45D * bed_gap_fit_score + 0.30D * market_support_score + 0.25D * access_alignment_score) * sqrt(market_support_score)")))
        .withColumn("candidate_id", F.concat(F.lit("S7-"), F.left(F.sha1(F.concat_ws("|", F.col("site_id").cast("string"), "configuration_id")), F.lit(16))))
        .drop("_pop30", "_pop45", "_beds30", "_isolation", "_fresh", "_gap")
    )


def scenario_scores(sites: DataFrame, cfg: ScenarioConfig = ScenarioConfig(), null_isolation: str = "zero") -> DataFrame:
    """Fit, cost efficiency (a percentile over all scenarios), composite score and feasibility."""
    crossed = with_fit(sites, cfg, null_isolation).withColumn("cost_efficiency_raw", F.expr(
        "(ln(1 + greatest(coalesce(weighted_drive_minutes_saved, 0), 0)) + 2 * ln(1 + greatest(coalesce(newly_accessible_population_30min, 0), 0)) "
        "+ 4 * ln(1 + least(modeled_unmet_beds_30min, proposed_beds))) / greatest(estimated_capital_cost_musd, 1)"))
    crossed = settle(crossed.drop("min_catchment_population_45min", "weighted_drive_minutes_saved", "newly_accessible_population_30min",
                                  "population_within_30min", "population_within_45min", "existing_beds_30min", "nearest_existing_hospital_minutes"))
    # Equal products under the logarithms are ties: sums of logarithms tell them apart by rounding errors only.
    ranked = ranking.add_percentiles(crossed, "candidate_id", {"cost_efficiency_score": F.round("cost_efficiency_raw", 12)},
                                     policy="half_constant")
    ranked = ranked.withColumns({
        "access_score": clip01(numeric(ranked, "access_improvement_score", 0)) * 0.65 + clip01(numeric(ranked, "new_access_score", 0)) * 0.35,
        "capacity_score": clip01(numeric(ranked, "capacity_gap_score", 0)),
        "vulnerability_score": clip01(numeric(ranked, "vulnerability_catchment_score", 0)),
    }).drop("access_improvement_score", "new_access_score", "capacity_gap_score", "vulnerability_catchment_score")
    poor = F.col("configuration_fit_score") < F.lit(cfg.minimum_fit)
    score = weighted_mean(ranked, cfg.score_weights())
    return ranked.withColumns({
        "overall_score": F.when(poor, score * cfg.low_fit_factor).otherwise(score),
        "configuration_feasible_proxy": ~poor,
    })


def with_site_columns(scenarios: DataFrame, sites: DataFrame) -> DataFrame:
    """Scenario rows with every site column and the design's description."""
    labels = designs(sites.sparkSession).select("configuration_id", *DESIGN_LABELS)
    rest = [c for c in sites.columns if c == "site_id" or (c not in scenarios.columns and c not in DESIGN_LABELS)]
    return scenarios.join(sites.select(*rest), "site_id").join(F.broadcast(labels), "configuration_id")  # 5 rows


# Equal scores keep the order design by design, then by site.
SCENARIO_ORDER = [("overall_score", True), ("configuration_ordinal", False), ("site_id", False)]


def with_design_ranks(scenarios: DataFrame) -> DataFrame:
    """The rank of every design within its site."""
    within = Window.partitionBy("site_id").orderBy(F.col("overall_score").desc(), "configuration_ordinal")  # 5 rows a site
    return scenarios.withColumn("site_configuration_rank", F.row_number().over(within))


def scenario_ranks(scenarios: DataFrame, state: str = "state_fips") -> DataFrame:
    """National, state and within-site ranks. Pass a settled frame."""
    ranked = ranking.add_rank(scenarios, "candidate_id", SCENARIO_ORDER, "overall_rank")
    ranked = ranked.join(ranking.ordered_rank(scenarios, "candidate_id", SCENARIO_ORDER, "state_rank", [state]), "candidate_id")
    return with_design_ranks(ranked)


def best_per_site(ranked: DataFrame) -> DataFrame:
    """The best design of every site, with the national rank of the site and its skyline flag.

    It needs the ranks of ``with_design_ranks`` only."""
    best = settle(ranked.where(F.col("site_configuration_rank") == 1))
    best = ranking.add_rank(best, "site_id", SCENARIO_ORDER, "site_rank")
    return skyline.flag_skyline(settle(best), "site_id", SKYLINE_COLUMNS, "pareto_optimal")


def finalists(best: DataFrame, sites: int = 50) -> DataFrame:
    return best.where(F.col("site_rank") <= sites)


def refinement_queue(best: DataFrame, sites: int = 20) -> DataFrame:
    """The first sites by rank, in that order."""
    return finalists(best, sites).withColumns({
        "refinement_priority": F.col("site_rank"), "refinement_reason": F.lit("top_stage7_unique_site")})
