"""Rule-driven typing of all-text tables with cell-level quality flags."""
from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.parsing import Rule, parsed_cells
from ..operators.checks import ContractError

# The rule book. One entry per source: (column pattern, rule); first match wins.
_NA = ("Not Available", "Not Applicable")
_SVI_MISSING = ("-999", "-999.0")
_MOE = {token: "controlled_estimate_moe" for token in ("-555555555", "-555555555.0", "-555555555.00")}
RULE_BOOK: dict[str, list[tuple[str, Rule]]] = {
    "SVI": [
        (r"m_.*", Rule("int64", 0, None, _SVI_MISSING, _MOE)),
        (r"mp_.*", Rule("float64", 0, None, _SVI_MISSING, _MOE, unit="percent")),
        (r"(e|f)_.*", Rule("int64", 0, None, _SVI_MISSING)),
        (r"ep_.*", Rule("float64", 0, None, _SVI_MISSING, unit="percent")),
        (r"(epl|rpl)_.*", Rule("float64", 0, 1, _SVI_MISSING, unit="percentile")),
        (r"spl_.*|area_sqmi", Rule("float64", 0, None, _SVI_MISSING)),
    ],
    "PLACES": [
        (r".*(_crudeprev|_adjprev)", Rule("float64", 0, 100, unit="percent")),
        (r".*(_crude95ci|_adj95ci)", Rule("interval", 0, 100, unit="percent")),
        (r"totalpopulation|totalpop18plus", Rule("int64", 0, unit="people")),
    ],
    "CMSHospital": [
        (r"emergency_services|meets_criteria_for_birthing_friendly_designation", Rule("bool", missing=_NA)),
        (r"hospital_overall_rating", Rule("int64", 1, 5, _NA, unit="stars")),
        (r".*_measure_count|count_of_facility_.*", Rule("int64", 0, None, _NA, unit="count")),
    ],
    "CMSFacilities": [
        (r"bed_cnt|crtfd_bed_cnt|mdcr_snf_bed_cnt|mdcd_nf_bed_cnt|mdcr_mdcd_snf_bed_cnt", Rule("int64", 0, None, _NA, unit="beds")),
    ],
    "HPSA": [
        (r"hpsa_score|pc_mcta_score", Rule("int64", 0, None, ("NA",))),
        (r"hpsa_fte|hpsa_designation_population|hpsa_estimated_served_population|hpsa_estimated_underserved_population"
         r"|hpsa_resident_civilian_population|hpsa_shortage", Rule("float64")),
        (r"of_population_below_100_poverty", Rule("float64", 0, 100, unit="percent", on_invalid="null_with_warning")),
        (r"hpsa_designation_date|hpsa_designation_last_update_date|withdrawn_date|hpsa_withdrawn_date_string", Rule("date")),
    ],
    "MUAP": [
        (r"imu_score", Rule("float64", 0, 100)),
        (r"designation_date|mua_p_designation_date_string|mua_p_update_date|mua_p_update_date_string"
         r"|medically_underserved_area_population_mua_p_withdrawal_date", Rule("date")),
        (r"percentage_of_population_age_65_and_over"
         r"|percent_of_population_with_incomes_at_or_below_100_percent_of_the_u_s_federal_poverty_level",
         Rule("float64", 0, 100, unit="percent")),
    ],
    "RUCA": [
        (r"population", Rule("int64", 0, unit="people")),
        (r"landarea|popdensity", Rule("float64", 0)),
    ],
}

Overrides = Mapping[str, Mapping[str, Mapping[str, Mapping]]]
OVERRIDE_FIELDS = {"type", "missing", "minimum", "maximum", "unit", "measurement_year"}


def rule_for(source: str, column: str, table: str = "", overrides: Overrides | None = None) -> Rule:
    """Built-in rule, then the source's override, then the table's. Unlisted columns stay text."""
    rule = next((r for pattern, r in RULE_BOOK.get(source, ()) if re.fullmatch(pattern, column)), Rule())
    if rule.type != "string":
        rule = Rule(**{**rule.__dict__, "origin": "builtin"})
    for scope, name in (("sources", source), ("tables", table)):
        change = (overrides or {}).get(scope, {}).get(name, {}).get(column)
        if change is not None:
            known = {k: tuple(v) if k == "missing" else v for k, v in change.items() if k != "measurement_year"}
            rule = rule.with_override(**known)
    return rule


def rules_for(df: DataFrame, source: str, table: str = "", overrides: Overrides | None = None) -> dict[str, Rule]:
    return {c: rule_for(source, c, table, overrides) for c in df.columns if not c.startswith("_stage2_")}


def override_problems(catalog: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides (scope, name, column, property) that match no catalog column or no known property.

    The catalog has one row per (source, table, column)."""
    known = catalog.select(F.lit("sources").alias("scope"), F.col("source").alias("name"), "column").unionByName(
        catalog.select(F.lit("tables").alias("scope"), F.col("table").alias("name"), "column")).distinct()
    unknown = overrides.join(known, ["scope", "name", "column"], "left_anti").withColumn("problem", F.lit("unknown column"))
    wrong = overrides.where(~F.col("property").isin(*sorted(OVERRIDE_FIELDS))).withColumn("problem", F.lit("unknown property"))
    scope = overrides.where(~F.col("scope").isin("sources", "tables")).withColumn("problem", F.lit("unknown scope"))
    return unknown.unionByName(wrong).unionByName(scope)


def parse_cells(df: DataFrame, rules: Mapping[str, Rule]) -> DataFrame:
    """Every ruled column replaced by struct(raw, value, status, error); parsed once, used three times."""
    return parsed_cells(df, rules)


def typed_table(cells: DataFrame, rules: Mapping[str, Rule]) -> DataFrame:
    """Typed columns plus the ordered quality flags of the row (null when there are none)."""
    keep = [c for c in cells.columns if c not in rules]
    flags = F.filter(F.array(*[_flag(c) for c in rules]), lambda f: f.isNotNull())
    return cells.select(*keep, *[F.col(f"{c}.value").alias(c) for c in rules],
                        F.when(F.size(flags) > 0, flags).alias("_stage2_quality_flags"))


def _flag(column: str):
    status = F.col(f"{column}.status")
    reason = F.when(status == "invalid_warned", F.lit("invalid_value")).otherwise(status)
    return F.when(~status.isin("present", "blank", "sentinel", "invalid"), F.struct(
        F.lit(column).alias("column"), F.col(f"{column}.raw").alias("raw_value"), reason.alias("reason"),
        F.col(f"{column}.error").alias("error")))


def cell_counts(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, status, cells."""
    return cells.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}.status").alias("status")) for c in columns])).alias("s")
    ).groupBy("s.column", "s.status").agg(F.count("*").alias("cells"))


def problem_samples(cells: DataFrame, columns: Sequence[str], status: str = "invalid",
                    row: str = "_stage2_source_row", limit: int = 100) -> DataFrame:
    """The first problems in row, then column order."""
    found = cells.select(F.col(row).alias("row"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.col(f"{c}.raw").alias("value"),
                 F.col(f"{c}.status").alias("status"), F.col(f"{c}.error").alias("error"))
        for i, c in enumerate(columns)])).alias("p")).select("row", "p.*").where(F.col("status") == status)
    return found.orderBy("row", "ordinal").limit(limit).drop("ordinal", "status")


def publishable(cells: DataFrame, rules: Mapping[str, Rule]) -> DataFrame:
    """The typed table, or an error when any cell is invalid under a rejecting rule."""
    rejecting = [c for c, rule in rules.items() if rule.on_invalid == "reject"]
    bad = cells.agg(*[F.count_if(F.col(f"{c}.status") == "invalid").alias(c) for c in rejecting]).first().asDict() if rejecting else {}
    total = sum(bad.values())
    if total:
        raise ContractError(f"{total} invalid cells: {({c: n for c, n in bad.items() if n})}")
    return typed_table(cells, rules)
