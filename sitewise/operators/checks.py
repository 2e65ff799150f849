"""Contract checks. Each returns the offending rows, or raises with a bounded sample."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


class ContractError(ValueError):
    """A table broke one of its declared contracts."""


def require_rows(df: DataFrame, minimum: int, what: str) -> None:
    """Stops reading as soon as the floor is reached."""
    if df.limit(minimum).count() < minimum:
        raise ContractError(f"Expected at least {minimum} {what}")


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError(f"Missing required columns: {missing}")


def require_none(bad: DataFrame, message: str) -> None:
    sample = bad.limit(5).collect()
    if sample:
        raise ContractError(f"{message}: {[tuple(r) for r in sample]}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def malformed_keys(df: DataFrame, key: str, digits: int) -> DataFrame:
    """Null keys and keys that are not exactly ``digits`` digits."""
    return df.where(F.col(key).isNull() | ~F.col(key).cast("string").rlike(rf"^[0-9]{{{digits}}}$")).select(key)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose non-null key is absent from the parent."""
    keys = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.where(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def disagreements(facilities: DataFrame, tracts: DataFrame) -> DataFrame:
    """Facilities whose county differs from the county of their tract."""
    owner = tracts.select("tract_geoid", F.col("county_geoid").alias("tract_county"))
    return facilities.where(F.col("county_geoid").isNotNull()).join(owner, "tract_geoid").where(
        F.col("county_geoid") != F.col("tract_county"))


def integrity_report(tracts: DataFrame, counties: DataFrame, facilities: DataFrame) -> DataFrame:
    """check, violations - one row per rule."""
    rules = {
        "duplicate_tract": duplicate_keys(tracts, ["tract_geoid"]),
        "duplicate_county": duplicate_keys(counties, ["county_geoid"]),
        "duplicate_facility": duplicate_keys(facilities, ["facility_id"]),
        "tract_without_county": orphans(tracts, counties, "county_geoid", "county_geoid"),
        "facility_without_tract": orphans(facilities, tracts, "tract_geoid", "tract_geoid"),
        "facility_without_county": orphans(facilities, counties, "county_geoid", "county_geoid"),
        "facility_tract_county_disagree": disagreements(facilities, tracts),
    }
    report = None
    for name, bad in rules.items():
        row = bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        report = row if report is None else report.unionByName(row)
    return report


def conserved(before: DataFrame, after: DataFrame, what: str) -> int:
    """Row conservation: raises unless both frames have the same number of rows."""
    left, right = before.count(), after.count()
    if left != right:
        raise ContractError(f"{what}: {left} rows in, {right} rows out")
    return left


def parity(before: DataFrame, after: DataFrame) -> DataFrame:
    """rows_in, rows_out, columns_in, columns_out, equal."""
    a = before.agg(F.count("*").alias("rows_in"))
    b = after.agg(F.count("*").alias("rows_out"))
    return a.crossJoin(b).withColumns({  # one row each
        "columns_in": F.lit(len(before.columns)), "columns_out": F.lit(len(after.columns))}).withColumn(
        "equal", (F.col("rows_in") == F.col("rows_out")) & (F.col("columns_in") == F.col("columns_out")))


def missing_names(required: Sequence[str], df: DataFrame) -> list[str]:
    return sorted(set(required) - set(df.columns))


def within(column: str, low: float, high: float, tolerance: float = 0.0) -> Column:
    return (F.col(column) >= low - tolerance) & (F.col(column) <= high + tolerance)
