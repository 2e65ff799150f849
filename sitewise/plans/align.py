"""Exact-identifier joins onto reference areas, with reconciliation of what did not match."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.exprs import strip
from ..operators.checks import ContractError, duplicate_keys, orphans, require_columns, require_none


@dataclass
class Alignment:
    joined: DataFrame
    unmatched: DataFrame
    classified: DataFrame


def checked_crosswalk(crosswalk: DataFrame, source: DataFrame, source_key: str, base: DataFrame, target_key: str) -> DataFrame:
    """One-to-one id replacements with evidence. Five things can be wrong; each is an error."""
    require_columns(crosswalk, ["source_geoid", "target_geoid", "evidence"])
    empty = F.col("source_geoid").isNull() | F.col("target_geoid").isNull() | F.col("evidence").isNull()
    require_none(crosswalk.where(empty), "Crosswalk rows need source, target and evidence")
    require_none(duplicate_keys(crosswalk, ["source_geoid"]), "Crosswalk source used twice")
    require_none(duplicate_keys(crosswalk, ["target_geoid"]), "Crosswalk target used twice")
    ids = source.select(strip(source_key).alias("source_geoid"))
    require_none(orphans(crosswalk, ids, "source_geoid", "source_geoid"), "Crosswalk source absent from the table")
    require_none(orphans(crosswalk, base, "target_geoid", target_key), "Crosswalk target absent from the reference")
    return crosswalk


def align(base: DataFrame, source: DataFrame, source_key: str, target_key: str, prefix: str, vintage: int,
          selected: Sequence[str] | None = None, crosswalk: DataFrame | None = None, digits: int | None = None) -> Alignment:
    """Left 1:1 join of a source table by identifier.

    Ids are trimmed but never padded or guessed. Two matched source rows with one id are an error.
    """
    digits = digits or (11 if target_key == "tract_geoid" else 5)
    require_columns(source, [source_key, *(selected or [])])
    columns = list(dict.fromkeys(selected)) if selected is not None else [c for c in source.columns if not c.startswith("_stage2_")]
    rows = source.withColumn("_raw", strip(source_key))
    if crosswalk is not None:
        crosswalk = checked_crosswalk(crosswalk, source, source_key, base, target_key)
        rows = rows.join(crosswalk.select(F.col("source_geoid").alias("_raw"), F.col("target_geoid").alias("_target")), "_raw", "left")
    else:
        rows = rows.withColumn("_target", F.lit(None).cast("string"))
    states = base.select(F.col("state_fips").alias("_state")).distinct().withColumn("_in_scope", F.lit(True))
    known = base.select(F.col(target_key).alias("_key")).distinct().withColumn("_known", F.lit(True))
    rows = (
        rows.withColumn("_key", F.coalesce("_target", "_raw")).withColumn("_state", F.substring("_raw", 1, 2))
        .join(states, "_state", "left").join(known, "_key", "left")
        .withColumn("_valid", F.coalesce(F.col("_raw").rlike(rf"^[0-9]{{{digits}}}$"), F.lit(False)))
        .withColumn("_matched", F.col("_valid") & F.coalesce("_known", F.lit(False)))
        .withColumn("_stage3_alignment_reason",
                    F.when(F.col("_matched"), F.lit(None).cast("string"))
                    .when(~F.col("_valid"), F.lit("malformed_identifier"))
                    .when(F.coalesce("_in_scope", F.lit(False)), F.lit("no_exact_2023_identifier"))
                    .otherwise(F.lit("outside_selected_states"))))
    matched = rows.where("_matched")
    require_none(duplicate_keys(matched, ["_key"]), f"{prefix}: duplicate matched identifiers")
    method = F.when(F.col("_raw") != F.col("_key"), F.lit("reviewed_identifier_equivalence")).otherwise(
        F.lit("exact_identifier_no_reallocation"))
    side = matched.select(F.col("_key").alias(target_key), *[F.col(c).alias(f"{prefix}_{c}") for c in columns],
                          F.lit(True).alias(f"{prefix}_matched"), F.lit(vintage).alias(f"{prefix}_source_geography_vintage"),
                          method.alias(f"{prefix}_match_method"))
    joined = base.join(side, target_key, "left").withColumn(f"{prefix}_matched", F.coalesce(f"{prefix}_matched", F.lit(False)))
    unmatched = rows.where(~F.col("_matched")).select(*source.columns, "_stage3_alignment_reason")
    return Alignment(joined, unmatched, rows)


def reconciliation(result: Alignment, prefix: str) -> DataFrame:
    """One row: matched, unmatched in scope, malformed, reference rows without a source row."""
    reason = F.col("_stage3_alignment_reason")
    counts = result.classified.agg(
        F.count_if("_matched").alias("matched"), F.count_if(reason == "no_exact_2023_identifier").alias("unmatched_in_scope"),
        F.count_if(reason == "malformed_identifier").alias("malformed_identifiers"))
    rest = result.joined.agg(F.count_if(~F.col(f"{prefix}_matched")).alias("reference_without_source"))
    return counts.crossJoin(rest)  # one row each


def require_coverage(base: DataFrame, aligned: DataFrame) -> None:
    if base.count() != aligned.count():
        raise ContractError("Alignment changed the number of reference rows")
