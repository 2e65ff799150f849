"""Approximate drive-time model: rurality sets a detour factor and an effective speed."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .exprs import as_column, clip01


@dataclass(frozen=True)
class RoadModel:
    urban_detour: float = 1.20
    rural_detour: float = 1.34
    urban_mph: float = 29.0
    rural_mph: float = 52.0
    floor_mph: float = 10.0


CATCHMENT_ROADS = RoadModel()
# The screening pass uses a narrower range and a lower floor for pair speeds.
SCREENING_ROADS = RoadModel(1.22, 1.30, 28.0, 46.0, 5.0)

# Accepted names of a ready-made rurality column, in order of preference.
RURALITY_COLUMNS = (
    "rurality", "rurality_score", "rural_fraction", "rural_population_fraction",
    "ruca_rural_fraction", "ruca_rurality", "rural_pct",
)


def rurality_from_ruca(code: Column | str, default: float = 0.0) -> Column:
    """Commuting-area code 1..10 -> 0..1."""
    return F.coalesce(clip01((as_column(code).try_cast("double") - 1.0) / 9.0), F.lit(default))


def rurality(df: DataFrame, column: str | None = None, ruca_column: str | None = None,
             default: float = 0.0, percent: bool = False) -> Column:
    """0..1 rurality from a named column, else from a named RUCA code, else a constant.

    The RUCA column is named by the caller: guessing it by substring would also match
    identifiers. ``percent`` states that the column runs 0..100; ``column_is_percent``
    decides it from the data.
    """
    name = column or next((c for c in RURALITY_COLUMNS if c in df.columns), None)
    if name is not None:
        value = F.col(name).try_cast("double")
        return F.coalesce(clip01(value / 100.0 if percent else value), F.lit(0.0))
    if ruca_column is not None:
        return rurality_from_ruca(ruca_column)
    return F.lit(default)


def column_is_percent(df: DataFrame, name: str) -> bool:
    """True when the 95th percentile of the column is above 1.5."""
    from ..operators.ranking import quantiles

    row = quantiles(df, name, [0.95]).first()
    return row is not None and row["q0"] is not None and row["q0"] > 1.5


def detour_factor(rural: Column | str, model: RoadModel = CATCHMENT_ROADS) -> Column:
    return F.lit(model.urban_detour) + as_column(rural) * F.lit(model.rural_detour - model.urban_detour)


def effective_mph(rural: Column | str, model: RoadModel = CATCHMENT_ROADS, floored: bool = True) -> Column:
    mph = F.lit(model.urban_mph) + as_column(rural) * F.lit(model.rural_mph - model.urban_mph)
    return F.greatest(mph, F.lit(model.floor_mph)) if floored else mph


def drive_minutes(miles, detour, mph, floor_mph: float = CATCHMENT_ROADS.floor_mph) -> Column:
    return as_column(miles) * as_column(detour) / F.greatest(as_column(mph), F.lit(floor_mph)) * F.lit(60.0)
