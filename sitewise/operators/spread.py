"""Greedy spatial diversification of a ranked list, with distance thresholds that relax.

Going down the ranking, a row is taken unless something taken earlier is closer than the current
threshold; when the list is exhausted the next, smaller threshold starts from the top.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.geo import EARTH_MILES_ROUNDED
from ..session import settle

# Rows that are looked at one after the other at a time.
BLOCK_ROWS = 4_000


def _near(lat, lon, to_lat: float, to_lon: float, threshold: float, radius: float) -> np.ndarray:
    """Which points (radians) are closer than the threshold to one point."""
    h = np.sin((lat - to_lat) / 2) ** 2 + np.cos(lat) * np.cos(to_lat) * np.sin((lon - to_lon) / 2) ** 2
    return 2 * radius * np.arcsin(np.minimum(1.0, np.sqrt(h))) < threshold


def spread(ranked: DataFrame, key: str, rank: str, thresholds: Sequence[float], limit: int, *,
           at: Sequence[str] = ("latitude", "longitude"), radius: float = EARTH_MILES_ROUNDED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key and pick (1-based order of selection). ``rank`` must be unique; smaller is better.

    All rows take part, in blocks: rows that are not too close to the picks so far (at most ``limit`` places, sent to
    the tasks) are found in parallel, the best ranked of them are walked, and what follows them in the ranking makes
    the next block. Rows without a position are never picked.
    """
    narrow = settle(ranked.select(key, F.col(rank).alias("_rank"), F.radians(at[0]).alias("_lat"), F.radians(at[1]).alias("_lon"))
                    .where(F.col("_lat").isNotNull() & F.col("_lon").isNotNull()))
    picks: list[tuple] = []

    def clear_of(taken: list[tuple], threshold: float):
        def run(batches):
            for batch in batches:
                blocked = batch["_rank"].isin([p[1] for p in taken]).to_numpy()
                for _, _, lat, lon in taken if threshold else []:
                    blocked |= _near(batch["_lat"].to_numpy(), batch["_lon"].to_numpy(), lat, lon, threshold, radius)
                yield batch[~blocked]
        return run

    for threshold in thresholds:
        after = None
        while len(picks) < limit:
            rows = narrow if after is None else narrow.where(F.col("_rank") > after)
            if picks:
                rows = rows.mapInPandas(clear_of(list(picks), threshold), narrow.schema)
            block = rows.orderBy("_rank").limit(block_rows).collect()
            if not block:
                break
            lat, lon = np.array([r["_lat"] for r in block]), np.array([r["_lon"] for r in block])
            blocked = np.zeros(len(block), dtype=bool)
            for i, row in enumerate(block):
                if len(picks) < limit and not blocked[i]:
                    picks.append((row[key], row["_rank"], row["_lat"], row["_lon"]))
                    if threshold:
                        blocked |= _near(lat, lon, lat[i], lon[i], threshold, radius)
            after = block[-1]["_rank"]
        if len(picks) >= limit:
            break
    schema = T.StructType([ranked.schema[key], T.StructField("pick", T.IntegerType())])
    return ranked.sparkSession.createDataFrame([(p[0], i) for i, p in enumerate(picks, 1)], schema)


# Shares of the initial separation tried in turn.
RELAXATION = (1.0, 0.75, 0.5, 0.25, 0.1, 0.0)


def relaxing_thresholds(initial: float) -> list[float]:
    return [initial * share for share in RELAXATION]


# Starting miles for the whole country, within a state, and the least for a viewport;
# the share of the viewport's diagonal that the square root of the number of results divides.
NATIONAL_MILES, STATE_MILES, LEAST_MILES, DIAGONAL_SHARE = 75.0, 40.0, 5.0, 0.75


def _on_sphere(lon: float, lat: float) -> tuple[float, float, float]:
    lam, phi = math.radians(lon), math.radians(lat)
    return math.cos(phi) * math.cos(lam), math.cos(phi) * math.sin(lam), math.sin(phi)


def initial_separation(limit: int, bbox: tuple[float, float, float, float] | None, state: str | None) -> float:
    """Miles to start from: what lets the results fill the viewport, else by state or nation."""
    if not bbox:
        return STATE_MILES if state else NATIONAL_MILES
    half_chord = math.dist(_on_sphere(*bbox[:2]), _on_sphere(*bbox[2:])) / 2
    diagonal = 2 * EARTH_MILES_ROUNDED * math.asin(min(half_chord, 1.0))
    return min(max(DIAGONAL_SHARE * diagonal / max(limit, 1) ** 0.5, LEAST_MILES), NATIONAL_MILES)
