import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitewise.operators import skyline, spread
from sitewise.plans import serving
from sitewise.plans.serving import CandidateFilter


def greedy(rows, thresholds, limit):
    def miles(a, b):
        p1, p2 = math.radians(a[1]), math.radians(b[1])
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 3958.8 * math.asin(min(1, math.sqrt(h)))

    chosen = []
    for t in thresholds:
        for row in rows:
            if len(chosen) >= limit:
                return [r[0] for r in chosen]
            if row in chosen or (t and any(miles(row, c) < t for c in chosen)):
                continue
            chosen.append(row)
    return [r[0] for r in chosen]


@pytest.mark.parametrize("seed,limit", [(1, 12), (2, 40)])
def test_blocks_equal_the_greedy_loop(spark, seed, limit):
    rng = np.random.default_rng(seed)
    rows = [(int(i), float(a), float(b)) for i, (a, b) in enumerate(rng.uniform([30, -100], [34, -96], (60, 2)))]
    pool = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "site long, latitude double, longitude double, place int")
    thresholds = [75.0, 40.0, 10.0, 0.0]
    want = greedy(rows, thresholds, limit)
    for block_rows in (4_000, 7):
        got = spread.spread(pool, "site", "place", thresholds, limit, block_rows=block_rows).orderBy("pick").collect()
        assert [r["site"] for r in got] == want
        assert [r["pick"] for r in got] == list(range(1, len(want) + 1))


def candidates(spark, rows):
    return spark.createDataFrame([(s, t, a, o, q, "06") for s, t, a, o, q in rows],
                                 "site_id string, source_tract_geoid string, latitude double, longitude double, stage8_score double, state_fips string")


def test_best_per_tract(spark):
    df = candidates(spark, [("best", "a", 40.0, -100.0, .9), ("duplicate", "a", 41.0, -101.0, .8), ("other", "b", 42.0, -102.0, .7)])
    top = serving.top_candidates(df, CandidateFilter(state="CA"), limit=3).orderBy("rank").collect()
    assert [r["site_id"] for r in top] == ["best", "other"]


def test_spread_before_relaxing(spark):
    df = candidates(spark, [("one", "a", 40.0, -100.0, .9), ("near-one", "b", 40.01, -100.01, .8), ("two", "c", 41.0, -101.0, .7)])
    top = serving.top_candidates(df, limit=2).orderBy("rank").collect()
    assert [r["site_id"] for r in top] == ["one", "two"]


def test_relax_to_fill(spark):
    df = candidates(spark, [(str(i), f"t{i}", 40 + i / 100, -100.0, 1 - i / 10) for i in range(5)])
    assert serving.top_candidates(df, limit=5).count() == 5


@pytest.mark.parametrize("block", [7, 4000])
def test_skyline_equals_brute_force(spark, block):
    rng = np.random.default_rng(5)
    values = rng.integers(0, 6, (400, 3)).astype(float)
    values[:3] = values[10]  # equal rows stay together
    df = spark.createDataFrame(pd.DataFrame(values, columns=list("abc")).assign(id=range(400))).repartition(5)
    got = {r["id"] for r in skyline.skyline(df, "id", ["a", "b", "c"], block_rows=block).collect()}
    beaten = [((values >= v).all(axis=1) & (values > v).any(axis=1)).any() for v in values]
    assert got == set(np.flatnonzero(~np.array(beaten)))


def test_request_validation():
    assert serving.normalize_state(" tx ") == "48" and serving.normalize_state("6") == "06" and serving.normalize_state("") is None
    with pytest.raises(ValueError):
        serving.normalize_state("Texas")
    assert serving.parse_bbox("-100, 30,-90,40") == (-100.0, 30.0, -90.0, 40.0)
    for bad in ("1,2,3", "10,0,5,1", "0,0,0,91", "a,b,c,d"):
        with pytest.raises(ValueError):
            serving.parse_bbox(bad)
    with pytest.raises(ValueError):
        CandidateFilter(services=["teleport"]).predicate()
    with pytest.raises(ValueError):
        serving.weighted_score({"access": 0})


def test_zoom_tables():
    assert [serving.cell_degrees(z) for z in (None, 3, 5, 6, 9, 9.5)] == [0.0, 3.0, 2.0, 1.25, 0.2, 0.0]
    assert [serving.default_limit(z) for z in (None, 4, 6, 8, 10, 11)] == [50, 50, 100, 175, 300, 500]


def test_weight_tools():
    moved = serving.with_share(serving.DEFAULT_WEIGHTS, "access", 50)
    assert moved["access"] == 0.5 and abs(sum(moved.values()) - 1) < 1e-12
    assert serving.with_share({"access": 1}, "access", 30)["capacity"] == pytest.approx(0.7 / 6)
    assert serving.shares({}) == serving.DEFAULT_WEIGHTS
    assert all(abs(sum(mix.values()) - 1) < 1e-9 for mix in serving.presets().values())


def test_initial_separation():
    assert spread.initial_separation(10, None, None) == 75.0
    assert spread.initial_separation(10, None, "TX") == 40.0
    assert spread.initial_separation(1, (-100, 30, -99.9, 30.1), None) == pytest.approx(6.87, abs=0.1)
