import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitewise.operators import ranking
from sitewise.plans import coverage


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 3000
    v = rng.normal(size=n).round(2)
    v[rng.random(n) < 0.33] = 0.0  # one value holds a third of the rows
    v[rng.random(n) < 0.1] = np.nan
    return pd.DataFrame({"id": np.arange(n), "v": v, "w": rng.integers(0, 50, n).astype(float), "g": np.where(rng.random(n) < 0.4, "hot", "cold" + pd.Series(rng.integers(0, 5, n).astype(str)))})


def test_average_rank_percentile_equals_pandas(spark, frame, monkeypatch):
    monkeypatch.setattr(ranking, "HOT_ROWS", 100)
    df = spark.createDataFrame(frame)
    got = ranking.percentile_scores(df, "id", {"v": F.col("v"), "w": F.col("w")}, inverted=["w"]).toPandas().sort_values("id")
    np.testing.assert_allclose(got["v"].to_numpy(float), frame["v"].rank(pct=True).to_numpy(), equal_nan=True)
    np.testing.assert_allclose(got["w"], (-frame["w"]).rank(pct=True))


def test_percentile_within_groups(spark, frame):
    df = spark.createDataFrame(frame)
    got = ranking.percentile_scores(df, "id", {"w": F.col("w")}, groups=["g"]).toPandas().sort_values("id")
    np.testing.assert_allclose(got["w"], frame.groupby("g")["w"].rank(pct=True))


def test_heavy_values_take_the_broadcast_branch(spark, frame):
    df = spark.createDataFrame(frame).select("id", F.col("w").alias("value"))
    lookup = df.groupBy("value").agg(F.count("*").alias("rows"))
    plain = df.join(lookup, "value").select("id", "rows")
    split = ranking.lookup_by_value(df, lookup, ["value"], "rows", hot_rows=60).select("id", "rows")
    assert plain.exceptAll(split).isEmpty() and split.exceptAll(plain).isEmpty()


def test_policies(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, 5.0, None), (3, None, None)], "id int, a double, b double")
    scores = {"a": F.col("a"), "b": F.col("b")}
    half = ranking.percentile_scores(df, "id", scores, policy="half_constant").orderBy("id").collect()
    assert [(r.a, r.b) for r in half] == [(0.5, 0.0), (0.5, 0.0), (0.0, 0.0)]
    zero = ranking.percentile_scores(df, "id", scores, policy="zero").orderBy("id").collect()
    assert [(r.a, r.b) for r in zero] == [(0.75, 0.0), (0.75, 0.0), (0.0, 0.0)]


def test_ordered_rank_spans_slices(spark, frame):
    df = spark.createDataFrame(frame.fillna(0))
    got = ranking.ordered_rank(df, "id", [("v", True), ("id", False)], "place", ["g"]).toPandas().set_index("id")["place"].sort_index()
    want = frame.fillna(0).sort_values(["v", "id"], ascending=[False, True]).groupby("g").cumcount() + 1
    assert (got == want.sort_index()).all()


def test_quantiles_equal_pandas(spark, frame):
    df = spark.createDataFrame(frame)
    row = ranking.quantiles(df, "v", [0.5, 0.95, 0.995]).first()
    np.testing.assert_allclose(list(row), frame["v"].quantile([0.5, 0.95, 0.995]))
    assert ranking.quantiles(df.where("false"), "v", [0.5]).first()["q0"] is None


def test_robust_scale_and_median(spark):
    df = spark.createDataFrame([(float(i),) for i in range(0, 41)], "v double")
    assert coverage.robust_scale(df, "v").first()["v_scale"] == 39.0  # position int(.95 * 40) of 1..40
    assert coverage.robust_scale(df.where("v < 0"), "v").first()["v_scale"] == 1.0
    assert coverage.upper_median(df.where("v < 4"), "v").first()["v_median"] == 2.0


def test_top_of_each_limits_before_the_shuffle(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"))
    best = ranking.top_of_each(df, ["g"], [F.col("id").desc()], 2)
    assert best.count() == 6
    assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()


def test_apportion_adds_up(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 1.0), ("a", 2, 1.0), ("b", 0, 0.0), ("b", 1, 0.0)], "g string, i int, v double")
    rows = ranking.apportion(df, "g", "i", "v", F.lit(100), "whole").orderBy("g", "i").collect()
    assert [r.whole for r in rows] == [34, 33, 33, 0, 0]


def test_equal_products_under_logarithms_are_ties(spark):
    """(1 + 49) (1 + 1)^2 = (1 + 1) (1 + 9)^2, though the sums of their logarithms differ in the last bit."""
    from sitewise.plans import scenarios

    sites = spark.createDataFrame([(1, 49.0, 1.0), (2, 1.0, 9.0), (3, 0.0, 0.0)], "site_id long, weighted_drive_minutes_saved double, newly_accessible_population_30min double").selectExpr(
        "*", "'T' AS source_tract_geoid", "'01' AS state_fips", "0D AS latitude", "0D AS longitude", "20000D AS population_within_30min", "30000D AS population_within_45min",
        "0D AS existing_beds_30min", "0.5D AS access_improvement_score", "0.5D AS capacity_gap_score", "0.5D AS vulnerability_catchment_score", "0.5D AS new_access_score",
        "0.5D AS stage6_access_score", "5D AS nearest_existing_hospital_minutes")
    rows = scenarios.scenario_scores(sites).where("configuration_id = 'rural_25' AND site_id < 3").collect()
    assert rows[0]["cost_efficiency_raw"] != rows[1]["cost_efficiency_raw"]
    assert rows[0]["cost_efficiency_score"] == rows[1]["cost_efficiency_score"]
