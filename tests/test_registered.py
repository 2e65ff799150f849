"""A few registered queries against their oracles on the smallest tables; check.py runs all of them."""
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SOME = ["flagship_ranked_demand", "sp05_radius_totals", "sp10_existing_access", "sp11_sp12_site_features", "wn09_grid_diversified",
        "typ02_to_typ12_typed_values", "jn01_alignment", "sp07_point_in_polygon", "adr12_src19_verdicts", "src03_src06_staged_csv"]


def test_oracles_belong_to_queries_and_the_first_modules_have_one_each():
    from suite.registry import ORACLES, QUERIES

    entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLES) == set(QUERIES)
    assert len(QUERIES) > 120


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_oracle(spark, name):
    import duckdb

    from check import rows_of

    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from '{FOLDER}/{f}'")
    df = entry.queries()[name](spark, FOLDER)
    cur = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_summary_carries_only_what_it_counts(spark, monkeypatch):
    import __spark_entry__ as driver
    from suite import scoring

    seen, settle = [], scoring.settle
    monkeypatch.setattr(scoring, "settle", lambda df: seen.append(df.columns) or settle(df))
    assert driver.queries()["ag11_snk04_run_summary"](spark, "/root/testdata/sf0.001").first()["sites"] > 0
    assert not any({"overall_rank", "state_rank"} & set(columns) for columns in seen)
    assert len(seen[-1]) < 10  # eleven services, four columns each, are not written for five figures
