import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise.operators import polygons
from sitewise.operators.checks import ContractError
from sitewise.plans import designations

RING = "array<array<struct<x:double,y:double>>>"


def ring(*pairs):
    return [(float(x), float(y)) for x, y in (*pairs, pairs[0])]


SQUARE_WITH_HOLE = [ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (1, 3), (3, 3), (3, 1))]
TRIANGLE = [ring((5, 0), (9, 0), (5, 4))]


@pytest.fixture(scope="module")
def shapes(spark):
    return spark.createDataFrame([("donut", SQUARE_WITH_HOLE), ("tri", TRIANGLE)], f"area string, rings {RING}")


def test_point_in_polygon_with_hole_and_edges(spark, shapes):
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 1.0, 2.0), (4, 4.0, 2.0), (5, 0.5, 6.0), (6, 2.0, 7.0), (7, 2.5, 7.0), (8, None, 1.0)],
                                "id int, latitude double, longitude double")
    hits = {(r["id"], r["area"]) for r in polygons.points_in_polygons(pts, shapes, "id", "area", cell_degrees=0.7).collect()}
    assert hits == {(1, "donut"), (3, "donut"), (4, "donut"), (5, "tri"), (6, "tri")}


def test_hot_cell_gives_the_same_hits(spark, shapes):
    pts = spark.range(600).selectExpr("id", "0.1 + (id % 97) / 30D AS latitude", "0.2 + (id % 89) / 25D AS longitude")
    plain = polygons.points_in_polygons(pts, shapes, "id", "area", cell_degrees=10.0)
    split = polygons.points_in_polygons(pts, shapes, "id", "area", cell_degrees=10.0, crowded_rows=50)
    assert plain.count() > 0 and plain.exceptAll(split).isEmpty() and split.exceptAll(plain).isEmpty()


def test_centroid_and_area(shapes):
    rows = {r["area"]: r for r in polygons.with_centroid(shapes.withColumn("e", polygons.edges("rings")), "rings", "cx", "cy")
            .select("area", "cx", "cy", polygons.signed_area("e").alias("a")).collect()}
    assert (rows["donut"]["cx"], rows["donut"]["cy"]) == (pytest.approx(2.0), pytest.approx(2.0)) and abs(rows["donut"]["a"]) == 12.0
    assert (rows["tri"]["cx"], rows["tri"]["cy"]) == (pytest.approx(5 + 4 / 3), pytest.approx(4 / 3))


def test_projection_round_trip(shapes):
    back = shapes.withColumn("p", polygons.projected("rings")).selectExpr("rings[0][2].x AS x", "rings[0][2].y AS y", "p[0][2].x AS px", "p[0][2].y AS py").select(
        "x", "y", polygons.unprojected_lon(F.col("px")).alias("bx"), polygons.unprojected_lat(F.col("py")).alias("by")).collect()
    for r in back:
        assert r["bx"] == pytest.approx(r["x"], abs=1e-9) and r["by"] == pytest.approx(r["y"], abs=1e-7)


def test_candidate_points_lie_inside(spark, shapes):
    points = polygons.candidate_points(shapes, "area", count=5)
    inside = polygons.points_in_polygons(points.withColumn("id", F.concat("area", "candidate_ordinal")), shapes, "id", "area")
    assert points.count() == inside.count() and points.count() >= 7
    first = points.where("area = 'donut' AND candidate_ordinal = 0").first()
    assert not (1 < first["longitude"] < 3 and 1 < first["latitude"] < 3)


def test_site_ids_are_stable(shapes):
    ids = [r["site_id"] for r in polygons.site_ids(polygons.candidate_points(shapes, "area"), "area").collect()]
    assert all(i.startswith("S6F-") and len(i) == 18 for i in ids) and len(set(ids)) == 2


def _edges(rings):
    return np.array([(*a, *b) for r in rings for a, b in zip(r, r[1:])])


def test_covered_area_against_sampling():
    rng = np.random.default_rng(0)
    area = _edges(SQUARE_WITH_HOLE)
    covers = [_edges([ring(*rng.uniform(-1, 5, (3, 2)))]) for _ in range(4)]
    exact = polygons.covered_area(area, covers)
    pts = rng.uniform(0, 4, (200_000, 2))

    def inside(e):
        x1, y1, x2, y2 = e.T
        px, py = pts[:, :1], pts[:, 1:]
        cut = (y1 > py) != (y2 > py)
        with np.errstate(divide="ignore", invalid="ignore"):
            return (cut & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)).sum(axis=1) % 2 == 1

    sampled = (inside(area) & np.any([inside(c) for c in covers], axis=0)).mean() * 16
    assert exact == pytest.approx(sampled, abs=0.1)
    # Strips add up to the whole.
    assert sum(polygons.covered_area(area, covers, a, a + 1) for a in range(4)) == pytest.approx(exact)


def test_overlay_union_and_strips(spark, monkeypatch):
    tract = spark.createDataFrame([("t", [ring((0, 0), (1, 0), (1, 1), (0, 1))]), ("far", [ring((20, 0), (21, 0), (21, 1), (20, 1))])], f"tract string, rings {RING}")
    cover = spark.createDataFrame([("a", "mua", [ring((-1, -1), (.5, -1), (.5, 2), (-1, 2))]), ("b", "mua", [ring((.25, -1), (.75, -1), (.75, 2), (.25, 2))]),
                                   ("c", "mup", [ring((-1, -1), (2, -1), (2, 2), (-1, 2))]), ("d", "mup", [ring((0, 0), (1, 0), (1, 1), (0, 1))])],
                                  f"designation_id string, designation_kind string, rings {RING}")
    for members in (64, 1):
        monkeypatch.setattr(polygons, "STRIP_MEMBERS", members)
        rows = {r["tract"]: r for r in designations.area_coverage(tract, cover, "tract").collect()}
        assert rows["t"]["mua_boundary_area_fraction"] == pytest.approx(0.75, abs=1e-9) and rows["t"]["mua_designation_count"] == 2
        assert rows["t"]["mup_boundary_area_fraction"] == pytest.approx(1.0)
        assert rows["far"]["mua_boundary_area_fraction"] == 0.0 and rows["far"]["mup_designation_count"] == 0


def test_designation_contracts(spark):
    def parts(*rows):
        return spark.createDataFrame([(i, s, t, v, TRIANGLE) for i, s, t, v in rows],
                                     f"designation_id string, designation_status string, designation_type string, imu_score double, rings {RING}")
    good = ("00001", "Designated", "Medically Underserved Area", 50.0)
    assert designations.load_designations(parts(good, good, ("00002", "Withdrawn", "other", 1.0))).count() == 1
    for bad in [(good, ("12", "Designated", "Medically Underserved Area", 1.0)), (good, ("00001", "Designated", "Medically Underserved Area", 51.0)),
                (good, ("00003", "Designated", "Unknown", 1.0)), (("00002", "Withdrawn", "x", 1.0),), (good, ("00001", "Designated", "Medically Underserved Area", None))]:
        with pytest.raises(ContractError):
            designations.load_designations(parts(*bad))


def test_ring_problems(spark):
    df = spark.createDataFrame([("ok", TRIANGLE), ("open", [TRIANGLE[0][:-1] + [(9.0, 9.0)]]), ("short", [TRIANGLE[0][:2]]), ("none", None)], f"k string, rings {RING}")
    assert {r["k"]: r["problem"] for r in polygons.ring_problems(df, "k", "rings").collect()} == {"open": "open ring", "short": "too short", "none": "missing"}


def _boxes(spark, rows, columns):
    ring = "array(array(" + ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))) + "))"
    return spark.createDataFrame(rows, columns + ", x0 double, y0 double, x1 double, y1 double").selectExpr("*", f"{ring} AS rings")


def test_copies_are_measured_once_and_boxes_meet_in_degrees(spark):
    areas = _boxes(spark, [("a", 0.0, 40.0, 2.0, 42.0), ("b", 0.0, 138.0, 2.0, 140.0)], "k string")
    covers = _boxes(spark, [(f"d{i}", "mua", 1.0, 41.0, 3.0, 43.0) for i in range(5)] + [("e", "mua", 0.0, 40.0, 1.0, 41.0)],
                    "designation_id string, designation_kind string")
    links, coverage = polygons.overlay(areas, covers, "k")
    rows = links.collect()
    assert {(r["k"], r["designation_id"]) for r in rows} == {("a", d) for d in ("d0", "d1", "d2", "d3", "d4", "e")}
    assert len({r["overlap_area_m2"] for r in rows if r["designation_id"] != "e"}) == 1
    fractions = {r["designation_id"]: r["boundary_area_fraction"] for r in rows}
    (union,) = coverage.collect()
    assert union["designation_count"] == 6 and union["boundary_area_fraction"] == pytest.approx(fractions["d0"] + fractions["e"])


def test_membership_equals_flags_of_all_links(spark):
    from sitewise.plans import designations

    shapes = _boxes(spark, [(f"d{i}", "mua" if i % 2 else "mup", i % 3 * 1.0, 0.0, i % 3 + 1.5, 1.0) for i in range(9)],
                    "designation_id string, designation_kind string")
    points = spark.range(40).selectExpr("id AS facility_id", "CASE WHEN id % 9 = 0 THEN NULL ELSE id % 2 * 0.8D END AS latitude", "id % 8 * 0.7D AS longitude")
    links = designations.facility_links(points, shapes)
    assert links.count() == links.distinct().count() > 0
    want = {tuple(r) for r in designations.with_membership(points, links).collect()}
    got = {tuple(r) for r in designations.membership(points, shapes).select("facility_id", "latitude", "longitude", "inside_mua_boundary", "inside_mup_boundary").collect()}
    assert got == want


@pytest.mark.parametrize("sites,units,key", [(30, 12, "_family"), (600, 3, "latitude")])
def test_links_grow_in_the_last_join_only(spark, monkeypatch, sites, units, key):
    rows = [(f"d{i}", "mua" if i % 2 else "mup", f"s{i}", lo, 0.0, lo + 1.5, 1.0) for i in range(units) for lo in (0.0, 1.0)]  # components overlap
    rows.append(("e", "mua", "x", 1.0, 0.0, 2.0, 1.0))
    shapes = spark.createDataFrame([(d, k, s, n, [ring((a, b), (c, b), (c, t), (a, t))]) for n, (d, k, s, a, b, c, t) in enumerate(rows)],
                                   f"designation_id string, designation_kind string, shown string, component int, rings {RING}")
    if key == "latitude":  # shapes of their own, facilities at one spot
        shapes = shapes.withColumn("rings", F.expr("transform(rings, r -> transform(r, p -> named_struct('x', p.x + component / 100D, 'y', p.y)))"))
    points = spark.range(sites).selectExpr("id AS facility_id", "CASE WHEN id % 9 = 0 THEN NULL ELSE 0.5D END AS latitude",
                                           "1.2D AS longitude" if key == "latitude" else "id % 8 * 0.4D AS longitude")
    last, join = [], designations.spatial._cell_join
    monkeypatch.setattr(designations.spatial, "_cell_join", lambda left, right, n, keys=designations.spatial.CELL, **k: last.append((left, list(keys))) or join(left, right, n, keys, **k))
    links = designations.facility_links(points, shapes, carry=["shown"])
    boxed = shapes.selectExpr("designation_id", "designation_kind", "shown", "rings[0][0].x AS x0", "rings[0][2].x AS x1")
    want = [tuple(r) for r in points.where("latitude IS NOT NULL").join(boxed, F.expr("longitude BETWEEN x0 AND x1")).select(
        "facility_id", "designation_id", "designation_kind", "shown").distinct().collect()]
    got = [tuple(r) for r in links.collect()]
    assert sorted(got) == sorted(want) and len(got) > sites
    left, keys = last[-1]
    assert key in keys and left.count() < len(got)
