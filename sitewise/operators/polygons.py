"""Polygons as arrays of rings, rings as arrays of struct(x, y), first point repeated at the end.

All rings of all parts sit in one array; inside is decided by parity, so holes need no marking.
Areas and centroids use signed ring areas: outer rings and holes run in opposite directions.
Coordinates are degrees (x longitude, y latitude) unless projected.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import as_column
from ..session import parallel_tasks, settle
from . import spatial

# The WGS84 ellipsoid and the standard parallel of the equal-area projection.
A = 6378137.0
E2 = 0.0066943799901413165
K0 = math.cos(math.radians(30)) / math.sqrt(1 - E2 * math.sin(math.radians(30)) ** 2)
E = math.sqrt(E2)


def _q(sine: str) -> str:
    """Authalic function of the sine of a latitude, as SQL."""
    return (f"({1 - E2!r}D * ({sine} / (1 - {E2!r}D * {sine} * {sine}) "
            f"- {1 / (2 * E)!r}D * ln((1 - {E!r}D * {sine}) / (1 + {E!r}D * {sine}))))")


QP = (1 - E2) * (1 / (1 - E2) - 1 / (2 * E) * math.log((1 - E) / (1 + E)))


def projected(rings: str) -> Column:
    """Rings in metres of the cylindrical equal-area projection, vertex by vertex."""
    sine = "sin(radians(p.y))"
    return F.expr(f"transform({rings}, r -> transform(r, p -> named_struct('x', {A * K0!r}D * radians(p.x), 'y', {A / (2 * K0)!r}D * {_q(sine)})))")


def unprojected_lon(x: Column) -> Column:
    return F.degrees(x / F.lit(A * K0))


def unprojected_lat(y: Column) -> Column:
    """Inverse by the authalic-latitude series."""
    beta = F.asin(F.least(F.greatest(y * F.lit(2 * K0 / (A * QP)), F.lit(-1.0)), F.lit(1.0)))
    e4, e6 = E2 ** 2, E2 ** 3
    c2, c4, c6 = E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040, 23 * e4 / 360 + 251 * e6 / 3780, 761 * e6 / 45360
    return F.degrees(beta + F.lit(c2) * F.sin(beta * 2) + F.lit(c4) * F.sin(beta * 4) + F.lit(c6) * F.sin(beta * 6))


def edges(rings: str) -> Column:
    """All edges of all rings as struct(x1, y1, x2, y2)."""
    return F.expr(
        f"flatten(transform({rings}, r -> transform(sequence(1, size(r) - 1), "
        "i -> named_struct('x1', r[i - 1].x, 'y1', r[i - 1].y, 'x2', r[i].x, 'y2', r[i].y))))")


def ring_problems(df: DataFrame, key: str, rings: str) -> DataFrame:
    """Keys whose rings are missing, shorter than four points, open, or contain nulls."""
    bad = F.expr(
        f"CASE WHEN {rings} IS NULL OR size({rings}) = 0 THEN 'missing' WHEN exists({rings}, r -> size(r) < 4) THEN 'too short' "
        f"WHEN exists({rings}, r -> exists(r, p -> p IS NULL OR p.x IS NULL OR p.y IS NULL)) THEN 'null vertex' "
        f"WHEN exists({rings}, r -> r[0] <> r[size(r) - 1]) THEN 'open ring' END")
    return df.select(key, bad.alias("problem")).where(F.col("problem").isNotNull())


def signed_area(edge_array: str) -> Column:
    return F.expr(f"aggregate({edge_array}, 0D, (a, e) -> a + (e.x1 * e.y2 - e.x2 * e.y1)) / 2")


def with_centroid(df: DataFrame, rings: str, x: str, y: str) -> DataFrame:
    """Planar area centroid of the rings."""
    moment = ("aggregate(_edges, 0D, (a, e) -> a + (e.{c}1 + e.{c}2) * (e.x1 * e.y2 - e.x2 * e.y1)) / "
              "(3 * aggregate(_edges, 0D, (a, e) -> a + (e.x1 * e.y2 - e.x2 * e.y1)))")
    # Moments are taken around the first vertex: far from the origin they would cancel.
    local = f"transform({rings}, r -> transform(r, p -> named_struct('x', p.x - {rings}[0][0].x, 'y', p.y - {rings}[0][0].y)))"
    return (df.withColumn("_local", F.expr(local)).withColumn("_edges", edges("_local"))
            .withColumns({x: F.expr(f"{rings}[0][0].x + {moment.format(c='x')}"), y: F.expr(f"{rings}[0][0].y + {moment.format(c='y')}")})
            .drop("_local", "_edges"))


def with_equal_area_centroid(df: DataFrame, rings: str, lon: str, lat: str) -> DataFrame:
    """Centroid in the equal-area projection, back in degrees."""
    framed = with_centroid(df.withColumn("_rings", projected(rings)), "_rings", "_cx", "_cy")
    return framed.withColumns({lon: unprojected_lon(F.col("_cx")), lat: unprojected_lat(F.col("_cy"))}).drop("_rings", "_cx", "_cy")


def _inside(edge_array: str, x: str, y: str) -> str:
    return (f"aggregate({edge_array}, 0, (n, e) -> n + CASE WHEN (e.y1 > {y}) <> (e.y2 > {y}) AND "
            f"{x} < (e.x2 - e.x1) * ({y} - e.y1) / (e.y2 - e.y1) + e.x1 THEN 1 ELSE 0 END) % 2 = 1")


def _on_edge(edge_array: str, x: str, y: str) -> str:
    return (f"exists({edge_array}, e -> (e.x2 - e.x1) * ({y} - e.y1) = (e.y2 - e.y1) * ({x} - e.x1) AND "
            f"{x} BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2) AND {y} BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2))")


def covers(edge_array: str, x: str, y: str) -> Column:
    """Point inside or on the boundary."""
    return F.expr(f"({_on_edge(edge_array, x, y)}) OR ({_inside(edge_array, x, y)})")


def _polygon_cells(polygons: DataFrame, key: str, rings: str, size: float, extra: Sequence[str] = ()) -> DataFrame:
    """One row per polygon and grid cell of its bounding box, with the edges a ray from that cell can meet.

    A ray to the right of a point in the cell meets only edges that reach the cell's rows and do
    not end left of it, so far-away parts of large polygons are not carried along."""
    s = f"{size!r}D"
    boxed = polygons.select(key, *extra, edges(rings).alias("_e")).selectExpr(
        "*", "array_min(transform(_e, e -> least(e.x1, e.x2))) AS _x0", "array_max(transform(_e, e -> greatest(e.x1, e.x2))) AS _x1",
        "array_min(transform(_e, e -> least(e.y1, e.y2))) AS _y0", "array_max(transform(_e, e -> greatest(e.y1, e.y2))) AS _y1")
    cells = boxed.selectExpr("*", f"explode(sequence(floor(_x0 / {s}), floor(_x1 / {s}))) AS cx").selectExpr(
        "*", f"explode(sequence(floor(_y0 / {s}), floor(_y1 / {s}))) AS cy", "0L AS cz")
    reachable = (f"filter(_e, e -> greatest(e.y1, e.y2) >= cy * {s} AND least(e.y1, e.y2) <= (cy + 1) * {s} AND greatest(e.x1, e.x2) >= cx * {s})")
    return cells.select(key, *extra, *spatial.CELL, F.expr(reachable).alias("_edges")).where(F.size("_edges") > 0)


def points_in_polygons(points: DataFrame, polygons: DataFrame, point_key: str, polygon_key: str, rings: str = "rings", *,
                       at: Sequence[str] = ("latitude", "longitude"), extra: Sequence[str] = (), cell_degrees: float = 0.5,
                       crowded_rows: int = spatial.CROWDED_ROWS) -> DataFrame:
    """point_key, polygon_key (and extra polygon columns) for every point in or on a polygon."""
    lat, lon = at
    placed = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        point_key, F.col(lon).alias("_px"), F.col(lat).alias("_py")).selectExpr(
        "*", f"floor(_px / {cell_degrees!r}D) AS cx", f"floor(_py / {cell_degrees!r}D) AS cy", "0L AS cz")
    cells = _polygon_cells(polygons, polygon_key, rings, cell_degrees, extra)
    return spatial._cell_join(placed, cells, crowded_rows).where(covers("_edges", "_px", "_py")).select(point_key, polygon_key, *extra)


def assign_areas(points: DataFrame, tracts: DataFrame, counties: DataFrame, point_key: str, **options) -> DataFrame:
    """Tract and county of each point with how it was decided.

    A point on a shared boundary hits two areas and stays unassigned there; that label wins over
    "outside".
    """
    result = points
    ambiguous = F.lit(False)
    for areas, key in ((tracts, "tract_geoid"), (counties, "county_geoid")):
        hits = points_in_polygons(points, areas, point_key, key, **options).groupBy(point_key).agg(
            F.min(key).alias("_low"), F.max(key).alias("_high"))
        result = result.join(hits, point_key, "left").withColumns({
            key: F.when(F.col("_low") == F.col("_high"), F.col("_low")),
            f"_many_{key}": F.coalesce(F.col("_low") != F.col("_high"), F.lit(False))}).drop("_low", "_high")
        ambiguous = ambiguous | F.col(f"_many_{key}")
    lat, lon = options.get("at", ("latitude", "longitude"))
    located = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    label = (F.when(F.col("tract_geoid").isNotNull() & F.col("county_geoid").isNotNull(), F.lit("point_in_2023_polygons"))
             .when(ambiguous, F.lit("ambiguous_boundary")).when(located, F.lit("outside_reference_or_partial_match")).otherwise(F.lit("unlocated")))
    return result.withColumn("geography_assignment", label).drop("_many_tract_geoid", "_many_county_geoid")


# --- candidate points ------------------------------------------------------------------------

# Lattice positions inside the bounding box, in order.
LATTICE = ((.35, .35), (.65, .65), (.35, .65), (.65, .35), (.5, .25), (.5, .75))


def with_interior_point(df: DataFrame, rings: str, x: str, y: str) -> DataFrame:
    """Middle of the widest inner stretch of a scan line halfway between the vertices around mid height."""
    framed = df.withColumn("_e", edges(rings)).selectExpr("*", f"transform(flatten({rings}), p -> p.y) AS _ys").selectExpr(
        "*", "(array_min(_ys) + array_max(_ys)) / 2 AS _mid").selectExpr(
        "*", "(array_max(filter(_ys, v -> v <= _mid)) + coalesce(array_min(filter(_ys, v -> v > _mid)), array_max(_ys))) / 2 AS _scan").selectExpr(
        "*", "array_sort(transform(filter(_e, e -> (e.y1 > _scan) <> (e.y2 > _scan)), e -> e.x1 + (e.x2 - e.x1) * (_scan - e.y1) / (e.y2 - e.y1))) AS _cuts").selectExpr(
        "*", "transform(sequence(0, size(_cuts) div 2 - 1), i -> named_struct('w', _cuts[2 * i + 1] - _cuts[2 * i], 'x', (_cuts[2 * i] + _cuts[2 * i + 1]) / 2)) AS _spans")
    return framed.withColumns({x: F.expr("CASE WHEN size(_cuts) >= 2 THEN array_max(_spans).x END"), y: F.col("_scan")}).drop(
        "_e", "_ys", "_mid", "_scan", "_cuts", "_spans")


def candidate_points(polygons: DataFrame, key: str, rings: str = "rings", count: int = 1) -> DataFrame:
    """key, ordinal, latitude, longitude: interior point, covered centroid, covered lattice points, up to ``count``."""
    framed = with_interior_point(polygons, rings, "_ix", "_iy")
    framed = with_centroid(framed, rings, "_gx", "_gy").withColumn("_e", edges(rings)).selectExpr(
        "*", "array_min(transform(_e, e -> least(e.x1, e.x2))) AS _x0", "array_max(transform(_e, e -> greatest(e.x1, e.x2))) AS _x1",
        "array_min(transform(_e, e -> least(e.y1, e.y2))) AS _y0", "array_max(transform(_e, e -> greatest(e.y1, e.y2))) AS _y1")
    lattice = ", ".join(f"named_struct('x', _x0 + (_x1 - _x0) * {fx}D, 'y', _y0 + (_y1 - _y0) * {fy}D)" for fx, fy in LATTICE)
    inside = f"({_on_edge('_e', 'p.x', 'p.y')}) OR ({_inside('_e', 'p.x', 'p.y')})"
    # The interior point always stays; the centroid is kept if covered; lattice points must also be new.
    listed = framed.selectExpr(
        "*", f"concat(array(named_struct('x', _ix, 'y', _iy)), filter(array(named_struct('x', _gx, 'y', _gy)), p -> {inside})) AS _fixed",
        f"filter(array({lattice}), p -> {inside}) AS _extra").selectExpr(
        "*", "aggregate(_extra, _fixed, (acc, p) -> CASE WHEN exists(acc, q -> sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) <= 1e-10D) "
        "THEN acc ELSE concat(acc, array(p)) END) AS _points")
    return listed.select(key, F.posexplode(F.slice("_points", 1, count)).alias("candidate_ordinal", "p")).select(
        key, "candidate_ordinal", F.col("p.y").alias("latitude"), F.col("p.x").alias("longitude"))


def site_ids(points: DataFrame, key: str) -> DataFrame:
    """Deterministic site id from area, ordinal and coordinates to six places."""
    raw = F.format_string("%s|%d|%.6f|%.6f", F.col(key).cast("string"), "candidate_ordinal", "latitude", "longitude")
    return points.withColumn("site_id", F.concat(F.lit("S6F-"), F.left(F.sha1(raw), F.lit(14))))


# --- overlay ---------------------------------------------------------------------------------

def _flat(edge_array: str) -> Column:
    """Edges as one array of doubles: a compact, copy-free column on the Python side."""
    return F.expr(f"flatten(transform({edge_array}, e -> array(e.x1, e.y1, e.x2, e.y2)))")


def _edge_rows(value) -> np.ndarray:
    return np.asarray(value, dtype=float).reshape(-1, 4)


def _breaks(all_edges: np.ndarray) -> np.ndarray:
    """Sorted x positions between which no two edges cross."""
    x1, y1, x2, y2 = all_edges.T
    found = [x1, x2]
    dx, dy = x2 - x1, y2 - y1
    for start in range(0, len(all_edges), 256):
        i = slice(start, start + 256)
        den = dx[i, None] * dy - dy[i, None] * dx
        ox, oy = x1 - x1[i, None], y1 - y1[i, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (ox * dy - oy * dx) / den
            u = (ox * dy[i, None] - oy * dx[i, None]) / den
        row, col = np.nonzero((den != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1))
        found.append(x1[i][row] + t[row, col] * dx[i][row])
    return np.unique(np.concatenate(found))


def _spans(edge_rows: np.ndarray, owner: np.ndarray, x: float) -> np.ndarray:
    """Inside stretches on a vertical line, rows (low, high), of all polygons at once; ``owner`` tells whose edge it is."""
    x1, y1, x2, y2 = edge_rows.T
    cut = (x1 > x) != (x2 > x)
    ys = y1[cut] + (y2[cut] - y1[cut]) * (x - x1[cut]) / (x2[cut] - x1[cut])
    return ys[np.lexsort((ys, owner[cut]))].reshape(-1, 2)


def _merged(spans: np.ndarray) -> np.ndarray:
    """Union of stretches as disjoint sorted rows."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0])]
    tops = np.maximum.accumulate(spans[:, 1])
    starts = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > tops[:-1]]))
    return np.column_stack([spans[starts, 0], tops[np.concatenate([starts[1:] - 1, [len(spans) - 1]])]])


def covered_area(area: np.ndarray, covers_: list[np.ndarray], low: float = -math.inf, high: float = math.inf) -> float:
    """Area of (polygon and union of polygons) for x in [low, high): widths of slabs times covered height at mid slab."""
    cover = np.vstack(covers_)
    owner = np.repeat(np.arange(len(covers_)), [len(c) for c in covers_])
    left, right = max(area[:, [0, 2]].min(), low), min(area[:, [0, 2]].max(), high)
    if not left < right:
        return 0.0
    xs = _breaks(np.vstack([area, cover]))
    xs = np.unique(np.concatenate([xs[(xs > left) & (xs < right)], [left, right]]))
    own = np.zeros(len(area), dtype=int)
    total = 0.0
    for a, b in zip(xs[:-1], xs[1:]):
        mid = (a + b) / 2
        mine = _spans(area, own, mid)
        if not len(mine):
            continue
        theirs = _merged(_spans(cover, owner, mid))
        shared = np.minimum(mine[:, None, 1], theirs[None, :, 1]) - np.maximum(mine[:, None, 0], theirs[None, :, 0])
        total += (b - a) * float(np.maximum(shared, 0.0).sum())
    return total


METRES_PER_DEGREE = 111_320.0
STRIP_MEMBERS = 64  # partial overlaps of one area handled together before its width is cut into strips


def overlay(areas: DataFrame, designations: DataFrame, key: str, rings: str = "rings", *, cell_metres: float = 50_000.0) -> tuple[DataFrame, DataFrame]:
    """(links, coverage).

    links: key, designation_id, designation_kind, overlap_area_m2, boundary_area_fraction for every
    positive overlap. coverage: key, designation_kind, designation_count, boundary_area_fraction of the union.
    """
    def shaped(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
        """Projected edges of each polygon, with their bounding box and that of the rings in degrees."""
        framed = df.withColumn("_p", projected(rings)).select(*columns, edges("_p").alias("_e"), F.expr(f"flatten({rings})").alias("_d"))
        return settle(framed.select(
            *columns, _flat("_e").alias(name),
            *[F.expr(f"array_{f}(transform(_e, e -> {g}(e.{t}1, e.{t}2))) AS {name}_{t}{n}") for t in "xy" for n, f, g in ((0, "min", "least"), (1, "max", "greatest"))],
            *[F.expr(f"array_{f}(transform(_d, p -> p.{t})) AS {name}_d{t}{n}") for t in "xy" for n, f in ((0, "min"), (1, "max"))]))

    left = shaped(areas, [key], "_area")
    placed = shaped(with_shape(designations), ["_shape", "designation_id", "designation_kind"], "_cover")
    # Equal shapes are measured once, under the first of their keys.
    boxes = [c for c in placed.columns if c.startswith("_cover_")]
    right = settle(placed.groupBy("_cover").agg(F.concat_ws("/", F.min("_shape"), F.xxhash64("_cover")).alias("_form"), *[F.first(c).alias(c) for c in boxes]))
    members = settle(placed.select("_shape", "designation_id", "designation_kind", "_cover").join(right.select("_cover", "_form"), "_cover").drop("_cover"))
    pairs = _bbox_pairs(left, right, key, cell_metres / METRES_PER_DEGREE)

    def measure(batches):
        for batch in batches:
            shapes = [(_edge_rows(a), _edge_rows(c)) for a, c in zip(batch["_area"], batch["_cover"])]
            batch["overlap_area_m2"] = [covered_area(a, [c]) for a, c in shapes]
            batch["area_m2"] = [abs(float((a[:, 0] * a[:, 3] - a[:, 2] * a[:, 1]).sum()) / 2) for a, _ in shapes]
            yield batch[[key, "_form", "overlap_area_m2", "area_m2"]]

    kind = left.schema[key].dataType.simpleString()
    # The work per pair dwarfs its bytes, so the task count must not follow the bytes.
    measured = pairs.repartition(parallel_tasks(pairs.sparkSession), key, "_form").mapInPandas(
        measure, f"{key} {kind}, _form string, overlap_area_m2 double, area_m2 double")
    shapes = settle(settle(measured.where(F.col("overlap_area_m2") > 0)).join(members, "_form"))
    links = shapes.groupBy(key, "designation_id", "designation_kind").agg(
        F.max("overlap_area_m2").alias("overlap_area_m2"), F.max("area_m2").alias("area_m2"), F.min("_form").alias("_low"), F.max("_form").alias("_high"))
    if "component" in designations.columns:
        # Several components of one designation in one area count once where they overlap.
        several = settle(links.where("_low <> _high"))
        links = links.join(_union_areas(several, shapes, left, right, key, "designation_id"), [key, "designation_id"], "left").withColumn(
            "overlap_area_m2", F.coalesce("union_m2", "overlap_area_m2")).drop("union_m2")
    links = settle(links.withColumn("boundary_area_fraction", F.col("overlap_area_m2") / F.col("area_m2")))
    totals = links.groupBy(key, "designation_kind").agg(
        F.count("*").alias("designation_count"), F.max("area_m2").alias("area_m2"),
        F.max("boundary_area_fraction").alias("_largest"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    # One designation already covers the area, or a single shape touches it: nothing to unite.
    open_ = totals.where((F.col("_largest") < 1 - 1e-12) & (F.col("_low") != F.col("_high")))
    united = _union_areas(open_, shapes, left, right, key, "designation_kind")
    coverage = totals.join(united, [key, "designation_kind"], "left").select(
        key, "designation_kind", "designation_count",
        F.least(F.coalesce(F.col("union_m2") / F.col("area_m2"), "_largest"), F.lit(1.0)).alias("boundary_area_fraction"))
    return links.select(key, "designation_id", "designation_kind", "overlap_area_m2", "boundary_area_fraction"), coverage


def with_shape(designations: DataFrame) -> DataFrame:
    """A key for each polygon: the designation, or its component if it comes in several."""
    parts = ["designation_id", *[c for c in ("component",) if c in designations.columns]]
    return designations.withColumn("_shape", F.concat_ws("/", *[F.col(c).cast("string") for c in parts]))


def _bbox_pairs(left: DataFrame, right: DataFrame, key: str, size: float) -> DataFrame:
    """Areas and shapes whose boxes in degrees overlap. Only boxes travel through the cell join."""
    w = f"{size!r}D"

    def celled(df: DataFrame, name: str, column: str) -> DataFrame:
        return df.select(column, *[f"{name}_d{t}{n}" for t in "xy" for n in (0, 1)]).selectExpr(
            "*", f"explode(sequence(floor({name}_dx0 / {w}), floor({name}_dx1 / {w}))) AS cx").selectExpr(
            "*", f"explode(sequence(floor({name}_dy0 / {w}), floor({name}_dy1 / {w}))) AS cy", "0L AS cz")

    met = spatial._cell_join(celled(left, "_area", key), celled(right, "_cover", "_form"), spatial.CROWDED_ROWS).where(
        "_area_dx0 < _cover_dx1 AND _cover_dx0 < _area_dx1 AND _area_dy0 < _cover_dy1 AND _cover_dy0 < _area_dy1 "
        # Two boxes may share several cells: the pair is kept in the first one only.
        f"AND cx = floor(greatest(_area_dx0, _cover_dx0) / {w}) AND cy = floor(greatest(_area_dy0, _cover_dy0) / {w})")
    return met.select(key, "_form").join(left.select(key, "_area"), key).join(right.select("_form", "_cover"), "_form")


def _union_areas(open_: DataFrame, shapes: DataFrame, left: DataFrame, right: DataFrame, key: str, group: str) -> DataFrame:
    """key, group, union_m2 of the shapes of a group in an area. Areas with many are cut into vertical strips, one task group each."""
    # Copies of one shape count once.
    forms = shapes.join(open_.select(key, group), [key, group], "left_semi").select(key, group, "_form").distinct()
    counts = forms.groupBy(key, group).agg(F.ceil(F.count("*") / STRIP_MEMBERS).cast("int").alias("_strips"))
    shaped = counts.join(left, key).selectExpr(
        "*", "explode(sequence(0, _strips - 1)) AS _strip").selectExpr(
        "*", "_area_x0 + (_area_x1 - _area_x0) * _strip / _strips AS _low", "_area_x0 + (_area_x1 - _area_x0) * (_strip + 1) / _strips AS _high")
    grouped = shaped.join(forms.join(right, "_form"), [key, group]).where("_cover_x0 < _high AND _cover_x1 > _low").select(
        key, group, "_strip", "_cover", "_area", "_low", "_high")
    kinds = {c: shapes.schema[c].dataType.simpleString() for c in (key, group)}

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        value = covered_area(_edge_rows(row["_area"]), [_edge_rows(c) for c in pdf["_cover"]], row["_low"], row["_high"])
        return pd.DataFrame({key: [row[key]], group: [row[group]], "part_m2": [value]})

    grouped = grouped.repartition(parallel_tasks(grouped.sparkSession), key, group, "_strip")
    parts = grouped.groupBy(key, group, "_strip").applyInPandas(unite, f"{key} {kinds[key]}, {group} {kinds[group]}, part_m2 double")
    return parts.groupBy(key, group).agg(F.sum("part_m2").alias("union_m2"))
