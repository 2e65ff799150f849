"""Writers: Zstd Parquet, versioned runs, rejects, columnar bundles, GeoJSON rows, location files."""
from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ..operators.checks import ContractError
from ..plans.serving import STATE_ROWS, county_name


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Zstd Parquet, read back and checked for row and column parity.

    Rows are counted while they are written and compared with what the files say they hold."""
    return _written(df, path, partition_by)[0]


def _written(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> tuple[DataFrame, int]:
    seen = Observation()
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    watched.write.mode("errorifexists").option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    back = df.sparkSession.read.parquet(path)
    if set(back.columns) != set(df.columns):
        raise ContractError(f"{path}: columns differ after writing")
    rows = back.count()
    if rows != seen.get["rows"]:
        raise ContractError(f"{path}: {seen.get['rows']} rows written, {rows} rows in the files")
    return back, rows


def publish(df: DataFrame, root: str, table: str, run_id: str | None = None) -> str:
    """Append one run of a table and, once it is complete, its row in the runs table."""
    run_id = run_id or uuid.uuid4().hex
    path = f"{root}/{table}/run_id={run_id}"
    written, _ = _written(df, path)
    note_run(df.sparkSession, root, table, run_id, "complete", written.agg(F.count("*").alias("rows")))
    return run_id


def note_run(spark: SparkSession, root: str, table: str, run_id: str, status: str, rows: DataFrame) -> None:
    rows.select(F.lit(table).alias("table"), F.lit(run_id).alias("run_id"), F.lit(status).alias("status"), "rows",
                F.current_timestamp().alias("finished")).write.mode("append").parquet(f"{root}/_runs")


def latest_run(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The most recently completed run of a table; unfinished and failed runs are not seen."""
    done = spark.read.parquet(f"{root}/_runs").where((F.col("table") == table) & (F.col("status") == "complete"))
    newest = done.agg(F.max_by("run_id", F.struct("finished", "run_id")).alias("run_id")).first()["run_id"]
    if newest is None:
        raise ContractError(f"No completed run of {table}")
    return spark.read.parquet(f"{root}/{table}/run_id={newest}")


def write_with_rejects(good: DataFrame, rejected: DataFrame, root: str, table: str) -> None:
    """The table and, next to it, the rows that were left out with their reasons."""
    write_table(good, f"{root}/{table}")
    write_table(rejected, f"{root}/{table}_rejected")


def to_bundles(df: DataFrame, key: str, rows_per_bundle: int = 5_000) -> DataFrame:
    """Column-wise JSON rows: one array per column, about ``rows_per_bundle`` rows in each.

    Rows are dealt to bundles by a hash of the key, so bundles are even whatever the data.
    """
    bundles = max(1, -(-df.count() // rows_per_bundle))
    dealt = df.withColumn("_bundle", F.pmod(F.xxhash64(key), F.lit(bundles)))
    rows = dealt.groupBy("_bundle").agg(F.array_sort(F.collect_list(F.struct(key, *[c for c in df.columns if c != key]))).alias("r"))
    return rows.select(F.lit(1).alias("version"), F.struct(*[F.col(f"r.{c}").alias(c) for c in df.columns]).alias("columns"))


def write_bundles(df: DataFrame, key: str, path: str, rows_per_bundle: int = 5_000) -> None:
    to_bundles(df, key, rows_per_bundle).write.mode("errorifexists").option("compression", "gzip").option("ignoreNullFields", "false").json(path)


def read_bundles(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Back to rows. ``columns`` is the DDL of the bundled columns."""
    row = T.StructType.fromDDL(columns)
    schema = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("columns", T.StructType(
        [T.StructField(f.name, T.ArrayType(f.dataType)) for f in row.fields]))])
    bundles = spark.read.schema(schema).json(path)
    wrong = bundles.where(F.col("version") != 1).limit(1).count()
    if wrong:
        raise ContractError("Unknown bundle version")
    zipped = F.arrays_zip(*[F.col(f"columns.{f.name}").alias(f.name) for f in row.fields])
    return bundles.select(F.explode(zipped).alias("r")).select("r.*")


def plain(df: DataFrame, name: str) -> Column:
    """Column as a JSON-safe scalar: NaN and infinities become null."""
    kind = dict(df.dtypes)[name]
    value = F.col(name)
    if kind in ("double", "float"):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    return value


def candidate_features(rows: DataFrame, score: str = "query_score", rank: str | None = "rank") -> DataFrame:
    """site_id, feature: one GeoJSON Feature per candidate, with presentation aliases."""
    have = set(rows.columns)
    fips = F.lpad(F.coalesce(F.col("state_fips").cast("string"), F.lit("")), 2, "0")
    abbr = F.create_map(*[F.lit(x) for f, a, _ in STATE_ROWS for x in (f, a)])[fips]
    name = F.create_map(*[F.lit(x) for f, _, n in STATE_ROWS for x in (f, n)])[fips]

    def col(*names: str) -> Column:
        present = [plain(rows, n) for n in names if n in have]
        return F.coalesce(*present) if present else F.lit(None)

    saved, speed = col("population_weighted_mean_minutes_saved"), col("stage8_effective_speed_mph")
    aliases = {
        "score": col(score, "stage8_score"), "state": abbr, "state_name": name, "tract_id": col("source_tract_geoid"),
        "county": county_name(rows), "uncovered_population": F.coalesce(col("newly_accessible_population_30min").cast("double"), F.lit(0.0)),
        "nearest_hospital_mi": col("nearest_existing_hospital_estimated_drive_miles"),
        "avg_distance_reduction_mi": F.round(saved.cast("double") * speed.cast("double") / 60.0, 1),
        "tract_population": col("source_population", "population_within_15min"), "density_per_sq_mi": col("source_population_density_per_sq_mi"),
        "density_imputed": F.lit(False), "in_mua": F.coalesce(col("source_in_mua", "in_mua").cast("boolean"), F.lit(False)),
        "in_hpsa": F.coalesce(col("source_in_hpsa", "in_hpsa").cast("boolean"), F.lit(False))}
    if rank and rank in have:
        aliases["rank"] = F.col(rank)
    own = [c for c in rows.columns if c not in ("latitude", "longitude") and c not in aliases]
    properties = F.struct(*[plain(rows, c).alias(c) for c in own], *[v.alias(k) for k, v in aliases.items()])
    return _features(rows, F.col("site_id").cast("string"), F.col("longitude"), F.col("latitude"), properties).withColumnRenamed("id", "site_id")


def point_features(rows: DataFrame, key: str, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """id, feature: plain point features with all other columns as properties."""
    own = [c for c in rows.columns if c not in (lon, lat)]
    return _features(rows, F.col(key).cast("string"), F.col(lon), F.col(lat), F.struct(*[plain(rows, c).alias(c) for c in own]))


def _features(rows: DataFrame, key: Column, lon: Column, lat: Column, properties: Column) -> DataFrame:
    feature = F.struct(F.lit("Feature").alias("type"), key.alias("id"),
                       F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"), properties.alias("properties"))
    return rows.select(key.alias("id"), F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def write_location_csv(rows: DataFrame, path: str, order: Sequence[str]) -> None:
    """Sorted CSV; range-sorted part files follow each other in order."""
    rows.orderBy(*order).write.mode("errorifexists").option("header", "true").csv(path)
