"""Staging, archives, catalogs, published runs. Files are written from the given tables and read back."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sitewise.functions import geo
from sitewise.operators import checks
from sitewise.session import parallel_tasks, settle, shared_folder
from sitewise.sources import sinks, staging

from .registry import case
from .tables import role, table, with_roles


def _place(spark):
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _customers(spark, folder):
    """All text, with blanks, quotes, delimiters and spaces."""
    return table(spark, folder, "customer").selectExpr(
        "string(c_custkey) AS `Customer Key`", "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat(' \"', c_name, '\", ') END AS `Customer Name `",
        "string(c_nationkey) AS `Nation`", "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS `nation `")


def _write_csv(df, path, **options):
    df.write.options(header="true", quoteAll="false", escape='"', emptyValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", **options).csv(path)


@case("src03_src06_staged_csv", """SELECT c_custkey::varchar AS customer_key, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ' "' || c_name || '", ' END AS customer_name, c_nationkey::varchar AS nation,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS nation__2 FROM customer""")
def staged_csv(spark, folder):
    path = _place(spark)
    _write_csv(_customers(spark, folder), path)
    staged = staging.stage_csv(spark, path)
    staging.require_staged(staged)
    return staged


@case("src09_column_profile", """SELECT 1 AS position, 'key' AS "column", 0 AS empty_strings, count(*) AS rows FROM customer
UNION ALL SELECT 2, 'name', count(*) FILTER (c_custkey % 5 = 0), count(*) FROM customer UNION ALL SELECT 3, 'segment', count(*) FILTER (c_custkey % 3 = 0), count(*) FROM customer""")
def column_profile(spark, folder):
    path = _place(spark)
    _write_csv(table(spark, folder, "customer").selectExpr(
        "string(c_custkey) AS Key", "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS Name", "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS Segment"), path)
    return staging.column_profile(staging.stage_csv(spark, path))


@case("src05_legacy_encoding", """SELECT s_suppkey::varchar AS key, 'Niño ' || s_name AS name FROM supplier""")
def legacy_encoding(spark, folder):
    path = _place(spark)
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # for writing the file
    _write_csv(table(spark, folder, "supplier").selectExpr("string(s_suppkey) AS key", "concat('Niño ', s_name) AS name"), path, encoding="windows-1252")
    spark.conf.unset("spark.sql.legacy.javaCharsets")
    encoding = staging.choose_encoding("Source/file.csv", "Source", {}, ["Source/file.csv"])
    return staging.stage_csv(spark, path, encoding)


@case("src07_blank_tail_repair", "SELECT s_suppkey::varchar AS key, s_name AS name FROM supplier")
def blank_tail(spark, folder):
    path = _place(spark)
    lines = table(spark, folder, "supplier").select(F.concat_ws(",", F.col("s_suppkey").cast("string"), "s_name", F.lit("")).alias("value"))
    header = spark.createDataFrame([("Key,Name,",)], "value string")
    header.unionByName(lines).coalesce(1).write.text(path)  # one header line on top of one part file
    return staging.stage_csv(spark, path, drop_blank_tail=True)


@case("src08_ragged_rows", "SELECT count(*) AS ragged FROM supplier WHERE s_suppkey % 4 IN (1, 2)")
def ragged(spark, folder):
    path = _place(spark)
    table(spark, folder, "supplier").selectExpr(
        "CASE s_suppkey % 4 WHEN 1 THEN string(s_suppkey) WHEN 2 THEN concat_ws(',', s_suppkey, s_name, 'extra') ELSE concat_ws(',', s_suppkey, s_name) END AS value").write.text(path)
    rows = spark.read.options(mode="PERMISSIVE", columnNameOfCorruptRecord=staging.CORRUPT).csv(path, schema=f"key string, name string, {staging.CORRUPT} string")
    return staging.ragged_rows(rows).agg(F.count("*").alias("ragged"))


@case("src10_parity", "SELECT count(*) AS rows_in, count(*) AS rows_out, 6 AS columns_in, 6 AS columns_out, true AS equal FROM part")
def parity(spark, folder):
    part = table(spark, folder, "part")
    back = sinks.write_table(part, _place(spark))
    return checks.parity(part, back)


@case("src01_src02_inventory", """SELECT s_nationkey::varchar AS source, count(*) AS files, count(*) FILTER (s_suppkey % 4 = 0) AS wrong_checksums FROM supplier GROUP BY 1""")
def inventory(spark, folder):
    """One small file per supplier in a folder per nation; a quarter of the receipts carry a wrong hash."""
    path = _place(spark)
    rows = table(spark, folder, "supplier").selectExpr("string(s_nationkey) AS source", "string(s_suppkey) AS file", "concat(s_name, s_suppkey) AS value")
    # One file a supplier is far more work than bytes: many tasks write, and each moves its own files into place.
    rows.repartition(parallel_tasks(spark), "source", "file").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(
        "source", "file").text(path)
    files = settle(staging.inventory(spark, path))  # read three times
    named = files.where(F.col("path").contains("part-")).withColumns({
        "source": F.regexp_extract("path", "source=([0-9]+)", 1), "file": F.regexp_extract("path", "file=([0-9]+)", 1)})
    receipts = named.join(rows, ["source", "file"]).select("path", F.upper(F.sha2(F.concat("value", F.when(
        F.col("file").cast("int") % 4 == 0, F.lit("changed")).otherwise(F.lit("\n"))), 256)).alias("sha256"))
    wrong = staging.checksum_mismatches(named, receipts).withColumn("wrong", F.lit(True))
    return named.join(wrong.select("path", "wrong"), "path", "left").groupBy("source").agg(
        F.count("*").alias("files"), F.count_if(F.col("wrong")).alias("wrong_checksums"))


@case("src12_changed_inputs", """SELECT p_partkey AS path, CASE WHEN p_partkey % 10 = 1 THEN 'removed' WHEN p_partkey % 10 = 2 THEN 'added' ELSE 'changed' END AS change
FROM part WHERE p_partkey % 10 IN (1, 2, 3, 4) UNION ALL SELECT p_partkey + 10000000, CASE WHEN p_partkey % 10 = 2 THEN 'removed' ELSE 'added' END FROM part WHERE p_partkey % 10 IN (1, 2)""")
def changed(spark, folder):
    files = table(spark, folder, "part").selectExpr("p_partkey AS path", "p_size AS bytes", "p_retailprice AS modified")
    # moved before or after: one path is gone and another one new
    after = files.selectExpr("CASE WHEN path % 10 = 1 THEN path + 10000000 ELSE path END AS path", "CASE WHEN path % 10 = 3 THEN bytes + 1 ELSE bytes END AS bytes", "CASE WHEN path % 10 = 4 THEN modified + 1 ELSE modified END AS modified")
    return staging.changed_inputs(files.withColumn("path", F.expr("CASE WHEN path % 10 = 2 THEN path + 10000000 ELSE path END")), after)


@case("src01_missing_sources", """SELECT DISTINCT n_name AS source, 'Source has no inputs' AS error FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT n_name, 'Empty input' FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 6 = 0""")
def missing_sources(spark, folder):
    nation = table(spark, folder, "nation").selectExpr("n_nationkey AS s_nationkey", "n_name AS source")
    files = table(spark, folder, "supplier").join(nation, "s_nationkey").selectExpr("source", "CASE WHEN s_suppkey % 6 = 0 THEN 0 ELSE 10 END AS bytes")
    return staging.inventory_issues(files, nation.select("source"))


@case("src04_src11_zip_members", """SELECT s_nationkey::varchar || '.zip' AS archive, 'm' || (s_suppkey % 3) || '.csv' AS member, count(*) AS rows, sum(s_suppkey) AS keys FROM supplier GROUP BY 1, 2""")
def zip_members(spark, folder):
    """Archives are packed by tasks, one per nation, and read back as CSV records."""
    body = staging.archive_rows(_archives(spark, folder)).where("line > 0")
    return body.groupBy("archive", "member").agg(F.count("*").alias("rows"), F.sum(F.col("fields")[0].cast("long")).alias("keys"))


def _archives(spark, folder, twice: int = 0):
    """Archives of (path, content); one member in ``twice`` nations is packed a second time."""

    def pack(pdf):
        import io
        import warnings
        from zipfile import ZipFile

        import pandas as pd

        warnings.simplefilter("ignore", UserWarning)  # of members with one name
        buffer = io.BytesIO()
        nation = int(pdf["nation"].iloc[0])
        with ZipFile(buffer, "w") as archive:
            for member, rows in pdf.groupby("member"):
                for _ in range(2 if member == 1 and nation < twice else 1):
                    archive.writestr(f"m{member}.csv", "Key,Name\r\n" + "".join(f'{k},"{n}, Inc"\r\n' for k, n in zip(rows["key"], rows["name"])))
            archive.writestr("readme.txt", "not a table")
        return pd.DataFrame({"path": [f"{nation}.zip"], "content": [buffer.getvalue()]})

    rows = table(spark, folder, "supplier").selectExpr("s_nationkey AS nation", "s_suppkey % 3 AS member", "s_suppkey AS key", "s_name AS name")
    return rows.groupBy("nation").applyInPandas(pack, "path string, content binary")


@case("src11_duplicate_members", """SELECT DISTINCT s_nationkey::varchar || '.zip' AS archive, 'm1.csv' AS member FROM supplier WHERE s_nationkey < 12 AND s_suppkey % 3 = 1""")
def duplicate_members(spark, folder):
    return staging.duplicate_members(staging.archive_members(_archives(spark, folder, twice=12))).select("archive", "member")


@case("src13_area_file", """SELECT '1400000US' || lpad(c_custkey::varchar, 11, '0') AS "GEO_ID", c_acctbal::varchar AS value FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT '0500000US' || lpad(s_suppkey::varchar, 5, '0'), 'county' FROM supplier""")
def area_file(spark, folder):
    path = _place(spark)
    rows = table(spark, folder, "customer").selectExpr(
        "CASE WHEN c_custkey % 3 = 0 THEN concat('1400000US', lpad(string(c_custkey), 11, '0')) ELSE concat('8600000US', c_custkey) END AS GEO_ID", "string(c_acctbal) AS value").unionByName(
        table(spark, folder, "supplier").selectExpr("concat('0500000US', lpad(string(s_suppkey), 5, '0')) AS GEO_ID", "'county' AS value"))
    rows.write.options(header="true", sep="|").csv(path)
    return staging.read_area_file(spark, path)


@case("src17_catalog", "SELECT count(*) AS rows, sum(p_size) AS size FROM part")
def catalog(spark, folder):
    part = table(spark, folder, "part")
    path = _place(spark)
    sinks.write_table(part, path)
    entries = part.groupBy(F.lit("PLACES/part_2024.csv").alias("input")).agg(F.count("*").alias("rows")).withColumn("path", F.lit(path)).unionByName(
        part.groupBy(F.lit("SVI/other.csv").alias("input")).agg(F.count("*").alias("rows")).withColumn("path", F.lit("")))
    loaded = staging.load_table(spark, staging.select_table(entries, "PLACES/part_*.csv"))
    return loaded.agg(F.count("*").alias("rows"), F.sum("p_size").alias("size"))


@case("src18_geocode_cache", """SELECT 'k' || s_suppkey AS key, CASE WHEN s_suppkey % 3 = 0 THEN 'No_Match' ELSE 'Match' END AS status, CASE WHEN s_suppkey % 3 <> 0 THEN -90.5::double END AS longitude FROM supplier""")
def geocode_cache(spark, folder):
    path = _place(spark)
    table(spark, folder, "supplier").selectExpr(
        "concat('k', s_suppkey) AS key", "array(s_name, 'TX') AS address", "'Public_AR_Current' AS benchmark", "CASE WHEN s_suppkey % 3 = 0 THEN 'No_Match' ELSE 'Match' END AS status",
        "CASE WHEN s_suppkey % 3 <> 0 THEN -90.5D END AS longitude", "CASE WHEN s_suppkey % 3 <> 0 THEN 30.25D END AS latitude", "'2026' AS fetched_utc").write.json(path)
    return staging.read_geocode_cache(spark, path).select("key", "status", "longitude")


@case("src19_reply_table", """SELECT p_partkey::varchar AS id, CASE WHEN p_partkey % 4 = 0 THEN 'No_Match' ELSE 'Match' END AS match_status, CASE WHEN p_partkey % 4 <> 0 THEN -90 - p_partkey / 1000.0::double END AS lon,
  CASE WHEN p_partkey % 4 <> 0 THEN 30.5::double END AS lat FROM part""")
def reply_table(spark, folder):
    from sitewise.plans.addresses import reply_coordinates
    path = _place(spark)
    table(spark, folder, "part").selectExpr(
        "string(p_partkey) AS id", "concat(p_name, ', Town, TX') AS input_address", "CASE WHEN p_partkey % 4 = 0 THEN 'No_Match' ELSE 'Match' END AS status", "'Exact' AS kind", "'1 Main St, TOWN, TX, 75001' AS matched",
        "CASE WHEN p_partkey % 4 <> 0 THEN concat(-90 - p_partkey / 1000D, ',30.5') END AS coordinates", "'1' AS a", "'L' AS b", "'48' AS c", "'001' AS d", "'1' AS e", "'2' AS f").write.csv(path)
    return reply_coordinates(staging.read_replies(spark, path)).select("id", "match_status", "lon", "lat")


@case("src20_wkt_points", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 0 THEN -90 - s_suppkey / 100.0::double END AS lon, CASE WHEN s_suppkey % 5 <> 0 THEN 30.5::double END AS lat FROM supplier")
def wkt_points(spark, folder):
    rows = table(spark, folder, "supplier").selectExpr("s_suppkey", "-90 - s_suppkey / 100D AS lon", "30.5D AS lat")
    text = rows.select("s_suppkey", F.when(F.col("s_suppkey") % 5 != 0, geo.point_wkt("lon", "lat")).otherwise(F.lit("POINT EMPTY")).alias("w"))
    return text.select("s_suppkey", geo.wkt_lon("w").alias("lon"), geo.wkt_lat("w").alias("lat"))


@case("src21_columnar_bundle", "SELECT p_partkey, p_name, p_retailprice, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS p_size FROM part")
def bundle(spark, folder):
    path = _place(spark)
    rows = table(spark, folder, "part").selectExpr("p_partkey", "p_name", "p_retailprice", "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS p_size")
    sinks.write_bundles(rows, "p_partkey", path, rows_per_bundle=300)
    return sinks.read_bundles(spark, path, "p_partkey bigint, p_name string, p_retailprice double, p_size int")


@case("src22_parquet_views", "SELECT n_name, count(*) AS suppliers FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
def views(spark, folder):
    staging.register_views(spark, {"site_nations": f"{folder}/nation.parquet", "site_suppliers": f"{folder}/supplier.parquet"}, {"site_absent": f"{folder}/absent.parquet"})
    return spark.sql("SELECT n_name, count(*) AS suppliers FROM site_suppliers JOIN site_nations ON n_nationkey = s_nationkey GROUP BY 1")


@case("src23_adaptive_columns", "SELECT s_suppkey AS id, s_acctbal AS balance, NULL::varchar AS phone FROM supplier")
def adaptive(spark, folder):
    picked = staging.columns_or(table(spark, folder, "supplier"), {"id": ["supplier_id", "s_suppkey"], "balance": ["s_acctbal"], "phone": ["s_phone"]})
    return picked.withColumn("phone", F.col("phone").cast("string"))


@case("snk02_latest_run", "SELECT s_suppkey, 2 AS version FROM supplier")
def latest_run(spark, folder):
    root = _place(spark)
    rows = table(spark, folder, "supplier").select("s_suppkey")
    sinks.publish(rows.withColumn("version", F.lit(1)), root, "sites")
    sinks.publish(rows.withColumn("version", F.lit(2)), root, "sites")
    sinks.note_run(spark, root, "sites", "unfinished", "running", rows.agg(F.count("*").alias("rows")))
    return sinks.latest_run(spark, root, "sites")


@case("snk01_snk03_table_with_rejects", "SELECT count(*) FILTER (p_size > 10) AS kept, count(*) FILTER (p_size <= 10) AS rejected FROM part")
def with_rejects(spark, folder):
    root = _place(spark)
    part = table(spark, folder, "part")
    sinks.write_with_rejects(part.where("p_size > 10"), part.where("p_size <= 10").withColumn("reason", F.lit("small")), root, "sites")
    kept, rejected = spark.read.parquet(f"{root}/sites"), spark.read.parquet(f"{root}/sites_rejected")
    return kept.agg(F.count("*").alias("kept")).crossJoin(rejected.where("reason = 'small'").agg(F.count("*").alias("rejected")))  # one row each


@case("snk05_geojson_features", with_roles("final") + """ SELECT site_id::varchar AS site_id, 'Feature' AS kind, longitude AS lon, latitude AS lat, stage8_score AS score,
  CASE lpad(state_fips, 2, '0') WHEN '06' THEN 'CA' WHEN '48' THEN 'TX' END AS state, source_tract_geoid AS tract_id, capacity_score IS NULL AS null_kept FROM final""")
def geojson(spark, folder):
    features = sinks.candidate_features(role(spark, folder, "final"), score="stage8_score")
    get = lambda path: F.get_json_object("feature", path)
    state = get("$.properties.state")
    return features.select(
        "site_id", get("$.type").alias("kind"), get("$.geometry.coordinates[0]").try_cast("double").alias("lon"), get("$.geometry.coordinates[1]").try_cast("double").alias("lat"),
        get("$.properties.score").cast("double").alias("score"), F.when(state.isin("CA", "TX"), state).alias("state"), get("$.properties.tract_id").alias("tract_id"),
        F.col("feature").contains('"capacity_score":null').alias("null_kept"))
