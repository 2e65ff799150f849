"""Lossless staging: any delimited text -> all-string table, with the checks that make it safe."""
from __future__ import annotations

import itertools
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ..operators.checks import ContractError, duplicate_keys, require_none, require_rows
from ..session import settle

CORRUPT = "_bad_record"
LEGACY = "windows-1252"


def normalize_headers(headers: Sequence[str | None]) -> list[str]:
    """Column names of lower-case letters, digits and single underscores, all different.

    A header without any of these characters is named after its position. Of headers with the same name the second
    one gets __2 and so on, passing over names that are taken.
    """
    plain = ["_".join(re.findall("[a-z0-9]+", strip_text(h).lower())) for h in headers]
    plain = [name or f"column_{place}" for place, name in enumerate(plain, 1)]
    used: set[str] = set()

    def free(name: str) -> str:
        wanted = next(w for w in itertools.chain([name], (f"{name}__{n}" for n in itertools.count(2))) if w not in used)
        used.add(wanted)
        return wanted

    return [free(name) for name in plain]


def strip_text(value: str | None) -> str:
    return (value or "").strip()


def choose_encoding(identity: str, source: str, overrides: Mapping[str, str], legacy: Sequence[str]) -> str:
    """Override for the table, then for the source, then the list of legacy-encoded tables, then UTF-8."""
    return overrides.get(identity, overrides.get(source, LEGACY if identity in legacy else "utf-8"))


def undecodable(encoding: str) -> Column:
    """Whether a line (``value``) has bytes that the encoding does not define."""
    if encoding.lower().replace("-", "") == "utf8":
        return ~F.is_valid_utf8("value")
    # The five byte values this code page leaves undefined.
    undefined = F.hex(F.to_binary("value", F.lit("utf-8")))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.length(undefined) / 2 - 1, F.lit(0)).cast("int")),
                        lambda i: F.substring(undefined, i * 2 + 1, F.lit(2)))
    return F.arrays_overlap(pairs, F.array(*[F.lit(b) for b in ("81", "8D", "8F", "90", "9D")]))


def undecodable_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """Lines with such bytes. The CSV reader would replace them silently."""
    return spark.read.text(path).where(undecodable(encoding))


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether any quoted field contains a line break (some line has an odd number of quotes)."""
    return not spark.read.text(path).where(F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1).isEmpty()


def _options(encoding: str, separator: str, multi_line: bool) -> dict:
    return {"sep": separator, "encoding": encoding, "multiLine": str(multi_line).lower(), "quote": '"', "escape": '"',
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"}


def stage_csv(spark: SparkSession, path: str, encoding: str = "utf-8", separator: str = ",",
              drop_blank_tail: bool = False, multi_line: bool | None = None) -> DataFrame:
    """All-string table with normalised names; blanks stay '' and are never null.

    A row with the wrong number of fields fails the table. Files without quoted line breaks are
    read in splits. ``drop_blank_tail`` repairs exports whose header ends in an extra delimiter,
    provided the extra field is blank in every row.

    The file is parsed once, into a settled table; everything that is checked is counted during that write. Its raw
    lines are read only where the caller leaves ``multi_line`` open, and where the parsed text holds the mark that
    replaces undefined bytes and so may hide some.
    """
    before = spark.conf.get("spark.sql.legacy.javaCharsets", None)
    if encoding == LEGACY:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        return _stage_csv(spark, path, encoding, separator, drop_blank_tail, spans_lines(spark, path) if multi_line is None else multi_line)
    finally:
        if encoding == LEGACY:
            if before is None:
                spark.conf.unset("spark.sql.legacy.javaCharsets")
            else:
                spark.conf.set("spark.sql.legacy.javaCharsets", before)


def _stage_csv(spark: SparkSession, path: str, encoding: str, separator: str, drop_blank_tail: bool, multi_line: bool) -> DataFrame:
    options = _options(encoding, separator, multi_line)
    first = spark.read.options(**options).csv(path, header=False, inferSchema=False).first()
    if first is None:
        raise ContractError(f"{path}: no header")
    headers = [v if v is not None else "" for v in first]
    names = normalize_headers(headers)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(CORRUPT, T.StringType())])
    rows = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, enforceSchema="true").csv(
        path, header=True, schema=schema)
    rows = rows.select(*[F.coalesce(F.col(n), F.lit("")).alias(n) for n in names], CORRUPT)
    tail = F.lit(False)
    if drop_blank_tail and headers[-1] == "":
        # Rows that already lack the trailing delimiter are one field short and are accepted here.
        outside = re.escape(separator) + '(?=(?:[^"]*"[^"]*")*[^"]*$)'  # a separator within quotes is text
        fields = F.size(F.split(F.coalesce(F.col(CORRUPT), F.lit("")), outside))
        rows = rows.withColumn(CORRUPT, F.when(fields == len(names) - 1, F.lit(None)).otherwise(F.col(CORRUPT)))
        tail = F.col(names[-1]) != ""
        names = names[:-1]
    replaced = F.exists(F.array(*[F.col(c) for c in rows.columns]), lambda v: v.contains("\ufffd"))
    seen = Observation()
    # the checks are made on rows as parsed, all columns of which are read
    watched = rows.withColumns({"_ragged": F.col(CORRUPT).isNotNull(), "_tail": tail, "_replaced": F.coalesce(replaced, F.lit(False))})
    staged = settle(watched.observe(seen, F.count_if("_ragged").alias("ragged"), F.count_if("_tail").alias("tail"), F.count_if("_replaced").alias("replaced"))
                    .drop("_tail", "_replaced"))
    counts = seen.get
    if counts["replaced"] or any("\ufffd" in h for h in headers):
        require_none(undecodable_lines(spark, path, encoding), f"{path}: bytes not valid in {encoding}")
    if counts["tail"]:
        raise ContractError(f"{path}: extra field is not blank in {counts['tail']} rows")
    if counts["ragged"]:
        require_none(staged.where("_ragged").select(CORRUPT), f"{path}: wrong number of fields")
    return staged.select(*names)


def ragged_rows(rows: DataFrame) -> DataFrame:
    """Raw text of rows with too few or too many fields. All columns are read so that nothing is skipped."""
    read = F.length(F.concat_ws("", *[F.col(c) for c in rows.columns if c != CORRUPT]))
    return rows.where(F.col(CORRUPT).isNotNull() & (read >= 0)).select(CORRUPT)


def column_profile(staged: DataFrame) -> DataFrame:
    """position, column, empty_strings, rows: one pass."""
    counts = staged.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c) == "").alias(c) for c in staged.columns])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(c).alias("empty_strings"), F.col("_rows").alias("rows"))
        for i, c in enumerate(staged.columns, 1)])).alias("p")).select("p.*")


# --- inventory -------------------------------------------------------------------------------

# Fixed value: names of road extracts, which are listed without being read.
ROAD_FILES = r"\.osm\.pbf$"


def inventory(spark: SparkSession, root: str, deferred: str = ROAD_FILES) -> DataFrame:
    """source, path, bytes, modified, sha256, hash_status for every file under root/<source>/.

    Files whose path matches ``deferred`` are listed but their content is not read. Others are hashed whatever their
    size; the file source behind this takes files of up to 2 GiB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    named = files.where(~F.col("path").endswith(".receipt.json") & ~F.col("path").endswith(".part"))
    relative = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    columns = [relative.alias("path"), F.substring_index(relative, "/", 1).alias("source"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")]
    hashed = named.where(~F.col("path").rlike(deferred)).select(*columns, F.sha2("content", 256).alias("sha256"), F.lit("computed").alias("hash_status"))
    listed = named.where(F.col("path").rlike(deferred)).select(*columns, F.lit(None).cast("string").alias("sha256"), F.lit("deferred").alias("hash_status"))
    return hashed.unionByName(listed)


def inventory_issues(files: DataFrame, expected: DataFrame) -> DataFrame:
    """source, error: expected sources without inputs, empty files."""
    missing = expected.join(files.select("source").distinct(), "source", "left_anti").select("source", F.lit("Source has no inputs").alias("error"))
    empty = files.where(F.col("bytes") == 0).select("source", F.lit("Empty input").alias("error"))
    return missing.unionByName(empty)


def checksum_mismatches(files: DataFrame, receipts: DataFrame) -> DataFrame:
    """Files whose hash differs from the receipt (path, sha256), ignoring case."""
    told = receipts.select("path", F.lower("sha256").alias("expected"))
    return files.join(told, "path").where(F.col("expected") != F.col("sha256")).select("path", "sha256", "expected")


def changed_inputs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files added, removed, resized or touched between two inventories."""
    a = before.select("path", F.col("bytes").alias("b1"), F.col("modified").alias("m1"))
    b = after.select("path", F.col("bytes").alias("b2"), F.col("modified").alias("m2"))
    both = a.join(b, "path", "full")
    change = (F.when(F.col("b1").isNull(), F.lit("added")).when(F.col("b2").isNull(), F.lit("removed"))
              .when((F.col("b1") != F.col("b2")) | (F.col("m1") != F.col("m2")), F.lit("changed")))
    return both.withColumn("change", change).where(F.col("change").isNotNull()).select("path", "change")


# --- archives --------------------------------------------------------------------------------

def zip_rows(spark: SparkSession, path: str, encoding: str = "utf-8-sig") -> DataFrame:
    """archive, member, line, fields for every CSV record in the archives under a folder."""
    return archive_rows(_zip_files(spark, path), encoding)


def _zip_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("path"), "content")


def archive_rows(archives: DataFrame, encoding: str = "utf-8-sig") -> DataFrame:
    """The same for a frame of (path, content); one task per archive.

    A ZIP file can only be read by one reader. Records are streamed, members are not unpacked.
    """
    schema = "archive string, member string, line long, fields array<string>"

    def members(batches):
        import csv
        import io
        from zipfile import ZipFile

        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with ZipFile(io.BytesIO(content)) as archive:
                    for info in archive.infolist():
                        if info.is_dir() or not info.filename.lower().endswith(".csv"):
                            continue
                        with archive.open(info) as raw:
                            reader = csv.reader(io.TextIOWrapper(raw, encoding=encoding, newline=""), strict=True)
                            rows = []
                            for line, fields in enumerate(reader):
                                rows.append((name, info.filename, line, fields))
                                if len(rows) >= 5_000:
                                    yield pd.DataFrame(rows, columns=["archive", "member", "line", "fields"])
                                    rows = []
                            if rows:
                                yield pd.DataFrame(rows, columns=["archive", "member", "line", "fields"])

    return archives.mapInPandas(members, schema)


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, bytes of everything in the archives under a folder, from their directories."""
    return archive_members(_zip_files(spark, path))


def archive_members(archives: DataFrame) -> DataFrame:
    """The same for a frame of (path, content). A member that is there twice is listed twice."""
    def listing(batches):
        import io
        from zipfile import ZipFile

        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with ZipFile(io.BytesIO(content)) as archive:
                    yield pd.DataFrame([(name, i.filename, i.file_size) for i in archive.infolist() if not i.is_dir()],
                                       columns=["archive", "member", "bytes"])

    return archives.mapInPandas(listing, "archive string, member string, bytes long")


def duplicate_members(members: DataFrame) -> DataFrame:
    return duplicate_keys(members, ["archive", "member"])


def member_table(rows: DataFrame, archive: str, member: str) -> DataFrame:
    """One member of ``zip_rows`` as an all-string table; wrong field counts fail it."""
    mine = rows.where((F.col("archive") == archive) & (F.col("member") == member))
    head = mine.where(F.col("line") == 0).first()
    if head is None:
        raise ContractError(f"{archive}::{member}: no header")
    names = normalize_headers(head["fields"])
    body = mine.where(F.col("line") > 0)
    require_none(body.where(F.size("fields") != len(names)).select("line"), f"{archive}::{member}: wrong number of fields")
    return body.select(*[F.col("fields")[i].alias(n) for i, n in enumerate(names)])


# --- catalog and other inputs ----------------------------------------------------------------

def _glob_regex(pattern: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def select_table(catalog: DataFrame, pattern: str) -> dict:
    """The one catalog entry whose input matches the glob pattern."""
    hits = catalog.where(F.col("input").rlike(_glob_regex(pattern))).limit(2).collect()
    if len(hits) != 1:
        raise ContractError(f"Expected exactly one table for {pattern}, found {'none' if not hits else 'several'}")
    return hits[0].asDict()


def load_table(spark: SparkSession, entry: Mapping) -> DataFrame:
    """Parquet of a catalog entry, checked against its recorded row count."""
    df = spark.read.parquet(entry["path"])
    rows = df.count()
    if rows != entry["rows"]:
        raise ContractError(f"{entry['input']}: {rows} rows, catalog says {entry['rows']}")
    return df


def read_area_file(spark: SparkSession, path: str, key: str = "GEO_ID") -> DataFrame:
    """Pipe-delimited national file cut down to tract and county rows, keys unique."""
    from ..plans.survey import area_rows

    names = spark.read.options(**_options("utf-8", "|", False)).csv(path, header=True, inferSchema=False).columns
    if key not in names:
        raise ContractError(f"{path}: no {key}")
    return area_rows(_strict_rows(spark, path, names, "|", header=True), key)


def _strict_rows(spark: SparkSession, path: str, names: Sequence[str], separator: str, header: bool) -> DataFrame:
    """Text columns of a delimited file, blanks as ''; a line with too few or too many fields is an error."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    rows = spark.read.options(**_options("utf-8", separator, False), mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT).csv(
        path, header=header, schema=schema)
    require_none(ragged_rows(rows), f"{path}: wrong number of fields")
    return rows.select(*[F.coalesce(F.col(n), F.lit("")).alias(n) for n in names])


# Columns of a headerless geocoder reply.
REPLY_COLUMNS = ["id", "input_address", "match_status", "match_type", "matched_address", "coordinates", "tiger_line_id",
                 "tiger_line_side", "state_fips", "county_fips", "tract", "block"]


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    """Replies of twelve fields each; blanks become null. Any other line is an error."""
    rows = _strict_rows(spark, path, REPLY_COLUMNS, ",", header=False)
    return rows.select(*[F.when(F.col(c) != "", F.col(c)).alias(c) for c in REPLY_COLUMNS])


def read_geocode_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached answers, one JSON object per line: key, address, benchmark, status, longitude, latitude, fetched_utc."""
    schema = ("key string, address array<string>, benchmark string, status string, longitude double, latitude double, fetched_utc string")
    rows = spark.read.schema(schema).json(path).withColumnRenamed("fetched_utc", "geocode_fetched_utc")
    from ..plans.registry import invalid_answers

    require_none(invalid_answers(rows).select("key"), "Cached answers with impossible coordinates")
    return rows


def columns_or(df: DataFrame, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """Project to ``wanted`` names, each from the first of its accepted columns that exists (null otherwise)."""
    def pick(names: Sequence[str]) -> Column:
        present = next((n for n in names if n in df.columns), None)
        return F.col(present) if present else F.lit(None)

    return df.select(*[pick(names).alias(name) for name, names in wanted.items()])


def register_views(spark: SparkSession, required: Mapping[str, str], optional: Mapping[str, str] | None = None) -> list[str]:
    """Temp views over Parquet; a missing optional table is left out, a missing required one is an error."""
    from pyspark.errors import AnalysisException

    registered = []
    for name, path in {**required, **(optional or {})}.items():
        try:
            spark.read.parquet(path).createOrReplaceTempView(name)
        except AnalysisException:
            if name in required:
                raise
            continue
        registered.append(name)
    return registered


def require_staged(staged: DataFrame) -> None:
    """A staged table has rows and only string columns."""
    require_rows(staged, 1, "staged rows")
    if any(kind != "string" for _, kind in staged.dtypes):
        raise ContractError("Staged tables hold text only")
