"""Survey tables: special tokens, column pairing, label paths, assembly and enrichment joins."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import as_column, strip
from ..operators.checks import duplicate_keys, malformed_keys, orphans, require_none, require_rows

# Tokens that stand for "no number here", and "1,234+" style thresholds.
SPECIAL_TOKENS = ["", ".", "-", "**", "***", "*****", "N", "(X)", "null", "-222222222", "-333333333", "-555555555",
                  "-666666666", "-888888888", "-999999999"]
THRESHOLD_PATTERN = r"^[0-9,]+[+-]$"
AREA_PATTERN = r"^(1400000US[0-9]{11}|0500000US[0-9]{5})$"


def is_special(raw: Column | str) -> Column:
    text = strip(raw)
    return text.isin(*SPECIAL_TOKENS) | text.rlike(THRESHOLD_PATTERN)


def survey_value(raw: Column | str) -> Column:
    return F.when(~is_special(raw), strip(raw).try_cast("double"))


def survey_annotation(raw: Column | str) -> Column:
    """The special token of the cell, if it has a non-blank one."""
    text = strip(raw)
    return F.when(is_special(raw) & (text != ""), text)


def unexpected(raw: Column | str) -> Column:
    """True for cells that are neither special nor a finite non-negative number."""
    value = survey_value(raw)
    return F.coalesce(~is_special(raw) & (value.isNull() | (value < 0) | F.isnan(value) | (value == float("inf"))), F.lit(False))


def survey_columns(df: DataFrame, columns: Sequence[str], key: str = "GEO_ID") -> DataFrame:
    """value and annotation columns for every raw column, named acs_<column> and acs_<column>_annotation."""
    out = []
    for c in columns:
        out += [survey_value(c).alias(f"acs_{c.lower()}"), survey_annotation(c).alias(f"acs_{c.lower()}_annotation")]
    return df.select(key, *out)


def require_expected(df: DataFrame, columns: Sequence[str]) -> None:
    bad = df.agg(*[F.count_if(unexpected(c)).alias(c) for c in columns]).first().asDict()
    if any(bad.values()):
        raise ValueError(f"Unexpected values: {({c: n for c, n in bad.items() if n})}")


def special_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, token, cells."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.when(is_special(c), strip(c)).alias("token")) for c in columns])).alias("s")
    ).where(F.col("s.token").isNotNull()).groupBy("s.column", "s.token").agg(F.count("*").alias("cells"))


def area_rows(df: DataFrame, key: str = "GEO_ID") -> DataFrame:
    """Tract and county rows; duplicates or an empty result are errors."""
    rows = df.where(F.col(key).rlike(AREA_PATTERN))
    require_rows(rows, 1, "tract or county records")
    require_none(duplicate_keys(rows, [key]), f"Duplicate {key}")
    return rows


def component_mismatches(geographies: DataFrame) -> DataFrame:
    """Rows whose state, county and tract parts do not spell the id's suffix."""
    parts = F.when(F.col("GEO_ID").startswith("050"), F.concat("STATE", "COUNTY")).otherwise(F.concat("STATE", "COUNTY", "TRACT"))
    return geographies.where(~parts.eqNullSafe(F.substring_index("GEO_ID", "US", -1)))


def unpaired_columns(columns: DataFrame) -> DataFrame:
    """Estimate or margin columns (name T_E001 / T_M001) without their partner."""
    kind = F.regexp_extract("column", r"^(.*)_([EM])([0-9]{3})$", 2)
    partner = F.concat(F.regexp_extract("column", r"^(.*)_([EM])([0-9]{3})$", 1), F.lit("_"),
                       F.when(kind == "E", F.lit("M")).otherwise(F.lit("E")), F.regexp_extract("column", r"^(.*)_([EM])([0-9]{3})$", 3))
    return columns.withColumn("partner", partner).join(
        columns.select(F.col("column").alias("partner")), "partner", "left_anti").select("column", "partner")


def label_paths(lines: DataFrame) -> DataFrame:
    """Full label path per (table, line) from indentation.

    At each depth the last label counts only if nothing shallower came after it. The depths are those found.
    """
    depths = sorted(r["indent"] for r in lines.select("indent").where("indent is not null").distinct().collect())
    w = Window.partitionBy("table").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    at = {d: F.last(F.when(F.col("indent") == d, F.struct("line", "label")), ignorenulls=True).over(w) for d in depths}
    framed = lines.withColumns({f"_d{d}": c for d, c in at.items()})
    parts = []
    for d in depths:
        shallower = [F.col(f"_d{s}.line") for s in depths if s < d]
        newest = F.greatest(*shallower) if len(shallower) > 1 else (shallower[0] if shallower else F.lit(None).cast("long"))
        mine = F.col(f"_d{d}.line")
        keep = (mine > F.coalesce(newest, F.lit(-1))) & (F.lit(d) <= F.col("indent"))
        parts.append(F.when(keep, F.col(f"_d{d}.label")))
    return framed.withColumn("label_path", F.concat_ws(" > ", *parts)).drop(*[f"_d{d}" for d in depths])


def assemble(geographies: DataFrame, tables: dict[str, DataFrame], year: int, key: str = "GEO_ID") -> DataFrame:
    """Geographies with every survey table joined 1:1, a record-present flag per table, and period columns."""
    frame = geographies
    for name, part in tables.items():
        require_none(orphans(part, geographies, key, key).select(key), f"{name}: ids absent from the geography table")
        frame = frame.join(part.withColumn(f"_{name}", F.lit(True)), key, "left").withColumn(
            f"acs_{name}_record_present", F.coalesce(f"_{name}", F.lit(False))).drop(f"_{name}")
    return frame.withColumns({"acs_release_year": F.lit(year), "acs_period_start": F.lit(year - 4), "acs_period_end": F.lit(year)})


def split_areas(assembled: DataFrame, key: str = "GEO_ID") -> tuple[DataFrame, DataFrame]:
    """(tracts, counties) with their plain id."""
    def one(prefix: str, name: str) -> DataFrame:
        return assembled.where(F.col(key).startswith(prefix)).withColumn(name, F.substring_index(key, "US", -1))

    return one("1400000US", "tract_geoid"), one("0500000US", "county_geoid")


def enrich(base: DataFrame, attributes: DataFrame, key: str, digits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(joined, reference rows without attributes, attributes without reference in the covered states).

    Keys must be unique and well formed on both sides and columns must not collide.
    """
    for name, frame in (("reference", base), ("attributes", attributes)):
        require_none(malformed_keys(frame, key, digits), f"{name}: malformed {key}")
        require_none(duplicate_keys(frame, [key]), f"{name}: duplicate {key}")
    collisions = sorted((set(base.columns) & set(attributes.columns)) - {key})
    if collisions or "acs_geography_matched" in base.columns:
        raise ValueError(f"Columns already present: {collisions}")
    missing = base.join(attributes.select(key), key, "left_anti").select(key)
    covered = base.select(F.substring(key, 1, 2).alias("_state")).distinct()
    unused = (attributes.join(base.select(key), key, "left_anti").select(key)
              .withColumn("_state", F.substring(key, 1, 2)).join(covered, "_state", "left_semi").drop("_state"))
    joined = base.join(attributes.withColumn("acs_geography_matched", F.lit(True)), key, "left").withColumn(
        "acs_geography_matched", F.coalesce("acs_geography_matched", F.lit(False)))
    return joined, missing, unused
