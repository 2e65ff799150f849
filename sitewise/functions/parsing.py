"""One text cell -> typed value, or a reason, or an error."""
from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from .exprs import strip

# The type names of a rule and their Spark types.
TYPES = {"string": "string", "int64": "bigint", "float64": "double", "bool": "boolean", "date": "date",
         "interval": "struct<lower:double,upper:double>"}

# Accepted date layouts, each with the shape of text it applies to. Checking the shape
# first keeps the parser from failing, and raising, on text of another layout.
DATE_FORMATS = {
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$", "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "yyyy-M-d'T'H:m:s": r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$", "M/d/yyyy H:m:s": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$"}

# Fixed value: "(lower, upper)" with optional brackets.
INTERVAL_PATTERN = r"^\(?\s*([0-9]+(?:\.[0-9]+)?)\s*,\s*([0-9]+(?:\.[0-9]+)?)\s*\)?$"
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


@dataclass(frozen=True)
class Rule:
    type: str = "string"
    minimum: float | None = None
    maximum: float | None = None
    missing: tuple[str, ...] = ()
    missing_reasons: dict[str, str] = field(default_factory=dict)
    unit: str | None = None
    on_invalid: str = "reject"
    origin: str = "unreviewed_text"

    def __post_init__(self):
        if self.type not in TYPES:
            raise ValueError(f"Unknown type: {self.type}")
        if not all(isinstance(token, str) for token in self.missing):
            raise ValueError("Missing tokens must be strings")

    @property
    def review_required(self) -> bool:
        return self.origin == "unreviewed_text"

    def with_override(self, **changes) -> "Rule":
        return replace(self, **changes, origin="configured")


# Parsing goes through three layers of columns, each referring to the one before by name. As one
# nested expression the same sub-expression would be evaluated again for value, status and error.

def candidate_parts(text: Column, rule: Rule) -> dict[str, Column]:
    """First layer: what the trimmed text could mean under the rule."""
    if rule.type == "date":
        days = [F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(layout))) for layout, shape in DATE_FORMATS.items()]
        return {"day": F.coalesce(*days).cast("date")}
    if rule.type == "interval":
        return {"low": F.regexp_extract(text, INTERVAL_PATTERN, 1).try_cast("double"),
                "high": F.regexp_extract(text, INTERVAL_PATTERN, 2).try_cast("double")}
    if rule.type in ("int64", "float64"):
        parts = {"number": F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))}
        if rule.type == "int64":
            # Twenty digits before the point: exact for every 64-bit integer, also written as "5.0" or "1e3".
            parts["exact"] = text.try_cast("decimal(38,18)")
        return parts
    return {}


def cell_error(text: Column, part: dict[str, Column], rule: Rule) -> Column:
    """Second layer: why the text is not a valid value, or null."""
    if rule.type == "bool":
        return F.when(~F.lower(text).isin("yes", "no", "y", "n"), F.lit("Expected Yes/No or Y/N"))
    if rule.type == "date":
        return F.when(part["day"].isNull(), F.lit("Unrecognized date format"))
    if rule.type == "interval":
        ordered = (part["low"] >= 0) & (part["low"] <= part["high"]) & (part["high"] <= 100)
        return (F.when(part["low"].isNull() | part["high"].isNull(), F.lit("Expected confidence interval: (lower, upper)"))
                .when(~ordered, F.lit("Confidence interval must satisfy 0 <= lower <= upper <= 100")))
    if rule.type == "string":
        return F.lit(None).cast("string")
    number = part["number"]
    error = F.when(F.lower(text).rlike("^[+-]?(inf|infinity|nan|snan)$"), F.lit("Non-finite number")).when(
        number.isNull(), F.lit("Invalid numeric value"))
    if rule.type == "int64":
        whole = (part["exact"] == F.floor(part["exact"])) & part["exact"].try_cast("bigint").isNotNull()
        error = error.when(~F.coalesce(whole, F.lit(False)), F.lit("Value is not an int64"))
    else:
        error = error.when(F.abs(number) == float("inf"), F.lit("Float overflow"))
    if rule.minimum is not None:
        error = error.when(number < rule.minimum, F.lit("Below configured minimum"))
    if rule.maximum is not None:
        error = error.when(number > rule.maximum, F.lit("Above configured maximum"))
    return error


def cell_status(text: Column, error: Column, rule: Rule) -> Column:
    """Third layer: present, blank, sentinel, a missing reason, invalid, or invalid_warned."""
    status = F.when(text.isNull() | (text == ""), F.lit("blank"))
    for token, reason in rule.missing_reasons.items():
        status = status.when(text == token, F.lit(reason))
    if rule.missing:
        status = status.when(F.lower(text).isin(*[token.lower() for token in rule.missing]), F.lit("sentinel"))
    bad = "invalid_warned" if rule.on_invalid == "null_with_warning" else "invalid"
    return status.when(error.isNotNull(), F.lit(bad)).otherwise(F.lit("present"))


def cell_value(raw: Column, text: Column, part: dict[str, Column], rule: Rule) -> Column:
    """The typed value of a present cell."""
    if rule.type == "bool":
        return F.lower(text).isin("yes", "y")
    if rule.type == "date":
        return part["day"]
    if rule.type == "interval":
        return F.struct(part["low"].alias("lower"), part["high"].alias("upper"))
    if rule.type == "int64":
        return part["exact"].try_cast("bigint")
    return part["number"] if rule.type == "float64" else raw


def parsed_cells(df: DataFrame, rules: Mapping[str, Rule]) -> DataFrame:
    """Every ruled column as struct(raw, value, status, error); other columns stay."""
    keep = [c for c in df.columns if c not in rules]
    text = {c: F.col(f"{c}#text") for c in rules}
    parts = {c: candidate_parts(text[c], rule) for c, rule in rules.items()}
    named = {c: {p: F.col(f"{c}#{p}") for p in parts[c]} for c in rules}
    with_text = df.select("*", *[strip(c).alias(f"{c}#text") for c in rules])
    with_parts = with_text.select("*", *[value.alias(f"{c}#{p}") for c in rules for p, value in parts[c].items()])
    with_errors = with_parts.select("*", *[cell_error(text[c], named[c], rule).alias(f"{c}#error") for c, rule in rules.items()])
    with_status = with_errors.select("*", *[cell_status(text[c], F.col(f"{c}#error"), rule).alias(f"{c}#status") for c, rule in rules.items()])

    def cell(c: str, rule: Rule) -> Column:
        status = F.col(f"{c}#status")
        return F.struct(F.col(c).alias("raw"), F.when(status == "present", cell_value(F.col(c), text[c], named[c], rule)).alias("value"),
                        status.alias("status"), F.when(status.isin("invalid", "invalid_warned"), F.col(f"{c}#error")).alias("error")).alias(c)

    return with_status.select(*keep, *[cell(c, rule) for c, rule in rules.items()])
