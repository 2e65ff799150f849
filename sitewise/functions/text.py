"""Names and street addresses."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .exprs import as_column, strip

# Parts of an address that cannot be placed on a map.
PO_BOX_PATTERN = r"(?i)\b(P\.?\s?O\.?\s*BOX|BOX)\s*\d+\b[\s,/-]*"
ANY_PO_BOX_PATTERN = r"(?i)\bP\.?\s*O\.?\s+BOX\b"
UNIT_PATTERN = r"(?i)\b(SUITE|STE|FLOOR|FL|BLDG|BUILDING|ROOM|UNIT)\b\.?\s*[\w-]*"
STREET_UNIT_PATTERN = r"(?i)\b(SUITE|STE|FLOOR|FL|BLDG|BUILDING|ROOM|RM|UNIT)\b\.?\s*#?[\w-]*|#\s*\w+"

# Words too common in facility names to tell two apart.
NAME_STOPWORDS = ("THE", "OF", "AND", "INC", "LLC", "HOSPITAL", "HOSPITALS", "MEDICAL", "CENTER", "CENTRE", "HEALTH",
                  "HEALTHCARE", "REGIONAL", "COMMUNITY", "MEMORIAL", "SYSTEM", "CAMPUS", "ST", "SAINT", "MC", "CTR", "HOSP", "MED")
OLDER_NAME_STOPWORDS = (*NAME_STOPWORDS, "RMC")

# Street directions.
DIRECTIONS = {"NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W", "NORTHEAST": "NE", "NORTHWEST": "NW",
              "SOUTHEAST": "SE", "SOUTHWEST": "SW"}


def text(value: Column | str) -> Column:
    """Trimmed text, '' for null."""
    return F.coalesce(strip(value), F.lit(""))


def normalized(value: Column | str) -> Column:
    """Upper case with single spaces."""
    return F.regexp_replace(F.upper(text(value)), r"\s+", " ")


def clean_address(value: Column | str, units: str = UNIT_PATTERN) -> Column:
    """Street part without PO boxes and unit text, spelled numbers one and two as digits."""
    out = F.regexp_replace(text(value), PO_BOX_PATTERN, " ")
    out = F.regexp_replace(out, units, " ")
    out = F.regexp_replace(out, r"(?i)^\s*ONE\b", "1")
    out = F.regexp_replace(out, r"(?i)^\s*TWO\b", "2")
    out = F.regexp_replace(out, r"\s+", " ")
    return F.regexp_replace(out, r"^[ ,/-]+|[ ,/-]+$", "")


def clean_street(value: Column | str) -> Column:
    return F.upper(clean_address(value, STREET_UNIT_PATTERN))


def has_po_box(value: Column | str) -> Column:
    return text(value).rlike(PO_BOX_PATTERN)


def name_tokens(value: Column | str, stopwords: Sequence[str] = NAME_STOPWORDS) -> Column:
    """Sorted distinct words of a name without the common ones and single letters."""
    words = F.split(F.trim(F.regexp_replace(F.replace(F.upper(text(value)), F.lit("&"), F.lit(" AND ")), "[^A-Z0-9 ]", " ")), " +")
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stopwords))
    return F.array_sort(F.array_distinct(kept))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared words over all words of two distinct word lists; null when both are empty.

    The intersection is the costly part, so it is bound once and the union follows from the sizes."""
    a, b = as_column(a), as_column(b)
    shared = F.array(F.size(F.array_intersect(a, b)))
    return F.element_at(F.transform(shared, lambda n: F.try_divide(n, F.size(a) + F.size(b) - n)), 1)


def house_number(street: Column | str) -> Column:
    number = F.regexp_extract(F.coalesce(as_column(street), F.lit("")), r"^\s*(\d+)", 1)
    return F.when(number != "", number)


def directions(street: Column | str) -> Column:
    """Sorted distinct abbreviated directions in a street."""
    table = F.create_map(*[F.lit(x) for pair in DIRECTIONS.items() for x in pair])
    words = F.split(F.trim(F.regexp_replace(F.upper(F.coalesce(as_column(street), F.lit(""))), "[^A-Z ]", " ")), " +")
    short = F.transform(words, lambda w: F.coalesce(table[w], w))
    return F.array_sort(F.array_distinct(F.filter(short, lambda w: w.isin(*DIRECTIONS.values()))))


def zip5(value: Column | str) -> Column:
    """First five digits of a 5- or 9-digit code; other text as it is."""
    code = text(value)
    return F.when(code.rlike(r"^[0-9]{5}(-?[0-9]{4})?$"), F.substring(code, 1, 5)).otherwise(code)
