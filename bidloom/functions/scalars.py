"""Scalar rules of the bid model as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = " > "


def strip(c: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def truthy(*columns: Column) -> Column:
    """The first that is neither null nor empty, stripped; else an empty string."""
    return strip(F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit("")))


def clean_number(s: Column) -> Column:
    """Digits, points and minus signs of a text as a number; null where they are none."""
    return F.regexp_replace(s, r"[^0-9.\-]", "").try_cast("double")


def strict_number(s: Column) -> Column:
    """A text as a number once separators and currency signs are gone; null if anything else remains."""
    bare = F.regexp_replace(strip(s), r"[,\s₩원$]|USD|\\", "")
    return F.when(bare.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), bare.try_cast("double"))


def strip_indent(s: Column) -> Column:
    return F.regexp_replace(s, r"^\[indent=\d+\]\s*", "")


def split_path(path: Column) -> Column:
    """Levels of a category path; a slash is part of a level."""
    return F.filter(F.transform(F.split(path, r"\s*[>|\\]\s*"), strip), lambda x: x != "")


def join_path(parts: Column) -> Column:
    return F.array_join(parts, SEPARATOR)


def prefixes(parts: Column) -> Column:
    """All paths from the first level down to the whole."""
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: join_path(F.slice(parts, 1, n)))


def row_label(n: Column) -> Column:
    """R001, R002, ...; longer numbers are not cut."""
    text = n.cast("string")
    return F.concat(F.lit("R"), F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text))


def is_hangul(s: Column) -> Column:
    return s.rlike("[가-힣]")


def mask_secret(s: Column) -> Column:
    return F.when(F.length(s) > 12, F.concat(F.substring(s, 1, 8), F.lit("..."), F.substring(s, -4, 4))).otherwise(F.lit("****"))


def cell_text(value: Column, indent: Column | None = None) -> Column:
    """A cell for a text rendering: integral numbers without a fraction, (empty) for nothing, the indent in front."""
    whole = F.regexp_replace(strip(value), r"^(-?[0-9]+)\.0+$", "$1")
    shown = F.when(F.coalesce(whole, F.lit("")) == "", F.lit("(empty)")).otherwise(whole)
    return shown if indent is None else F.when(indent > 0, F.concat(F.lit("[indent="), indent.cast("string"), F.lit("]"), shown)).otherwise(shown)


def from_json_list(s: Column) -> Column:
    """A JSON array of texts; anything else is an empty array."""
    return F.coalesce(F.from_json(s, "array<string>"), F.array().cast("array<string>"))


def name_key(s: Column) -> Column:
    """A name folded for matching: case, white space and brackets with what they hold don't count."""
    return F.regexp_replace(F.lower(F.regexp_replace(s, r"[\(\[{（].*?[\)\]}）]", "")), r"(?U)[\s\-_/·,.]+", "")
