"""String helpers as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """``text`` without Unicode white space at its ends (``trim`` removes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def non_empty(text: Column) -> Column:
    """``text``, or null where it is empty."""
    return F.when(text != "", text)


def join_stripped(parts: Column, separator: str) -> Column:
    """Non-null parts, stripped, without empty ones, joined; null for a null array."""
    return F.array_join(F.filter(F.transform(parts, strip), lambda x: x.isNotNull() & (x != "")), separator)


def clean_caption(value: Column) -> Column:
    """Caption text of a variant: a list's non-empty stripped parts joined by a space, else the stripped string form."""
    from .jsonpath import as_array, as_string

    parts = F.transform(as_array(value), as_string)
    return F.coalesce(join_stripped(parts, " "), strip(as_string(value)), F.lit(""))


def coerce_page(value: Column) -> Column:
    """Page number of a variant: whole numbers and strings of digits, else 1 (2.0, negative, text, null)."""
    from .jsonpath import as_string

    text = F.when(F.schema_of_variant(value).isin("BIGINT", "STRING"), as_string(value))
    return F.coalesce(F.when(text.rlike("^[0-9]+$"), text.try_cast("int")), F.lit(1))
