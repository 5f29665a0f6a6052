"""Small document helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import vocab


def blank(c: Column) -> Column:
    """Null or ''."""
    return F.coalesce(c, F.lit("")) == ""


def one_of(c: Column, values: tuple[str, ...]) -> Column:
    """Membership in which null is no member."""
    return F.coalesce(c.isin(*values), F.lit(False))


def equals(c: Column, value: str) -> Column:
    return F.coalesce(c == value, F.lit(False))


def staleish(staleness: Column, verification: Column) -> Column:
    return one_of(staleness, vocab.STALE_STALENESS) | one_of(verification, vocab.STALE_VERIFICATION)


def listed(c: Column) -> Column:
    """An array, empty for null."""
    return F.coalesce(c, F.slice(c, 1, 0), F.array().cast("array<string>"))


def canonical(json_text: Column) -> Column:
    """Compact JSON with sorted keys; numbers in one spelling."""
    return F.to_json(F.try_parse_json(json_text))
