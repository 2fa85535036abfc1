"""Text helpers. Whitespace and word characters are Unicode's."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    """Runs of whitespace as one space, none at either end; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def filled(c: Column) -> Column:
    """Null where empty."""
    return F.nullif(c, F.lit(""))


def found(c: Column, pattern: str, group: int) -> Column:
    """A regular expression's group, null where it takes no part."""
    return filled(F.regexp_extract(c, pattern, group))


def has_any(c: Column, terms: Iterable[str]) -> Column:
    out = F.lit(False)
    for term in terms:
        out = out | c.contains(term)
    return out


def rounded(c: Column, places: int) -> Column:
    """Half up on the double itself, so that engines agree."""
    scale = 10.0**places
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
