"""String expressions that Spark lacks or that behave differently there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without outer white space of any kind (Spark's trim takes spaces only)."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def single_spaced(c: Column | str) -> Column:
    """Outer white space removed, inner runs of it made one space."""
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def match_key(c: Column | str) -> Column:
    """How names are compared: in lower case, single-spaced."""
    return F.lower(single_spaced(c))


def record_code(c: Column | str) -> Column:
    """A code without outer blanks, in capitals."""
    return F.upper(strip(c))


def capital_first(c: Column) -> Column:
    """First sign upper, the rest lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1_000_000)))


def filled(c: Column) -> Column:
    """Array without null and blank strings, each without outer white space."""
    return F.filter(F.transform(c, strip), lambda x: x != "")


def split_list(c: Column | str, pattern: str) -> Column:
    """Split, strip, drop blanks; null gives an empty array."""
    return filled(F.coalesce(F.split(col(c), pattern), F.array().cast("array<string>")))
