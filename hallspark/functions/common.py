"""Small column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column) -> Column:
    """Half up, as the source data's scores are rounded; a long."""
    return F.floor(c + F.lit(0.5))


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.when(c.isNotNull(), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), c)))


def collapse(c: Column) -> Column:
    """Runs of blanks become one space, the ends are trimmed."""
    return F.trim(F.regexp_replace(F.translate(c, "\N{NO-BREAK SPACE}", " "), r"\s+", " "))


def lookup(c: Column, values: dict[str, str], default: Column | None = None) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, value in values.items():
        out = out.when(c == key, F.lit(value))
    return out.otherwise(default if default is not None else F.lit(None))


def first_contained(c: Column, pairs: list[tuple[str, str]], default: str) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for part, value in pairs:
        out = out.when(c.contains(part), F.lit(value))
    return out.when(c.isNotNull(), F.lit(default))


def listed(*items: Column) -> Column:
    """The items that are not null, in order."""
    return F.array_compact(F.array(*items))
