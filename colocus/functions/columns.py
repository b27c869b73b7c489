"""Column expressions of the cohort rules; all of them pass NULL through unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coerced(c: Column) -> Column:
    """A number, or NULL where the text is none."""
    return c.try_cast("double")


def recoded(c: Column, mapping: dict, kind: str = "string") -> Column:
    """A dictionary look-up; NULL for unmapped values."""
    out = F.lit(None).cast(kind)
    for key, value in mapping.items():
        out = F.when(c == F.lit(key), F.lit(value)).otherwise(out)
    return out.cast(kind)


def inverted(mapping: dict[str, list]) -> dict:
    """Value to class, from class to list of values."""
    return {v: name for name, values in mapping.items() for v in values}


def banded(n: Column) -> Column:
    """Counts 0, 1-3, 4-9 and from 10 on as 0 to 3."""
    return F.when(n == 0, 0).when(n <= 3, 1).when(n <= 9, 2).when(n >= 10, 3).cast("long")


def slug(c: Column) -> Column:
    """Runs of anything but letters and digits as one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(c, "[^0-9A-Za-z]+", "_"), F.lit("_"))


def censored_time(time: Column, horizon: float) -> Column:
    return F.when(time.isNotNull(), F.least(time, F.lit(float(horizon))))


def censored_event(event: Column, time: Column, horizon: float) -> Column:
    """An event counts up to and at the horizon."""
    return event & ~F.coalesce(time > F.lit(float(horizon)), F.lit(False))


def first_match(branches: list[tuple[Column, str]]) -> Column:
    """The value of the first true condition; NULL conditions do not match, and none gives NULL."""
    out = F.lit(None).cast("string")
    for condition, value in reversed(branches):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def first_known(column: str, order: str) -> Column:
    """Aggregate: the first non-null value by ``order``."""
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(order)))


def md5_uniform(*parts: Column) -> Column:
    """A whole number below 2**32 from the md5 of the parts: the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 8), 16, 10).cast("long")
