"""Settings given as text: flags, severities and numbers with a fallback."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.lexicon import SEVERITY


def as_flag(value: Column, fallback: bool) -> Column:
    """True for 1, true, yes and on in any case; the fallback for nothing or an empty text."""
    return F.when(F.coalesce(value, F.lit("")) == "", fallback).otherwise(F.lower(value).isin("1", "true", "yes", "on"))


def as_severity(value: Column, fallback: str = "medium") -> Column:
    low = F.lower(value)
    return F.when(low.isin(*SEVERITY), low).otherwise(fallback)


def as_number(value: Column, fallback: float, least: float | None = None) -> Column:
    """The number in a text; the fallback if it is none or isn't finite; ``least`` bounds it from below."""
    number = F.expr("try_cast(NULL AS DOUBLE)") if value is None else value.try_cast("double")
    ok = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    out = F.when(ok, number).otherwise(F.lit(float(fallback)))
    return out if least is None else F.greatest(out, F.lit(float(least)))
