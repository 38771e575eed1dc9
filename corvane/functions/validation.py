"""Checks of parsed fields as columns: passed, warning, failed or skipped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TYPES = {"int": "bigint", "float": "double", "bool": "boolean"}


def field(value: Column, required: bool = True, dtype: str = "str", choices: list[str] | None = None) -> Column:
    """Missing: failed if required, else skipped. Not among the choices or not of the type: failed. Numbers read from text: warning."""
    status = F.when(value.isNull() | (F.trim(value) == ""), "failed" if required else "skipped")
    if choices:
        status = status.when(~value.isin(choices), "failed")
    if dtype in _TYPES:
        status = status.when(value.try_cast(_TYPES[dtype]).isNull(), "failed")
        if dtype == "int":
            status = status.when(~value.rlike(r"^-?\d+$"), "warning")
    return status.otherwise("passed")


def clamp_confidence(value: Column) -> Column:
    """A confidence within 0 and 1; one that can't be read is 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(1.0))))


def valid(*statuses: Column) -> Column:
    out = F.lit(True)
    for s in statuses:
        out = out & (s != "failed")
    return out


def rule(value: Column, least: int | None = None, most: int | None = None, pattern: str | None = None, low: float | None = None, high: float | None = None) -> Column:
    """passed or failed: a text's length, its pattern, a number's range; a missing value fails, a rule that is not given passes."""
    ok = value.isNotNull()
    if least is not None:
        ok = ok & (F.length(value) >= least)
    if most is not None:
        ok = ok & (F.length(value) <= most)
    if pattern is not None:
        ok = ok & value.rlike(pattern)
    if low is not None:
        ok = ok & F.coalesce(value.try_cast("double") >= low, F.lit(False))
    if high is not None:
        ok = ok & F.coalesce(value.try_cast("double") <= high, F.lit(False))
    return F.when(F.coalesce(ok, F.lit(False)), "passed").otherwise("failed")


def summary(statuses: Column) -> Column:
    """struct(passed, warnings, failed, skipped) of an array of statuses."""
    many = lambda s: F.size(F.filter(statuses, lambda x: x == s))
    return F.struct(*[many(s).alias(n) for s, n in (("passed", "passed"), ("warning", "warnings"), ("failed", "failed"), ("skipped", "skipped"))])
