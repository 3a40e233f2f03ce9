"""Column expressions of events, states and ratios.

All stay inside code generation; none needs Python on the executors.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

START, EXIT = "START", "EXIT"
ENDS = (START, EXIT)
OTHER, UNKNOWN, UNNAMED, NO_CLICK, TAIL = "other", "unknown", "(none)", "(no_click)", "(other)"
OS_FAMILIES = ("android", "ios", "windows", "macos")
AXES = ("period", "service_type", "os", "gender", "age_band", "daypart", "app_version")
COND_AXES = ("period", "service_type", "os", "app_version")
DAY_PATTERN = r"\d{4}-\d{2}-\d{2}"


def filled(c: Column) -> Column:
    """Null for blank text; only spaces are trimmed."""
    return F.nullif(F.trim(c), F.lit(""))


def or_else(c: Column, word: str) -> Column:
    return F.coalesce(filled(c), F.lit(word))


def os_family(c: Column) -> Column:
    name = F.lower(F.coalesce(c, F.lit("")))
    return F.when(name.isin(*OS_FAMILIES), name).otherwise(OTHER)


def age_band(c: Column) -> Column:
    """0 means the age is not known, like null."""
    return F.when(c.isNull() | (c == 0), UNKNOWN).otherwise(c.cast("string"))


def listed(c: Column, words: Iterable[str], rest: Column | str = OTHER) -> Column:
    """``c`` if it is one of ``words``, else ``rest``; an empty list means always ``rest``."""
    words = list(words)
    rest = F.lit(rest) if isinstance(rest, str) else rest
    return F.when(c.isin(*words), c).otherwise(rest) if words else rest


def screen_name(service: Column, name: Column) -> Column:
    return F.concat(service, F.lit("/"), or_else(name, UNNAMED))


def screen_state(service: Column, name: Column, screens: Iterable[str]) -> Column:
    return listed(screen_name(service, name), screens, F.concat(service, F.lit("/"), F.lit(OTHER)))


def slot(layer1: Column, layer2: Column) -> Column:
    """Two-level slot name; null without a first level."""
    return F.concat(filled(layer1), F.lit(">"), or_else(layer2, UNNAMED))


def service_of(state: Column) -> Column:
    """What stands before the first slash; null for the ends and for names without one."""
    return F.when(~state.isin(*ENDS) & state.contains("/"), F.substring_index(state, "/", 1))


def is_lumped(state: Column) -> Column:
    return state.endswith(f"/{OTHER}")


def ratio(a: Column, b: Column) -> Column:
    """Null unless the denominator is positive: nothing measured is not zero."""
    return F.when(b > 0, a / b)


def information(p: Column) -> Column:
    """-p ln p, 0 for p = 0."""
    return F.when(p > 0, -p * F.ln(p)).otherwise(0.0)


def day_kind(day: Column, holidays: Iterable[str]) -> Column:
    """weekday, weekend or holiday; a holiday on a weekend is a holiday."""
    out = F.when(F.dayofweek(F.to_date(day)).isin(1, 7), "weekend").otherwise("weekday")
    holidays = sorted(set(holidays))
    return F.when(day.isin(*holidays), "holiday").otherwise(out) if holidays else out
