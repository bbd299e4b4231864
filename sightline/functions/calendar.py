"""Calendar arithmetic as Spark column expressions (no Python per row).

Weeks start on Monday. A week belongs to the calendar year of its Monday
(``year(start_of_week)``), never to the ISO week-year, so every week has
exactly one row and one ``start_of_year``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("day", "week", "month", "quarter", "year")

# grain -> (period column name, within-year label column name)
PERIOD_COLUMNS = {
    "day": ("date", "day_of_year"),
    "week": ("week", "week_number"),
    "month": ("month", "month_number"),
    "quarter": ("quarter", "quarter_number"),
    "year": ("year_start", "year_number"),
}

_STEPS = {
    "day": "INTERVAL 1 DAY",
    "week": "INTERVAL 7 DAYS",
    "month": "INTERVAL 1 MONTH",
    "quarter": "INTERVAL 3 MONTHS",
    "year": "INTERVAL 1 YEAR",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def check_grain(grain: str) -> str:
    if grain not in PERIOD_COLUMNS:
        raise ValueError(f"unknown grain {grain!r}; expected one of {GRAINS}")
    return grain


def week_start(c: Column | str) -> Column:
    """Monday of the week containing ``c``, as a date."""
    return F.date_trunc("week", _col(c)).cast("date")


def week_end(c: Column | str) -> Column:
    """Sunday of the week containing ``c``."""
    return F.date_add(week_start(c), 6)


def year_start(c: Column | str) -> Column:
    return F.trunc(_col(c), "year")


def period_start(c: Column | str, grain: str) -> Column:
    """First day of the ``grain`` period containing ``c``."""
    check_grain(grain)
    if grain == "day":
        return _col(c).cast("date")
    return F.date_trunc(grain, _col(c)).cast("date")


def period_end(c: Column | str, grain: str) -> Column:
    """Last day of the ``grain`` period containing ``c``."""
    check_grain(grain)
    if grain == "day":
        return _col(c).cast("date")
    if grain == "week":
        return F.date_add(week_start(c), 6)
    if grain == "month":
        return F.last_day(_col(c))
    return F.date_sub(F.add_months(period_start(c, grain), 3 if grain == "quarter" else 12), 1)


def period_step(grain: str) -> Column:
    """Interval between consecutive period starts, for ``sequence``."""
    return F.expr(_STEPS[check_grain(grain)])


def week_label(week: Column | str, reconcile_years: Iterable[int] | None = None) -> Column:
    """Week number within the year of the week's Monday.

    ISO numbering, except that a December Monday whose ISO week is 1 (it
    belongs to next year's ISO week 1) is labelled 53, so labels are unique
    within ``year(week)``. ``reconcile_years`` restricts that relabelling to
    the given years (an empty collection keeps raw ISO numbers); ``None``
    applies it to every year.
    """
    w = _col(week)
    iso = F.weekofyear(w)
    wraps = (F.month(w) == 12) & (iso == 1)
    if reconcile_years is not None:
        years = sorted(set(int(y) for y in reconcile_years))
        wraps = wraps & F.year(w).isin(years) if years else F.lit(False)
    return F.when(wraps, F.lit(53)).otherwise(iso)


def anchored_year(day: Column | str, first_month: int = 4) -> Column:
    """The year that restarts on the first of ``first_month``: days before it
    belong to the year before."""
    return F.year(F.add_months(_col(day), 1 - first_month))


def period_label(period: Column | str, grain: str, reconcile_years: Iterable[int] | None = None) -> Column:
    """Position of a period inside its year (day of year, week number, ...);
    for years the year itself."""
    check_grain(grain)
    p = _col(period)
    if grain == "day":
        return F.dayofyear(p)
    if grain == "week":
        return week_label(p, reconcile_years)
    if grain == "month":
        return F.month(p)
    return F.quarter(p) if grain == "quarter" else F.year(p)
