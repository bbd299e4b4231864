"""Gap-free calendars generated with ``sequence`` from data-derived bounds.

A calendar is tiny (one row per day or week of the covered years) and is
derived lazily from a one-row bounds frame, so building it never collects
anything to the driver.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.calendar import (
    PERIOD_COLUMNS,
    period_label,
    period_start,
    period_step,
    week_end,
    week_label,
    week_start,
    year_start,
)

DateLike = dt.date | str | Column | None


def as_date_col(value: DateLike) -> Column | None:
    if value is None:
        return None
    if isinstance(value, Column):
        return value.cast("date")
    return F.lit(str(value)).cast("date")


def whole_year_bounds(lo: Column, hi: Column, margin_years: int = 1) -> list[Column]:
    """Whole calendar years around [lo, hi], widened by ``margin_years``."""
    return [
        F.make_date(F.year(lo) - margin_years, F.lit(1), F.lit(1)).alias("start_date"),
        F.make_date(F.year(hi) + margin_years, F.lit(12), F.lit(31)).alias("end_date"),
    ]


def date_bounds(df: DataFrame, date_col: str = "observed_on", margin_years: int = 1) -> DataFrame:
    """One row ``(start_date, end_date)``: whole years covering the data,
    one more on each side by default."""
    return df.agg(F.min(date_col).alias("lo"), F.max(date_col).alias("hi")).select(
        *whole_year_bounds(F.col("lo"), F.col("hi"), margin_years)
    )


def literal_bounds(spark: SparkSession, start: DateLike, end: DateLike) -> DataFrame:
    return spark.range(1).select(as_date_col(start).alias("start_date"), as_date_col(end).alias("end_date"))


def override_bounds(bounds: DataFrame, start: DateLike = None, end: DateLike = None) -> DataFrame:
    """Replace either bound by an explicit date."""
    s, e = as_date_col(start), as_date_col(end)
    return bounds.select(
        (s if s is not None else F.col("start_date")).alias("start_date"),
        (e if e is not None else F.col("end_date")).alias("end_date"),
    )


def calendar_days(bounds: DataFrame) -> DataFrame:
    """Day-grain date dimension: one row per day in [start_date, end_date]."""
    days = bounds.select(
        F.explode(F.sequence("start_date", "end_date", F.expr("INTERVAL 1 DAY"))).alias("date")
    )
    sow = week_start("date")
    return days.select(
        "date",
        sow.alias("start_of_week"),
        year_start("date").alias("start_of_year"),
        F.year("date").alias("year"),
        F.year(sow).alias("start_of_week_year"),
        F.month("date").alias("month"),
        F.month(sow).alias("start_of_week_month"),
        F.date_format("date", "MMMM").alias("month_name"),
        F.date_format(sow, "MMMM").alias("start_of_week_month_name"),
        F.dayofmonth("date").alias("day"),
        F.date_format("date", "EEEE").alias("day_name"),
        F.quarter("date").alias("quarter"),
        F.dayofyear("date").alias("day_of_year"),
        F.weekofyear("date").alias("week_number"),
        F.weekofyear(sow).alias("start_of_week_week_number"),
        week_label(sow).alias("start_of_week_week_number_reconciled"),
    )


def period_calendar(
    bounds: DataFrame,
    grain: str = "week",
    as_of: DateLike = None,
    reconcile_years: Iterable[int] | None = None,
) -> DataFrame:
    """One row per period start in the bounds, up to ``as_of``.

    Columns: period (``week``/``date``/...), ``year`` = year of the period
    start, ``start_of_year`` and the within-year label. ``as_of`` defaults to
    today (only when omitted).
    """
    pcol, label = PERIOD_COLUMNS[grain]
    cutoff = as_date_col(as_of) if as_of is not None else F.current_date()
    periods = bounds.select(
        F.explode(
            F.sequence(period_start("start_date", grain), period_start("end_date", grain), period_step(grain))
        ).alias(pcol)
    ).where(F.col(pcol) <= cutoff)
    return periods.select(
        pcol,
        F.year(pcol).alias("year"),
        year_start(pcol).alias("start_of_year"),
        period_label(pcol, grain, reconcile_years).alias(label),
    )


def week_calendar(bounds: DataFrame, as_of: DateLike = None, reconcile_years=None) -> DataFrame:
    return period_calendar(bounds, "week", as_of, reconcile_years)


def day_calendar(bounds: DataFrame, as_of: DateLike = None) -> DataFrame:
    return period_calendar(bounds, "day", as_of)


def week_bounds(df: DataFrame, date_col: str = "observed_on") -> DataFrame:
    """Each distinct date with the Monday and Sunday of its week."""
    return (
        df.where(F.col(date_col).isNotNull())
        .select(F.col(date_col).alias("date"))
        .distinct()
        .select("date", week_start("date").alias("week_start"), week_end("date").alias("week_end"))
    )
