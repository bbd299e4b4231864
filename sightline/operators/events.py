"""Event calendars and event bands over period series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.calendar import week_start
from sightline.operators.intervals import interval_join

# The reference's event dates (event year, first day, last day).
REFERENCE_EVENTS = (
    ("2019", "2019-04-26", "2019-04-29"),
    ("2020", "2020-04-24", "2020-04-27"),
    ("2021", "2021-04-30", "2021-05-03"),
    ("2022", "2022-04-29", "2022-05-02"),
    ("2023", "2023-04-28", "2023-05-01"),
    ("2024", "2024-04-25", "2024-04-29"),
)


def reference_events(spark: SparkSession) -> DataFrame:
    """The six published events as a typed table (a sample input)."""
    rows = [(e, s, t) for e, s, t in REFERENCE_EVENTS]
    return spark.createDataFrame(rows, "event string, start_date string, end_date string").select(
        "event", F.col("start_date").cast("date"), F.col("end_date").cast("date")
    )


def last_weekend_of_april(years: DataFrame, year_col: str = "year") -> DataFrame:
    """One event per year: the last Friday of April through the Monday after."""
    apr30 = F.make_date(F.col(year_col), F.lit(4), F.lit(30))
    friday = F.next_day(F.date_sub(apr30, 7), "Fri")
    return years.select(
        F.col(year_col).cast("string").alias("event"),
        friday.alias("start_date"),
        F.date_add(friday, 3).alias("end_date"),
    )


def events_for_data_years(obs: DataFrame, date_col: str = "observed_on") -> DataFrame:
    """Event calendar for every year the observations cover."""
    years = obs.where(F.col(date_col).isNotNull()).select(F.year(date_col).alias("year")).distinct()
    return last_weekend_of_april(years)


MEASURED_EVENTS = 100_000


def measured(events: DataFrame) -> DataFrame:
    """``events`` marked for broadcast if they are counted to be at most
    ``MEASURED_EVENTS`` rows (a few MB), else unchanged. Events that are
    derived from large data should be written first: they are read twice."""
    return F.broadcast(events) if events.count() <= MEASURED_EVENTS else events


def event_band(periods: DataFrame, events: DataFrame, period_col: str = "week") -> DataFrame:
    """Periods inside each event's band: from the Monday of the event's first
    week to its last day (both inclusive).

    A binned interval join: bands may overlap and be of any length.
    """
    bands = events.select(
        "event", week_start("start_date").alias("band_start"), F.col("end_date").alias("band_end")
    )
    return interval_join(periods, bands, period_col, "band_start", "band_end")

