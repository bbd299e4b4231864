import datetime as dt

from pyspark.sql import functions as F

from sightline.operators import calendar


def test_one_row_per_week_and_unique_labels(spark):
    bounds = calendar.literal_bounds(spark, "1994-01-01", "2060-12-31")
    weeks = calendar.week_calendar(bounds, "2060-12-31").collect()
    starts = [r.week for r in weeks]
    assert len(starts) == len(set(starts))
    assert all(w.weekday() == 0 for w in starts)
    assert all((b - a).days == 7 for a, b in zip(starts, starts[1:]))
    labels = [(r.year, r.week_number) for r in weeks]
    assert len(labels) == len(set(labels)), "week labels must be unique per year"
    by_week = {r.week: r for r in weeks}
    # a December Monday in next year's ISO week 1 is week 53 of its own year
    for monday in ("1996-12-30", "2001-12-31", "2018-12-31", "2024-12-30"):
        r = by_week[dt.date.fromisoformat(monday)]
        assert r.week_number == 53 and r.year == int(monday[:4])
        assert r.start_of_year == dt.date(int(monday[:4]), 1, 1)


def test_reference_reconcile_rule_only_2019(spark):
    bounds = calendar.literal_bounds(spark, "2018-01-01", "2020-12-31")
    weeks = {r.week: r.week_number for r in calendar.week_calendar(bounds, "2020-12-31", reconcile_years={2019}).collect()}
    assert weeks[dt.date(2019, 12, 30)] == 53
    assert weeks[dt.date(2018, 12, 31)] == 1  # not reconciled outside 2019
    raw = {r.week: r.week_number for r in calendar.week_calendar(bounds, "2020-12-31", reconcile_years=()).collect()}
    assert raw[dt.date(2019, 12, 30)] == 1


def test_day_calendar_has_leap_days_and_full_years(spark):
    bounds = calendar.literal_bounds(spark, "2015-01-01", "2025-12-31")
    days = calendar.calendar_days(bounds)
    assert len(days.columns) == 16
    got = {r.date for r in days.select("date").collect()}
    assert dt.date(2020, 2, 29) in got and dt.date(2024, 2, 29) in got
    assert max(got) == dt.date(2025, 12, 31)
    assert len(got) == (dt.date(2025, 12, 31) - dt.date(2015, 1, 1)).days + 1
    row = days.where(F.col("date") == F.lit("2019-12-31").cast("date")).first()
    assert row.start_of_week == dt.date(2019, 12, 30)
    assert row.day_name == "Tuesday" and row.month_name == "December"
    assert row.start_of_week_week_number_reconciled == 53 and row.week_number == 1


def test_as_of_cuts_calendar(spark):
    bounds = calendar.literal_bounds(spark, "2020-01-01", "2020-12-31")
    weeks = calendar.week_calendar(bounds, "2020-03-01").collect()
    assert max(r.week for r in weeks) == dt.date(2020, 2, 24)


def test_bounds_from_data(spark):
    df = spark.createDataFrame([(dt.date(1995, 3, 1),), (dt.date(2001, 8, 1),), (None,)], "observed_on date")
    b = calendar.date_bounds(df).first()
    assert (b.start_date, b.end_date) == (dt.date(1994, 1, 1), dt.date(2002, 12, 31))


def test_week_bounds(spark):
    df = spark.createDataFrame([(dt.date(2019, 1, 1),), (dt.date(2019, 1, 1),), (None,)], "observed_on date")
    rows = calendar.week_bounds(df).collect()
    assert [(r.date, r.week_start, r.week_end) for r in rows] == [
        (dt.date(2019, 1, 1), dt.date(2018, 12, 31), dt.date(2019, 1, 6))
    ]
