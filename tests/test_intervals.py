"""The binned interval join against comparing every pair."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import intervals
from sightline.operators.intervals import binned, interval_join

DAY = dt.datetime(2020, 4, 24)


def brute(points, spans, closed):
    return sorted(
        (p, s) for p, at in points for s, lo, hi in spans
        if None not in (at, lo, hi) and lo <= at and (at <= hi if closed == "both" else at < hi)
    )


def got(df):
    return sorted((r.p, r.s) for r in df.select("p", "s").collect())


@pytest.fixture(scope="module")
def timed(spark):
    rng = random.Random(3)
    step = lambda: dt.timedelta(seconds=rng.choice([1, 60, 3600, 86400, 90 * 86400]) * rng.random() * 9)
    points = [(i, DAY + step() - step()) for i in range(150)] + [(200, None), (201, DAY), (201, DAY)]
    spans = [(i, a, a + step()) for i, a in enumerate(DAY + step() - step() for _ in range(60))]
    spans += [
        (90, DAY, DAY), (91, dt.datetime(1960, 1, 1), dt.datetime(2030, 1, 1)), (92, DAY, None), (93, None, DAY),
        (94, DAY + dt.timedelta(1), DAY), (90, DAY, DAY), (95, DAY, DAY + dt.timedelta(microseconds=1)),
    ]
    return points, spans


@pytest.mark.parametrize("closed", ["both", "left"])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("broadcast", [True, False])
def test_equals_every_pair(spark, timed, closed, kind, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(intervals, "broadcast_rows", lambda *a: 0)
    points, spans = timed
    p = spark.createDataFrame(points, f"p int, at {kind}")
    s = spark.createDataFrame(spans, f"s int, lo {kind}, hi {kind}")
    joined = interval_join(p, s, "at", "lo", "hi", closed)
    assert joined.columns == ["p", "at", "s", "lo", "hi"]
    assert got(joined) == brute(points, spans, closed)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == broadcast


def test_dates_and_numbers(spark):
    day = DAY.date()
    points = [(i, day + dt.timedelta(i - 40)) for i in range(80)]
    spans = [(i, day - dt.timedelta(3 * i), day + dt.timedelta(i)) for i in range(12)]
    p, s = spark.createDataFrame(points, "p int, at date"), spark.createDataFrame(spans, "s int, lo date, hi date")
    assert got(interval_join(p, s, "at", "lo", "hi")) == brute(points, spans, "both")
    numbers = [(i, i / 7 - 5) for i in range(100)]
    ranges = [(0, -4.5, -4.4), (1, -0.1, 0.1), (2, -100.0, 100.0), (3, 2.0, 2.0)]
    p = spark.createDataFrame(numbers, "p int, at double")
    s = spark.createDataFrame(ranges, "s int, lo double, hi double")
    assert got(interval_join(p, s, "at", "lo", "hi")) == brute(numbers, ranges, "both")


def test_long_intervals_make_two_rows_at_most(spark):
    spans = [(i, dt.datetime(1970 - i, 3, 1, 5), dt.datetime(2020, 1, i + 1)) for i in range(20)]
    rows = binned(spark.createDataFrame(spans, "s int, lo timestamp_ntz, hi timestamp_ntz"), "lo", "hi")
    assert {r["count"] for r in rows.groupBy("s").count().collect()} <= {1, 2}


def test_empty_sides_and_wrong_input(spark, timed):
    points, spans = timed
    p = spark.createDataFrame(points, "p int, at timestamp_ntz")
    s = spark.createDataFrame(spans, "s int, lo timestamp_ntz, hi timestamp_ntz")
    assert interval_join(p.limit(0), s, "at", "lo", "hi").count() == 0
    assert interval_join(p, s.limit(0), "at", "lo", "hi").count() == 0
    with pytest.raises(ValueError, match="share"):
        interval_join(p, s.withColumn("at", F.col("lo")), "at", "lo", "hi")
    with pytest.raises(ValueError, match="zone"):
        interval_join(p, s.withColumn("hi", F.col("hi").cast("timestamp")), "at", "lo", "hi")
    with pytest.raises(ValueError, match="point"):
        interval_join(p.withColumn("at", F.col("at").cast("string")), s, "at", "lo", "hi")
