import datetime as dt
import math

import pytest

from sightline.functions.calendar import anchored_year
from sightline.operators import events, participation, trends
from tests.fixtures import make_obs

EVENTS = [("2020", dt.date(2020, 4, 24), dt.date(2020, 4, 27)), ("2021", dt.date(2021, 4, 30), dt.date(2021, 5, 3)),
          ("2023", dt.date(2023, 4, 28), dt.date(2023, 5, 1))]

ROWS = [
    (1, "2020-04-23", 1, 10, "a", "a"),  # the day before
    (2, "2020-04-24", 1, 10, "a", "a"),  # first day
    (3, "2020-04-27", 2, 11, "b", "b"),  # last day
    (4, "2020-04-28", 2, 12, "c", "c"),  # the day after: week 0
    (5, "2020-05-05", 2, 12, "c", "c"),  # week 1
    (6, "2020-01-01", 3, 10, "a", "a"),
    (6, "2020-01-01", 3, 10, "a", "a"),  # repeated id
    (7, "2020-12-31", 3, None, None, None),
    (8, "2021-05-04", 4, 10, "a", "a"),
    (9, "2021-01-02", 2, 10, "a", "a"),  # week 35 after the event of 2020
    (10, None, 5, 10, "a", "a"),
    (11, "2020-04-25", None, 10, "a", "a"),
    (12, "2022-06-01", 6, 10, "a", "a"),  # a year without an event
]


@pytest.fixture(scope="module")
def obs(spark):
    return make_obs(spark, ROWS)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(EVENTS, "event string, start_date date, end_date date")


def test_event_metrics(obs, table):
    got = {r.event: (r.unique_users, r.unique_species, r.unique_observations)
           for r in participation.event_metrics(obs, table).collect()}
    assert got == {"2020": (2, 2, 3), "2021": (0, 0, 0), "2023": (0, 0, 0)}


def test_participants_are_users_active_in_the_year(obs, table):
    got = {(r.event, r.user_id): r.participated for r in participation.event_participants(obs, table).collect()}
    assert got == {("2020", 1): True, ("2020", 2): True, ("2020", 3): False, ("2021", 2): False, ("2021", 4): False}


def test_averages_before_and_after_include_zeros(obs, table):
    activity = participation.event_activity(obs, table)
    got = {(r.event, r.participated): r for r in participation.participation_activity(activity).collect()}
    assert (got["2020", True].users, got["2020", True].avg_observations_before, got["2020", True].avg_observations_after) == (
        2, 0.5, 1.0)
    assert (got["2020", False].avg_observations_before, got["2020", False].avg_observations_after) == (1.0, 1.0)
    species = {(r.event, r.participated): r for r in participation.participation_species(activity).collect()}
    assert (species["2020", False].avg_species_before, species["2020", False].avg_species_after) == (1.0, 0.0)
    assert species["2020", True].avg_species_after == 0.5


def test_acquisition(spark, obs, table):
    firsts = obs.where("user_id is not null and observed_on is not null").groupBy("user_id").agg(
        {"observed_on": "min"}).toDF("user_id", "first_date")
    got = {(r.year, r.event): (r.new_users, r.first_during, r.first_near)
           for r in participation.event_acquisition(firsts, table).collect()}
    assert got == {(2020, "2020"): (3, 1, 2), (2021, "2021"): (1, 0, 1), (2022, None): (1, 0, 0)}


def test_retention_by_week_after(obs, table):
    who = participation.event_participants(obs, table)
    got = {(r.event, r.participated, r.week_after): (r.active_users, r.observations)
           for r in participation.event_retention(obs, table, who).collect()}
    assert got[("2020", True, 0)] == (1, 1) and got[("2020", True, 1)] == (1, 1)
    assert got[("2020", True, 35)] == (1, 1) and got[("2020", False, 35)] == (1, 1)
    assert got[("2021", False, 0)] == (1, 1)
    assert ("2020", False, 0) not in got
    short = participation.event_retention(obs, table, who, weeks=1).collect()
    assert {r.week_after for r in short} == {0}


def test_events_side_is_measured(obs, table, monkeypatch):
    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    few = participation.event_participants(obs, table)
    assert "broadcast" in plan(few) and "LocalRelation" not in plan(events.measured(table.where("event > ''")))
    monkeypatch.setattr(events, "MEASURED_EVENTS", 1)
    many = participation.event_participants(obs, table)
    assert "broadcast" not in plan(many)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))


def test_lift_drop_and_vanishing_species(spark):
    rows = [(1, "x", 2019, 4), (1, "x", 2020, 6), (2, "y", 2019, 5), (2, "y", 2021, 1), (3, "z", 2021, 9)]
    yearly = spark.createDataFrame(rows, "taxon_id bigint, scientific_name string, year int, observations bigint")
    got = {(r.taxon_id, r.year): (r.observations, r.previous_observations, r.lift, r.ratio, r.lift_rank)
           for r in trends.yoy_lift(yearly, min_count=2).collect()}
    assert got == {
        (1, 2020): (6, 4, 2, 1.5, 1), (2, 2020): (0, 5, -5, 0.0, 2),
        (3, 2021): (9, 0, 9, None, 1), (1, 2021): (0, 6, -6, 0.0, 2),
    }


def test_trend_needs_three_years(spark):
    rows = [(1, "x", y, 10 - y % 10) for y in (2011, 2012, 2013)] + [(2, "y", 2011, 1), (2, "y", 2012, 5)] + [
        (3, "z", y, 7) for y in (2011, 2013, 2016)]
    yearly = spark.createDataFrame(rows, "taxon_id bigint, scientific_name string, year int, observations bigint")
    got = {r.taxon_id: (r.years, r.slope, r.trend) for r in trends.species_trend(yearly).collect()}
    assert got == {1: (3, -1.0, "declining"), 3: (3, 0.0, "level")}


def test_shares_and_totals(obs):
    share = {(r.month, r.taxon_id): r.share for r in trends.species_share(obs, "month").collect()}
    assert share[dt.date(2020, 4, 1), 10] == pytest.approx(3 / 5)
    assert sum(v for (m, _), v in share.items() if m == dt.date(2020, 4, 1)) == pytest.approx(1)
    assert {r.taxon_kingdom_name: r.observations for r in trends.kingdom_totals(obs).collect()} == {"Plantae": 12}
    months = {r.month: r.observations for r in trends.kingdom_by_period(obs, "month").collect()}
    assert months[dt.date(2020, 1, 1)] == 1 and None not in months
    rare = [(r.scientific_name, r.observations) for r in trends.rarest_species(obs).collect()]
    assert rare == [("b", 1), ("c", 2), ("a", 8)]
    assert [r.scientific_name for r in trends.rarest_species(obs, 1).collect()] == ["b"]
    more = obs.unionByName(make_obs(obs.sparkSession, [(800, "2020-01-01", 1, 77, "t", "t"), (801, None, 1, 78, None, "t")]))
    ranks = [(r.scientific_name, r.rank) for r in trends.rarest_species(more).collect()]
    assert ranks == [(None, 1), ("b", 1), ("t", 1), ("c", 4), ("a", 5)]  # ties share a rank


def test_quality_percentages(obs):
    graded = obs.selectExpr("*", "case when id < 4 then 'research' when id < 9 then 'casual' end as quality_grade")
    got = {r.quality_grade: (r.observations, r.percentage) for r in trends.quality_breakdown(graded).collect()}
    assert got["research"] == (3, 25.0) and sum(p for _, p in got.values()) == pytest.approx(100)


def test_range_shift_over_the_date_line(spark):
    rows = [(1, "2020-05-01", 1, 5, "a", "a"), (2, "2021-05-01", 1, 5, "a", "a"), (3, "2023-05-01", 1, 5, "a", "a"),
            (4, "2021-05-01", 1, 6, "b", "b")]
    places = {1: "0,179.5", 2: "0,-179.5", 3: "10,0", 4: "bad"}
    table = make_obs(spark, rows).join(spark.createDataFrame(list(places.items()), "id bigint, location string"), "id")
    got = trends.range_shift(trends.with_coordinates(table)).collect()
    assert [(r.taxon_id, r.year) for r in got] == [(5, 2021)]  # 2023 has no year before it
    assert got[0].shift_km == pytest.approx(math.radians(1) * trends.EARTH_KM, abs=0.01)


def test_places_that_cancel_out_have_no_mean(spark):
    rows = [(1, "2020-05-01", 1, 5, "a", "a"), (2, "2020-06-01", 1, 5, "a", "a"), (3, "2021-05-01", 1, 5, "a", "a"),
            (4, "2022-05-01", 1, 5, "a", "a")]
    places = {1: "0,0", 2: "0,180", 3: "0,10", 4: "0,11"}
    table = make_obs(spark, rows).join(spark.createDataFrame(list(places.items()), "id bigint, location string"), "id")
    got = {r.year: r.shift_km for r in trends.range_shift(trends.with_coordinates(table)).collect()}
    assert got[2021] is None and got[2022] == pytest.approx(math.radians(1) * trends.EARTH_KM, abs=0.01)


def test_anchored_year(spark):
    days = spark.createDataFrame([(dt.date(2020, 3, 31),), (dt.date(2020, 4, 1),), (dt.date(2021, 1, 1),)], "d date")
    assert [r[0] for r in days.select(anchored_year("d")).collect()] == [2019, 2020, 2020]
