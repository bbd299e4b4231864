import datetime as dt

from pyspark.sql import functions as F

from sightline.operators import period_metrics as pm
from sightline.operators.first_seen import first_seen, observation_fact, store_first_seen
from sightline.session import Scratch
from tests.fixtures import BOUNDARY, make_obs

CAL = dict(as_of="2026-12-31", start="2018-01-01", end="2026-12-31")


def _rows(df, key):
    return sorted(df.collect(), key=lambda r: r[key])


def test_invariants_weekly_and_daily(spark):
    obs = make_obs(spark, BOUNDARY)
    users = {r.user_id for r in obs.where("observed_on is not null and user_id is not null").collect()}
    taxa = {r.taxon_id for r in obs.where("observed_on is not null and taxon_id is not null").collect()}
    ids = {r.id for r in obs.where("observed_on is not null").collect()}
    for grain, p in (("week", "week"), ("day", "date")):
        table = _rows(pm.period_summary(obs, grain=grain, **CAL), p)
        periods = [r[p] for r in table]
        assert len(periods) == len(set(periods))
        last = table[-1]
        assert last.cumulative_users == len(users)
        assert last.cumulative_species == len(taxa)
        assert last.cumulative_observations == len(ids)
        assert sum(r.new_users for r in table) == len(users)
        assert all(r.new_users <= r.unique_users and r.new_species <= r.unique_species for r in table)
        for a, b in zip(table, table[1:]):
            assert a.cumulative_users <= b.cumulative_users
            assert a.cumulative_observations <= b.cumulative_observations


def test_boundary_week_counted_once(spark):
    obs = make_obs(spark, BOUNDARY)
    table = {r.week: r for r in pm.weekly_observations(obs, **CAL).collect()}
    # 2018-12-31 and 2019-01-01 share the week of Monday 2018-12-31
    wk = table[dt.date(2018, 12, 31)]
    assert wk.unique_observations == 2 and wk.year == 2018 and wk.week_number == 53
    assert table[dt.date(2025, 12, 29)].unique_observations == 2  # ids 9 (twice) and 10


def test_metamorphic_duplicates_and_partitioning(spark):
    obs = make_obs(spark, BOUNDARY)
    base = sorted(map(tuple, pm.period_summary(obs, **CAL).collect()))
    noisy = obs.unionByName(obs).repartition(7)
    assert sorted(map(tuple, pm.period_summary(noisy, **CAL).collect())) == base


def test_null_keys_and_dates_skipped(spark):
    obs = make_obs(spark, BOUNDARY)
    fs = {r.user_id: r.first_date for r in first_seen(obs, "user_id").collect()}
    assert None not in fs and 17 not in fs  # user 17 has no dated observation
    raw = obs.withColumn("time_observed_at", F.lit(None).cast("timestamp_ntz"))
    fact = observation_fact(raw, store_first_seen(raw, Scratch(spark)))
    row = fact.where("id = 6").first()
    assert row.first_user_date is None and row.first_taxon_date == dt.date(2020, 12, 31)
    assert row.time_observed_at == dt.datetime(2020, 12, 31)


def test_derived_calendar_covers_whole_years(spark):
    obs = make_obs(spark, BOUNDARY)
    table = pm.weekly_users(obs, as_of="2030-01-01").collect()
    assert min(r.week for r in table) == dt.date(2016, 12, 26)  # week of 2017-01-01
    assert max(r.week for r in table) == dt.date(2026, 12, 28)


def test_metric_set_costs_one_fact_pass(spark):
    """However many metrics: the fact is read once and shuffled once (one
    keyed aggregation gives both distinct pairs and first periods), no join
    back to the fact."""
    from sightline.sources import driver_tables
    from tests.conftest import SMOKE_DIR

    obs = driver_tables.observations(spark, SMOKE_DIR)
    for metrics in (["users"], ["users", "species", "observations"]):
        df = pm.period_summary(obs, metrics, as_of="2002-12-31", start="1994-01-01", end="2002-12-31")
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert final.count("FileScan parquet [l_orderkey") == 1, metrics
        assert final.count("partial_min(") == 1, metrics
        assert "SortMergeJoin" not in final


def test_approx_unique_counts_close_and_new_exact(spark):
    from sightline.sources import driver_tables
    from tests.conftest import SMOKE_DIR

    obs = driver_tables.observations(spark, SMOKE_DIR)
    cal = dict(as_of="2002-12-31", start="1994-01-01", end="2002-12-31")
    exact = {r.week: r for r in pm.period_summary(obs, **cal).collect()}
    approx = {r.week: r for r in pm.period_summary(obs, approx=True, rsd=0.01, **cal).collect()}
    assert exact.keys() == approx.keys()
    for week, e in exact.items():
        a = approx[week]
        assert (a.new_users, a.cumulative_users, a.new_species) == (e.new_users, e.cumulative_users, e.new_species)
        for col in ("unique_users", "unique_species", "unique_observations"):
            assert abs(a[col] - e[col]) <= max(2, 0.05 * e[col]), (week, col)


def test_hot_user_exact_and_combined_map_side(spark):
    """One user holds 40% of all rows, spread over every input partition:
    counts stay exact, and the keyed aggregation combines per task before
    its shuffle (partial_min below the exchange)."""
    n = 4000
    obs = (
        spark.range(n, numPartitions=16)
        .select(
            F.col("id"),
            F.date_add(F.lit("2019-01-01").cast("date"), (F.col("id") % 700).cast("int")).alias("observed_on"),
            F.when(F.col("id") % 5 < 2, F.lit(7)).otherwise(F.col("id") % 300 + 100).alias("user_id"),
            (F.col("id") % 37).alias("taxon_id"),
        )
    )
    cal = dict(as_of="2021-12-31", start="2019-01-01", end="2021-12-31")
    df = pm.period_summary(obs, grain="week", **cal)
    table = df.collect()
    rows = obs.collect()
    assert sum(r.user_id == 7 for r in rows) * 5 == 2 * n
    last = table[-1]
    assert last.cumulative_users == len({r.user_id for r in rows})
    assert last.cumulative_species == len({r.taxon_id for r in rows})
    assert last.cumulative_observations == n
    for r in table:
        in_week = [x for x in rows if x.observed_on - dt.timedelta(days=x.observed_on.weekday()) == r.week]
        assert r.unique_users == len({x.user_id for x in in_week}), r.week
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.index("partial_min(") > plan.index("Exchange hashpartitioning(k")


def test_first_seen_join_broadcast_or_shuffle_same_rows(spark):
    """Measured first-seen tables within the limit are broadcast (the fact is
    never shuffled); over the limit the shuffle join gives the same rows."""
    from sightline.operators.first_seen import attach_first_seen, store_first_seen
    from sightline.session import Scratch
    from sightline.sources import driver_tables
    from tests.conftest import SMOKE_DIR

    obs = driver_tables.observations(spark, SMOKE_DIR)
    cols = ["id", "user_id", "taxon_id", "first_user_date", "first_user_week", "first_taxon_date", "first_taxon_week"]
    firsts = store_first_seen(obs, Scratch(spark))
    small = attach_first_seen(obs, firsts).select(*cols)
    rows = small.collect()
    plan = small._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Exchange hashpartitioning(user_id" not in plan and "SortMergeJoin" not in plan
    big = attach_first_seen(obs, firsts, broadcast_limit=0).select(*cols)
    assert sorted(big.collect()) == sorted(rows)
    first_user = {}
    for r in obs.where("observed_on is not null").collect():
        first_user[r.user_id] = min(first_user.get(r.user_id, r.observed_on), r.observed_on)
    assert all(r.first_user_date == first_user[r.user_id] for r in rows)
