import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import by_species
from sightline.operators import period_metrics as pm
from sightline.operators import sketches
from sightline.plans.metric_store import MetricStore, day_pairs, within
from tests.fixtures import make_obs

NAMES = ("Aa", "b b")
SPAN = dict(start=dt.date(2019, 1, 1), end=dt.date(2021, 12, 31), as_of=dt.date(2021, 12, 31))


def random_rows(seed, n, first_id, start, days):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        day = None if rng.random() < 0.05 else str(start + dt.timedelta(days=rng.randrange(days)))
        taxon = rng.choice([None, *range(12)])
        name = rng.choice(["aa", "B B", "c", None])
        out.append((first_id + i, day, rng.choice([None, *range(25)]), taxon, name, rng.choice(["x", "y", None])))
    return out


@pytest.fixture(scope="module")
def batches():
    """A base, a later batch, one of late rows that overlaps the others (rows
    repeated, ids seen again on other days) and one with nothing dated."""
    base = random_rows(1, 400, 0, dt.date(2020, 3, 1), 120)
    later = random_rows(2, 200, 1000, dt.date(2020, 6, 20), 60)
    late = random_rows(3, 150, 100, dt.date(2019, 11, 1), 200) + base[:40] + later[:10]
    return {"base": base, "later": later, "late": late, "undated": [(5000, None, 1, 1, "aa", "x")]}


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize(
    "order,grains", [(("base", "later", "late", "undated"), ("week", "day", "month")), (("late", "later", "base"), ("week",))]
)
def test_base_and_increments_equal_a_full_build(spark, tmp_dir, batches, order, grains):
    store = MetricStore(spark, f"{tmp_dir}/store", grains, NAMES)
    for key in order:
        store.apply_increment(make_obs(spark, batches[key]), key)
    rows = make_obs(spark, [r for key in order for r in batches[key]])
    for grain in grains:
        same(store.summary(grain, **SPAN), pm.period_summary(rows, grain=grain, **SPAN))
    same(store.summary("week", as_of=SPAN["as_of"]), pm.period_summary(rows, grain="week", as_of=SPAN["as_of"]))
    early = dict(SPAN, as_of=dt.date(2020, 5, 5))
    same(store.summary("week", **early), pm.period_summary(rows, grain="week", **early))
    same(store.by_species(**SPAN), by_species.weekly_by_species(rows, NAMES, **SPAN))
    exact = pm.unique_per_period(rows, pm.METRICS, "month").orderBy("month").collect()
    estimate = store.approx_uniques("month").orderBy("month").collect()
    assert [tuple(r) for r in estimate] == [tuple(r) for r in exact]  # small sets


def test_a_batch_applied_again_changes_nothing(spark, tmp_dir, batches):
    store = MetricStore(spark, f"{tmp_dir}/store", ("week",), NAMES)
    for key in ("base", "late"):
        store.apply_increment(make_obs(spark, batches[key]), key)
    before = sorted(map(repr, store.counts().collect())), sorted(map(repr, store.by_species(**SPAN).collect()))
    for key in ("late", "base"):  # also one that others have been compared with
        store.apply_increment(make_obs(spark, batches[key]), key)
    assert before == (sorted(map(repr, store.counts().collect())), sorted(map(repr, store.by_species(**SPAN).collect())))
    # the same rows under another name are no new pairs
    store.apply_increment(make_obs(spark, batches["base"]), "copy")
    assert before[0] == sorted(r for r in map(repr, store.counts().collect()))


def test_an_increment_reads_only_its_periods(spark, tmp_dir):
    root = f"{tmp_dir}/store"
    store = MetricStore(spark, root, ("week",))
    old = [(i, str(dt.date(2015, 1, 1) + dt.timedelta(days=i % 700)), i % 50, i % 9, "n", "n") for i in range(3000)]
    store.apply_increment(make_obs(spark, old), "base")
    days = day_pairs(make_obs(spark, [(9000, "2016-11-20", 1, 1, "n", "n")]))
    near = store._near(store._read("pairs", "x"), days, "week")
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(day), GreaterThanOrEqual(day,2016-11-14), LessThanOrEqual(day,2016-11-20)]" in plan
    assert {r.day.isocalendar().week for r in near.select("day").distinct().collect()} == {46}


def test_nothing_applied_yet(spark, tmp_dir):
    with pytest.raises(ValueError, match="nothing has been applied"):
        MetricStore(spark, f"{tmp_dir}/none").counts()


def test_within_joins_spans(spark):
    day = dt.date(2020, 1, 1)
    spans = [(day + dt.timedelta(days=3 * i), day + dt.timedelta(days=3 * i)) for i in range(500)]
    df = spark.range(0, 1600).select(F.date_add(F.lit(day), F.col("id").cast("int")).alias("d"))
    kept = {r.d for r in df.where(within(F.col("d"), spans)).collect()}
    assert {a for a, _ in spans} <= kept
    assert df.where(within(F.col("d"), [])).count() == 0
    assert df.where(within(F.col("d"), spans[:3])).count() == 3


def test_sketches_roll_up_to_any_grain_within_their_error(spark):
    obs = spark.range(0, 300_000).select(
        F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") % 400).cast("int")).alias("observed_on"),
        ((F.col("id") * 7919) % 90_001).alias("user_id"),
        (F.col("id") % 1000).alias("taxon_id"),
        F.when(F.col("id") % 10 != 0, F.col("id")).alias("id"),
    )
    daily = sketches.daily_sketches(obs)
    for grain in ("week", "month", "year"):
        pcol, _ = pm.PERIOD_COLUMNS[grain]
        exact = {r[pcol]: r for r in pm.unique_per_period(obs, pm.METRICS, grain).collect()}
        got = {r[pcol]: r for r in sketches.rollup_uniques(daily, grain).collect()}
        assert got.keys() == exact.keys()
        for p, r in got.items():
            for m in pm.METRICS:
                assert abs(r[f"unique_{m}"] - exact[p][f"unique_{m}"]) <= 1 + 4 * sketches.standard_error() * exact[p][f"unique_{m}"]
    # overlapping batches: an entity counts once
    twice = daily.unionByName(sketches.daily_sketches(obs.where("id % 3 = 0")))
    assert sorted(map(tuple, sketches.rollup_uniques(twice, "year").collect())) == sorted(
        map(tuple, sketches.rollup_uniques(daily, "year").collect()))


def test_ingest_keeps_the_store_up_to_date(spark, tmp_dir, monkeypatch):
    """Three runs; the second fails after the store has its rows, and again
    after the append, before the batch is committed."""
    import json
    import os

    from sightline.plans.incremental import ingest_pages
    from sightline.streaming import ingest_stream

    pages, table = os.path.join(tmp_dir, "pages"), "sightline_test_store"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    os.makedirs(pages)

    def land(name, rows):
        records = [{"id": i, "observed_on": day, "user": {"id": u}, "taxon": {"id": t, "name": "aa"},
                    "created_at": f"{day}T00:00:00Z"} for i, day, u, t in rows]
        with open(os.path.join(pages, name), "w") as fh:
            fh.write(json.dumps({"page": 1, "results": records}) + "\n")

    store = MetricStore(spark, f"{tmp_dir}/store", ("week",), NAMES)
    options = dict(table_path=f"{tmp_dir}/table", checkpoint_path=f"{tmp_dir}/ckpt", metrics=store)
    land("a.json", [(1, "2020-05-05", 1, 1), (2, "2020-05-06", 1, 2)])
    assert ingest_pages(spark, pages, table, **options) == 2
    land("b.json", [(3, "2020-01-08", 1, 1), (1, "2020-06-01", 9, 9), (4, "2020-05-07", 2, 1)])  # late, held, new
    plain = ingest_stream.new_rows_for_append
    for stage in ("before the append", "after it"):
        calls = []

        def fail(*args, **kw):
            calls.append(1)
            if stage == "before the append" and len(calls) == 2:
                raise RuntimeError(stage)
            return plain(*args, **kw)

        with monkeypatch.context() as patched:
            patched.setattr(ingest_stream, "new_rows_for_append", fail)
            if stage == "after it":
                observation = ingest_stream.Observation
                patched.setattr(observation, "get", property(lambda self: (_ for _ in ()).throw(RuntimeError(stage))))
            with pytest.raises(Exception, match=stage):
                ingest_pages(spark, pages, table, **options)
    ingest_pages(spark, pages, table, **options)
    land("c.json", [(5, "2020-05-05", 7, 7)])
    assert ingest_pages(spark, pages, table, **options) == 1
    rows = spark.table(table)
    assert sorted(r.id for r in rows.collect()) == [1, 2, 3, 4, 5]
    same(store.summary("week", **SPAN), pm.period_summary(rows, grain="week", **SPAN))
