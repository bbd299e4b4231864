import datetime as dt

from sightline.operators import by_species, series, yoy
from sightline.operators import period_metrics as pm
from tests.fixtures import BOUNDARY, make_obs

CAL = dict(as_of="2026-12-31", start="2018-01-01", end="2026-12-31")


def test_two_common_names_one_row(spark):
    obs = make_obs(
        spark,
        [
            (1, "2020-05-04", 1, 7, "Red Plate", "zeta"),
            (2, "2020-05-05", 2, 7, "Red Plate", "alpha"),
            (3, "2020-05-12", 2, 7, "RED PLATE", "alpha"),
            (4, "2020-05-12", 3, 8, "other", "q"),
        ],
    )
    rows = by_species.weekly_by_species(obs, ["red plate"], **CAL).orderBy("week", "scientific_name").collect()
    first = rows[0]
    assert (first.week, first.common_name, first.observations, first.cumulative_observations) == (
        dt.date(2020, 5, 4), "alpha", 2, 2)
    # case-insensitive match keeps both spellings, each with its own running total
    assert {r.scientific_name for r in rows} == {"Red Plate", "RED PLATE"}


def test_name_lists_of_any_size_and_form_agree(spark):
    obs = make_obs(spark, BOUNDARY)
    names = ["red plate", "OLD ROD"]
    long = names + [f"absent {i}" for i in range(1500)]
    table = spark.createDataFrame([(n,) for n in long + names], "name string")  # repeats do not multiply rows
    for form in (names, long, table):
        assert sorted(r.id for r in by_species.name_in_list(obs, form).collect()) == [1, 2, 3, 4, 5, 8]
        marked = by_species.mark_tracked(obs, form).collect()
        assert sorted(r.id for r in marked if r._tracked) == [1, 2, 3, 4, 5, 8] and len(marked) == len(BOUNDARY)
    assert by_species.name_in_list(obs, []).count() == 0


def test_species_counts_use_fixed_width_buffers(spark):
    """No object or sort aggregation holds a buffer per observation id."""
    import re

    from sightline.sources import driver_tables
    from tests.conftest import SMOKE_DIR

    obs = driver_tables.observations(spark, SMOKE_DIR)
    df = by_species.observations_per_period_species(obs, driver_tables.TRACKED_NAMES)
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ObjectHashAggregate" not in plan
    for line in plan.splitlines():
        if "SortAggregate" in line:  # only the common name, over counted rows
            assert "value" not in re.search(r"key=\[(.*?)\]", line).group(1)


def test_year_adjusted_first_period_is_zero(spark):
    obs = make_obs(spark, BOUNDARY)
    three = [pm.period_metrics(obs, m, "week", **CAL) for m in ("users", "species", "observations")]
    table = yoy.yoy_metrics(*three).collect()
    by_year = {}
    for r in table:
        by_year.setdefault(r.year, []).append(r)
    for rows in by_year.values():
        first = min(rows, key=lambda r: r.week)
        assert first.year_adjusted_cumulative_users == 0
        assert first.year_adjusted_cumulative_observations == 0
    labels = [(r.year, r.week_number) for r in table]
    assert len(labels) == len(set(labels))


def test_prior_baseline_counts_first_period(spark):
    obs = make_obs(spark, [
        (1, "2020-01-06", 1, 5, "a", "a"),
        (2, "2020-01-07", 2, 5, "a", "a"),
        (3, "2020-01-13", 3, 6, "b", "b"),
    ])
    wo = pm.weekly_observations(obs, as_of="2020-12-31", start="2020-01-01", end="2020-12-31")
    step = {"cumulative_observations": "unique_observations"}
    first = {r.week: r for r in yoy.year_adjusted(wo, step).collect()}
    prior = {r.week: r for r in yoy.year_adjusted(wo, step, baseline="prior").collect()}
    jan6, jan13 = dt.date(2020, 1, 6), dt.date(2020, 1, 13)
    assert first[jan6].year_adjusted_cumulative_observations == 0  # the first period's own count is excluded
    assert prior[jan6].year_adjusted_cumulative_observations == 2
    assert (first[jan13].year_adjusted_cumulative_observations, prior[jan13].year_adjusted_cumulative_observations) == (1, 3)


def test_keep_first_per_label_with_raw_iso_labels(spark):
    obs = make_obs(spark, BOUNDARY)
    wo = pm.weekly_observations(obs, reconcile_years=(), **CAL)
    kept = yoy.keep_first_per_label(wo).collect()
    # 2018-12-31 (ISO week 1 of 2019) collides with 2018-01-01 in year 2018
    assert dt.date(2018, 12, 31) not in {r.week for r in kept}
    assert len(kept) == len({(r.year, r.week_number) for r in wo.collect()}) < wo.count()


def test_series_long_form(spark):
    obs = make_obs(spark, BOUNDARY)
    three = [pm.period_metrics(obs, m, "week", **CAL) for m in ("users", "species", "observations")]
    table = yoy.yoy_metrics(*three)
    long = series.metric_series(table, 2019)
    weeks_2019_plus = table.where("year >= 2019").count()
    assert long.count() == 16 * weeks_2019_plus
    every = {r.series_year for r in series.series_by_year(table, "week_number", "cumulative_users").collect()}
    assert every == {r.year for r in table.select("year").collect()}  # no year is left out by default
    pts = series.series_by_year(table, "week_number", "cumulative_users", years=[2020]).collect()
    assert {p.series_year for p in pts} == {2020} and isinstance(pts[0].week_number, int)


def test_densify_gives_every_species_every_week(spark):
    obs = make_obs(spark, BOUNDARY)
    cal = dict(as_of="2020-12-31", start="2018-01-01", end="2026-12-31")
    sparse = by_species.weekly_by_species(obs, ["red plate", "old rod"], **cal)
    dense = by_species.weekly_by_species(obs, ["red plate", "old rod"], densify=True, **cal).collect()
    n_weeks = len({r.week for r in dense})
    assert n_weeks == (dt.date(2020, 12, 28) - dt.date(2018, 1, 1)).days // 7 + 1
    sparse_rows = sparse.collect()
    keys = {(r.taxon_id, r.scientific_name) for r in sparse_rows}
    assert len(keys) == 3  # 'old rod' is seen under two taxa
    assert len(dense) == len(keys) * n_weeks
    seen = {(r.taxon_id, r.scientific_name, r.week): r for r in sparse_rows}
    for r in dense:
        hit = seen.get((r.taxon_id, r.scientific_name, r.week))
        assert r.observations == (hit.observations if hit else 0)
    last = max((r for r in dense if r.taxon_id == 100), key=lambda r: r.week)
    assert last.cumulative_observations == sum(h.observations for (t, _, _), h in seen.items() if t == 100)
