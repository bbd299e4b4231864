import os

from pyspark.sql import functions as F

from sightline.operators import period_metrics as pm
from sightline.operators.by_species import weekly_by_species
from sightline.plans.chart_series import build_series
from sightline.plans.count_check import count_check
from sightline.plans.metric_build import build_metrics
from sightline.sources import driver_tables as dt
from sightline.sources.metrics_io import read_metrics
from tests.conftest import SMOKE_DIR

CAL = dict(as_of=dt.AS_OF, start=dt.CAL_START, end=dt.CAL_END)


def _same(a, b):
    return sorted(map(tuple, a.select(*sorted(a.columns)).collect())) == sorted(
        map(tuple, b.select(*sorted(b.columns)).collect())
    )


def test_metric_build_then_series(spark, tmp_dir):
    raw = dt.observations(spark, SMOKE_DIR)
    root = os.path.join(tmp_dir, "out")
    paths = build_metrics(spark, raw, root, dt.TRACKED_NAMES, as_of=dt.AS_OF)
    assert {"weekly_users", "weekly_species", "weekly_observations", "weekly_by_species"} <= set(paths)
    tables = read_metrics(spark, root, "weekly")
    obs = dt.observations(spark, SMOKE_DIR)
    assert _same(tables["users"], pm.weekly_users(obs, **CAL))
    assert _same(tables["species"], pm.weekly_species(obs, **CAL))
    assert _same(tables["observations"], pm.weekly_observations(obs, **CAL))
    assert _same(tables["by_species"], weekly_by_species(obs, dt.TRACKED_NAMES, **CAL))
    fact = spark.read.parquet(os.path.join(root, "observations_fact"))
    assert fact.count() == raw.count() and "scientific_name_key" in fact.columns

    series = build_series(spark, root, os.path.join(tmp_dir, "charts"), dt.TRACKED_NAMES, min_year=1996)
    long = spark.read.parquet(series["metric_series"])
    assert long.select("metric").distinct().count() == 3
    weeks = tables["users"].where(F.col("year") >= 1996).count()
    assert long.count() == 16 * weeks
    assert spark.read.parquet(series["species_series"]).count() > 0

    audit_rows, previews = count_check(spark, obs, root)
    overall = [r for r in audit_rows if r.scope == "all"][0]
    assert overall.total_count == 6000 and overall.distinct_id_count == 4599
    assert len(previews["users"]) == 5


def test_command_line_jobs(spark, tmp_dir, capsys):
    from sightline.__main__ import main
    from sightline.sources.observations_csv import write_observations_csv

    export = os.path.join(tmp_dir, "export")
    write_observations_csv(dt.observations(spark, SMOKE_DIR, with_names=True).drop("quality_grade"), export)
    out = os.path.join(tmp_dir, "metrics")
    main(["build-metrics", export, out, "--as-of", "2002-12-31"])
    main(["build-charts", out, os.path.join(tmp_dir, "charts"), "--min-year", "1996"])
    main(["check-counts", export, "--metrics", out])
    printed = capsys.readouterr().out
    assert "weekly_users" in printed and "'distinct_id_count': 4599" in printed
    users = read_metrics(spark, out, "weekly", names=("users",))["users"]
    assert _same(users, pm.weekly_users(dt.observations(spark, SMOKE_DIR), as_of=dt.AS_OF,
                                        start=dt.CAL_START, end=dt.CAL_END))
    assert not spark.sparkContext._jsc.sc().isStopped()


def test_fact_write_rebalanced_by_year(spark, tmp_dir):
    """Scattered input (every task holds every year): the rebalanced write
    gives each year folder few files instead of one per input task, and the
    rows are the same either way."""
    import glob

    from sightline.plans.metric_build import write_fact

    raw = dt.observations(spark, SMOKE_DIR).repartition(16)
    counts = {}
    for rebalance in (True, False):
        path = os.path.join(tmp_dir, f"fact-{rebalance}")
        fact = write_fact(raw, path, rebalance=rebalance)
        assert fact.count() == 6000
        files = glob.glob(os.path.join(path, "observed_year=*", "*.parquet"))
        years = {os.path.basename(os.path.dirname(f)) for f in files}
        counts[rebalance] = len(files) / len(years)
    assert counts[True] <= 2 and counts[False] >= 8


def test_fused_counts_equal_separate_passes_and_read_once(spark):
    """Period counts and tracked-species counts from one keyed aggregation
    equal the two separate aggregations, and read the fact once."""
    import re

    from sightline.operators.by_species import (
        observations_per_period_species,
        period_and_species_counts,
        species_counts,
    )

    obs = dt.observations(spark, SMOKE_DIR)
    metrics = ("users", "species", "observations")
    fused = period_and_species_counts(obs, metrics, dt.TRACKED_NAMES)
    rows = fused.collect()
    plan = fused._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet [l_orderkey") == 1
    assert set(re.findall(r"(SortAggregate|ObjectHashAggregate|HashAggregate)", plan)) == {"HashAggregate"}
    cols = [c for c in pm.period_counts(obs, metrics).columns if c != "week"]
    expected = {r.week: tuple(r[c] for c in cols) for r in pm.period_counts(obs, metrics).collect()}
    assert {r.week: tuple(r[c] for c in cols) for r in rows if not r.species} == expected
    keys = ["week", "taxon_id", "scientific_name", "common_name", "observations"]
    want = sorted(tuple(r[k] for k in keys) for r in observations_per_period_species(obs, dt.TRACKED_NAMES).collect())
    assert sorted(tuple(r[k] for k in keys) for r in species_counts(fused).collect()) == want


def test_build_writes_the_same_tables_for_any_name_list(spark, tmp_dir):
    """A short list, a long one and a table of names: the same tables with
    the same rows."""
    raw = dt.observations(spark, SMOKE_DIR)
    long = [*dt.TRACKED_NAMES, *(f"absent {i}" for i in range(1500))]
    built = []
    for i, names in enumerate((dt.TRACKED_NAMES, long, spark.createDataFrame([(n,) for n in long], "name string"))):
        root = os.path.join(tmp_dir, str(i))
        paths = build_metrics(spark, raw, root, names, as_of=dt.AS_OF)
        built.append((sorted(paths), read_metrics(spark, root, "weekly")))
    for paths, tables in built[1:]:
        assert paths == built[0][0] and "weekly_counts" in paths
        for name in ("users", "species", "observations", "by_species"):
            assert _same(tables[name], built[0][1][name]), name


def test_all_grains_are_built(spark, tmp_dir):
    raw = dt.observations(spark, SMOKE_DIR, with_names=True)
    root = os.path.join(tmp_dir, "grains")
    build_metrics(spark, raw, root, dt.TRACKED_NAMES, as_of=dt.AS_OF, grains=("month", "quarter", "year"), fmt="csv")
    ids = raw.select("id").distinct().count()
    for period, key in (("monthly", "month"), ("quarterly", "quarter"), ("yearly", "year_start")):
        tables = read_metrics(spark, root, period, names=("users", "species", "observations"), fmt="csv")
        rows = tables["observations"].orderBy(key).collect()
        assert len({r[key] for r in rows}) == len(rows)
        assert sum(r.unique_observations for r in rows) >= ids and rows[-1].year == 2002
    years = {r.year_number: r.unique_observations for r in rows}
    by_year = raw.groupBy(F.year("observed_on").alias("y")).agg(F.count_distinct("id").alias("n")).collect()
    assert {r.y: r.n for r in by_year} == {y: n for y, n in years.items() if n}


def test_csv_hand_over_between_the_jobs(spark, tmp_dir, capsys):
    from sightline.__main__ import main
    from sightline.sources.observations_csv import write_observations_csv

    export, out = os.path.join(tmp_dir, "export"), os.path.join(tmp_dir, "metrics")
    write_observations_csv(dt.observations(spark, SMOKE_DIR).drop("quality_grade"), export)
    main(["build-metrics", export, out, "--as-of", "2002-12-31", "--start", "1994-01-01", "--end", "2002-12-31",
          "--csv", "--single-line"])
    main(["build-charts", out, os.path.join(tmp_dir, "charts"), "--min-year", "1996", "--csv"])
    main(["check-counts", export, "--metrics", out, "--csv", "--single-line"])
    assert "'distinct_id_count': 4599" in capsys.readouterr().out
    assert spark.read.parquet(os.path.join(tmp_dir, "charts", "metric_series")).count() > 0


def test_sorted_results_arrive_in_order(spark):
    from sightline.plans import registry

    for key in ("sort_by_period", "sort_desc"):
        places = [r.place for r in registry.QUERIES[key](spark, SMOKE_DIR).collect()]
        assert places == list(range(1, len(places) + 1)), key


def test_checkpoint_folder_is_required_on_a_cluster():
    import pytest

    from sightline.session import checkpoint_root

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(Session())


def test_fact_files_sorted_by_name_key(spark, tmp_dir):
    """Within every fact file the rows run in name-key order, the layout that
    lets row-group statistics skip untracked names."""
    import glob

    import pyarrow.parquet as pq

    from sightline.plans.metric_build import write_fact

    path = os.path.join(tmp_dir, "fact")
    write_fact(dt.observations(spark, SMOKE_DIR).repartition(4), path)
    files = glob.glob(os.path.join(path, "observed_year=*", "*.parquet"))
    assert files
    for f in files:
        keys = pq.read_table(f, columns=["scientific_name_key"]).column(0).to_pylist()
        assert keys == sorted(keys), f
