"""Registered queries over the driver's tables (one per operator key).

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole tables. Queries that exercise a reader or writer first write the
observations in that format under the shared checkpoint folder, then read
them back through the operator.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions.calendar import PERIOD_COLUMNS, anchored_year, week_start
from sightline.functions.text import ntz_literal
from sightline.operators import (
    audit,
    by_species,
    calendar,
    events,
    first_seen,
    ingest,
    intervals,
    participation,
    series,
    sketches,
    trends,
    yoy,
)
from sightline.operators import period_metrics as pm
from sightline.plans.metric_store import MetricStore
from sightline.schema import RAW_OBSERVATION, REQUIRED_EXPORT_COLUMNS
from sightline.session import Scratch, delete_path, scratch_path
from sightline.streaming import ingest_stream, latest_stream
from sightline.sources import api_pages, catalog, metrics_io, observations_csv
from sightline.sources import driver_tables as dt

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CAL = dict(as_of=dt.AS_OF, start=dt.CAL_START, end=dt.CAL_END)
RAW_COLS = [f.name for f in RAW_OBSERVATION.fields]


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return deco


def _obs(spark, sf_dir, names=False, source=False):
    return dt.observations(spark, sf_dir, with_names=names, with_source=source)


def _raw(spark, sf_dir):
    return _obs(spark, sf_dir, names=True).select(*RAW_COLS)


# ---------------------------------------------------------------- metrics


def _metric(metric: str, grain: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pm.period_metrics(_obs(spark, sf_dir), metric, grain, **CAL)

    return run


for _grain, _prefix in (("week", "weekly"), ("day", "daily")):
    for _metric_name in ("users", "species", "observations"):
        register(f"{_prefix}_{_metric_name}")(_metric(_metric_name, _grain))


def _weekly_summary(spark, sf_dir):
    """Users, species and observations per week from one fact pass."""
    return pm.period_summary(_obs(spark, sf_dir), ("users", "species", "observations"), "week", **CAL)


def _by_species(spark, sf_dir):
    return by_species.weekly_by_species(_obs(spark, sf_dir, names=True), dt.TRACKED_NAMES, **CAL)


@register("weekly_by_species")
def q_weekly_by_species(spark, sf_dir):
    return _by_species(spark, sf_dir)


@register("observation_fact")
def q_observation_fact(spark, sf_dir):
    obs = _obs(spark, sf_dir, names=True)
    return first_seen.observation_fact(obs, first_seen.store_first_seen(obs, Scratch(spark)))


@register("count_audit")
def q_count_audit(spark, sf_dir):
    return audit.count_audit(_obs(spark, sf_dir))


# ---------------------------------------------------------------- sources


def _csv_roundtrip(spark, df, name="export"):
    path = scratch_path(spark, name)
    observations_csv.write_observations_csv(df, path)
    return path


@register("read_observations_csv")
def q_read_observations_csv(spark, sf_dir):
    """Two exports in one folder: one in the export's column order, one with
    the columns reversed and one more in front."""
    raw, path = _raw(spark, sf_dir), scratch_path(spark, "export")
    first = F.col("id") % 2 == 0
    observations_csv.write_observations_csv(raw.where(first), f"{path}/a")
    other = raw.where(~first).select(F.lit('say "hi", ok').alias("description"), *reversed(RAW_COLS))
    observations_csv.write_observations_csv(other, f"{path}/b")
    return observations_csv.read_observations_csv(spark, f"{path}/*").drop("source_file")


@register("project_required")
def q_project_required(spark, sf_dir):
    return observations_csv.project_required(_obs(spark, sf_dir, names=True))


@register("validate_columns")
def q_validate_columns(spark, sf_dir):
    obs = observations_csv.validate_columns(_obs(spark, sf_dir, names=True), REQUIRED_EXPORT_COLUMNS)
    return observations_csv.project_required(obs)


@register("union_files")
def q_union_files(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    early = _csv_roundtrip(spark, raw.where(F.col("observed_on") < F.lit("1999-01-01").cast("date")), "early")
    late = _csv_roundtrip(spark, raw.where(F.col("observed_on") >= F.lit("1998-01-01").cast("date")), "late")
    frames = [observations_csv.read_observations_csv(spark, p).drop("source_file") for p in (early, late)]
    return observations_csv.union_files(frames)


@register("load_audit")
def q_load_audit(spark, sf_dir):
    return observations_csv.load_audit(_obs(spark, sf_dir, source=True), latest=dt.AS_OF)


@register("write_metrics")
def q_write_metrics(spark, sf_dir):
    """All four written tables read back, one after the other."""
    root = _store_weekly(spark, sf_dir, fmt="csv", with_species=True)
    tables = metrics_io.read_metrics(spark, root, "weekly", fmt="csv")
    tagged = [df.withColumn("metric_table", F.lit(name)) for name, df in tables.items()]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


@register("read_metrics")
def q_read_metrics(spark, sf_dir):
    root = scratch_path(spark, "metrics")
    metrics_io.write_metrics({"by_species": _by_species(spark, sf_dir)}, root, "weekly")
    return metrics_io.read_metrics(spark, root, "weekly", names=("by_species",))["by_species"]


def _from_saved_table(spark, sf_dir, read):
    """Save the observations as a table, read them with ``read`` and take the
    name out of the catalog again (the files stay in scratch)."""
    name = f"sightline_obs_{uuid.uuid4().hex[:12]}"
    catalog.save_table(_raw(spark, sf_dir), name, path=scratch_path(spark, name))
    df = read(name)
    spark.sql(f"DROP TABLE {name}")
    return df


@register("save_table")
def q_save_table(spark, sf_dir):
    return _from_saved_table(spark, sf_dir, spark.table)


@register("table_or_empty")
def q_table_or_empty(spark, sf_dir):
    def read(name):
        missing = catalog.table_or_empty(spark, f"{name}_absent", RAW_OBSERVATION)
        return catalog.table_or_empty(spark, name, RAW_OBSERVATION).unionByName(missing)

    return _from_saved_table(spark, sf_dir, read)


def _landed_pages(spark, sf_dir):
    path = scratch_path(spark, "pages")
    api_pages.write_api_pages(dt.observations(spark, sf_dir), path, fields=dt.api_fields())
    return path


@register("read_api_pages")
def q_read_api_pages(spark, sf_dir):
    recs = api_pages.read_api_pages(spark, _landed_pages(spark, sf_dir))
    return recs.select(
        "page",
        F.col("record.id").alias("id"),
        F.col("record.observed_on").alias("observed_on"),
        F.col("record.user.id").alias("user_id"),
        F.col("record.taxon.id").alias("taxon_id"),
    )


# ------------------------------------------------------ projections, filters


@register("rename_date")
def q_rename_date(spark, sf_dir):
    return _obs(spark, sf_dir).withColumnRenamed("observed_on", "observed_date").select(
        "id", "observed_date", "user_id", "taxon_id"
    )


@register("week_of")
def q_week_of(spark, sf_dir):
    return _obs(spark, sf_dir).select(
        "id", F.col("observed_on").alias("observed_date"), week_start("observed_on").alias("observed_week")
    )


@register("observed_at_fill")
def q_observed_at_fill(spark, sf_dir):
    obs = _obs(spark, sf_dir)
    return obs.select(
        "id", F.col("observed_on").alias("observed_date"), first_seen.observed_at_fill(obs).alias("time_observed_at")
    )


@register("name_in_list")
def q_name_in_list(spark, sf_dir):
    return by_species.name_in_list(_obs(spark, sf_dir, names=True), dt.TRACKED_NAMES).select(
        "id", "taxon_id", "scientific_name", "observed_on"
    )


@register("as_of_filter")
def q_as_of_filter(spark, sf_dir):
    cal = dict(CAL, as_of="1999-06-30")
    return pm.period_metrics(_obs(spark, sf_dir), "observations", "week", **cal)


@register("min_year_filter")
def q_min_year_filter(spark, sf_dir):
    return series.min_year_filter(yoy.yoy_summary(_weekly_summary(spark, sf_dir)), 1998)


@register("single_name_filter")
def q_single_name_filter(spark, sf_dir):
    return by_species.name_in_list(yoy.yoy_species(_by_species(spark, sf_dir)), ["small widget"])


@register("typed_metrics")
def q_typed_metrics(spark, sf_dir):
    users = pm.period_metrics(_obs(spark, sf_dir), "users", "week", **CAL)
    path = scratch_path(spark, "text-metrics")
    users.coalesce(1).write.option("header", True).csv(path)
    text = spark.read.option("header", True).csv(path)  # every column a string
    return metrics_io.typed_metrics(text, "week", "users")


@register("zero_fill")
def q_zero_fill(spark, sf_dir):
    obs = _obs(spark, sf_dir)
    cal = calendar.week_calendar(calendar.literal_bounds(spark, dt.CAL_START, dt.CAL_END), dt.AS_OF)
    uniq = pm.unique_per_period(obs, ["users"], "week")
    return cal.join(uniq, "week", "left").select(
        "week", F.coalesce(F.col("unique_users"), F.lit(0)).alias("unique_users")
    )


def _flat_records(spark, sf_dir):
    return api_pages.flatten_records(api_pages.read_api_pages(spark, _landed_pages(spark, sf_dir)))


@register("flatten_record")
def q_flatten_record(spark, sf_dir):
    flat = _flat_records(spark, sf_dir).drop("page", "source_file")
    return flat.withColumn("created_at_details", F.to_json("created_at_details"))


@register("geometry_fields")
def q_geometry_fields(spark, sf_dir):
    """The landed geometry as typed columns."""
    shapes = api_pages.geometry_fields(_flat_records(spark, sf_dir))
    return shapes.select("id", *api_pages.GEOMETRY)


@register("year_of_date")
def q_year_of_date(spark, sf_dir):
    return _obs(spark, sf_dir).select("id", F.col("observed_on").alias("observed_date"), F.year("observed_on").alias("year"))


@register("subtract_baseline")
def q_subtract_baseline(spark, sf_dir):
    wo = pm.period_metrics(_obs(spark, sf_dir), "observations", "week", **CAL)
    wo = yoy.year_start_value(wo, "cumulative_observations", "starting_cumulative_observations")
    wo = yoy.subtract_baseline(
        wo, "cumulative_observations", "starting_cumulative_observations", "year_adjusted_cumulative_observations"
    )
    return wo.select(
        "week",
        "year",
        "cumulative_observations",
        "starting_cumulative_observations",
        "year_adjusted_cumulative_observations",
    )


@register("drop_helper")
def q_drop_helper(spark, sf_dir):
    """A helper column is added, used and dropped; what stays has the types
    of the metric tables."""
    in_year = Window.partitionBy("year").orderBy("week")
    helped = _weekly_summary(spark, sf_dir).withColumn("row_number", F.row_number().over(in_year))
    return metrics_io.metric_columns(helped.where("row_number > 1").drop("row_number"), "week")


# ------------------------------------------------------------------ joins


@register("attach_first_seen")
def q_attach_first_seen(spark, sf_dir):
    obs = _obs(spark, sf_dir)
    return first_seen.attach_first_seen(obs, first_seen.store_first_seen(obs, Scratch(spark))).select(
        "id",
        "user_id",
        "taxon_id",
        "observed_on",
        "first_user_date",
        "first_user_week",
        "first_taxon_date",
        "first_taxon_week",
    )


@register("densify_calendar")
def q_densify_calendar(spark, sf_dir):
    cal = calendar.week_calendar(calendar.literal_bounds(spark, dt.CAL_START, dt.CAL_END), dt.AS_OF)
    return cal.join(pm.unique_per_period(_obs(spark, sf_dir), ["observations"], "week"), "week", "left")


@register("attach_unique")
def q_attach_unique(spark, sf_dir):
    return pm.period_metrics(_obs(spark, sf_dir), "species", "week", **CAL).select(
        "week", "new_species", "cumulative_species", "unique_species"
    )


def _store_weekly(spark, sf_dir, fmt="parquet", with_species=False):
    """Write the weekly metric tables as a metric build does: the combined
    summary once, then each table split from it (no recomputation)."""
    root = scratch_path(spark, "metrics")
    summary_path = f"{root}/weekly_summary"
    _weekly_summary(spark, sf_dir).write.parquet(summary_path)
    tables = pm.split_summary(spark.read.parquet(summary_path))
    if with_species:
        tables["by_species"] = _by_species(spark, sf_dir)
    metrics_io.write_metrics(tables, root, "weekly", fmt=fmt)
    return root


def _stored_weekly_three(spark, sf_dir):
    """The stored weekly users / species / observations tables, read back:
    the inputs the combine step works on."""
    m = metrics_io.read_metrics(
        spark, _store_weekly(spark, sf_dir), "weekly", names=("users", "species", "observations")
    )
    return m["users"], m["species"], m["observations"]


@register("combine_metrics")
def q_combine_metrics(spark, sf_dir):
    return yoy.combine_metrics(*_stored_weekly_three(spark, sf_dir))


def _existing(spark, sf_dir):
    """The already-ingested table (records created before the cut), stored
    once like the observation table it stands for, and all records."""
    obs = _obs(spark, sf_dir, names=True)
    path = scratch_path(spark, "existing")
    obs.where(F.col("created_at") < ntz_literal(dt.INGEST_CUT)).write.parquet(path)
    return spark.read.parquet(path), obs


def _increment(spark, sf_dir):
    existing, obs = _existing(spark, sf_dir)
    return existing, ingest.select_increment(obs, ingest.incremental_start(existing))


@register("anti_new")
def q_anti_new(spark, sf_dir):
    existing, batch = _increment(spark, sf_dir)
    return ingest.anti_new(batch, existing)


@register("event_band")
def q_event_band(spark, sf_dir):
    obs = _obs(spark, sf_dir)
    wo = pm.period_metrics(obs, "observations", "week", **CAL)
    return events.event_band(wo, _events(spark, sf_dir)).select(
        "event", "band_start", "band_end", "week", "unique_observations"
    )


# ----------------------------------------------------------- aggregations


@register("first_seen")
def q_first_seen(spark, sf_dir):
    return first_seen.first_seen_all(_obs(spark, sf_dir))


@register("new_per_period")
def q_new_per_period(spark, sf_dir):
    return pm.new_per_period(_obs(spark, sf_dir), ["users", "species"], "week")


@register("unique_per_period")
def q_unique_per_period(spark, sf_dir):
    return pm.unique_per_period(_obs(spark, sf_dir), ["users", "species"], "week")


@register("observations_per_period")
def q_observations_per_period(spark, sf_dir):
    return pm.unique_per_period(_obs(spark, sf_dir), ["observations"], "week")


@register("observations_per_period_species")
def q_observations_per_period_species(spark, sf_dir):
    return by_species.observations_per_period_species(_obs(spark, sf_dir, names=True), dt.TRACKED_NAMES)


@register("total_vs_distinct")
def q_total_vs_distinct(spark, sf_dir):
    return audit.total_vs_distinct(_obs(spark, sf_dir))


@register("yearly_total_vs_distinct")
def q_yearly_total_vs_distinct(spark, sf_dir):
    return audit.yearly_total_vs_distinct(_obs(spark, sf_dir))


@register("high_watermark")
def q_high_watermark(spark, sf_dir):
    existing, _ = _existing(spark, sf_dir)
    return ingest.high_watermark(existing)


@register("page_stats")
def q_page_stats(spark, sf_dir):
    return ingest.page_stats(_flat_records(spark, sf_dir)).drop("source_file")


@register("distinct_rows")
def q_distinct_rows(spark, sf_dir):
    return audit.distinct_rows(_obs(spark, sf_dir).select(week_start("observed_on").alias("observed_week"), "user_id"))


# ---------------------------------------------------------------- windows


@register("running_total")
def q_running_total(spark, sf_dir):
    counts = pm.unique_per_period(_obs(spark, sf_dir), ["observations"], "week")
    return pm.running_total(counts, "unique_observations", "week", "cumulative_observations")


@register("running_total_by_key")
def q_running_total_by_key(spark, sf_dir):
    return _by_species(spark, sf_dir).select(
        "taxon_id", "scientific_name", "week", "observations", "cumulative_observations"
    )


@register("year_start_value")
def q_year_start_value(spark, sf_dir):
    wu = pm.period_metrics(_obs(spark, sf_dir), "users", "week", **CAL)
    return yoy.year_start_value(wu, "cumulative_users", "starting_cumulative_users").select(
        "week", "year", "cumulative_users", "starting_cumulative_users"
    )


@register("keep_first_per_label")
def q_keep_first_per_label(spark, sf_dir):
    iso_labels = dict(CAL, reconcile_years=())
    wo = pm.period_metrics(_obs(spark, sf_dir), "observations", "week", **iso_labels)
    return yoy.keep_first_per_label(wo, "week_number", ("year",), "week")


# --------------------------------------------------------------- calendar


def _data_bounds(spark, sf_dir):
    return calendar.date_bounds(_obs(spark, sf_dir))


@register("calendar")
def q_calendar(spark, sf_dir):
    return calendar.calendar_days(_data_bounds(spark, sf_dir))


@register("week_calendar")
def q_week_calendar(spark, sf_dir):
    return calendar.week_calendar(_data_bounds(spark, sf_dir), dt.AS_OF)


@register("day_calendar")
def q_day_calendar(spark, sf_dir):
    return calendar.day_calendar(_data_bounds(spark, sf_dir), dt.AS_OF)


@register("week_bounds")
def q_week_bounds(spark, sf_dir):
    return calendar.week_bounds(_obs(spark, sf_dir))


@register("event_calendar")
def q_event_calendar(spark, sf_dir):
    return events.events_for_data_years(_obs(spark, sf_dir))


# ----------------------------------------------------- sorts, limits, sets


@register("sort_by_period")
def q_sort_by_period(spark, sf_dir):
    users = pm.period_metrics(_obs(spark, sf_dir), "users", "week", **CAL)
    place = F.row_number().over(Window.orderBy("week"))
    return users.withColumn("place", place).orderBy("week")


@register("sort_desc")
def q_sort_desc(spark, sf_dir):
    newest_first = F.col("year").desc_nulls_last()
    counts = audit.count_audit(_obs(spark, sf_dir))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(newest_first))).orderBy(newest_first)


@register("preview_limit")
def q_preview_limit(spark, sf_dir):
    return audit.preview(pm.period_metrics(_obs(spark, sf_dir), "users", "week", **CAL), ["week"], 5)


@register("union_by_name")
def q_union_by_name(spark, sf_dir):
    obs = _obs(spark, sf_dir)
    cut = ntz_literal(dt.INGEST_CUT)
    old = obs.where(F.col("created_at") < cut).select("id", "user_id", "taxon_id", "observed_on", "created_at")
    new = obs.where(F.col("created_at") >= cut).select("created_at", "observed_on", "taxon_id", "user_id", "id")
    return old.unionByName(new)


# ------------------------------------------------ year over year, series


@register("yoy_metrics")
def q_yoy_metrics(spark, sf_dir):
    return yoy.yoy_summary(_weekly_summary(spark, sf_dir))


@register("yoy_species")
def q_yoy_species(spark, sf_dir):
    return yoy.yoy_species(_by_species(spark, sf_dir))


@register("metric_series")
def q_metric_series(spark, sf_dir):
    return series.metric_series(yoy.yoy_summary(_weekly_summary(spark, sf_dir)), dt.MIN_CHART_YEAR)


@register("series_by_year")
def q_series_by_year(spark, sf_dir):
    yoy_table = yoy.yoy_summary(_weekly_summary(spark, sf_dir))
    return series.series_by_year(yoy_table, "week_number", "year_adjusted_cumulative_users", years=None)


@register("species_series")
def q_species_series(spark, sf_dir):
    return series.species_series(yoy.yoy_species(_by_species(spark, sf_dir)), dt.TRACKED_NAMES, dt.MIN_CHART_YEAR)


# ------------------------------------------------------------------ ingest


@register("incremental_start")
def q_incremental_start(spark, sf_dir):
    existing, _ = _existing(spark, sf_dir)
    return ingest.incremental_start(existing)


@register("select_increment")
def q_select_increment(spark, sf_dir):
    _, batch = _increment(spark, sf_dir)
    return batch


@register("merge_insert_only")
def q_merge_insert_only(spark, sf_dir):
    existing, batch = _increment(spark, sf_dir)
    return ingest.merge_insert_only(existing, batch)


def _stored(spark, sf_dir, grains=("week",), tracked=None):
    """A metric store that took the existing rows, then those created later in
    two batches, the older of them last (its rows come late)."""
    store = MetricStore(spark, scratch_path(spark, "metric-store"), grains, tracked)
    # joined once, for all batches
    obs = Scratch(spark).write(_obs(spark, sf_dir, names=True), "observations")
    created, later = F.col("created_at"), ntz_literal(dt.INGEST_CUT) + F.expr("INTERVAL 1 YEAR")
    cut = ntz_literal(dt.INGEST_CUT)
    store.apply_increment(obs.where(created < cut), "base")
    store.apply_increment(obs.where(created >= later), "new")
    store.apply_increment(obs.where((created >= cut) & (created < later)), "late")
    return store


@register("metric_refresh")
def q_metric_refresh(spark, sf_dir):
    """The weekly tables of all rows, kept by increments."""
    return _stored(spark, sf_dir).summary("week", **CAL)


@register("species_refresh")
def q_species_refresh(spark, sf_dir):
    return _stored(spark, sf_dir, tracked=dt.TRACKED_NAMES).by_species(**CAL)


@register("rollup_uniques")
def q_rollup_uniques(spark, sf_dir):
    """Months and years from one table of daily sketches, each next to the
    exact count: estimates within four standard errors of it."""
    obs = _obs(spark, sf_dir)
    daily = Scratch(spark).write(sketches.daily_sketches(obs), "daily-sketches")
    out = None
    for grain in ("month", "year"):
        exact = pm.unique_per_period(obs, pm.METRICS, grain)
        estimate = sketches.rollup_uniques(daily, grain)
        near = [
            (F.abs(estimate[f"unique_{m}"] - exact[f"unique_{m}"])
             <= 1 + 4 * sketches.standard_error() * exact[f"unique_{m}"]).alias(f"{m}_near")
            for m in pm.METRICS
        ]
        pcol, _ = PERIOD_COLUMNS[grain]
        rows = estimate.join(exact, exact[pcol] == estimate[pcol]).select(
            F.lit(grain).alias("grain"), exact[pcol].alias("period"),
            *[exact[f"unique_{m}"].alias(f"unique_{m}") for m in pm.METRICS], *near,
        )
        out = rows if out is None else out.unionByName(rows)
    return out


# ------------------------------------------------------------ participation


def _events(spark, sf_dir):
    """The fixture's events: one per year of the data, as a written table."""
    path = scratch_path(spark, "events")
    events.events_for_data_years(_obs(spark, sf_dir)).write.parquet(path)
    return spark.read.parquet(path)


@register("event_metrics")
def q_event_metrics(spark, sf_dir):
    return participation.event_metrics(_obs(spark, sf_dir), _events(spark, sf_dir))


@register("interval_hits")
def q_interval_hits(spark, sf_dir):
    """Observations by creation time in overlapping spans around each event:
    its days, the eight weeks around it and the three years after it."""
    first, last = F.col("start_date").cast("timestamp_ntz"), F.col("end_date").cast("timestamp_ntz")
    ago = lambda text: F.expr(f"INTERVAL {text}")
    spans = {
        "days": (first, last + ago("'23:59:59' HOUR TO SECOND")),
        "season": (first - ago("28 DAYS") + ago("12 HOURS"), last + ago("28 DAYS") + ago("12 HOURS")),
        "after": (last, last + ago("3 YEARS")),
    }
    rows = [F.struct(F.lit(k).alias("span"), a.alias("since"), b.alias("until")) for k, (a, b) in spans.items()]
    table = _events(spark, sf_dir).select("event", F.explode(F.array(*rows)).alias("s")).select("event", "s.*")
    hits = intervals.interval_join(_obs(spark, sf_dir).select("id", "created_at"), table, "created_at", "since", "until")
    return hits.groupBy("event", "span").agg(
        F.count(F.lit(1)).alias("observations"), F.min("created_at").alias("first_at"), F.max("id").alias("max_id")
    )


@register("event_participants")
def q_event_participants(spark, sf_dir):
    return participation.event_participants(_obs(spark, sf_dir), _events(spark, sf_dir))


def _activity(spark, sf_dir):
    return participation.event_activity(_obs(spark, sf_dir), _events(spark, sf_dir))


@register("participation_activity")
def q_participation_activity(spark, sf_dir):
    return participation.participation_activity(_activity(spark, sf_dir))


@register("participation_species")
def q_participation_species(spark, sf_dir):
    return participation.participation_species(_activity(spark, sf_dir))


@register("event_acquisition")
def q_event_acquisition(spark, sf_dir):
    firsts = first_seen.first_seen(_obs(spark, sf_dir), "user_id")
    return participation.event_acquisition(firsts, _events(spark, sf_dir))


@register("event_retention")
def q_event_retention(spark, sf_dir):
    obs, calendar_events = _obs(spark, sf_dir), _events(spark, sf_dir)
    participants = participation.event_participants(obs, calendar_events)
    return participation.event_retention(obs, calendar_events, participants)


# ------------------------------------------------------------------- trends


@register("yoy_lift")
def q_yoy_lift(spark, sf_dir):
    yearly = Scratch(spark).write(trends.yearly_species(_obs(spark, sf_dir, names=True)), "yearly-species")
    return trends.yoy_lift(yearly, min_count=2)


@register("species_trend")
def q_species_trend(spark, sf_dir):
    return trends.species_trend(trends.yearly_species(_obs(spark, sf_dir, names=True)))


@register("species_share")
def q_species_share(spark, sf_dir):
    return trends.species_share(_obs(spark, sf_dir, names=True), "quarter")


@register("kingdom_totals")
def q_kingdom_totals(spark, sf_dir):
    return trends.kingdom_totals(_obs(spark, sf_dir, names=True))


@register("kingdom_by_period")
def q_kingdom_by_period(spark, sf_dir):
    return trends.kingdom_by_period(_obs(spark, sf_dir, names=True), "month")


@register("rarest_species")
def q_rarest_species(spark, sf_dir):
    return trends.rarest_species(_obs(spark, sf_dir, names=True))


@register("quality_breakdown")
def q_quality_breakdown(spark, sf_dir):
    return trends.quality_breakdown(_obs(spark, sf_dir))


@register("range_shift")
def q_range_shift(spark, sf_dir):
    obs = dt.observations(spark, sf_dir, with_location=True)
    return trends.range_shift(trends.with_coordinates(obs))


@register("anchored_year")
def q_anchored_year(spark, sf_dir):
    """Weekly observations of years that restart in April."""
    weekly = pm.period_metrics(_obs(spark, sf_dir), "observations", "week", **CAL)
    weekly = weekly.select("week", anchored_year("week").alias("anchored_year"), "unique_observations",
                           "cumulative_observations")
    return yoy.year_adjusted(
        weekly, {"cumulative_observations": "unique_observations"}, "week", ("anchored_year",), "prior"
    )


# --------------------------------------------------------------- streaming


STREAM_COLS = ("id", "observed_on", "user_id", "taxon_id", "created_at", "scientific_name", "quality_grade")


@register("stream_ingest")
def q_stream_ingest(spark, sf_dir):
    pages = _landed_pages(spark, sf_dir)
    table = scratch_path(spark, "stream-table")
    ingest_stream.run_ingest_stream(spark, pages, table, max_files_per_trigger=1000)
    delete_path(spark, pages)
    return spark.read.parquet(table).select(*STREAM_COLS)


@register("stream_latest")
def q_stream_latest(spark, sf_dir):
    """The same pages through the stream that keeps the latest copy in state."""
    pages = _landed_pages(spark, sf_dir)
    table = scratch_path(spark, "latest-table")
    latest_stream.run_latest_stream(spark, pages, table, max_files_per_trigger=1000)
    delete_path(spark, pages)
    return spark.read.parquet(table).select(*STREAM_COLS)
