"""New / unique / cumulative counts per calendar period.

One generic operator covers users, species (taxa) and observations at any
grain. Every count comes from one pass over the fact and one fact-sized
aggregation, never a fact-sized join:

* unique_X(p)  = distinct (p, X) pairs of the metric
* new_X(p)     = entities whose minimum period is p
* cumulative_X = running sum of new_X (of unique_X for observations)

Each observation is expanded into one "active" row per metric and one
"first" row per metric that has a "new" count. A single aggregation keyed by
(kind, metric, entity, period of active rows) yields the distinct pairs and
each entity's first period side by side; a second, period-keyed aggregation
over that result counts both. The first aggregation combines map-side, so a
user or taxon holding a third of all rows collapses to one row per task (per
period for active rows) before the shuffle, and its active rows are spread
over the periods. The per-period result has at most one row per period; it
is joined onto the calendar (one row per period up to ``as_of``),
zero-filled, and the running sum is a window over that calendar, never over
facts.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.calendar import PERIOD_COLUMNS, check_grain, period_end, period_start
from sightline.operators.calendar import (
    DateLike,
    as_date_col,
    date_bounds,
    literal_bounds,
    override_bounds,
    period_calendar,
)

# metric name -> (entity column, whether "new" is defined)
METRICS = {
    "users": ("user_id", True),
    "species": ("taxon_id", True),
    "observations": ("id", False),
}


def _check(metrics: Iterable[str]) -> list[str]:
    metrics = list(dict.fromkeys(metrics))
    for m in metrics:
        if m not in METRICS:
            raise ValueError(f"unknown metric {m!r}; expected one of {sorted(METRICS)}")
    return metrics


def running_total(
    df: DataFrame, value_col: str, order_col: str, out_col: str, partition_cols: Sequence[str] = ()
) -> DataFrame:
    """Cumulative sum in ``order_col`` order (rows frame, so each row counts once).

    Without ``partition_cols`` this is one task: use it on calendar-sized
    tables only.
    """
    w = Window.partitionBy(*partition_cols).orderBy(order_col) if partition_cols else Window.orderBy(order_col)
    w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out_col, F.sum(value_col).over(w))


def entity_rows(
    obs: DataFrame, metrics: Sequence[str], grain: str = "week", date_col: str = "observed_on"
) -> DataFrame:
    """``(period, m, value)`` per observation and metric: entity ``value`` of
    metric number ``m`` (index into ``metrics``) was observed in ``period``.
    Null dates and null entities take no part, as in a distinct count."""
    pcol, _ = PERIOD_COLUMNS[check_grain(grain)]
    args = ", ".join(f"{i}, CAST(`{METRICS[m][0]}` AS BIGINT)" for i, m in enumerate(metrics))
    d = F.col(date_col)
    return (
        obs.where(d.isNotNull())
        .select(period_start(d, grain).alias(pcol), F.expr(f"stack({len(metrics)}, {args}) AS (m, value)"))
        .where(F.col("value").isNotNull())
    )


def entity_period_pairs(
    obs: DataFrame, metrics: Sequence[str], grain: str = "week", date_col: str = "observed_on"
) -> DataFrame:
    """Distinct ``(period, m, value)``."""
    return entity_rows(obs, metrics, grain, date_col).distinct()


def unique_from_pairs(pairs: DataFrame, metrics: Sequence[str], pcol: str) -> DataFrame:
    return pairs.groupBy(pcol).agg(
        *[F.count_if(F.col("m") == i).alias(f"unique_{m}") for i, m in enumerate(metrics)]
    )


def new_from_rows(rows: DataFrame, metrics: Sequence[str], pcol: str) -> DataFrame:
    """First period per (metric, entity), counted per period. ``rows`` may
    repeat: a minimum ignores duplicates."""
    with_new = [i for i, m in enumerate(metrics) if METRICS[m][1]]
    firsts = rows.where(F.col("m").isin(with_new)).groupBy("m", "value").agg(F.min(pcol).alias(pcol))
    return firsts.groupBy(pcol).agg(*[F.count_if(F.col("m") == i).alias(f"new_{metrics[i]}") for i in with_new])


def unique_per_period(
    obs: DataFrame, metrics: Iterable[str], grain: str = "week", date_col: str = "observed_on"
) -> DataFrame:
    """Distinct entities per period (sparse: only periods with data)."""
    metrics = _check(metrics)
    pcol, _ = PERIOD_COLUMNS[check_grain(grain)]
    return unique_from_pairs(entity_period_pairs(obs, metrics, grain, date_col), metrics, pcol)


def new_per_period(
    obs: DataFrame, metrics: Iterable[str], grain: str = "week", date_col: str = "observed_on"
) -> DataFrame:
    """Entities counted in the period of their first observation (sparse)."""
    metrics = [m for m in _check(metrics) if METRICS[m][1]]
    if not metrics:
        raise ValueError("'new' is defined for users and species only")
    pcol, _ = PERIOD_COLUMNS[check_grain(grain)]
    return new_from_rows(entity_rows(obs, metrics, grain, date_col), metrics, pcol)


def period_counts(
    obs: DataFrame, metrics: Iterable[str], grain: str = "week", date_col: str = "observed_on"
) -> DataFrame:
    """``unique_X`` (and ``new_X`` for users and species) per period, sparse,
    from one scan of ``obs``.

    Kind 0 rows are grouped by (metric, entity, period): the distinct pairs.
    Kind 1 rows are grouped by (metric, entity) only, keeping the minimum
    period: the first-seen period. Both kinds go through the same
    aggregation and the same shuffle, so the fact is read once.
    """
    metrics = _check(metrics)
    pcol, _ = PERIOD_COLUMNS[check_grain(grain)]
    items = keyed_items(metrics)
    d = F.col(date_col)
    rows = (
        obs.where(d.isNotNull())
        .select(period_start(d, grain).alias(pcol), F.expr(f"stack({len(items)}, {', '.join(items)}) AS (k, m, value)"))
        .where(F.col("value").isNotNull())
    )
    keyed = rows.groupBy("k", "m", "value", F.when(F.col("k") == 0, F.col(pcol)).alias("active")).agg(
        F.min(pcol).alias(pcol)
    )
    return keyed.groupBy(pcol).agg(*keyed_counts(metrics))


def keyed_items(metrics: Sequence[str]) -> list[str]:
    """``stack`` arguments: an active row (kind 0) per metric and a first
    row (kind 1) per metric with a "new" count, as (kind, metric, entity)."""
    items = []
    for i, m in enumerate(metrics):
        col, has_new = METRICS[m]
        items.append(f"0, {i}, CAST(`{col}` AS BIGINT)")
        if has_new:
            items.append(f"1, {i}, CAST(`{col}` AS BIGINT)")
    return items


def keyed_counts(metrics: Sequence[str]) -> list:
    """Per-period counts over the keyed aggregation's rows."""
    k, m_ = F.col("k"), F.col("m")
    counts = []
    for i, m in enumerate(metrics):
        if METRICS[m][1]:
            counts.append(F.count_if((k == 1) & (m_ == i)).alias(f"new_{m}"))
        counts.append(F.count_if((k == 0) & (m_ == i)).alias(f"unique_{m}"))
    return counts


def upto_cutoff(
    obs: DataFrame, grain: str, as_of: DateLike = None, end: DateLike = None, date_col: str = "observed_on"
) -> DataFrame:
    """Drop observations after the last period the output can show.

    Rows after the period containing ``min(as_of, end)`` change no reported
    count: a later period is cut from the calendar, and an entity first seen
    after it is never "new" in the output. Filtering them before the shuffle
    lets the scan skip them (partition pruning, row-group statistics).
    Earlier rows are kept: they decide who is new.
    """
    cut = as_date_col(as_of) if as_of is not None else F.current_date()
    if end is not None:
        cut = F.least(cut, as_date_col(end))
    last_day = period_end(cut, grain)
    kept = obs.where(F.col(date_col) <= last_day)
    if "observed_year" in obs.columns:  # the fact's partition column: prune folders
        kept = kept.where(F.col("observed_year") <= F.year(last_day))
    return kept


def period_summary(
    obs: DataFrame,
    metrics: Iterable[str] = ("users", "species", "observations"),
    grain: str = "week",
    *,
    as_of: DateLike = None,
    start: DateLike = None,
    end: DateLike = None,
    reconcile_years: Iterable[int] | None = None,
    date_col: str = "observed_on",
    approx: bool = False,
    rsd: float = 0.01,
) -> DataFrame:
    """Gap-free per-period metrics for one or more of users/species/observations.

    The calendar runs from ``start`` to ``end``; a bound left out is derived
    from the data (whole years, one extra on each side), which costs one
    min/max pass over the date column. It stops at ``as_of`` (today when
    omitted).

    ``approx=True`` estimates the unique counts with HyperLogLog++ sketches
    (relative standard deviation ``rsd``): each task sends one small sketch
    per period instead of its distinct (period, entity) pairs. New and
    cumulative counts stay exact; cumulative observations then sum estimates.
    """
    metrics = _check(metrics)
    pcol, _ = PERIOD_COLUMNS[check_grain(grain)]
    bounds = summary_bounds(obs, start, end, date_col)
    kept = upto_cutoff(obs, grain, as_of, end, date_col)
    if approx:
        unique = (
            kept.where(F.col(date_col).isNotNull())
            .groupBy(period_start(date_col, grain).alias(pcol))
            .agg(*[F.approx_count_distinct(METRICS[m][0], rsd).alias(f"unique_{m}") for m in metrics])
        )
        aggregates = [unique]
        if any(METRICS[m][1] for m in metrics):
            aggregates.append(new_from_rows(entity_rows(kept, metrics, grain, date_col), metrics, pcol))
    else:
        aggregates = [period_counts(kept, metrics, grain, date_col)]
    return calendar_summary(aggregates, bounds, metrics, grain, as_of, reconcile_years)


def summary_bounds(obs: DataFrame, start: DateLike = None, end: DateLike = None, date_col: str = "observed_on"):
    """One-row calendar bounds: explicit, or whole years around the data."""
    if start is not None and end is not None:
        return literal_bounds(obs.sparkSession, start, end)
    return override_bounds(date_bounds(obs, date_col), start, end)


def calendar_summary(
    aggregates: Sequence[DataFrame],
    bounds: DataFrame,
    metrics: Sequence[str],
    grain: str = "week",
    as_of: DateLike = None,
    reconcile_years: Iterable[int] | None = None,
) -> DataFrame:
    """Sparse per-period counts -> the gap-free table with running totals.

    Each aggregate has at most one row per period seen; AQE broadcasts it
    onto the calendar from its measured size. The running sums are a window
    over the calendar (one row per period), never over facts.
    """
    pcol, label = PERIOD_COLUMNS[check_grain(grain)]
    out = period_calendar(bounds, grain, as_of, reconcile_years)
    for agg in aggregates:
        out = out.join(agg, pcol, "left")

    w = Window.orderBy(pcol).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols = [F.col(pcol), F.col("year"), F.col("start_of_year"), F.col(label)]
    for m in metrics:
        uniq = F.coalesce(F.col(f"unique_{m}"), F.lit(0)).cast("bigint")
        if METRICS[m][1]:
            new = F.coalesce(F.col(f"new_{m}"), F.lit(0)).cast("bigint")
            cols += [new.alias(f"new_{m}"), uniq.alias(f"unique_{m}"), F.sum(new).over(w).alias(f"cumulative_{m}")]
        else:
            cols += [uniq.alias(f"unique_{m}"), F.sum(uniq).over(w).alias(f"cumulative_{m}")]
    return out.select(*cols)


def period_metrics(obs: DataFrame, metric: str, grain: str = "week", **kwargs) -> DataFrame:
    """One metric's table, e.g. ``period_metrics(obs, 'users', 'week')`` gives
    week, year, start_of_year, week_number, new_users, unique_users,
    cumulative_users."""
    return period_summary(obs, [metric], grain, **kwargs)


def weekly_users(obs: DataFrame, **kw) -> DataFrame:
    return period_metrics(obs, "users", "week", **kw)


def daily_users(obs: DataFrame, **kw) -> DataFrame:
    return period_metrics(obs, "users", "day", **kw)


def weekly_species(obs: DataFrame, **kw) -> DataFrame:
    return period_metrics(obs, "species", "week", **kw)


def daily_species(obs: DataFrame, **kw) -> DataFrame:
    return period_metrics(obs, "species", "day", **kw)


def weekly_observations(obs: DataFrame, **kw) -> DataFrame:
    return period_metrics(obs, "observations", "week", **kw)


def daily_observations(obs: DataFrame, **kw) -> DataFrame:
    return period_metrics(obs, "observations", "day", **kw)


def split_summary(summary: DataFrame, grain: str = "week") -> dict[str, DataFrame]:
    """Per-metric tables (the metric build's outputs) from a combined summary."""
    pcol, label = PERIOD_COLUMNS[check_grain(grain)]
    head = [pcol, "year", "start_of_year", label]
    out = {}
    for m, (_, has_new) in METRICS.items():
        cols = ([f"new_{m}"] if has_new else []) + [f"unique_{m}", f"cumulative_{m}"]
        if all(c in summary.columns for c in cols):
            out[m] = summary.select(*head, *cols)
    return out
