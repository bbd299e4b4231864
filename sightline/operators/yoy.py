"""Year-over-year views: cumulative counts restarted at each year's start."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def year_start_value(
    df: DataFrame, value_col: str, out_col: str, period_col: str = "week", partition_cols: Sequence[str] = ("year",)
) -> DataFrame:
    """``out_col`` = ``value_col`` at the earliest period of its partition."""
    w = Window.partitionBy(*partition_cols).orderBy(period_col).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return df.withColumn(out_col, F.first(value_col).over(w))


def subtract_baseline(df: DataFrame, value_col: str, baseline_col: str, out_col: str) -> DataFrame:
    return df.withColumn(out_col, F.col(value_col) - F.col(baseline_col))


def year_adjusted(
    df: DataFrame,
    cumulative: Mapping[str, str],
    period_col: str = "week",
    partition_cols: Sequence[str] = ("year",),
    baseline: str = "first",
) -> DataFrame:
    """Add ``starting_<c>`` and ``year_adjusted_<c>`` for each cumulative column.

    ``cumulative`` maps each cumulative column to the per-period count it
    sums. ``baseline='first'`` subtracts the cumulative value of the year's
    first period, so that period shows 0; ``'prior'`` subtracts the value just
    before the year, so the first period shows its own count.
    """
    if baseline not in ("first", "prior"):
        raise ValueError("baseline must be 'first' or 'prior'")
    w = Window.partitionBy(*partition_cols).orderBy(period_col).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    cols = [F.col(c) for c in df.columns]
    for cum, step in cumulative.items():
        first_value = F.first(F.col(cum)).over(w)
        if baseline == "prior":
            first_value = F.first(F.col(cum) - F.col(step)).over(w)
        cols += [first_value.alias(f"starting_{cum}"), (F.col(cum) - first_value).alias(f"year_adjusted_{cum}")]
    return df.select(*cols)


def keep_first_per_label(
    df: DataFrame,
    label_col: str = "week_number",
    partition_cols: Sequence[str] = ("year",),
    period_col: str = "week",
) -> DataFrame:
    """One row per (label, partition): the earliest period (ties broken by
    the period itself, which is unique per partition)."""
    w = Window.partitionBy(label_col, *partition_cols).orderBy(period_col)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def combine_metrics(users: DataFrame, species: DataFrame, observations: DataFrame, on: str = "week") -> DataFrame:
    """Users left-join species left-join observations on the period. The
    users table drives: its periods are the output rows."""
    head = [c for c in users.columns if c in ("year", "start_of_year", "week_number", "day_of_year")]
    s = species.drop(*[c for c in head if c in species.columns])
    o = observations.drop(*[c for c in head if c in observations.columns])
    return users.join(s, on, "left").join(o, on, "left")


_MAIN = {
    "cumulative_users": "new_users",
    "cumulative_species": "new_species",
    "cumulative_observations": "unique_observations",
}


def yoy_summary(
    combined: DataFrame, period_col: str = "week", label_col: str = "week_number", baseline: str = "first"
) -> DataFrame:
    """Year-over-year columns on an already combined per-period table (e.g.
    ``period_summary`` of users, species and observations: no joins)."""
    adjusted = year_adjusted(combined, _MAIN, period_col, ("year",), baseline)
    return keep_first_per_label(adjusted, label_col, ("year",), period_col)


def yoy_metrics(
    users: DataFrame,
    species: DataFrame,
    observations: DataFrame,
    period_col: str = "week",
    label_col: str = "week_number",
    baseline: str = "first",
) -> DataFrame:
    """Combined users/species/observations with starting_* and
    year_adjusted_* columns, one row per (label, year)."""
    return yoy_summary(combine_metrics(users, species, observations, period_col), period_col, label_col, baseline)


def yoy_species(
    by_species: DataFrame,
    period_col: str = "week",
    label_col: str = "week_number",
    baseline: str = "first",
) -> DataFrame:
    """Per-species year-adjusted cumulative observations, one row per
    (label, year, species)."""
    keys = ("year", "taxon_id", "scientific_name")
    adjusted = year_adjusted(by_species, {"cumulative_observations": "observations"}, period_col, keys, baseline)
    return keep_first_per_label(adjusted, label_col, keys, period_col)
