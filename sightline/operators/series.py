"""Chart-ready long-form series (one row per point), computed in one pass.

Each chart of the metric build is a set of per-year lines; here every line
point becomes a row ``(metric, measure, x_kind, series_year, week,
week_number, y)`` so all charts come from one Spark job and any plotting
tool can draw them from the table.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.by_species import name_in_list

DEFAULT_MIN_YEAR = 2018

# (measure, x axis, column pattern) per chart of one metric.
_MAIN_CHARTS = (
    ("year_adjusted_cumulative", "week_number", "year_adjusted_cumulative_{m}"),
    ("cumulative", "week", "cumulative_{m}"),
    ("unique", "week_number", "unique_{m}"),
    ("unique", "week", "unique_{m}"),
    ("new", "week_number", "new_{m}"),
    ("new", "week", "new_{m}"),
)
_SPECIES_CHARTS = (
    ("year_adjusted_cumulative", "week_number", "year_adjusted_cumulative_observations"),
    ("cumulative", "week", "cumulative_observations"),
    ("observations", "week_number", "observations"),
)


def min_year_filter(df: DataFrame, min_year: int | None = DEFAULT_MIN_YEAR) -> DataFrame:
    return df if min_year is None else df.where(F.col("year") >= F.lit(min_year))


def _points(specs) -> list:
    return [
        F.struct(
            F.lit(metric).alias("metric"),
            F.lit(measure).alias("measure"),
            F.lit(x_kind).alias("x_kind"),
            F.col(column).cast("bigint").alias("y"),
        )
        for metric, measure, x_kind, column in specs
    ]


def metric_series(yoy: DataFrame, min_year: int | None = DEFAULT_MIN_YEAR) -> DataFrame:
    """All main charts (users, species, observations) as one long table."""
    specs = [
        (m, measure, x_kind, pattern.format(m=m))
        for m in ("users", "species", "observations")
        for measure, x_kind, pattern in _MAIN_CHARTS
        if not (m == "observations" and measure == "new")
    ]
    return (
        min_year_filter(yoy, min_year)
        .select(F.col("year").alias("series_year"), "week", "week_number", F.inline(F.array(*_points(specs))))
        .select("metric", "measure", "x_kind", "series_year", "week", "week_number", "y")
    )


def species_series(
    yoy_by_species: DataFrame, names: Iterable[str] | None = None, min_year: int | None = DEFAULT_MIN_YEAR
) -> DataFrame:
    """The per-species charts as one long table, keyed by species. The
    all-time line uses the plain cumulative count."""
    df = min_year_filter(yoy_by_species, min_year)
    if names is not None:
        df = name_in_list(df, names)
    specs = [("observations", measure, x_kind, column) for measure, x_kind, column in _SPECIES_CHARTS]
    return df.select(
        "taxon_id",
        "scientific_name",
        F.col("year").alias("series_year"),
        "week",
        "week_number",
        F.inline(F.array(*_points(specs))),
    ).select("taxon_id", "scientific_name", "measure", "x_kind", "series_year", "week", "week_number", "y")


def series_by_year(
    df: DataFrame, x_col: str, y_col: str, years: Iterable[int] | None = None
) -> DataFrame:
    """One line per year (every year, or the given ones): ``(series_year, x, y)`` with a typed x (date for
    week/date axes, int for week_number/day_of_year)."""
    x = F.col(x_col).cast("date") if x_col in ("week", "date") else F.col(x_col).cast("int")
    out = df.select(F.col("year").cast("int").alias("series_year"), x.alias(x_col), F.col(y_col).alias(y_col))
    if years is not None:
        out = out.where(F.col("series_year").isin(sorted(set(years))))
    return out
