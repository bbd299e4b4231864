"""Weekly observations of tracked species, with a running total per species."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.calendar import PERIOD_COLUMNS, check_grain, period_start, week_label, year_start
from sightline.functions.text import name_key
from sightline.operators.calendar import DateLike, as_date_col
from sightline.operators.period_metrics import _check, keyed_counts, keyed_items, upto_cutoff

SPECIES_KEYS = ("taxon_id", "scientific_name")
Names = Iterable[str] | DataFrame


def _name_column(df: DataFrame, col: str) -> Column:
    """Lower-cased name: the stored key of the fact, else computed."""
    return F.col(f"{col}_key") if f"{col}_key" in df.columns else name_key(col)


def _name_table(names: DataFrame) -> DataFrame:
    return names.select(name_key(F.col(names.columns[0])).alias("_name_key")).distinct()


def mark_tracked(df: DataFrame, names: Names, col: str = "scientific_name", flag: str = "_tracked") -> DataFrame:
    """Add ``flag``: the row's name is one of ``names``, ignoring case.

    ``names`` is a list of any length (a membership test, one hash lookup per
    row) or a table whose first column holds the names (a left join with its
    distinct names; Spark picks the join from the table's size).
    """
    key = _name_column(df, col)
    if isinstance(names, DataFrame):
        wanted = _name_table(names).withColumn(flag, F.lit(True))
        joined = df.join(wanted, key == F.col("_name_key"), "left").drop("_name_key")
        return joined.withColumn(flag, F.coalesce(flag, F.lit(False)))
    return df.withColumn(flag, F.coalesce(key.isin(sorted({n.lower() for n in names})), F.lit(False)))


def name_in_list(df: DataFrame, names: Names, col: str = "scientific_name") -> DataFrame:
    """Rows whose ``col`` matches one of ``names``, ignoring case. On a table
    that stores the lower-cased name (``<col>_key``, written by the metric
    build) a list is a plain ``IN`` on that column, so it reaches the parquet
    scan as a pushed filter."""
    key = _name_column(df, col)
    if isinstance(names, DataFrame):
        return df.join(_name_table(names), key == F.col("_name_key"), "left_semi")
    return df.where(key.isin(sorted({n.lower() for n in names})))


def observations_per_period_species(
    obs: DataFrame,
    names: Names | None = None,
    grain: str = "week",
    date_col: str = "observed_on",
    keys: Sequence[str] = SPECIES_KEYS,
) -> DataFrame:
    """Distinct observation ids per (period, taxon_id, scientific_name).

    ``common_name`` is the smallest name seen for the taxon in that period,
    so two common names in one week give one row, not two. Every observation
    yields an id row and a common-name row; one keyed aggregation makes both
    distinct with fixed-width buffers (a hash aggregation that combines
    map-side), the names are minimised over the small counted rows.
    """
    df = obs if names is None else name_in_list(obs, names)
    pcol, _ = PERIOD_COLUMNS[check_grain(grain)]
    rows = df.where(F.col(date_col).isNotNull()).select(
        period_start(date_col, grain).alias(pcol),
        *keys,
        "common_name",
        F.expr("stack(2, 2, CAST(`id` AS BIGINT), 3, 0L) AS (k, value)"),
    )
    counts = _species_level(rows.where(F.col("value").isNotNull()), pcol, keys)
    return species_counts(counts.withColumn("species", F.lit(True)), pcol, keys)


def _species_level(rows: DataFrame, pcol: str, keys: Sequence[str]) -> DataFrame:
    """Distinct kind 2 (id) and kind 3 (common name) rows, counted per period,
    key and common name."""
    k = F.col("k")
    distinct = rows.select("k", "value", pcol, *keys, F.when(k == 3, F.col("common_name")).alias("common_name")).distinct()
    return distinct.groupBy(pcol, *keys, "common_name").agg(F.count_if(k == 2).alias("observations"))


def weekly_by_species(
    obs: DataFrame,
    names: Names,
    *,
    as_of: DateLike = None,
    start: DateLike = None,
    end: DateLike = None,
    reconcile_years=None,
    date_col: str = "observed_on",
    densify: bool = False,
) -> DataFrame:
    """Weekly distinct observations per tracked species and their running total.

    Sparse by default: only weeks in which the species was seen. With
    ``densify`` every species gets every calendar week from ``start`` to
    ``min(end, as_of)`` (zero when unseen); each species row expands into its
    own week sequence, so this is a per-row generator, not a cross join, and
    its output is exactly the dense table asked for.

    The running total is partitioned by species and runs over that species'
    weeks only, so a popular species costs one small partition, never a
    fact-sized one.
    """
    counts = observations_per_period_species(upto_cutoff(obs, "week", as_of, end, date_col), names, "week", date_col)
    return by_species_from_counts(
        counts, as_of=as_of, start=start, end=end, reconcile_years=reconcile_years, densify=densify
    )


def by_species_from_counts(
    counts: DataFrame,
    *,
    as_of: DateLike = None,
    start: DateLike = None,
    end: DateLike = None,
    reconcile_years=None,
    densify: bool = False,
) -> DataFrame:
    """Weekly ``(week, taxon_id, scientific_name, common_name, observations)``
    counts -> the per-species table: weeks cut to [start, min(end, as_of)],
    optionally densified, with the running total per species."""
    cutoff = as_date_col(as_of) if as_of is not None else F.current_date()
    counts = counts.where(F.col("week") <= cutoff)
    if start is not None:
        counts = counts.where(F.col("week") >= period_start(as_date_col(start), "week"))
    if end is not None:
        counts = counts.where(F.col("week") <= as_date_col(end))
    if densify:
        if start is None or end is None:
            raise ValueError("densify needs explicit start and end")
        last = F.least(as_date_col(end), cutoff)
        species = counts.groupBy("taxon_id", "scientific_name").agg(F.min("common_name").alias("_name"))
        grid = species.select(
            "taxon_id",
            "scientific_name",
            "_name",
            F.explode(
                F.sequence(period_start(as_date_col(start), "week"), period_start(last, "week"), F.expr("INTERVAL 7 DAYS"))
            ).alias("week"),
        )
        counts = grid.join(counts, ["taxon_id", "scientific_name", "week"], "left").select(
            "taxon_id",
            "scientific_name",
            F.coalesce("common_name", "_name").alias("common_name"),
            "week",
            F.coalesce("observations", F.lit(0)).cast("bigint").alias("observations"),
        )
    w = (
        Window.partitionBy("taxon_id", "scientific_name")
        .orderBy("week")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return counts.select(
        "taxon_id",
        "scientific_name",
        "common_name",
        "week",
        F.year("week").alias("year"),
        year_start("week").alias("start_of_year"),
        week_label("week", reconcile_years).alias("week_number"),
        "observations",
        F.sum("observations").over(w).alias("cumulative_observations"),
    )


def period_and_species_counts(
    obs: DataFrame,
    metrics: Iterable[str],
    names: Names,
    grain: str = "week",
    date_col: str = "observed_on",
) -> DataFrame:
    """The period counts of ``period_counts`` and the tracked-species counts
    of ``observations_per_period_species`` from one scan and one keyed
    aggregation.

    Besides the active (kind 0) and first (kind 1) rows, every observation of
    a tracked name yields a kind 2 row (its id, keyed by period, taxon and
    name) and a kind 3 row (its common name as a key). Every aggregation
    buffer is fixed-width, so both levels stay hash aggregations (a string
    ``min`` here would turn the fact-sized one into a sort aggregation). The
    period-level result has ``species`` = false rows (the ``new_``/``unique_``
    counts per period) and ``species`` = true rows: distinct ids per period,
    taxon and name (``common_name`` null) and one row per common name seen
    (``observations`` 0); ``species_counts`` folds the latter into the
    per-species table. Split the two after writing the result once:
    filtering a shared aggregate by its key would push the filter below it
    and read the fact twice again.
    """
    metrics = _check(metrics)
    pcol, _ = PERIOD_COLUMNS[check_grain(grain)]
    items = keyed_items(metrics) + [
        "2, 0, CASE WHEN `_tracked` THEN CAST(`id` AS BIGINT) END",
        "3, 0, CASE WHEN `_tracked` THEN 0L END",
    ]
    d = F.col(date_col)
    rows = (
        mark_tracked(obs.where(d.isNotNull()), names)
        .select(
            period_start(d, grain).alias(pcol),
            *SPECIES_KEYS,
            "common_name",
            F.expr(f"stack({len(items)}, {', '.join(items)}) AS (k, m, value)"),
        )
        .where(F.col("value").isNotNull())
    )
    k = F.col("k")
    keyed = rows.groupBy(
        "k",
        "m",
        "value",
        F.when(k != 1, F.col(pcol)).alias("active"),
        *[F.when(k >= 2, F.col(c)).alias(c) for c in SPECIES_KEYS],
        F.when(k == 3, F.col("common_name")).alias("common_name"),
    ).agg(F.min(pcol).alias(pcol))
    return keyed.groupBy((k >= 2).alias("species"), pcol, *SPECIES_KEYS, "common_name").agg(
        *keyed_counts(metrics), F.count_if(k == 2).alias("observations")
    )


def species_counts(counts: DataFrame, pcol: str = "week", keys: Sequence[str] = SPECIES_KEYS) -> DataFrame:
    """Per (period, taxon, name) of the ``species`` rows of
    ``period_and_species_counts``: distinct ids and the smallest common name
    (a small aggregation over already counted rows)."""
    return (
        counts.where(F.col("species"))
        .groupBy(pcol, *keys)
        .agg(F.min("common_name").alias("common_name"), F.sum("observations").alias("observations"))
    )
