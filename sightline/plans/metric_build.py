"""The metric build: raw observations -> fact table -> metric tables.

The typed fact is written once (parquet, partitioned by year) and read back,
which cuts the lineage to the raw input and lets every metric scan only the
columns it needs. The weekly tables (users, species, observations and the
tracked species) come from one scan of the fact and one keyed aggregation,
written once as per-period counts and split from there; other grains use
``period_summary`` (also one scan each).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.text import name_key
from sightline.operators.by_species import (
    SPECIES_KEYS,
    Names,
    by_species_from_counts,
    period_and_species_counts,
    species_counts,
)
from sightline.operators.period_metrics import (
    calendar_summary,
    period_summary,
    split_summary,
    summary_bounds,
    upto_cutoff,
)
from sightline.sources.metrics_io import write_metrics
from sightline.tracked_species import ALL_TRACKED

_PERIOD_NAMES = {"week": "weekly", "day": "daily", "month": "monthly", "quarter": "quarterly", "year": "yearly"}
_METRICS = ("users", "species", "observations")


def write_fact(raw: DataFrame, path: str, rebalance: bool = True) -> DataFrame:
    """Persist the raw observations as the fact table and return it re-read.

    Partitioned by observation year (date filters prune whole folders) and
    carrying the lower-cased scientific name, so name filters are pushed to
    the scan instead of evaluating ``lower()`` on every row.

    Written straight from the scan, every input task would write one file
    per year it touches (input tasks x years files). ``rebalance`` shuffles
    the rows by year first and lets AQE cut each year into partitions of
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes``: right-sized files,
    and a year holding most of the data is split over many tasks rather than
    given to one. Rows within a file are sorted by name key, then date: the
    row-group statistics then let the tracked-species scan (a pushed ``IN``
    on the name key) skip every row group without a tracked name, while date
    filters keep pruning whole year folders.
    """
    fact = raw.withColumn("observed_year", F.year("observed_on"))
    order = ["observed_year", "observed_on"]
    if "scientific_name" in raw.columns:
        fact = fact.withColumn("scientific_name_key", name_key("scientific_name"))
        order.insert(1, "scientific_name_key")
    if rebalance:
        fact = fact.hint("rebalance", "observed_year").sortWithinPartitions(*order)
    fact.write.mode("overwrite").partitionBy("observed_year").parquet(path)
    return raw.sparkSession.read.parquet(path)


def calendar_bounds(fact: DataFrame, margin_years: int = 1) -> tuple[dt.date, dt.date] | None:
    """Whole years around the data (one row comes back to the driver)."""
    row = fact.agg(F.min("observed_on").alias("lo"), F.max("observed_on").alias("hi")).first()
    if row is None or row["lo"] is None:
        return None
    return dt.date(row["lo"].year - margin_years, 1, 1), dt.date(row["hi"].year + margin_years, 12, 31)


def build_metrics(
    spark: SparkSession,
    raw: DataFrame,
    out_root: str,
    tracked_names: Names = ALL_TRACKED,
    *,
    as_of=None,
    start=None,
    end=None,
    grains: Iterable[str] = ("week",),
    fmt: str = "parquet",
) -> dict[str, str]:
    """Build and write every metric table; returns name -> path. Grains: day,
    week, month, quarter, year (the tracked species are weekly)."""
    out_root = out_root.rstrip("/")
    fact = write_fact(raw, f"{out_root}/observations_fact")
    if start is None or end is None:
        bounds = calendar_bounds(fact)
        if bounds is None:
            raise ValueError("no dated observations to build metrics from")
        start = start or bounds[0]
        end = end or bounds[1]
    paths: dict[str, str] = {}
    for grain in grains:
        period = _PERIOD_NAMES[grain]
        summary_path = f"{out_root}/{period}_summary"
        cal = dict(as_of=as_of, start=start, end=end)
        if grain == "week":
            counts_path = f"{out_root}/{period}_counts"
            kept = upto_cutoff(fact, grain, as_of, end)
            period_and_species_counts(kept, _METRICS, tracked_names, grain).write.mode("overwrite").parquet(counts_path)
            counts = spark.read.parquet(counts_path)
            per_period = counts.where(~F.col("species")).drop("species", *SPECIES_KEYS, "common_name", "observations")
            summary = calendar_summary([per_period], summary_bounds(fact, start, end), _METRICS, grain, as_of)
            by_species = by_species_from_counts(species_counts(counts), **cal)
            paths[f"{period}_counts"] = counts_path
        else:
            summary = period_summary(fact, _METRICS, grain, **cal)
            by_species = None
        summary.write.mode("overwrite").parquet(summary_path)
        tables = split_summary(spark.read.parquet(summary_path), grain)
        if by_species is not None:
            tables["by_species"] = by_species
        for name, path in write_metrics(tables, out_root, period, fmt=fmt).items():
            paths[f"{period}_{name}"] = path
        paths[f"{period}_summary"] = summary_path
    return paths
