"""Chart series job: metric tables -> long-form series tables (two jobs)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from sightline.operators.series import DEFAULT_MIN_YEAR, metric_series, species_series
from sightline.operators.yoy import yoy_metrics, yoy_species
from sightline.sources.metrics_io import read_metrics
from sightline.tracked_species import ALL_TRACKED


def build_series(
    spark: SparkSession,
    metrics_root: str,
    out_root: str,
    tracked_names: Iterable[str] | None = ALL_TRACKED,
    min_year: int | None = DEFAULT_MIN_YEAR,
    fmt: str = "parquet",
) -> dict[str, str]:
    m = read_metrics(spark, metrics_root, "weekly", fmt=fmt)
    out = {
        "metric_series": f"{out_root.rstrip('/')}/metric_series",
        "species_series": f"{out_root.rstrip('/')}/species_series",
    }
    metric_series(yoy_metrics(m["users"], m["species"], m["observations"]), min_year).write.mode(
        "overwrite"
    ).partitionBy("metric").parquet(out["metric_series"])
    species_series(yoy_species(m["by_species"]), tracked_names, min_year).write.mode("overwrite").parquet(
        out["species_series"]
    )
    return out
