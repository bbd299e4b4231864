"""Sanity check: count audit of the observations and a preview of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.operators.audit import count_audit, preview
from sightline.sources.metrics_io import read_metrics


def count_check(spark: SparkSession, obs: DataFrame, metrics_root: str | None = None, n: int = 5,
                fmt: str = "parquet"):
    """Returns (audit rows, {metric: first n rows}); all small, bounded results."""
    audit_rows = count_audit(obs).orderBy("scope", "year").collect()
    previews = {}
    if metrics_root:
        names = ("users", "species", "observations")
        for name, df in read_metrics(spark, metrics_root, "weekly", names=names, fmt=fmt).items():
            previews[name] = preview(df, ["week"], n).collect()
    return audit_rows, previews
