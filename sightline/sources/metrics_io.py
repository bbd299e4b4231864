"""Metric tables: write once, read back typed."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.schema import METRIC_SCHEMAS

_PERIOD_NAMES = {"weekly": "week", "daily": "day", "monthly": "month", "quarterly": "quarter", "yearly": "year"}


def metric_path(root: str, period: str, name: str) -> str:
    return f"{root.rstrip('/')}/{period}_{name}"


def write_metrics(
    tables: Mapping[str, DataFrame], root: str, period: str = "weekly", fmt: str = "parquet", mode: str = "overwrite"
) -> dict[str, str]:
    """Write each metric table to ``{root}/{period}_{name}``.

    ``fmt='csv'`` writes with a header (the interchange form); parquet is the
    default at rest. Tables with one row per calendar period are coalesced to
    one file; the per-species table grows with the tracked taxa and keeps its
    partitioning.
    """
    paths = {}
    for name, df in tables.items():
        path = metric_path(root, period, name)
        writer = (df if name == "by_species" else df.coalesce(1)).write.mode(mode)
        if fmt == "csv":
            writer.option("header", True).csv(path)
        else:
            writer.format(fmt).save(path)
        paths[name] = path
    return paths


def read_metrics(
    spark: SparkSession, root: str, period: str = "weekly", names=("users", "species", "observations", "by_species"),
    fmt: str = "parquet",
) -> dict[str, DataFrame]:
    """Read metric tables with their declared schemas (no inference)."""
    grain = _PERIOD_NAMES.get(period, period)
    out = {}
    for name in names:
        schema = METRIC_SCHEMAS[(grain, name)]
        path = metric_path(root, period, name)
        if fmt == "csv":
            out[name] = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
        else:
            out[name] = spark.read.schema(schema).format(fmt).load(path)
    return out


def metric_columns(df: DataFrame, grain: str) -> DataFrame:
    """The metric tables' columns of a combined table, in their declared types
    and order; every other column is dropped."""
    fields = {}
    for name in ("users", "species", "observations"):
        fields |= {f.name: f for f in METRIC_SCHEMAS[(_PERIOD_NAMES.get(grain, grain), name)].fields}
    return df.select(*[F.col(n).cast(f.dataType).alias(n) for n, f in fields.items() if n in df.columns])


def typed_metrics(df: DataFrame, grain: str, name: str) -> DataFrame:
    """Text metric columns (e.g. a CSV read without a schema) -> declared
    types; unreadable values become null instead of failing the job."""
    schema = METRIC_SCHEMAS[(_PERIOD_NAMES.get(grain, grain), name)]
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])
