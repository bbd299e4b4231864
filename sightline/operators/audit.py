"""Count audits: total rows against distinct observation ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def total_vs_distinct(obs: DataFrame) -> DataFrame:
    """One row: all rows and distinct ids (repeats show as the gap)."""
    return obs.agg(F.count(F.lit(1)).alias("total_count"), F.count_distinct("id").alias("distinct_id_count"))


def yearly_total_vs_distinct(obs: DataFrame, date_col: str = "observed_on") -> DataFrame:
    """The same per calendar year of the observation, newest year first."""
    return (
        obs.groupBy(F.year(date_col).alias("year"))
        .agg(F.count(F.lit(1)).alias("yearly_total_count"), F.count_distinct("id").alias("yearly_distinct_id_count"))
        .orderBy(F.col("year").desc())
    )


def count_audit(obs: DataFrame, date_col: str = "observed_on") -> DataFrame:
    """Yearly and overall counts in one aggregation (a rollup over year).

    ``scope`` is 'year' for the per-year rows (``year`` null for rows without
    a date) and 'all' for the overall row.
    """
    return (
        obs.select(F.year(date_col).alias("year"), "id")
        .rollup("year")
        .agg(
            F.count(F.lit(1)).alias("total_count"),
            F.count_distinct("id").alias("distinct_id_count"),
            F.when(F.grouping("year") == 1, F.lit("all")).otherwise(F.lit("year")).alias("scope"),
        )
        .select("scope", "year", "total_count", "distinct_id_count")
    )


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def preview(df: DataFrame, order_cols, n: int = 5) -> DataFrame:
    """Deterministic first ``n`` rows (a top-k, not an arbitrary sample)."""
    return df.orderBy(*order_cols).limit(n)
