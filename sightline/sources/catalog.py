"""Catalog tables through Spark's public catalog API."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def save_table(
    df: DataFrame, name: str, path: str | None = None, mode: str = "overwrite", partition_by=None,
    buckets: tuple[int, str] | None = None,
) -> None:
    """Save as a catalog table; with ``path`` the files live there (a shared
    location) rather than in the session's warehouse folder.

    ``buckets`` (number, column) hashes the rows into that many buckets a
    partition, sorted by the column: joins and aggregations by it, such as the
    anti join of a large batch, do not shuffle the table. Rows are clustered
    by the bucket first, so a task writes its bucket's file alone; appends must
    name the same buckets."""
    if buckets:
        df = df.repartition(*buckets)
    writer = df.write.mode(mode).format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if buckets:
        writer = writer.bucketBy(*buckets).sortBy(buckets[1])
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def table_or_empty(spark: SparkSession, name: str, schema: StructType) -> DataFrame:
    """The table if it exists, else an empty frame of ``schema``."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.createDataFrame([], schema)
