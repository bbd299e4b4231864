"""Observation records mapped onto the driver's benchmark tables.

``lineitem`` rows are observations: the order gives the date and the
observer, the part gives the taxon and its names. Only the tables a query
needs are joined (the part join is skipped when no name is used; every line
item has its part, so the row set is the same either way).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values for runs over the driver's tables.
AS_OF = dt.date(2002, 12, 31)  # the as-of date: every week of the data is in the past
CAL_START = dt.date(1994, 1, 1)  # calendar: whole years around the data (1995-2001)
CAL_END = dt.date(2002, 12, 31)
TRACKED_NAMES = ("Red Plate", "SMALL WIDGET", "old rod")  # mixed case on purpose
INGEST_CUT = dt.datetime(1999, 1, 1)  # rows created before it form the existing table
MIN_CHART_YEAR = 1996  # first year drawn by the chart series


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def observations(
    spark: SparkSession, sf_dir: str, with_names: bool = True, with_source: bool = False, with_location: bool = False
) -> DataFrame:
    """Raw observations (typed export columns plus ``quality_grade``, and
    ``location`` as "latitude,longitude" text)."""
    li = table(spark, sf_dir, "lineitem")
    line_cols = [
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_shipdate",
    ]
    if with_source:
        li = li.select(*line_cols, F.col("_metadata.file_name").alias("source_file"))
    else:
        li = li.select(*line_cols)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    joined = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    name_cols = []
    if with_names:
        part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
        joined = joined.join(part, F.col("l_partkey") == F.col("p_partkey"))
        name_cols = [
            F.col("p_name").alias("scientific_name"),
            F.col("p_brand").alias("common_name"),
            F.col("p_type").alias("taxon_kingdom_name"),
            F.col("p_name").alias("taxon_species_name"),
        ]
    return joined.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.lit(None).cast("string").alias("uuid"),
        F.col("o_orderdate").cast("date").alias("observed_on"),
        F.when(F.col("l_linenumber") % 2 == 1, F.col("o_orderdate")).alias("time_observed_at"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_shipdate").alias("created_at"),
        F.col("l_partkey").alias("taxon_id"),
        *name_cols,
        F.col("o_orderstatus").alias("quality_grade"),
        *([F.col("source_file")] if with_source else []),
        *([location(F.col("o_custkey"), F.col("l_partkey")).alias("location")] if with_location else []),
    )


def _latitude(user: Column) -> Column:
    return user % 40 + 20


def _longitude(taxon: Column) -> Column:
    return taxon % 60 - 120


def location(user: Column, taxon: Column) -> Column:
    """A made-up place: whole degrees from the user and the taxon."""
    return F.concat_ws(",", _latitude(user).cast("string"), _longitude(taxon).cast("string"))


def api_fields() -> list[Column]:
    """The fields of a nested API record made from an observation, every field
    filled: those the tables lack are made up from the ids."""
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    return [
        F.col("id"),
        F.concat(F.lit("u-"), F.col("id").cast("string")).alias("uuid"),
        F.date_format("observed_on", "yyyy-MM-dd").alias("observed_on"),
        F.date_format("time_observed_at", iso).alias("time_observed_at"),
        F.date_format("created_at", iso).alias("created_at"),
        location(F.col("user_id"), F.col("taxon_id")).alias("location"),
        F.struct(
            F.lit("Point").alias("type"), F.array(_longitude(F.col("taxon_id")), _latitude(F.col("user_id"))).alias("coordinates")
        ).alias("geojson"),
        F.struct(F.date_format("created_at", "yyyy-MM-dd").alias("date")).alias("created_at_details"),
        F.concat(F.lit("Place \""), (F.col("user_id") % 7).cast("string"), F.lit("\", north")).alias("place_guess"),
        (F.col("id") % 11 == 0).alias("spam"),
        (F.col("id") % 13 == 0).alias("hidden"),
        F.col("quality_grade"),
        F.struct(F.col("user_id").alias("id")).alias("user"),
        F.struct(
            F.col("taxon_id").alias("id"),
            F.col("scientific_name").alias("name"),
            F.col("common_name").alias("preferred_common_name"),
            F.col("taxon_kingdom_name").alias("iconic_taxon_name"),
            F.when(F.col("taxon_id") % 3 == 0, "genus").otherwise("species").alias("rank"),
            F.concat(F.lit("https://wiki.example/"), F.col("taxon_id").cast("string")).alias("wikipedia_url"),
            F.when(
                F.col("taxon_id") % 5 == 0, F.struct(F.lit("endangered").alias("status_name"))
            ).alias("conservation_status"),
        ).alias("taxon"),
    ]


def api_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same observations shaped as nested API records (for landing)."""
    return observations(spark, sf_dir).select(*api_fields())


def event_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as observations: one per event, the event type as
    the taxon (its CRC-32 as the id, the type as the name). A dense, short
    range (about a month): the daily-metrics case."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("id"),
        F.lit(None).cast("string").alias("uuid"),
        F.col("ts").cast("date").alias("observed_on"),
        F.col("ts").alias("time_observed_at"),
        F.col("user_id"),
        F.col("ts").alias("created_at"),
        F.col("event_type").alias("scientific_name"),
        F.lit(None).cast("string").alias("common_name"),
        F.crc32(F.col("event_type").cast("binary")).alias("taxon_id"),
        F.lit(None).cast("string").alias("taxon_kingdom_name"),
        F.col("event_type").alias("taxon_species_name"),
    )
