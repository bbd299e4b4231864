"""First-seen dates per user and per taxon, and the enriched observation fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.calendar import week_start
from sightline.schema import OBSERVATION_FACT_COLUMNS
from sightline.session import Scratch, broadcast_rows

_ENTITIES = {"user": "user_id", "taxon": "taxon_id"}
KEY_BYTES = 64  # a bigint key and two dates in a broadcast hash relation


def first_seen(obs: DataFrame, key: str, date_col: str = "observed_on") -> DataFrame:
    """``(key, first_date, first_week)``: earliest dated observation per key.

    One aggregation (partial per task, then merged per key), so a key holding
    a third of all rows still collapses map-side. The week is derived from the
    date: truncation is monotone, so min(week) = week(min date).
    """
    return (
        obs.where(F.col(key).isNotNull() & F.col(date_col).isNotNull())
        .groupBy(key)
        .agg(F.min(date_col).alias("first_date"))
        .withColumn("first_week", week_start("first_date"))
    )


def first_seen_all(obs: DataFrame, date_col: str = "observed_on") -> DataFrame:
    """Users and taxa in one table: ``(entity, entity_id, first_date, first_week)``.

    One scan and one aggregation for both: each observation yields a
    ``(user, user_id)`` and a ``(taxon, taxon_id)`` row, grouped by
    (entity, id).
    """
    pairs = ", ".join(f"'{name}', CAST(`{key}` AS BIGINT)" for name, key in _ENTITIES.items())
    return (
        obs.where(F.col(date_col).isNotNull())
        .select(F.col(date_col), F.expr(f"stack({len(_ENTITIES)}, {pairs}) AS (entity, entity_id)"))
        .where(F.col("entity_id").isNotNull())
        .groupBy("entity", "entity_id")
        .agg(F.min(date_col).alias("first_date"))
        .withColumn("first_week", week_start("first_date"))
    )


def store_first_seen(obs: DataFrame, scratch: Scratch, date_col: str = "observed_on") -> DataFrame:
    """The first-seen table, written once (partitioned by entity) to the
    caller's scratch."""
    return scratch.write(first_seen_all(obs, date_col), "first-seen", partition_by="entity")


def attach_first_seen(
    obs: DataFrame, firsts: DataFrame, date_col: str = "observed_on", broadcast_limit: int | None = None
) -> DataFrame:
    """Left-join the first-seen date and week per user and per taxon.

    ``firsts`` is the written first-seen table (``store_first_seen``), one
    aggregation over the fact for both; its row counts are read first (a
    small job). A side within ``broadcast_limit`` keys (what fits into a
    share of an executor's heap, when not given) is broadcast, so the fact is
    read once more and never shuffled. A larger one is joined by shuffle,
    where AQE splits skewed fact partitions. (Left to AQE alone, the fact
    would be shuffled by user_id before the tables' sizes are known.)
    """
    limit = broadcast_rows(obs.sparkSession, KEY_BYTES) if broadcast_limit is None else broadcast_limit
    sizes = {r["entity"]: r["n"] for r in firsts.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = obs
    for name, key in _ENTITIES.items():
        table = firsts.where(F.col("entity") == name).select(
            F.col("entity_id").alias(key),
            F.col("first_date").alias(f"first_{name}_date"),
            F.col("first_week").alias(f"first_{name}_week"),
        )
        if sizes.get(name, 0) <= limit:
            table = F.broadcast(table)
        out = out.join(table, key, "left")
    return out


def observed_at_fill(obs: DataFrame, date_col: str = "observed_on") -> Column:
    """Time of observation, else midnight of the observation date."""
    ts_type = obs.schema["time_observed_at"].dataType
    return F.coalesce(F.col("time_observed_at"), F.col(date_col).cast(ts_type))


def observation_fact(raw: DataFrame, firsts: DataFrame) -> DataFrame:
    """Raw observations and their written first-seen table -> the enriched
    fact.

    ``observed_on`` becomes ``observed_date``, its Monday ``observed_week``;
    a missing time of observation falls back to midnight of the date.
    """
    derived = {
        "observed_date": F.col("observed_on"),
        "observed_week": week_start("observed_on"),
        "time_observed_at": observed_at_fill(raw),
    }
    enriched = attach_first_seen(raw, firsts)
    return enriched.select(*[derived.get(c, F.col(c)).alias(c) for c in OBSERVATION_FACT_COLUMNS])
