"""Event participation: who observed during an event, and what users did
before and after it.

All operators take the events as a table (event, start_date, end_date). An
observation belongs to an event when its date lies between the event's first
and last day, both included; "before" and "after" mean the same calendar year.
Events join observations by equality (on the year, the day or the bin of an
interval join) with a measured, broadcast events side, so the observations are scanned, never shuffled, until
they are aggregated per user; per-user counts come from one keyed aggregation
with fixed-width buffers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.events import measured
from sightline.operators.intervals import interval_join

BEFORE, DURING, AFTER = 0, 1, 2
_PHASES = {"before": BEFORE, "during": DURING, "after": AFTER}


def event_metrics(obs: DataFrame, events: DataFrame, date_col: str = "observed_on") -> DataFrame:
    """Distinct users, species (taxa) and observations per event (an event
    without observations has zeros)."""
    spans = events.select("event", "start_date", "end_date")
    hits = interval_join(obs.select(date_col, "user_id", "taxon_id", "id"), spans, date_col, "start_date", "end_date")
    items = "stack(3, 0, CAST(user_id AS BIGINT), 1, CAST(taxon_id AS BIGINT), 2, CAST(id AS BIGINT)) AS (k, value)"
    distinct = hits.select("event", F.expr(items)).where("value IS NOT NULL").distinct()
    counts = distinct.groupBy("event").agg(
        F.count_if(F.col("k") == 0).alias("unique_users"),
        F.count_if(F.col("k") == 1).alias("unique_species"),
        F.count_if(F.col("k") == 2).alias("unique_observations"),
    )
    names = ["unique_users", "unique_species", "unique_observations"]
    return events.join(counts, "event", "left").select(
        "event", "start_date", "end_date", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names]
    )


def event_activity(obs: DataFrame, events: DataFrame, date_col: str = "observed_on") -> DataFrame:
    """Per event and user active in the event's year: distinct observations
    and species before, during and after the event."""
    own = measured(events.select("event", "start_date", "end_date", F.year("start_date").alias("_year")))
    d = F.col(date_col)
    phase = F.when(d < F.col("start_date"), BEFORE).when(d <= F.col("end_date"), DURING).otherwise(AFTER)
    rows = (
        obs.where(F.col("user_id").isNotNull() & d.isNotNull())
        .withColumn("_year", F.year(d))
        .join(own, "_year")
        .select(
            "event",
            "user_id",
            phase.alias("phase"),
            F.expr("stack(2, 0, CAST(id AS BIGINT), 1, CAST(taxon_id AS BIGINT)) AS (k, value)"),
        )
    )
    distinct = rows.distinct()
    seen = F.col("value").isNotNull()
    return distinct.groupBy("event", "user_id").agg(*[
        F.count_if(seen & (F.col("k") == k) & (F.col("phase") == number)).alias(f"{what}_{name}")
        for k, what in enumerate(("observations", "species"))
        for name, number in _PHASES.items()
    ])


def event_participants(obs: DataFrame, events: DataFrame, date_col: str = "observed_on") -> DataFrame:
    """(event, user, participated): every user active in the event's year, and
    whether the user observed during the event."""
    own = measured(events.select("event", "start_date", "end_date", F.year("start_date").alias("_year")))
    d = F.col(date_col)
    during = d.between(F.col("start_date"), F.col("end_date"))
    return (
        obs.where(F.col("user_id").isNotNull() & d.isNotNull())
        .withColumn("_year", F.year(d))
        .join(own, "_year")
        .groupBy("event", "user_id")
        .agg(F.max(during).alias("participated"))
    )


def _segment_averages(activity: DataFrame, what: str, participated) -> DataFrame:
    return activity.groupBy("event", participated.alias("participated")).agg(
        F.count(F.lit(1)).alias("users"),
        F.avg(f"{what}_before").alias(f"avg_{what}_before"),
        F.avg(f"{what}_after").alias(f"avg_{what}_after"),
    )


def participation_activity(activity: DataFrame) -> DataFrame:
    """Average observations per user before and after each event, of
    participants and of others (users without any count as zero)."""
    return _segment_averages(activity, "observations", _participated(activity))


def participation_species(activity: DataFrame) -> DataFrame:
    """The same for distinct species."""
    return _segment_averages(activity, "species", _participated(activity))


def _participated(activity: DataFrame):
    """A user took part with an observation during the event, identified or
    not; an observation without an id still shows in its species."""
    return (F.col("observations_during") > 0) | (F.col("species_during") > 0)


def event_acquisition(firsts: DataFrame, events: DataFrame, near_days: int = 7) -> DataFrame:
    """New users per year, and how many of them were first seen during the
    year's event or within ``near_days`` of it (days of the event included).

    ``firsts`` has one row per user with ``first_date``. A year without an
    event has a null event and zeros.
    """
    own = measured(events.select("event", "start_date", "end_date", F.year("start_date").alias("year")))
    day = F.col("first_date")
    during = day.between(F.col("start_date"), F.col("end_date"))
    near = day.between(F.date_sub("start_date", near_days), F.date_add("end_date", near_days))
    return (
        firsts.select(F.year("first_date").alias("year"), "first_date")
        .join(own, "year", "left")
        .groupBy("year", "event")
        .agg(
            F.count(F.lit(1)).alias("new_users"),
            F.count_if(during).alias("first_during"),
            F.count_if(near).alias("first_near"),
        )
    )


def event_retention(
    obs: DataFrame, events: DataFrame, participants: DataFrame, weeks: int = 52, date_col: str = "observed_on"
) -> DataFrame:
    """Active users and distinct observations in the k-th week after each
    event (k from 0: the seven days after its last day), of participants and
    of the other users active in its year.

    The days after an event are expanded (``7 * weeks`` rows per event) and
    joined by equality; ``participants`` is ``event_participants``.
    """
    after = F.explode(F.sequence(F.date_add("end_date", 1), F.date_add("end_date", 7 * weeks), F.expr("INTERVAL 1 DAY")))
    days = events.select("event", "end_date", after.alias("_day")).select(
        "event", "_day", F.floor((F.datediff("_day", "end_date") - 1) / 7).cast("int").alias("week_after")
    )
    rows = (
        obs.where(F.col("user_id").isNotNull())
        .join(measured(days), F.col(date_col) == F.col("_day"))
        .select("event", "user_id", "week_after", "id")
        .distinct()
        .join(participants, ["event", "user_id"])
    )
    items = "stack(2, 0, CAST(user_id AS BIGINT), 1, CAST(id AS BIGINT)) AS (k, value)"
    distinct = rows.select("event", "participated", "week_after", F.expr(items)).where("value IS NOT NULL").distinct()
    return distinct.groupBy("event", "participated", "week_after").agg(
        F.count_if(F.col("k") == 0).alias("active_users"), F.count_if(F.col("k") == 1).alias("observations")
    )
