"""Species and kingdom questions: totals, shares, trends, shifts.

Counts are distinct observation ids. Grouping keys are table columns, ids are
counted by Spark's two-level distinct aggregation (combined map-side by key
and id), and everything after it works on tables of one row per species and
year (or period), never on observations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.calendar import PERIOD_COLUMNS, check_grain, period_start

SPECIES = ("taxon_id", "scientific_name")


def yearly_species(obs: DataFrame, date_col: str = "observed_on") -> DataFrame:
    """Distinct observations per species and calendar year."""
    return (
        obs.where(F.col(date_col).isNotNull() & F.col("taxon_id").isNotNull())
        .groupBy(*SPECIES, F.year(date_col).alias("year"))
        .agg(F.count_distinct("id").alias("observations"))
    )


def yoy_lift(yearly: DataFrame, min_count: int = 1) -> DataFrame:
    """Change per species from one calendar year to the next, with its rank
    (largest lift first, ties by name, then taxon) in the year.

    A year without observations of the species counts as zero, so a species
    that vanishes shows its drop; the first year of the data has no change,
    the year after the last none. ``ratio`` is null where the year before is
    zero. Only changes with at least ``min_count`` observations in either
    year are kept. ``yearly`` is read twice (its span, the changes): give a
    written table.
    """
    span = yearly.agg(F.min("year").alias("first"), F.max("year").alias("last"))
    # each count stands for its own year and as the count before the next one
    sides = yearly.select(
        *SPECIES, F.expr("stack(2, year, observations, 0L, year + 1, 0L, observations) AS (year, current, previous)")
    )
    both = sides.groupBy(*SPECIES, "year").agg(
        F.sum("current").alias("observations"), F.sum("previous").alias("previous_observations")
    )
    inside = both.where(
        (F.col("year") > span.select("first").scalar()) & (F.col("year") <= span.select("last").scalar())
    ).where(F.greatest("observations", "previous_observations") >= min_count)
    lift = F.col("observations") - F.col("previous_observations")
    ratio = F.when(F.col("previous_observations") > 0, F.col("observations") / F.col("previous_observations"))
    order = Window.partitionBy("year").orderBy(F.desc("lift"), "scientific_name", "taxon_id")
    return (
        inside.withColumn("lift", lift)
        .withColumn("ratio", ratio)
        .withColumn("lift_rank", F.row_number().over(order))
    )


def species_trend(yearly: DataFrame, min_years: int = 3) -> DataFrame:
    """Least-squares slope of a species' yearly observations on the year, for
    species seen in at least ``min_years`` years."""
    slope = F.regr_slope(F.col("observations").cast("double"), F.col("year").cast("double"))
    # rounded: the last bits of a sum depend on the order of its terms
    fitted = yearly.groupBy(*SPECIES).agg(F.count(F.lit(1)).alias("years"), (F.round(slope, 9) + 0.0).alias("slope"))
    direction = (
        F.when(F.col("slope") == 0, "level").when(F.col("slope") > 0, "increasing").otherwise("declining")
    )
    return fitted.where(F.col("years") >= min_years).withColumn("trend", direction)


def species_share(obs: DataFrame, grain: str = "month", date_col: str = "observed_on") -> DataFrame:
    """Share of each species in the distinct observations of a period
    (observations counted per species and summed over species)."""
    pcol, _ = PERIOD_COLUMNS[check_grain(grain)]
    counts = (
        obs.where(F.col(date_col).isNotNull() & F.col("taxon_id").isNotNull())
        .groupBy(period_start(date_col, grain).alias(pcol), *SPECIES)
        .agg(F.count_distinct("id").alias("observations"))
    )
    return counts.withColumn("share", F.col("observations") / F.sum("observations").over(Window.partitionBy(pcol)))


def kingdom_totals(obs: DataFrame) -> DataFrame:
    """Distinct observations per kingdom, all time."""
    return obs.groupBy("taxon_kingdom_name").agg(F.count_distinct("id").alias("observations"))


def kingdom_by_period(obs: DataFrame, grain: str = "month", date_col: str = "observed_on") -> DataFrame:
    """Distinct observations per period and kingdom (stacked-bar form)."""
    pcol, _ = PERIOD_COLUMNS[check_grain(grain)]
    return (
        obs.where(F.col(date_col).isNotNull())
        .groupBy(period_start(date_col, grain).alias(pcol), "taxon_kingdom_name")
        .agg(F.count_distinct("id").alias("observations"))
    )


def rarest_species(obs: DataFrame, limit: int | None = None) -> DataFrame:
    """Species by all-time distinct observations, rarest first (ties by name,
    then taxon); the first ``limit`` when given. ``rank`` is one more than the
    number of species with fewer observations, so ties share it: it comes from
    a histogram (a row per number of observations), not from a window over
    all species.
    """
    counts = (
        obs.where(F.col("taxon_id").isNotNull()).groupBy(*SPECIES).agg(F.count_distinct("id").alias("observations"))
    )
    fewer = Window.orderBy("observations").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.groupBy("observations").agg(F.count(F.lit(1)).alias("species")).select(
        "observations", (F.coalesce(F.sum("species").over(fewer), F.lit(0)) + 1).alias("rank")
    )
    ordered = counts.join(ranks, "observations").select(*SPECIES, "observations", "rank").orderBy(
        "observations", "scientific_name", "taxon_id"
    )
    return ordered if limit is None else ordered.limit(limit)


def quality_breakdown(obs: DataFrame) -> DataFrame:
    """Distinct observations per quality grade and their percentage of the
    sum over grades."""
    counts = obs.groupBy("quality_grade").agg(F.count_distinct("id").alias("observations"))
    total = F.sum("observations").over(Window.partitionBy())  # one row per grade
    return counts.withColumn("percentage", F.lit(100.0) * F.col("observations") / total)


EARTH_KM = 6371.0088
CANCELLED = 1e-9  # a mean vector shorter than this is rounding error


def with_coordinates(obs: DataFrame, col: str = "location") -> DataFrame:
    """``latitude`` and ``longitude`` from "lat,lon" text (null if unreadable
    or out of range)."""
    parts = F.split(F.col(col), ",")
    lat, lon = (F.get(parts, i).try_cast("double") for i in (0, 1))
    known = lat.between(-90, 90) & lon.between(-180, 180)
    return obs.withColumn("latitude", F.when(known, lat)).withColumn("longitude", F.when(known, lon))


def range_shift(obs: DataFrame, date_col: str = "observed_on") -> DataFrame:
    """Distance in km between a species' mean locations of one calendar year
    and the next.

    A mean location is the mean of unit-sphere vectors, which has no seam at
    the date line; the distance is the great-circle distance between the two
    directions. Vectors that cancel out (antipodal places) have no mean
    location: it and the distances from and to it are null. Needs
    ``latitude`` and ``longitude``.
    """
    lat, lon = F.radians("latitude"), F.radians("longitude")
    centres = (
        obs.where(F.col(date_col).isNotNull() & F.col("taxon_id").isNotNull() & F.col("latitude").isNotNull())
        .groupBy(*SPECIES, F.year(date_col).alias("year"))
        .agg(
            F.count(F.lit(1)).alias("located"),
            F.avg(F.cos(lat) * F.cos(lon)).alias("x"),
            F.avg(F.cos(lat) * F.sin(lon)).alias("y"),
            F.avg(F.sin(lat)).alias("z"),
        )
        .withColumn("_some", F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2 > CANCELLED**2)
        .withColumn("_lat", F.when(F.col("_some"), F.atan2("z", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2))))
        .withColumn("_lon", F.when(F.col("_some"), F.atan2("y", "x")))
        .select(*SPECIES, "year", "located", "_lat", "_lon")
    )
    before = Window.partitionBy(*SPECIES).orderBy("year")
    lat0, lon0 = F.lag("_lat").over(before), F.lag("_lon").over(before)
    paired = centres.withColumn("_y0", F.lag("year").over(before)).withColumn("_lat0", lat0).withColumn("_lon0", lon0)
    half = (
        F.sin((F.col("_lat") - F.col("_lat0")) / 2) ** 2
        + F.cos("_lat") * F.cos("_lat0") * F.sin((F.col("_lon") - F.col("_lon0")) / 2) ** 2
    )
    # least() skips nulls: a missing place must stay missing
    km = F.when(half.isNotNull(), F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(half))))
    return paired.where(F.col("_y0") == F.col("year") - 1).select(
        *SPECIES,
        "year",
        "located",
        F.round(F.degrees("_lat"), 6).alias("latitude"),
        F.round(F.degrees("_lon"), 6).alias("longitude"),
        F.round(km, 3).alias("shift_km"),
    )
