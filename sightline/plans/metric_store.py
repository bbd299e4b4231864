"""Metric tables kept up to date from increments, without the fact.

A store holds what the metrics need to know about the rows seen so far:

* ``pairs``: distinct (metric, entity, day),
* ``firsts``: the first day of each user and taxon,
* ``species_pairs``: distinct (week, taxon, name, id) of the tracked species,
* ``sketches``: a mergeable HLL sketch of each metric's entities per day,
* ``<grain>_deltas`` and ``species_deltas``: by how much a batch changed the
  counts of each period; their sum is the metric table,
* ``bounds``: the first and last day of each batch,
* ``batches``: the number of each batch.

``apply_increment`` compares an increment only with the stored pairs of the
periods it touches and the first days of the entities it holds: a pair that is
not there yet adds to its period's unique count; an entity that is new, or seen
earlier than before (a late record), adds to the new count of that period and
takes one from the period it was first seen in until now. Every table is
append-only with a folder per batch, numbered in the order in which batches
were first applied, and a batch is compared with those before it only:
applying it again writes the same folders again.

Base plus increments equals a build over all rows at once, for any order and
any overlap of the increments.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.calendar import PERIOD_COLUMNS, period_end, period_start
from sightline.operators.by_species import SPECIES_KEYS, Names, by_species_from_counts, name_in_list
from sightline.operators.period_metrics import (
    METRICS,
    calendar_summary,
    entity_period_pairs,
    summary_bounds,
)
from sightline.operators.sketches import daily_sketches, rollup_uniques
from sightline.session import Scratch

NAMES = tuple(METRICS)
WITH_NEW = [i for i, m in enumerate(NAMES) if METRICS[m][1]]
MOST_RANGES = 64


def day_pairs(obs: DataFrame) -> DataFrame:
    """Distinct (day, m, value)."""
    return entity_period_pairs(obs, NAMES, "day").withColumnRenamed(PERIOD_COLUMNS["day"][0], "day")


class MetricStore:
    """The stored tables below one folder."""

    def __init__(self, spark: SparkSession, root: str, grains: Iterable[str] = ("week", "day"), tracked: Names | None = None):
        self.spark, self.root, self.grains, self.tracked = spark, root.rstrip("/"), tuple(grains), tracked

    # ---- tables ----------------------------------------------------------

    def _write(self, df: DataFrame, table: str, folder: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/batch={folder}")

    def _read(self, table: str, before: str | None = None) -> DataFrame | None:
        """All batches of a table, or those before one (a partition filter);
        None before the first."""
        try:
            df = self.spark.read.parquet(f"{self.root}/{table}")
        except AnalysisException:
            return None
        return (df if before is None else df.where(F.col("batch") < before)).drop("batch")

    def _folder(self, batch: str) -> str:
        """The numbered folder of a batch, which keeps the number it first got."""
        known = self._read("batches")
        found = None if known is None else known.agg(
            F.max("number").alias("last"), F.max(F.when(F.col("name") == batch, F.col("number"))).alias("own")
        ).first()
        last, own = (-1, None) if found is None else (found.last, found.own)
        number = last + 1 if own is None else own
        folder = f"b{number:012d}"
        if own is None:
            row = self.spark.createDataFrame([(batch, number)], "name string, number bigint")
            self._write(row, "batches", folder)
        return folder

    # ---- maintenance -----------------------------------------------------

    def apply_increment(self, increment: DataFrame, batch: str) -> None:
        """Take the rows of one batch (typed observations) into the store."""
        batch = self._folder(batch)
        dated = increment.where(F.col("observed_on").isNotNull())
        with Scratch(self.spark) as scratch:
            days = scratch.write(day_pairs(dated), "day-pairs")
            self._write(days.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).where("lo is not null"), "bounds", batch)
            changed = scratch.write(self._changed_firsts(days, batch), "changed-firsts")
            known = self._read("pairs", batch)
            for grain in self.grains:
                self._write(self._grain_delta(days, known, changed, grain), f"{grain}_deltas", batch)
            fresh = days if known is None else days.join(self._near(known, days, "day"), ["day", "m", "value"], "left_anti")
            # sorted by day, so that a reader of few periods skips the rest
            self._write(fresh.repartitionByRange("day").sortWithinPartitions("day"), "pairs", batch)
            self._write(changed.select("m", "value", "first"), "firsts", batch)
        self._write(daily_sketches(dated, NAMES), "sketches", batch)
        if self.tracked is not None:
            self._apply_species(dated, batch)

    def _changed_firsts(self, days: DataFrame, batch: str) -> DataFrame:
        """(m, value, first, old): entities first seen earlier than known."""
        firsts = days.where(F.col("m").isin(WITH_NEW)).groupBy("m", "value").agg(F.min("day").alias("first"))
        known = self._read("firsts", batch)
        if known is None:
            return firsts.withColumn("old", F.lit(None).cast("date"))
        mine = known.join(firsts.select("m", "value"), ["m", "value"], "left_semi")
        old = mine.groupBy("m", "value").agg(F.min("first").alias("old"))
        return firsts.join(old, ["m", "value"], "left").where(F.col("old").isNull() | (F.col("first") < F.col("old")))

    def _near(self, known: DataFrame, days: DataFrame, grain: str) -> DataFrame:
        """The stored pairs of the periods that ``days`` touches: a filter on
        the day column that reaches the scan."""
        starts = days.select(period_start(F.col("day"), grain).alias("p")).distinct()
        periods = [(r.p, r.e) for r in starts.select("p", period_end(F.col("p"), grain).alias("e")).orderBy("p").collect()]
        return known.where(within(F.col("day"), periods))

    def _grain_delta(self, days: DataFrame, known: DataFrame | None, changed: DataFrame, grain: str) -> DataFrame:
        """Change of the counts of each period at one grain."""
        pcol, _ = PERIOD_COLUMNS[grain]
        at = period_start(F.col("day"), grain).alias(pcol)
        pairs = days.select(at, "m", "value").distinct()
        if known is not None:
            held = self._near(known, days, grain).select(at, "m", "value")
            pairs = pairs.join(held, [pcol, "m", "value"], "left_anti")
        unique = pairs.select(pcol, "m", F.lit(0).alias("new"), F.lit(1).alias("unique"))
        first, old = (period_start(F.col(c), grain) for c in ("first", "old"))
        moved = changed.where(F.col("old").isNull() | (first != old))
        gained = moved.select(first.alias(pcol), "m", F.lit(1).alias("new"), F.lit(0).alias("unique"))
        lost = moved.where("old is not null").select(old.alias(pcol), "m", F.lit(-1).alias("new"), F.lit(0).alias("unique"))
        rows = unique.unionByName(gained).unionByName(lost)
        sums = []
        for i, m in enumerate(NAMES):
            if METRICS[m][1]:
                sums.append(F.sum(F.when(F.col("m") == i, F.col("new")).otherwise(0)).alias(f"new_{m}"))
            sums.append(F.sum(F.when(F.col("m") == i, F.col("unique")).otherwise(0)).alias(f"unique_{m}"))
        return rows.groupBy(pcol).agg(*sums)

    def _apply_species(self, dated: DataFrame, batch: str) -> None:
        rows = name_in_list(dated, self.tracked).select(
            period_start(F.col("observed_on"), "week").alias("week"), *SPECIES_KEYS, "common_name",
            F.col("id").cast("long").alias("id"),
        )
        keys = ["week", *SPECIES_KEYS]
        with Scratch(self.spark) as scratch:
            rows = scratch.write(rows, "species-rows")
            fresh = rows.where("id is not null").select(*keys, "id").distinct()
            known = self._read("species_pairs", batch)
            if known is not None:
                weeks = [(r.week, r.week) for r in rows.select("week").distinct().orderBy("week").collect()]
                near = known.where(within(F.col("week"), weeks)).alias("k")
                same = [F.col(f"f.{c}").eqNullSafe(F.col(f"k.{c}")) for c in (*keys, "id")]
                fresh = fresh.alias("f").join(near, same, "left_anti")
            self._write(fresh, "species_pairs", batch)
            counted = self.spark.read.parquet(f"{self.root}/species_pairs/batch={batch}").select(
                *keys, F.lit(None).cast("string").alias("common_name"), F.lit(1).alias("n")
            )
            names = rows.groupBy(*keys).agg(F.min("common_name").alias("common_name")).withColumn("n", F.lit(0))
            delta = counted.unionByName(names).groupBy(*keys).agg(
                F.min("common_name").alias("common_name"), F.sum("n").alias("observations")
            )
            self._write(delta, "species_deltas", batch)

    # ---- metric tables ---------------------------------------------------

    def _required(self, table: str) -> DataFrame:
        df = self._read(table)
        if df is None:
            raise ValueError(f"nothing has been applied to the metric store at {self.root}")
        return df

    def counts(self, grain: str = "week") -> DataFrame:
        """``new_X`` and ``unique_X`` per period with data."""
        pcol, _ = PERIOD_COLUMNS[grain]
        deltas = self._required(f"{grain}_deltas")
        total = deltas.groupBy(pcol).agg(*[F.sum(c).alias(c) for c in deltas.columns if c != pcol])
        return total

    def summary(self, grain: str = "week", *, as_of=None, start=None, end=None, reconcile_years=None) -> DataFrame:
        """The table ``period_summary`` computes from all rows."""
        ends = self._required("bounds").select(F.explode(F.array("lo", "hi")).alias("observed_on"))
        bounds = summary_bounds(ends, start, end)
        return calendar_summary([self.counts(grain)], bounds, NAMES, grain, as_of, reconcile_years)

    def by_species(self, *, as_of=None, start=None, end=None, **options) -> DataFrame:
        """The table ``weekly_by_species`` computes from all rows."""
        deltas = self._required("species_deltas")
        counts = deltas.groupBy("week", *SPECIES_KEYS).agg(
            F.min("common_name").alias("common_name"), F.sum("observations").alias("observations")
        )
        return by_species_from_counts(counts, as_of=as_of, start=start, end=end, **options)

    def approx_uniques(self, grain: str = "month") -> DataFrame:
        """Estimated distinct entities per period of any grain, from the
        stored sketches."""
        return rollup_uniques(self._required("sketches"), grain)


def within(column: Column, periods: list[tuple[dt.date, dt.date]]) -> Column:
    """``column`` lies in one of the (first, last) day spans, which are sorted.
    Spans that touch are one; the closest of too many are joined, so that the
    filter stays short enough to be pushed to a scan (it may then let more
    through than was asked)."""
    spans: list[list[dt.date]] = []
    for first, last in periods:
        if spans and first <= spans[-1][1] + dt.timedelta(days=1):
            spans[-1][1] = max(last, spans[-1][1])
        else:
            spans.append([first, last])
    while len(spans) > MOST_RANGES:
        at = min(range(1, len(spans)), key=lambda i: spans[i][0] - spans[i - 1][1])
        spans[at - 1 : at + 1] = [[spans[at - 1][0], spans[at][1]]]
    test = F.lit(False)
    for first, last in spans:
        test = test | column.between(F.lit(first), F.lit(last))
    return test
