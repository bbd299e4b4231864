"""Points in intervals: a binned interval join.

Spark has no hash join for ``start <= point <= end``. Here an interval gets
the level whose bins (``2^level`` seconds or units) are just long enough that
it touches at most two of them, and one row for each of those. A point has one
bin at every level the intervals use, so the join is an equality on (level,
bin) followed by the exact bounds, and each pair is found once. An interval of
fifty years makes two rows like one of an hour; points are repeated once per
level in use (the few distinct magnitudes of the intervals), and a bin is at
most twice as long as the shortest interval of its level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.session import broadcast_rows

ROW_BYTES = 200  # an interval row in a broadcast hash relation
_LEVEL, _BIN, _LO, _HI = "_interval_level", "_interval_bin", "_interval_lo", "_interval_hi"


def _units(df: DataFrame, name: str) -> Column:
    """A whole number that grows with the value: the second of a timestamp or
    of a day's beginning, the floor of a number."""
    kind, value = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.TimestampType):
        return F.unix_seconds(value)
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("bigint") * 86400
    if isinstance(kind, T.TimestampNTZType):
        seconds = F.hour(value) * 3600 + F.minute(value) * 60 + F.second(value)
        return F.unix_date(value.cast("date")).cast("bigint") * 86400 + seconds
    if isinstance(kind, T.NumericType):
        return F.floor(value).cast("bigint")
    raise ValueError(f"{name}: {kind.simpleString()} is no point on a line")


def binned(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """The intervals with their level, one row for each bin they touch (one or
    two). Intervals without both bounds, or that end before they start, hold
    no point and go."""
    length = F.col(_HI) - F.col(_LO)
    level = F.when(length == 0, 0).otherwise(F.length(F.bin(length)))
    touched = F.expr(f"sequence(shiftright({_LO}, {_LEVEL}), shiftright({_HI}, {_LEVEL}))")
    return (
        intervals.withColumn(_LO, _units(intervals, start))
        .withColumn(_HI, _units(intervals, end))
        .where((F.col(f"`{start}`") <= F.col(f"`{end}`")) & F.col(_LO).isNotNull() & F.col(_HI).isNotNull())
        .withColumn(_LEVEL, level.cast("int"))
        .withColumn(_BIN, F.explode(touched))
        .drop(_LO, _HI)
    )


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, closed: str = "both") -> DataFrame:
    """Every point with every interval that holds it: ``start <= at <= end``,
    or ``start <= at < end`` with ``closed="left"``. Intervals may overlap and
    be of any length; repeated rows count each on their own. The column names
    of both sides must differ, and dates may meet timestamps without a zone
    (a day is its beginning).

    The intervals are counted by level before the join, in one small job: within
    the measured bound they are broadcast and the points are not shuffled;
    beyond it both sides are shuffled by (level, bin)."""
    if closed not in ("both", "left"):
        raise ValueError("closed must be 'both' or 'left'")
    both = set(points.columns) & set(intervals.columns)
    if both:
        raise ValueError(f"points and intervals share the columns {sorted(both)}")
    zoned = {isinstance(df.schema[c].dataType, T.TimestampType) for df, c in ((points, at), (intervals, start), (intervals, end))}
    if len(zoned) > 1:
        raise ValueError("timestamps with and without a zone cannot be compared")
    rows = binned(intervals, start, end)
    sizes = {r[_LEVEL]: r["count"] for r in rows.groupBy(_LEVEL).count().collect()}  # at most 64 rows
    if sum(sizes.values()) <= broadcast_rows(points.sparkSession, ROW_BYTES):
        rows = F.broadcast(rows)
    levels = F.array(*[F.lit(n) for n in sorted(sizes)]).cast("array<int>")
    probes = (
        points.withColumn(_LO, _units(points, at))
        .where(F.col(_LO).isNotNull())
        .withColumn(_LEVEL, F.explode(levels))
        .withColumn(_BIN, F.expr(f"shiftright({_LO}, {_LEVEL})"))
        .drop(_LO)
    )
    when, first, last = (F.col(f"`{c}`") for c in (at, start, end))
    holds = (when >= first) & ((when <= last) if closed == "both" else (when < last))
    return probes.join(rows, [_LEVEL, _BIN]).where(holds).drop(_LEVEL, _BIN)
