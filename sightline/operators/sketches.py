"""Approximate distinct counts that can be merged.

A distinct count of a month cannot be had from those of its days; a sketch
can. ``daily_sketches`` reduces the observations to one HLL sketch per day and
metric (bounded by ``2**lg_k`` bytes however many entities a day has), and
``rollup_uniques`` unites them to any grain. Sketches of overlapping or
repeated batches may be united too: an entity counts once.

The relative standard error of a sketch is about ``1.04 / sqrt(2**lg_k)``
(0.8 % at the default); small sets are counted almost exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.calendar import PERIOD_COLUMNS, check_grain, period_start
from sightline.operators.period_metrics import METRICS, _check

LG_K = 14


def standard_error(lg_k: int = LG_K) -> float:
    return 1.04 / math.sqrt(2**lg_k)


def daily_sketches(
    obs: DataFrame, metrics: Iterable[str] = tuple(METRICS), date_col: str = "observed_on", lg_k: int = LG_K
) -> DataFrame:
    """``day`` and a ``<metric>_sketch`` of the entities seen on it. Each task
    sends one sketch per day, not its entities."""
    sketches = [
        F.hll_sketch_agg(F.col(METRICS[m][0]).cast("long"), lg_k).alias(f"{m}_sketch") for m in _check(metrics)
    ]
    return obs.where(F.col(date_col).isNotNull()).groupBy(F.col(date_col).alias("day")).agg(*sketches)


def rollup_uniques(sketches: DataFrame, grain: str = "month") -> DataFrame:
    """Estimated ``unique_X`` per period with data."""
    pcol, _ = PERIOD_COLUMNS[check_grain(grain)]
    metrics = [c.removesuffix("_sketch") for c in sketches.columns if c.endswith("_sketch")]
    united = [F.hll_sketch_estimate(F.hll_union_agg(f"{m}_sketch")).alias(f"unique_{m}") for m in metrics]
    return sketches.groupBy(period_start(F.col("day"), grain).alias(pcol)).agg(*united)
