"""sightline: observation analytics on Spark.

Timestamped observation records (who recorded which taxon, when) are read
from exports or landed API pages, enriched with first-seen dates, and turned
into per-period new / unique / cumulative metrics on a gap-free calendar,
year-over-year views and chart-ready long-form series. Every operator is a
``DataFrame -> DataFrame`` function built from Spark SQL built-ins.
"""

__version__ = "0.1.0"
