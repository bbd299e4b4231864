"""Explicit schemas for every table sightline reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns an observation export must carry, in the
# export's own order.
REQUIRED_EXPORT_COLUMNS = (
    "id",
    "uuid",
    "observed_on",
    "time_observed_at",
    "user_id",
    "created_at",
    "scientific_name",
    "common_name",
    "taxon_id",
    "taxon_kingdom_name",
    "taxon_species_name",
)

# Typed form of one export row (the "raw observation").
RAW_OBSERVATION = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("uuid", T.StringType()),
        T.StructField("observed_on", T.DateType()),
        T.StructField("time_observed_at", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("scientific_name", T.StringType()),
        T.StructField("common_name", T.StringType()),
        T.StructField("taxon_id", T.LongType()),
        T.StructField("taxon_kingdom_name", T.StringType()),
        T.StructField("taxon_species_name", T.StringType()),
    ]
)

# Enriched fact: observation plus first-seen dates per user and per taxon.
OBSERVATION_FACT_COLUMNS = (
    "observed_date",
    "observed_week",
    "time_observed_at",
    "id",
    "taxon_id",
    "user_id",
    "common_name",
    "scientific_name",
    "first_taxon_date",
    "first_taxon_week",
    "first_user_date",
    "first_user_week",
)

# One observation record as returned inside an API page.
API_RECORD = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("uuid", T.StringType()),
        T.StructField("observed_on", T.StringType()),
        T.StructField("time_observed_at", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("location", T.StringType()),
        # any geometry, kept as its JSON text
        T.StructField("geojson", T.StringType()),
        T.StructField("created_at_details", T.MapType(T.StringType(), T.StringType())),
        T.StructField("place_guess", T.StringType()),
        T.StructField("quality_grade", T.StringType()),
        T.StructField("spam", T.BooleanType()),
        T.StructField("hidden", T.BooleanType()),
        T.StructField("user", T.StructType([T.StructField("id", T.LongType())])),
        T.StructField(
            "taxon",
            T.StructType(
                [
                    T.StructField("id", T.LongType()),
                    T.StructField("name", T.StringType()),
                    T.StructField("preferred_common_name", T.StringType()),
                    T.StructField("iconic_taxon_name", T.StringType()),
                    T.StructField("rank", T.StringType()),
                    T.StructField("wikipedia_url", T.StringType()),
                    T.StructField(
                        "conservation_status",
                        T.StructType([T.StructField("status_name", T.StringType())]),
                    ),
                ]
            ),
        ),
    ]
)

# A landed API response page.
API_PAGE = T.StructType(
    [
        T.StructField("total_results", T.LongType()),
        T.StructField("page", T.LongType()),
        T.StructField("per_page", T.LongType()),
        T.StructField("results", T.ArrayType(API_RECORD)),
    ]
)

# The flat, typed ingest row (one per API record).
INGEST_COLUMNS = (
    "id",
    "observed_on",
    "time_observed_at",
    "taxon_id",
    "user_id",
    "common_name",
    "created_at",
    "location",
    "species_name",
    "geojson",
    "uuid",
    "scientific_name",
    "taxon_kingdom_name",
    "wikipedia_url",
    "status_name",
    "category",
    "spam",
    "hidden",
    "created_at_details",
    "place_guess",
    "quality_grade",
)

def _head(period: str, label: str) -> list[T.StructField]:
    return [
        T.StructField(period, T.DateType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("start_of_year", T.DateType()),
        T.StructField(label, T.IntegerType()),
    ]


def _counts(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


_HEADS = {
    "day": _head("date", "day_of_year"),
    "week": _head("week", "week_number"),
    "month": _head("month", "month_number"),
    "quarter": _head("quarter", "quarter_number"),
    "year": _head("year_start", "year_number"),
}
_MEASURES = {
    "users": ("new_users", "unique_users", "cumulative_users"),
    "species": ("new_species", "unique_species", "cumulative_species"),
    "observations": ("unique_observations", "cumulative_observations"),
}

# Metric tables as written by the metric build (read back with these).
METRIC_SCHEMAS = {
    (grain, metric): T.StructType(head + _counts(*names))
    for grain, head in _HEADS.items()
    for metric, names in _MEASURES.items()
} | {
    ("week", "by_species"): T.StructType(
        [
            T.StructField("taxon_id", T.LongType()),
            T.StructField("scientific_name", T.StringType()),
            T.StructField("common_name", T.StringType()),
        ]
        + _HEADS["week"]
        + _counts("observations", "cumulative_observations")
    ),
}

EVENT = T.StructType(
    [
        T.StructField("event", T.StringType()),
        T.StructField("start_date", T.DateType()),
        T.StructField("end_date", T.DateType()),
    ]
)
