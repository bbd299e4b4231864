"""Hand-made micro fixtures (typed raw observations)."""

import datetime as dt

from sightline.schema import RAW_OBSERVATION


def D(s):
    return dt.date.fromisoformat(s)


def T(s):
    return dt.datetime.fromisoformat(s)


def obs_rows(rows):
    """rows: (id, observed_on, user_id, taxon_id, scientific_name, common_name[, created_at])."""
    out = []
    for r in rows:
        rid, day, user, taxon, sci, common = r[:6]
        created = r[6] if len(r) > 6 else (T(day + " 12:00:00") if day else None)
        out.append(
            (rid, None, D(day) if day else None, None, user, created, sci, common, taxon, "Plantae", sci)
        )
    return out


def make_obs(spark, rows):
    return spark.createDataFrame(obs_rows(rows), RAW_OBSERVATION)


# Boundary weeks around New Year, leap days, null keys, repeated ids.
BOUNDARY = [
    (1, "2018-12-30", 10, 100, "Red Plate", "a"),
    (2, "2018-12-31", 11, 100, "Red Plate", "a"),
    (3, "2019-01-01", 10, 101, "old rod", "b"),
    (4, "2019-12-30", 12, 102, "old rod", "b"),
    (5, "2020-02-29", 13, 100, "Red Plate", "a"),
    (6, "2020-12-31", None, 103, "x", "c"),
    (7, "2024-02-29", 14, None, None, None),
    (8, "2024-12-30", 10, 100, "Red Plate", "a"),
    (9, "2025-12-29", 15, 104, "y", "d"),
    (9, "2025-12-29", 15, 104, "y", "d"),  # same id twice
    (10, "2025-12-31", 16, 105, "y", "d"),
    (11, None, 17, 106, "z", "e"),  # no date
]
