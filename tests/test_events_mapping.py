"""The second fixture mapping (events table): dense daily metrics checked
against a pandas brute force, and the insert-only merge of overlapping
halves with re-sent records."""

import datetime as dt
import zlib

import pandas as pd
from pyspark.sql import functions as F

from sightline.operators import ingest
from sightline.operators import period_metrics as pm
from sightline.sources import driver_tables
from tests.conftest import SMOKE_DIR


def test_daily_metrics_on_dense_events(spark):
    obs = driver_tables.event_observations(spark, SMOKE_DIR)
    ev = pd.read_parquet(f"{SMOKE_DIR}/events.parquet")
    ev["day"] = ev["ts"].dt.date
    got = pm.period_summary(obs, grain="day", as_of="2024-12-31", start="2024-01-01", end="2024-12-31")
    rows = {r.date: r for r in got.collect()}
    assert len(rows) == 366  # leap year, every day present
    first_user = ev.groupby("user_id")["day"].min()
    first_type = ev.groupby("event_type")["day"].min()
    cum_users = cum_obs = 0
    for day in sorted(rows):
        r = rows[day]
        in_day = ev[ev["day"] == day]
        assert r.unique_users == in_day["user_id"].nunique()
        assert r.unique_observations == in_day["event_id"].nunique()
        assert r.unique_species == in_day["event_type"].nunique()
        cum_users += int((first_user == day).sum())
        cum_obs += in_day["event_id"].nunique()
        assert (r.new_users, r.cumulative_users, r.cumulative_observations) == (
            int((first_user == day).sum()), cum_users, cum_obs)
        assert r.new_species == int((first_type == day).sum())
    assert rows[dt.date(2024, 12, 31)].cumulative_users == ev["user_id"].nunique()
    taxa = {r.taxon_id for r in obs.select("taxon_id").distinct().collect()}
    assert taxa == {zlib.crc32(t.encode()) for t in ev["event_type"].unique()}


def test_merge_of_overlapping_halves(spark):
    obs = driver_tables.event_observations(spark, SMOKE_DIR)
    n = obs.count()
    overlap = 25
    table = obs.where(F.col("id") < n // 2 + overlap)
    batch = obs.where(F.col("id") >= n // 2)
    resent = batch.where(F.col("id") >= n - overlap)  # the last records arrive twice
    merged = ingest.merge_insert_only(table, batch.unionByName(resent))
    assert merged.count() == n
    assert merged.select("id").distinct().count() == n
    again = ingest.merge_insert_only(merged, batch)
    assert again.count() == n
