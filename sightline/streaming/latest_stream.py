"""Landed records deduplicated across batches in bounded keyed state.

The merge stream (``ingest_stream``) takes the latest copy of an id within a
batch; a better copy in the next batch finds the id held already. Here copies
of an id that land within ``hold`` of each other are one session of a session
window keyed by id: the state keeps the latest of them (by ``created_at``, then
by the other columns, so the order of arrival does not matter), and the
watermark closes the session ``hold`` after its last copy. Then the record is
appended, unless the table holds its id, and its state is dropped. State is
thus bounded by the ids that land within ``hold``, whatever the table holds.

The clock is the time at which a batch is taken, which never runs backwards:
no record is late for the watermark, so none is dropped however old its
``created_at``. The state is kept in RocksDB, on the executors' disks: what
lands within ``hold`` need not fit into their memory. It is compressed in large
blocks, and only its last versions stay in the checkpoint. Records without an
id, which have no key, are not merged; the merge stream's reject table shows
them.

A run that stops when nothing is left would leave the last ``hold`` in state.
``drain`` (on by default for such runs) reads what the state still holds from
the checkpoint and appends that as well; if a later run closes the same
session, the sink finds the id in the table and appends nothing. Ids that are
held once, nearly all, are appended without a shuffle of their records.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators.ingest import dedupe_by_id, new_rows_for_append
from sightline.schema import INGEST_COLUMNS
from sightline.session import Scratch, delete_path, release_shuffles, scratch_path
from sightline.sources.api_pages import flatten_records, page_records
from sightline.streaming.ingest_stream import _read_table, page_stream

HOLD = "10 minutes"
STATE_STORE = "spark.sql.streaming.stateStore"
STATE_CONF = {
    f"{STATE_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STATE_STORE}.rocksdb.boundedMemoryUsage": "true",
    f"{STATE_STORE}.rocksdb.compression": "zstd",
    f"{STATE_STORE}.rocksdb.blockSizeKB": "64",
    f"{STATE_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{STATE_STORE}.compression.codec": "zstd",  # of the changelog
    f"{STATE_STORE}.maintenanceInterval": "10s",
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",  # copies travel once
}
FIELDS = [c for c in INGEST_COLUMNS if c not in ("id", "created_at")]


def _ordered(records: DataFrame) -> tuple[list, list]:
    """The fields of a record in the order in which copies of an id compare
    (one copy in the state, so maps, which do not compare, are kept as JSON),
    and how to get them back from the struct ``latest``."""
    kinds = {f.name: f.dataType for f in records.schema}
    maps = [c for c in FIELDS if kinds[c].typeName() == "map"]
    plain = ["created_at", *(c for c in FIELDS if c not in maps)]
    kept = [*plain, *(F.to_json(c).alias(c) for c in maps)]
    back = [F.col(f"latest.{c}") for c in plain]
    back += [F.from_json(F.col(f"latest.{c}"), kinds[c]).alias(c) for c in maps]
    return kept, back


def latest_copies(records: DataFrame, hold: str = HOLD) -> DataFrame:
    """The latest copy of each id of a stream of flat records, once no copy
    of it has landed for ``hold`` (also works on a batch frame)."""
    kept, back = _ordered(records)
    landed = records.where(F.col("id").isNotNull()).withColumn("landed_at", F.current_timestamp())
    latest = (
        landed.withWatermark("landed_at", "0 seconds")
        .groupBy("id", F.session_window("landed_at", hold).alias("session"))
        .agg(F.max(F.struct(*kept)).alias("latest"))
    )
    return latest.select("id", *back).select(*INGEST_COLUMNS)


def held_copies(records: DataFrame, checkpoint_path: str) -> DataFrame:
    """The copies that the state of a stopped stream of ``records`` still
    holds, read from its checkpoint."""
    _, back = _ordered(records)
    state = records.sparkSession.read.format("statestore").load(checkpoint_path)
    return state.select("value.id", F.col("value.max").alias("latest")).select("id", *back).select(*INGEST_COLUMNS)


def append_new(records: DataFrame, table_path: str, once: bool = False) -> None:
    """Append the records whose ids the table lacks; ``once`` tells that no id
    is repeated among them."""
    spark = records.sparkSession
    release_shuffles(spark)  # those of the batch before
    existing = _read_table(spark, table_path)
    with Scratch(spark) as scratch:
        if existing is None or existing.isEmpty():
            rows = records if once else dedupe_by_id(records)
        else:
            rows = new_rows_for_append(existing, records, scratch, distinct=once)
        rows.write.mode("append").parquet(table_path)


def append_held(records: DataFrame, checkpoint_path: str, table_path: str) -> None:
    """Append what the state of a stopped stream holds."""
    held = held_copies(records, checkpoint_path)
    repeated = held.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    append_new(held, table_path, once=repeated.isEmpty())


def record_stream(
    spark: SparkSession, pages_path: str, max_files_per_trigger: int | None = None, multi_line: bool = False
) -> DataFrame:
    pages = page_stream(spark, pages_path, max_files_per_trigger, multi_line)
    return flatten_records(page_records(pages).select("record")).select(*INGEST_COLUMNS)


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB (one that goes on
    from a checkpoint stays with the store it began with)."""
    before = {key: spark.conf.get(key, None) for key in STATE_CONF}
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def run_latest_stream(
    spark: SparkSession,
    pages_path: str,
    table_path: str,
    checkpoint_path: str | None = None,
    hold: str = HOLD,
    max_files_per_trigger: int | None = None,
    available_now: bool = True,
    drain: bool = True,
    multi_line: bool = False,
):
    """Start the stream. With ``available_now`` it takes every page present,
    stops, and with ``drain`` appends what its state holds; otherwise it keeps
    running and the caller owns the returned query."""
    own = checkpoint_path is None
    checkpoint_path = checkpoint_path or scratch_path(spark, "latest-stream-checkpoint")
    records = record_stream(spark, pages_path, max_files_per_trigger, multi_line)
    writer = (
        latest_copies(records, hold)
        .writeStream.foreachBatch(lambda batch, epoch_id: append_new(batch, table_path))
        .outputMode("append")
        .option("checkpointLocation", checkpoint_path)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    with _state_on_disk(spark):
        query = writer.start()
    if not available_now:
        return query
    query.awaitTermination()
    if drain:
        append_held(records, checkpoint_path, table_path)
        if own:  # nobody else knows it, and all it holds is in the table
            delete_path(spark, checkpoint_path)
    release_shuffles(spark)
    return query
