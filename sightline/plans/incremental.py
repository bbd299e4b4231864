"""Batch incremental ingest: landed pages -> insert-only merge into a table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from sightline.operators.ingest import BACKFILL_START, incremental_start
from sightline.plans.metric_store import MetricStore
from sightline.session import checkpoint_root, delete_path
from sightline.streaming.ingest_stream import MergeCounts, batch_folder, batch_name, merge_pages, page_stream


def ingest_pages(
    spark: SparkSession,
    pages_path: str,
    table: str,
    table_path: str | None = None,
    backfill: bool = False,
    backfill_start: dt.datetime = BACKFILL_START,
    *,
    checkpoint_path: str | None = None,
    rejects_path: str | None = None,
    most_unreadable: float = 0.0,
    multi_line: bool = False,
    outside: str = "append",
    counts: MergeCounts | None = None,
    metrics: MetricStore | None = None,
) -> int:
    """Append the records of newly landed pages whose ids ``table`` lacks.

    Pages are taken as a file stream that runs until nothing is left: its
    checkpoint remembers the files, so a run reads the files landed since the
    last one and a run over an unchanged folder reads none. A backfill, or a
    table that does not exist yet, starts a new checkpoint and reads them all.

    The files are the increment: every record of a newly landed file whose id
    is new is appended, however old it is. Records created more than a day
    before the newest one held when the run started (or before the backfill
    date) count as late, those without a readable ``created_at`` as undated;
    with ``outside="reject"`` both go to the reject table instead. Only new
    rows are appended: the table is never overwritten while it is being read.
    Returns the number of rows appended; ``counts`` also receives pages,
    unreadable pages, pages with gaps in their ids, and records without id,
    late and undated. The caller's session sees the appended rows.

    With ``metrics`` the metric store takes each batch's new records, so that
    its tables follow the table without reading it; a batch that fails half
    way is taken once.
    """
    exists = spark.catalog.tableExists(table)
    if exists:
        spark.catalog.refreshTable(table)  # another session may have appended to it
    start = incremental_start(
        spark.table(table) if exists else None, backfill=backfill or not exists, default=backfill_start
    )
    start_at = start.first()["start_at"]
    checkpoint_path = checkpoint_path or f"{checkpoint_root(spark)}/sightline-ingest/{table}"
    if backfill or not exists:
        delete_path(spark, checkpoint_path)
    counts = counts or MergeCounts()

    def append(new: DataFrame) -> None:
        writer = new.write.format("parquet")
        if new.sparkSession.catalog.tableExists(table):
            writer.mode("append").saveAsTable(table)
        else:
            if table_path:
                writer = writer.option("path", table_path)
            writer.mode("overwrite").saveAsTable(table)

    def merge(batch: DataFrame, epoch_id: int) -> None:
        own = batch.sparkSession
        stage, on_new = None, None
        if metrics is not None:
            name = batch_name(own, checkpoint_path, epoch_id)
            stage = f"{metrics.root}/staged/{name}"
            # the batch before this one is committed
            delete_path(own, f"{metrics.root}/staged/{batch_name(own, checkpoint_path, epoch_id - 1)}")
            store = MetricStore(own, metrics.root, metrics.grains, metrics.tracked)
            on_new = lambda new: store.apply_increment(new, name)
        existing = own.table(table) if own.catalog.tableExists(table) else None
        merge_pages(
            batch,
            existing,
            append,
            counts,
            start_at=start_at,
            outside=outside,
            rejects_path=batch_folder(own, rejects_path, checkpoint_path, epoch_id),
            most_unreadable=most_unreadable,
            stage_path=stage,
            on_new=on_new,
        )

    query = (
        page_stream(spark, pages_path, multi_line=multi_line)
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    finally:
        # batches append in the stream's own session
        if spark.catalog.tableExists(table):
            spark.catalog.refreshTable(table)
    return counts.appended
