"""Labelled texts, all or a bounded sample, for fitting classifiers."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.session import broadcast_rows

SAMPLE_CHARS = 200_000
LABEL_BYTES = 48  # an id and its label in a broadcast hash relation


def remainder(column: str, parts: int) -> Column:
    """crc32 of the value as text, modulo ``parts`` (null: the empty text)."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % parts


def smallest_hashes(df: DataFrame, rows: int, total: int, name: str = "h") -> DataFrame:
    """The ``rows`` rows with the smallest value of the hash column ``name``,
    ties by the other columns. Rows far above the expected cut are dropped
    where they are read, so about ``rows`` rows, not ``rows`` from every task,
    travel. ``total`` is the number of rows of ``df``."""
    share = min(1.0, (1.2 * rows + 200) / max(total, 1))
    place = F.shiftrightunsigned(F.col(name), 11) * F.lit(2.0**-53)
    near = df if share >= 1 else df.where(place < share)
    # unsigned order, so that the cut above and the order agree
    order = [place, *[F.col(c) for c in df.columns if c != name]]
    return near.orderBy(*order).limit(rows)


def sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int) -> list:
    """Rows (t text, y label, l lang) of at most ``per_class`` documents of
    each class, those whose id has the smallest hash. The ids are chosen from
    the labels alone, so no text is shuffled; whole texts are read, texts of
    over ``SAMPLE_CHARS`` characters are not learned from. Of several labels
    of one document the largest counts; rows with a null label, id or text are
    not learned from."""
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .select("doc_id", "y", F.xxhash64("doc_id").alias("h"))
    )
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = [smallest_hashes(known.where(F.col("y") == y), per_class, n) for y, n in sorted(totals.items())]
    if not chosen:
        return []
    ids = functools.reduce(DataFrame.unionByName, chosen)
    lang = F.col("lang") if "lang" in documents.columns else F.lit(None).cast("string")
    texts = documents.where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).select(
        "doc_id", F.col("text").alias("t"), lang.alias("l")
    )
    # at most 2 * per_class ids; repeated rows of a document count once
    joined = texts.join(F.broadcast(ids), "doc_id").groupBy("h", "doc_id", "y").agg(F.min(F.struct("t", "l")).alias("d"))
    return joined.orderBy("h", "doc_id").select("d.t", "y", "d.l").collect()


def labelled_texts(documents: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Every labelled document: t text (as bytes), y label, l lang and h, a
    hash of its id. Of several labels of one document the largest counts,
    repeated rows of a document count once; rows with a null label, id or text
    are left out. Ids within ``broadcast_rows`` are broadcast, so that no
    other text is shuffled."""
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    if known.count() <= broadcast_rows(known.sparkSession, LABEL_BYTES):
        known = F.broadcast(known)
    lang = F.col("lang") if "lang" in documents.columns else F.lit(None).cast("string")
    texts = documents.where("text is not null").select("doc_id", F.struct(F.col("text").alias("t"), lang.alias("l")).alias("d"))
    once = texts.join(known, "doc_id").groupBy("doc_id", "y").agg(F.min("d").alias("d"))
    return once.select(F.xxhash64("doc_id").alias("h"), F.col("d.t").cast("binary").alias("t"), "y", "d.l")
