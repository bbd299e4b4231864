"""Reproducible shuffle into shards by a Feistel permutation.

Every row gets a global row number 0..N-1 that depends on the rows alone, not
on their files: rows are ordered by the hash of their content. A balanced
Feistel network over the smallest even-bit domain that holds N, with cycle
walking back into 0..N-1, permutes the numbers; position ``p`` goes to shard
``p mod shards`` at slot ``p div shards``. Anyone who knows (N, seed) can
compute the place of a row number, and ``row_at`` inverts it.

Numbers are made without a global sort: rows are counted per hash bucket
(a fixed number of buckets, one small table), each bucket is numbered by a
window, and the bucket's offset is added. Identical rows are counted first
and numbered as a block, so a row that repeats for a third of the table is
one entry; its copies are written out by ranges in many tasks.

Defined cases: null text has size 8 (no bytes) and CRC 0; null doc_ids and
repeated rows are rows like any other and get places of their own; an empty
table gives an empty result; columns that clash with ``shard`` or ``slot``
are kept, the new column gets the next free numbered name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.tables import (
    REPEAT_RANGE,
    ROW,
    ROW_COUNT,
    ROW_ID,
    ROW_KEY,
    distinct_rows,
    free_name,
    keyed_rows,
    materialise,
    repeat_rows,
    same_row,
)

BUCKET_BITS = 12
ROUNDS = 6


def _round_keys(seed: int) -> np.ndarray:
    state = np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _scramble(state ^ np.uint64(seed & 0xFFFFFFFFFFFFFFFF))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def half_bits(n: int) -> int:
    """Bits of each Feistel half: the domain 2**(2b) is the least that holds n."""
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, n: int, seed: int, inverse: bool) -> np.ndarray:
    bits = np.uint64(half_bits(n))
    mask = np.uint64((1 << int(bits)) - 1)
    left, right = x >> bits, x & mask
    keys = _round_keys(seed)
    if inverse:
        for k in keys[::-1]:
            left, right = right ^ (_scramble(left ^ k) & mask), left
    else:
        for k in keys:
            left, right = right, left ^ (_scramble(right ^ k) & mask)
    return (left << bits) | right


def permute(numbers: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """Feistel permutation of 0..n-1 with cycle walking (or its inverse)."""
    out = np.asarray(numbers).astype(np.uint64)
    out = _network(out, n, seed, inverse)
    while (outside := np.flatnonzero(out >= np.uint64(n))).size:
        out[outside] = _network(out[outside], n, seed, inverse)
    return out.astype(np.int64)


def row_at(shard: int, slot: int, shards: int, n: int, seed: int) -> int:
    """The row number stored at a place."""
    return int(permute(np.array([slot * shards + shard]), n, seed, inverse=True)[0])


def position(number: Column, n: int, seed: int) -> Column:
    """Permuted position of a row-number column."""

    @F.pandas_udf("long")
    def place(values: pd.Series) -> pd.Series:
        return pd.Series(permute(values.to_numpy(), n, seed))

    return place(number)


def first_numbers(units: DataFrame) -> tuple[DataFrame, int, int]:
    """Add ``first_number`` to a table of distinct rows with multiplicities,
    so that the rows tile 0..N-1; also returns N and the largest multiplicity.

    ``units`` is read twice (bucket counts, then the numbering), so it should
    be a written table.
    """
    bucketed = units.withColumn("_bucket", F.shiftrightunsigned(F.col(ROW_KEY), 64 - BUCKET_BITS))
    counts = bucketed.groupBy("_bucket").agg(F.sum(ROW_COUNT).alias("_n"), F.max(ROW_COUNT).alias("_most"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"), "_n", "_most")
    offsets, _ = materialise(offsets, "shard-offsets")
    total, most = offsets.agg(F.sum("_n"), F.max("_most")).first()
    inside = Window.partitionBy("_bucket").orderBy(ROW_KEY, F.col(ROW_ID).asc_nulls_first())
    running = F.sum(ROW_COUNT).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    numbered = (
        bucketed.withColumn("_running", running)
        # at most 2**BUCKET_BITS rows, whatever the table holds
        .join(F.broadcast(offsets.drop("_n", "_most")), "_bucket")
        .withColumn("first_number", F.col("_offset") + F.col("_running") - F.col(ROW_COUNT))
        .drop("_bucket", "_offset", "_running")
    )
    return numbered, int(total or 0), int(most or 0)


def _places(numbered: DataFrame, total: int, most: int, shards: int, seed: int, limit: int) -> DataFrame:
    """Each row of each unit with its ``_shard`` and ``_slot``."""
    if most > limit:  # then it is read twice
        numbered, _ = materialise(numbered, "shard-numbered")
    return (
        repeat_rows(numbered, ROW_COUNT, "_copy", most, limit)
        .withColumn("_position", position(F.col("first_number") + F.col("_copy"), max(total, 1), seed))
        .withColumn("_shard", (F.col("_position") % shards).cast("int"))
        .withColumn("_slot", F.expr(f"_position div {int(shards)}"))
    )


def shard_rows(df: DataFrame, shards: int, seed: int = 0, limit: int = REPEAT_RANGE) -> DataFrame:
    """All columns of ``df`` plus ``shard`` and ``slot``; counts per shard
    differ by at most one. ``df`` needs a ``doc_id`` column."""
    keyed = keyed_rows(df)
    units, _ = materialise(
        keyed.groupBy(ROW_KEY, ROW_ID).agg(F.count(F.lit(1)).alias(ROW_COUNT)), "shard-units"
    )
    numbered, total, most = first_numbers(units)
    rows = distinct_rows(keyed).drop(ROW_COUNT).alias("r").join(numbered.alias("u"), same_row("r", "u"))
    placed = _places(rows.select(f"r.{ROW}", f"u.{ROW_COUNT}", "u.first_number"), total, most, shards, seed, limit)
    return placed.select(
        f"{ROW}.*",
        F.col("_shard").alias(free_name(df.columns, "shard")),
        F.col("_slot").alias(free_name(df.columns, "slot")),
    )


def shard_digest(documents: DataFrame, shards: int, seed: int = 0, limit: int = REPEAT_RANGE) -> DataFrame:
    """doc_id, size, CRC, shard and slot of every document; only the keys are
    shuffled, never the texts."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    size = (F.octet_length(raw) + F.lit(8)).cast("long")
    keyed = documents.select(
        F.xxhash64("doc_id", "text").alias(ROW_KEY),
        F.col("doc_id").alias(ROW_ID),
        F.struct(size.alias("size"), F.crc32(raw).alias("crc")).alias(ROW),
    )
    units, _ = materialise(distinct_rows(keyed), "shard-units")
    numbered, total, most = first_numbers(units)
    return _places(numbered, total, most, shards, seed, limit).select(
        F.col(ROW_ID).alias("doc_id"),
        F.col(f"{ROW}.size").alias("size"),
        F.col(f"{ROW}.crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
