"""Corpus pipeline: five stages over ``documents``, each written and read again.

Each stage works on all rows its predecessor kept and returns the columns of
``documents``; the last adds ``shard`` and ``slot`` (under the next free name
where the table has such columns). Its other columns may have any name and type.

Defined cases, stage by stage:

=================  ==========================================================
language           a null text, or one without a letter, goes; a null ``lang``
                   is not learned from; with no labelled row every text goes
near copies        null, empty and wordless texts are copies of one another;
                   of a group the smallest doc_id stays (null last), of rows
                   that share it the one with the smallest row hash, so
                   repeated rows become one
decontamination    a null or empty text holds no benchmark words and stays; so
                   does every text if the benchmark is empty
mixing             a null ``source`` is a source; a text without words counts
                   nothing and is drawn like the others; repeated rows are
                   taken one by one
sharding           every row, also a repeated one, gets a place of its own
=================  ==========================================================

Very long texts are read whole everywhere; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import decontam, langid, mixing, sharding, simhash
from sightline.llm.queries import SEED, SHARDS
from sightline.llm.tables import materialise, read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts in no learned language (see
    ``langid``: their n-grams are much rarer than in any text learned from)."""
    return langid.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group of
    SimHash-linked documents (four-word shingles, four bits)."""
    return simhash.keep_one(docs, simhash.DISTANCE, simhash.SHINGLE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source takes it."""
    return mixing.mix(docs, SEED)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``shard`` and ``slot`` of a reproducible shuffle."""
    return sharding.shard_rows(docs, SHARDS, SEED)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# Trained, hashed and randomised stages cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
