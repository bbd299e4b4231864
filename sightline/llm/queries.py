"""Registered queries of the subpackage: each operator over its whole table
with its production parameters, reduced to the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import (
    decontam, fingerprints, langid, merkle, mixing, pii, quality, sharding, simhash, suffix_dedup, toxicity, warc, whitening,
)
from sightline.llm.tables import materialise, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SEED = 20240613
SHARDS = 24


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return deco


@register("op1_quality_rules")
def op1_quality_rules(spark, sf_dir):
    documents, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality.quality_digest(documents, labels)


@register("op2_decontamination")
def op2_decontamination(spark, sf_dir):
    documents, benchmark = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return decontam.contamination_digest(documents, benchmark)


@register("op3_pii")
def op3_pii(spark, sf_dir):
    return pii.pii_digest(read_table(spark, sf_dir, "documents"))


@register("op4_warc")
def op4_warc(spark, sf_dir):
    """Writes the archives, then reads every record back."""
    bundles, _ = materialise(warc.bundles(read_table(spark, sf_dir, "pages")), "warc-bundles", **warc.TABLE_OPTIONS)
    return warc.read_all(bundles, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op5_sharding")
def op5_sharding(spark, sf_dir):
    return sharding.shard_digest(read_table(spark, sf_dir, "documents"), SHARDS, SEED)


@register("op6_simhash")
def op6_simhash(spark, sf_dir):
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@register("op7_suffix_dedup")
def op7_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup_digest(read_table(spark, sf_dir, "documents"))


@register("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    documents, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return toxicity.toxicity_digest(documents, labels)


@register("op9_language_id")
def op9_language_id(spark, sf_dir):
    return langid.language_digest(read_table(spark, sf_dir, "documents"))


@register("op10_mixing")
def op10_mixing(spark, sf_dir):
    return mixing.mix_digest(read_table(spark, sf_dir, "documents"), SEED)


@register("op11_whitening")
def op11_whitening(spark, sf_dir):
    return whitening.whitening_digest(read_table(spark, sf_dir, "embeddings"))


@register("op12_fingerprints")
def op12_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_digest(read_table(spark, sf_dir, "documents"))


@register("op13_merkle")
def op13_merkle(spark, sf_dir):
    return merkle.manifest_digest(read_table(spark, sf_dir, "documents"))
