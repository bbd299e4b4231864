import zlib

import numpy as np
import pytest

from sightline.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000, 65537])
def test_permutation_is_a_bijection_with_inverse(n):
    places = sharding.permute(np.arange(n), n, 7)
    assert sorted(places.tolist()) == list(range(n))
    assert (sharding.permute(places, n, 7, inverse=True) == np.arange(n)).all()


def test_permutation_depends_on_seed_and_moves_rows():
    a, b = (sharding.permute(np.arange(5000), 5000, s) for s in (1, 2))
    assert (a != b).mean() > 0.99
    assert abs(np.corrcoef(a, np.arange(5000))[0, 1]) < 0.05


def test_place_can_be_computed_both_ways():
    n, shards = 1003, 7
    places = sharding.permute(np.arange(n), n, 3)
    for row in (0, 5, 1002):
        assert sharding.row_at(int(places[row] % shards), int(places[row] // shards), shards, n, 3) == row


def _check_law(rows, shards):
    counts = [sum(r.shard == s for r in rows) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_digest_of_edge_rows(edge_docs, edge_rows):
    rows = sharding.shard_digest(edge_docs, 5, 1).collect()
    assert len(rows) == len(edge_rows)
    _check_law(rows, 5)
    expected = sorted(
        (-1 if d is None else d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in edge_rows
    )
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32) for r in rows) == expected
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}


def test_digest_matches_brute_force(spark, edge_docs):
    """Row numbers, permutation, shard and slot worked out row by row."""
    from pyspark.sql import functions as F

    docs = edge_docs.select("doc_id", "text")
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).collect()
    rows.sort(key=lambda r: ((r.h % (1 << 64)) >> (64 - sharding.BUCKET_BITS), r.h, r.doc_id or -1))
    places = sharding.permute(np.arange(len(rows)), len(rows), 9)
    expected = [
        (str(r.doc_id), len((r.text or "").encode()) + 8, int(p) % 5, int(p) // 5) for r, p in zip(rows, places)
    ]
    got = [(str(r.doc_id), r["size"], r.shard, r.slot) for r in sharding.shard_digest(docs, 5, 9).collect()]
    assert sorted(got) == sorted(expected)


def test_places_do_not_depend_on_files(edge_docs):
    key = lambda r: (r.doc_id or -1, r["size"], r.shard, r.slot)
    a = sorted(map(key, sharding.shard_digest(edge_docs, 5, 1).collect()))
    b = sorted(map(key, sharding.shard_digest(edge_docs.repartition(7), 5, 1).collect()))
    assert a == b


def test_whole_rows_keep_clashing_columns_and_repeats(spark, edge_docs, edge_rows):
    docs = edge_docs.selectExpr("*", "'mine' as shard", "cast(null as int) as SLOT", "1 as _row_key")
    out = sharding.shard_rows(docs, 3)
    assert out.columns == docs.columns + ["shard_1", "slot_1"]
    rows = out.collect()
    assert len(rows) == len(edge_rows)
    assert len({(r.shard_1, r.slot_1) for r in rows}) == len(rows)
    assert sorted(map(repr, (r[:5] for r in rows))) == sorted(repr(tuple(r)) for r in edge_rows)


def test_one_row_repeated_many_times(spark):
    docs = spark.createDataFrame([(1, "same")] * 900 + [(2, "other")], "doc_id bigint, text string")
    rows = sharding.shard_digest(docs, 24).collect()
    assert len(rows) == 901
    _check_law(rows, 24)
    # copies dealt out in ranges get the same places; no array is longer than the range
    place = lambda r: (r.doc_id, r.shard, r.slot)
    ranged = sharding.shard_digest(docs, 24, limit=7)
    assert sorted(map(place, ranged.collect())) == sorted(map(place, rows))
    whole = sharding.shard_rows(docs, 24, limit=7).collect()
    assert sorted((r.doc_id, r.text) for r in whole) == [(1, "same")] * 900 + [(2, "other")]
    _check_law(whole, 24)


def test_empty(no_docs):
    assert sharding.shard_digest(no_docs, 24).count() == 0
    assert sharding.shard_rows(no_docs, 24).columns == no_docs.columns + ["shard", "slot"]
