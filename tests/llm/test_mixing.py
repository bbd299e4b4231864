from collections import defaultdict

import pytest

from sightline.llm import mixing
from tests.llm.conftest import DOC_SCHEMA, plan_of, prose


def brute_targets(sizes: dict) -> dict:
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        w = sum(weight[s] for s in open_)
        share = {s: total * weight[s] / w for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            total -= target[s]
        open_ -= over
        if not open_:
            return target


CASES = [
    {"a": 100, "b": 100, "c": 100},
    {"a": 1000, "b": 1, "c": 3, "é": 50, None: 7},
    {"a": 5},
    {"a": 0, "b": 10, None: 0},
    {"z": 10, "Z": 1000, "m": 10, "n": 400, "o": 2},
]


@pytest.mark.parametrize("sizes", CASES)
def test_targets_match_repeated_resharing(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.source_targets(table).collect()}
    assert got == pytest.approx(brute_targets(sizes), abs=1e-6)


@pytest.fixture(scope="module")
def mixed_docs(spark):
    rows = []
    for i in range(3000):
        source = "hot" if i % 3 == 0 else f"s{i % 7}" if i % 11 else None
        rows.append((i, prose(1 + (i * i) % 97 + (500 if i % 100 == 0 else 0), 1, i), "en", source, 0))
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(4)


def test_sources_come_near_their_targets(mixed_docs):
    rows = mixing.mix_digest(mixed_docs, 5).collect()
    by = defaultdict(lambda: [0, 0, None])
    source = {r.doc_id: r.source for r in mixed_docs.select("doc_id", "source").collect()}
    for r in rows:
        assert r.taken % max(r["size"], 1) == 0 and r.taken <= 2 * r["size"]
        entry = by[source[r.doc_id]]
        entry[0] += r["size"]
        entry[1] += r.taken
        entry[2] = r.target
        assert r.source_size is not None
    assert len(rows) == 3000
    targets = brute_targets({s: e[0] for s, e in by.items()})
    for s, (size, taken, target) in by.items():
        assert target == pytest.approx(targets[s])
        assert abs(taken - target) <= max(0.005 * target, 20), s


def test_reruns_agree_whatever_the_partitions(mixed_docs):
    a = sorted(map(tuple, mixing.mix_digest(mixed_docs, 5).collect()))
    b = sorted(map(tuple, mixing.mix_digest(mixed_docs.repartition(9), 5).collect()))
    assert a == b
    c = sorted(map(tuple, mixing.mix_digest(mixed_docs, 6).collect()))
    assert a != c


def test_copies_are_fair(spark):
    """Over seeds, every document is taken about as often as its share says."""
    docs = spark.createDataFrame(
        [(i, prose(5 + i), "en", "a" if i < 12 else "b", 0) for i in range(20)], DOC_SCHEMA
    )
    total = defaultdict(int)
    for seed in range(12):
        for r in mixing.mix_digest(docs, seed).collect():
            total[r.doc_id] += r.taken / r["size"]
            rate = r.target / r.source_size
            assert int(rate) <= r.taken / r["size"] <= int(rate) + 1
    assert len({round(v) for v in total.values()}) > 1


def test_edge_rows(edge_docs, edge_rows):
    rows = mixing.mix_digest(edge_docs, 1).collect()
    assert len(rows) == len(edge_rows)
    assert sorted(r["size"] for r in rows) == sorted(len((t or "").split()) for _, t, *_ in edge_rows)
    mixed = mixing.mix(edge_docs.selectExpr("*", "1 as _copies", "2 as size", "3 as _row"), 1)
    assert mixed.columns == edge_docs.columns + ["_copies", "size", "_row"]
    words = sum(len((r.text or "").split()) for r in mixed.collect())
    assert abs(words - 1.5 * sum(r["size"] for r in rows)) < 30_000  # within the longest document


def test_one_row_repeated_many_times(spark):
    """Copies dealt out in ranges are taken alike."""
    docs = spark.createDataFrame([(1, "a b c", "s")] * 700 + [(2, "d e", "t"), (3, "f", "s")], "doc_id bigint, text string, source string")
    rows = sorted(map(tuple, mixing.mix_digest(docs, 4).collect()))
    assert len(rows) == 702
    assert sorted(map(tuple, mixing.mix_digest(docs, 4, limit=7).collect())) == rows
    mixed = sorted(map(tuple, mixing.mix(docs, 4).collect()))
    assert sorted(map(tuple, mixing.mix(docs, 4, limit=7).collect())) == mixed
    assert abs(sum(len(t.split()) for _, t, _ in mixed) - sum(r[4] for r in rows)) <= 10  # other draws


def test_only_dataframe_operations(mixed_docs):
    plan = plan_of(mixing.mix_digest(mixed_docs, 5))
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(no_docs):
    assert mixing.mix_digest(no_docs).count() == 0
    assert mixing.mix(no_docs).count() == 0
