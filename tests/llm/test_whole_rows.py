"""Whole-row operators keep columns of any name and type."""

import pytest

from sightline.llm import decontam, fingerprints, langid, mixing, pii, quality, sharding, simhash, toxicity
from tests.llm.conftest import prose

ODD = [
    "named_struct('a b', 1, 'c`d', map('k', array(1, 2))) as `one two`", "map('x', 1) as `tick``tick`",
    "array(map(coalesce(doc_id, 0), 'v')) as `dot.name`", "'s' as score", "1 as _row_key", "parse_json('{\"a\": 1}') as v",
]


@pytest.fixture(scope="module")
def odd_docs(edge_docs):
    return edge_docs.selectExpr("*", *ODD)


def labelled(spark):
    rows = [(i, i % 2, i % 2) for i in range(10)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


OPERATORS = {
    "language": lambda d, s: langid.identify(d.drop("v"), langid.train(d)),
    "quality": lambda d, s: quality.judge(d.drop("v"), quality.train(d, labelled(s))),
    "personal data": lambda d, s: pii.find(d.drop("v"), pii.train(d)),
    "toxicity": lambda d, s: toxicity.score_documents(d.drop("v"), toxicity.train(d, labelled(s))),
    "fingerprints": lambda d, s: fingerprints.with_fingerprint(d.drop("v")),
    "sharding": lambda d, s: sharding.shard_rows(d, 3),
    "clean": lambda d, s: decontam.clean(d, s.createDataFrame([(1, "no such words")], "item_id bigint, text string")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_and_column_is_kept(spark, odd_docs, edge_rows, name):
    out = OPERATORS[name](odd_docs, spark)
    kept = [c for c in odd_docs.columns if c != "v" or name in ("sharding", "clean")]
    assert out.columns[: len(kept)] == kept
    rows = [tuple(r)[: len(kept)] for r in out.collect()]
    want = [tuple(r)[: len(kept)] for r in odd_docs.select(*[f"`{c.replace('`', '``')}`" for c in kept]).collect()]
    key = lambda r: repr(r[:5])
    assert sorted(map(key, rows)) == sorted(map(key, want)) and len(rows) == len(edge_rows)
    assert {repr(r[5]) for r in rows} == {repr(r[5]) for r in want}


def test_selecting_operators_keep_columns(spark, odd_docs):
    for out in (simhash.keep_one(odd_docs), mixing.mix(odd_docs, 1)):
        assert out.columns == odd_docs.columns
        assert {r["one two"]["c`d"]["k"][1] for r in out.collect()} == {2}


def test_rows_that_differ_in_a_map_are_different_rows(spark):
    df = spark.createDataFrame([(1, prose(9))] * 3, "doc_id bigint, text string").selectExpr("*", "map('a', 1) as m")
    df = df.unionByName(df.limit(1).selectExpr("doc_id", "text", "map('a', 2) as m"))
    rows = sharding.shard_rows(df, 2).collect()
    assert sorted(r.m["a"] for r in rows) == [1, 1, 1, 2] and len({(r.shard, r.slot) for r in rows}) == 4
