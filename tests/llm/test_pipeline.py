import corpus_pipeline
import pytest

import __spark_entry__ as entry
from sightline.llm import decontam, langid, simhash
from sightline.llm.oracle import ORACLE
from sightline.llm.queries import QUERIES
from tests.conftest import SMOKE_DIR
from tests.llm.test_classifiers import FOREIGN
from tests.llm.test_mixing import brute_targets


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage, the stages run one after the other."""
    docs, out = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet"), []
    out.append(docs.toPandas())
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SMOKE_DIR).toPandas())
        out.append(docs.toPandas())
    return out


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_columns(stages):
    for frame in stages[:-1]:
        assert list(frame.columns) == COLUMNS
    assert list(stages[-1].columns) == [*COLUMNS, "shard", "slot"]


def test_language_stage(spark, stages):
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out()))
    seen = langid.identify(docs, model).collect()
    expected = {r.doc_id for r in seen if r.lang_pred != "und" and r.familiarity >= model.least_familiar}
    assert set(stages[1].doc_id) == expected and len(expected) > 190


def test_language_stage_rejects_what_was_never_learned(spark):
    docs = spark.read.parquet(SMOKE_DIR.replace("0.001", "0.01") + "/documents.parquet")
    foreign = [(10**6 + i, t, None, "s", len(t)) for i, t in enumerate(FOREIGN)]
    more = docs.unionByName(spark.createDataFrame(foreign, docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, more, SMOKE_DIR).select("doc_id").collect()}
    assert not kept & {d for d, *_ in foreign}
    lettered = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert len(lettered - kept) <= 0.002 * len(lettered)


def test_stages_on_edge_rows(spark, edge_docs, edge_rows, no_docs):
    """Nulls, empty and long texts, repeated rows, odd columns, no rows."""
    odd = edge_docs.selectExpr("*", "named_struct('a b', 1) as `x ``y`", "map(1, 2) as m", "0.5 as score", "'s' as shard")
    frame = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, SMOKE_DIR)
        extra = ["shard_1", "slot"] if name == "sharding" else []
        assert out.columns == odd.columns + extra, name
        rows = out.collect()
        assert rows or not frame.count(), name
        frame = spark.createDataFrame(rows, out.schema)
    assert {r["x `y"]["a b"] for r in rows} == {1}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SMOKE_DIR).count() == 0, name


def test_near_copy_stage(spark, stages):
    ids = simhash.near_duplicates(spark.createDataFrame(stages[1])).toPandas()
    assert set(stages[2].doc_id) == set(ids.component_id)
    assert len(stages[2]) == ids.component_id.nunique() < len(stages[1])


def test_decontamination_stage(spark, stages):
    items = spark.read.parquet(f"{SMOKE_DIR}/benchmark.parquet")
    verdict = decontam.contamination_digest(spark.createDataFrame(stages[2]), items).toPandas()
    assert set(stages[3].doc_id) == set(verdict[~verdict.contaminated].doc_id)
    assert verdict.contaminated.any()


def test_mixing_stage(stages):
    words = lambda f: f.assign(n=f.text.str.encode("utf-8").map(lambda b: len(b.split()))).groupby("source").n
    before, after = words(stages[3]), words(stages[4]).sum()
    for source, target in brute_targets(before.sum().to_dict()).items():
        # ten documents a source: within the last open one
        assert abs(after.get(source, 0) - target) < before.max()[source]
    assert stages[4].groupby("doc_id").size().max() <= 2
    assert set(stages[4].doc_id) <= set(stages[3].doc_id)


def test_sharding_stage(stages):
    last = stages[5]
    assert sorted(last[COLUMNS].map(str).agg("|".join, axis=1)) == sorted(stages[4].map(str).agg("|".join, axis=1))
    counts = last.groupby("shard").size()
    assert counts.max() - counts.min() <= 1
    for _, own in last.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))


def test_run_applies_all_stages(spark, stages):
    got = corpus_pipeline.run(spark, SMOKE_DIR)
    assert got.columns == [*COLUMNS, "shard", "slot"]
    assert sorted(got.toPandas().doc_id) == sorted(stages[5].doc_id)


def test_registered():
    names = set(entry.queries())
    assert set(QUERIES) | {"pipeline"} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES) and set(ORACLE) <= set(entry.oracle_sql())
