import pickle
import random

import duckdb
import numpy as np
import pytest

from sightline.llm import decontam
from sightline.llm.oracle import ORACLE
from tests.conftest import SMOKE_DIR
from tests.llm.conftest import prose
from tools.oracle_check import digest

ITEMS = [
    (1, "alpha beta gamma delta"),
    (1, "second text of the same item"),
    (2, prose(25, 1, 4)),
    (3, None),
    (4, "!!! ..."),
    (None, "null item words"),
    (10, "É Ünï wörd"),
    (5, "alpha"),
]


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


@pytest.fixture(scope="module")
def contaminated(spark, edge_rows):
    extra = [
        (20, "say ALPHA, Beta-gamma delta!", "en", "a", 0),
        (21, "alpha beta gamma x delta", "en", "a", 0),
        (22, "und É Ünï Wörd.", "de", "a", 0),
        (23, "the null item words are here", "en", "a", 0),
        (24, prose(12, 1, 6) + " " + prose(30, 1, 2), "en", "a", 0),
        (25, "alpha beta gamma", "en", "a", 0),
    ]
    rows = edge_rows + extra
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def oracle(documents, benchmark):
    con = duckdb.connect()
    con.register("documents", documents.toPandas())
    con.register("benchmark", benchmark.toPandas().astype({"item_id": "Int64"}))
    res = con.execute(ORACLE["op2_decontamination"])
    return [c[0] for c in res.description], res.fetchall()


def test_digest_matches_sql(contaminated, benchmark):
    docs = contaminated.selectExpr("*", "'x' as segment", "1 as n_words")
    got = decontam.contamination_digest(docs.repartition(3), benchmark)
    cols, rows = oracle(contaminated, benchmark)
    assert digest(got.columns, [tuple(r) for r in got.collect()])[1] == digest(cols, rows)[1]
    assert {r[0] for r in rows if r[cols.index("contaminated")]} >= {20, 21, 22, 23, 24, 25}


def test_routed_pieces_give_the_same(contaminated, benchmark, monkeypatch):
    whole = sorted(map(repr, decontam.contamination_digest(contaminated, benchmark).collect()))
    monkeypatch.setattr(decontam.matches, "__defaults__", (decontam.WINDOW, 0, 0))
    monkeypatch.setattr(decontam, "match", None)
    for width in (64, 3):
        monkeypatch.setattr(decontam, "PIECE_WINDOWS", width)
        routed = decontam.contamination_digest(contaminated.repartition(3), benchmark)
        assert whole == sorted(map(repr, routed.collect()))


def test_pieces_go_only_where_their_rarest_terms_are(spark, monkeypatch):
    docs = [(i, f"common words number{i} follow here") for i in range(40)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(8, "doc_id")
    items = [(i, f"common words number{i}") for i in range(0, 80, 2)] + [(100, "common words")]
    items = spark.createDataFrame(items, "item_id bigint, text string")
    index, pieces = decontam.build_index(docs), decontam.benchmark_pieces(items, 3)
    n_segments = index.count()
    sent = decontam.routes(index, pieces).join(pieces, "piece").groupBy("item_id").count()
    by_item = {r["item_id"]: r["count"] for r in sent.collect()}
    assert by_item == {i: 1 for i in range(0, 40, 2)} | {100: n_segments} and n_segments > 3


def test_clean_keeps_the_other_rows(contaminated, benchmark, edge_rows):
    docs = contaminated.selectExpr("*", "'x' as _row_key", "1 as segment")
    bad = {repr((r.doc_id, r.n_words)) for r in decontam.contamination_digest(docs, benchmark).where("contaminated").collect()}
    kept = decontam.clean(docs, benchmark)
    assert kept.columns == docs.columns
    texts = sorted(repr(r.doc_id) for r in kept.collect())
    expected = sorted(
        repr(r.doc_id) for r in decontam.contamination_digest(docs, benchmark).where("not contaminated").collect()
    )
    assert texts == expected and bad


def brute_matches(terms, queries, slop):
    out = set()
    for q, query in enumerate(queries):
        for start in range(len(terms)):
            near = all(
                t in terms[max(start + j - slop, 0) : start + j + slop + 1] if j else t == terms[start]
                for j, t in enumerate(query)
            )
            if near:
                out.add((q, start, terms[start : start + len(query)] == list(query)))
    return out


@pytest.mark.parametrize("candidates", [7, 1 << 20])
@pytest.mark.parametrize("slop", [0, 1, 3])
def test_phrase_and_proximity_search(slop, candidates, monkeypatch):
    monkeypatch.setattr(decontam, "CANDIDATES", candidates)
    rng = random.Random(slop)
    terms = [rng.randint(1, 6) for _ in range(300)]
    queries = [[rng.randint(1, 6) for _ in range(4)] for _ in range(30)] + [[1, 2, 3, 99]]
    t, counts, steps = decontam.invert(np.array(terms, np.uint64), np.arange(300) + decontam.GAP)
    segment = decontam.Segment.decode(t.tobytes(), counts.tobytes(), steps.tobytes())
    query, start, exact = decontam.search(segment, np.array(queries, np.uint64), slop)
    got = [(int(q), int(p) - decontam.GAP, bool(e)) for q, p, e in zip(query, start, exact)]
    assert len(got) == len(set(got)) and set(got) == brute_matches(terms, queries, slop)
    assert any(e for *_, e in got) and (slop == 0 or any(not e for *_, e in got))


def test_proximity_rows(spark):
    docs = spark.createDataFrame([(1, "red green very blue"), (2, "red green blue")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "red green blue")], "item_id bigint, text string")
    index = decontam.build_index(docs)
    ids = decontam.indexed_documents(index)
    found = decontam.matches(index, items, slop=1).join(ids, ["segment", "ordinal"])
    assert sorted((r.doc_id, r.kind, r.start, r.stop) for r in found.collect()) == [
        (1, "proximity", 0, 3), (2, "phrase", 0, 3)
    ]


def test_driver_tables(spark):
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet")
    items = spark.read.parquet(f"{SMOKE_DIR}/benchmark.parquet")
    got = decontam.contamination_digest(docs, items)
    cols, rows = oracle(docs, items)
    assert digest(got.columns, [tuple(r) for r in got.collect()])[0] == digest(cols, rows)[0]


def test_empty(spark, no_docs, contaminated, benchmark):
    none = benchmark.limit(0)
    assert decontam.contamination_digest(no_docs, benchmark).count() == 0
    assert decontam.contamination_digest(contaminated, none).where("contaminated").count() == 0
    assert decontam.clean(contaminated, none).count() == contaminated.count()


def test_the_broadcast_is_bounded_and_jobs_do_not_grow(spark, monkeypatch):
    words = [f"w{i}" for i in range(2000)]
    items = [(1, " ".join(words))] + [(2, " ".join(words[5:40]))] * 300
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    docs = [(1, " ".join(["x", *words, "y"])), (2, " ".join(words[600:609])), (3, " ".join(words[600:610]))]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    sent, broadcast, written, materialise = [], spark.sparkContext.broadcast, [], decontam.materialise
    monkeypatch.setattr(
        spark.sparkContext, "broadcast", lambda v: (sent.append(len(pickle.dumps(v))), broadcast(v))[1]
    )
    monkeypatch.setattr(decontam, "materialise", lambda df, name, **o: (written.append(name), materialise(df, name, **o))[1])
    expected = [(1, 2000, 2), (2, 0, 0), (3, 10, 1)]
    for limit in (1 << 20, 40_000):
        monkeypatch.setattr(decontam.matches, "__defaults__", (decontam.WINDOW, 0, limit))
        got = decontam.contamination_digest(docs, benchmark).collect()
        assert sorted((r.doc_id, r.n_hit, r.n_items) for r in got) == expected
        assert written == ["positional-index", "benchmark-pieces", "benchmark-matches"]
        written.clear()
    assert len(sent) == 1 and sent[0] < 1 << 20


def test_words_moved_by_one_count_as_near(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [
        (1, "one two three extra four five six seven eight nine ten"),
        (2, "x one two four three five six seven eight nine ten"),
        (3, "one two three extra extra four five six seven eight nine ten"),
        (4, f"y {item} z"),
        (5, "one two three four five six seven eight ten"),
    ]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    got = decontam.contamination_digest(docs, items).collect()
    assert {r.doc_id: (r.n_hit, r.n_near) for r in got} == {1: (0, 10), 2: (0, 10), 3: (0, 0), 4: (10, 10), 5: (0, 0)}
    cols, rows = oracle(docs, items)
    assert digest(list(got[0].asDict()), [tuple(r) for r in got])[1] == digest(cols, rows)[1]
