import hashlib
import random

import numpy as np
import pytest

from sightline.llm import suffix_dedup as s
from tests.conftest import SMOKE_DIR


def brute(rows, length=50):
    """(id, bytes, removed, spans, hash of the rest) of each row."""
    rows = [(s.LAST_ID if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, t in rows:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            first[w] = min(d, first.get(w, d))
    out = []
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df):
    return sorted(
        (s.LAST_ID if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
        for r in df.collect()
    )


EDGES = [
    (5, None), (6, ""), (7, "a" * 300), (8, "a" * 49), (9, "a" * 50), (None, "a" * 400), (None, "b" * 90),
    (5, "a" * 70), (5, "a" * 70), (900001, "xyz\0" * 40), (900002, "q" + "xyz\0" * 40), (900003, "é" * 60),
    (3, "é" * 30), (900004, "end with nul" * 4 + "\0\0"), (900005, "end with nul" * 4 + "\0\0\0"),
]


def test_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame(EDGES, docs.schema)).selectExpr("*", "'x' as runs", "1 as key")
    expected = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert found(s.dedup_digest(docs.repartition(3))) == expected


def test_matches_brute_force_on_small_alphabet(spark, monkeypatch):
    """Many partial overlaps, several pieces and segments."""
    monkeypatch.setattr(s, "PIECE", 700)
    monkeypatch.setattr(s, "FLUSH_BYTES", 2500)
    rng = random.Random(4)
    base = ["".join(rng.choice("ab") for _ in range(rng.randint(40, 90))) for _ in range(25)]
    rows = [(rng.randint(0, 40), "".join(rng.choice(base) for _ in range(rng.randint(1, 9)))) for _ in range(60)]
    rows.append((100, "".join(rng.choice(base) for _ in range(60))))
    boxes = []

    class Key:
        def __init__(self, v):
            self.v = v

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows]), pa.array([hash(r[1]) for r in rows]), pa.array([r[1] for r in rows])],
        names=["doc_id", "key", "text"],
    )
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    for sent in s._send_partition([batch], 8, 50):
        boxes += sent.to_pylist()
    by_bin, by_segment = {}, {}
    for r in boxes:
        by_bin.setdefault(r["bin"], []).append(r)
    assert len({r["segment"] for r in boxes}) > 3
    for rows_of_bin in by_bin.values():
        for r in s._settle((), pa.Table.from_pylist(rows_of_bin), 50).to_pylist():
            by_segment.setdefault(r["segment"], []).append(r)
    runs = {}
    for parts in by_segment.values():
        for r in s._merge((), pa.Table.from_pylist(parts)).to_pylist():
            runs[(r["doc_id"], r["key"])] = r["runs"]
    got = []
    for d, t in rows:
        kept, pairs = s._keep(t.encode(), runs.get((d, hash(t))))
        got.append((d, len(t), len(t) - len(kept), len(pairs), hashlib.sha256(kept).hexdigest()))
    assert sorted(got) == brute(rows)


def test_batches_are_scanned_before_they_join_geometric_levels():
    """Batches in order of their ids: what a batch is told is the least id of
    each window over all batches, also those to come."""
    rng = np.random.default_rng(0)
    ids = np.sort(rng.integers(0, 10_000, 2000))
    words = np.array([f"w{v:04d}" for v in rng.integers(0, 3000, 2000)], "S5")
    truth = {}
    for w, i in zip(words, ids):
        truth.setdefault(w, i)
    family, scanned = s.Family(), []
    plain = family.scan
    family.scan = lambda windows: scanned.append([len(level) for level, _ in family.levels]) or plain(windows)
    for a in range(0, 2000, 50):
        told = family.take(words[a : a + 50], ids[a : a + 50])
        assert told.tolist() == [truth[w] for w in words[a : a + 50]]
        sizes = [len(level) for level, _ in family.levels]
        assert all(x > 2 * y for x, y in zip(sizes, sizes[1:]))
    assert scanned[0] == [] and len(scanned) == 40  # each batch once, before it joins
    assert plain(np.array([b"none"], "S5"))[0] == s.LAST_ID
    assert len(family.levels) <= 12


def heavy_rows(n=240):
    """One phrase in every document, between words that differ, and passages
    shared by some around the same phrase."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    shared = [f"{word()} {word()} {word()} the same old phrase {word()} {word()} {word()}" for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [f"{word()} {word()} the same old phrase {word()} {word()}" for _ in range(6)]
        parts.insert(rng.randrange(6), rng.choice(shared))
        rows.append((rng.randint(0, 5000), " ".join(parts)))
    return rows


def test_heavy_anchors_spread_over_their_contexts(spark, monkeypatch):
    """A third of all records has one of a few anchors: no bin holds more than
    a small part of them, and the result is that of brute force."""
    rows = heavy_rows()
    text = "\n".join(t for _, t in rows).encode()
    buf = np.frombuffer(text + b"\n", np.uint8)
    sums = s.prefix_sums(buf)
    r = s.records(buf, sums, np.zeros(1, np.int64), np.array([len(text)]), 50)
    anchors, counts = np.unique(r.anchor, return_counts=True)
    heavy = anchors[counts > 100]
    share = np.isin(r.anchor, heavy).mean()
    assert share > 1 / 3
    parts, group, parent = s.split_heavy(r, s.mix(r.anchor), sums, heavy, 50)
    assert (np.bincount(parent, weights=parts.size - 49) == r.size - 49).all()  # every window once
    most = np.unique(group, return_counts=True)[1].max()
    assert most < counts.max() / 5
    # equal windows of different records are in one group
    where = {}
    for at, size, g in zip(parts.at, parts.size, group):
        for i in range(at, at + size - 49):
            assert where.setdefault(text[i : i + 50], g) == g
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    monkeypatch.setattr(s, "heavy_anchors", lambda *args: np.sort(heavy))
    assert found(s.dedup_digest(df)) == brute(rows)


def test_heavy_anchors_are_found_in_a_sample(spark, monkeypatch):
    rows = heavy_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "xxhash64(text) as key", "text")
    total = sum(len(t) for _, t in rows)
    assert len(s.heavy_anchors(df, total, 50)) == 0  # all records fit into half a bin
    monkeypatch.setattr(s, "BIN_BYTES", 40_000)
    for sample in (s.SAMPLE_BYTES, total // 2):
        monkeypatch.setattr(s, "SAMPLE_BYTES", sample)
        got = s.heavy_anchors(df, total, 50)
        assert 0 < len(got) < 20 and (np.diff(got.view(np.int64).astype(object)) != 0).all()
    monkeypatch.setattr(s, "MOST_HEAVY", 1)
    assert len(s.heavy_anchors(df, total, 50)) == 1


def test_index_settles_later_batches_against_all_before(spark, tmp_dir):
    """Four batches of growing ids, the index opened anew for each: the runs of
    all batches are those of one corpus; levels merge geometrically."""
    rows = sorted(set(heavy_rows(200)))
    rows = [(i, t) for i, (_, t) in enumerate(rows)] + [(1000, None), (1001, ""), (1002, rows[0][1] + " tail"), (1003, "x" * 500)]
    expected = {d: tuple(v) for d, *v in brute(rows)}
    got = {}
    for a in range(0, len(rows), 55):
        batch = spark.createDataFrame(rows[a : a + 55], "doc_id bigint, text string").repartition(3)
        index = s.SuffixIndex(spark, f"{tmp_dir}/index", 100_000)
        runs = {r.doc_id: bytes(r.runs) for r in index.add_batch(batch).collect()}
        for d, t in rows[a : a + 55]:
            kept, pairs = s._keep((t or "").encode(), runs.get(d))
            got[d] = (len((t or "").encode()), len((t or "").encode()) - len(kept), len(pairs), hashlib.sha256(kept).hexdigest())
    assert got == expected
    sizes = [n for _, n in s.SuffixIndex(spark, f"{tmp_dir}/index").levels]
    assert 1 <= len(sizes) <= 3 and all(x > 2 * y for x, y in zip(sizes, sizes[1:]))


def test_kept_bytes(spark):
    docs = spark.createDataFrame([(1, "x" * 60), (2, "head " + "x" * 60 + " tail")], "doc_id bigint, text string")
    kept = {r.doc_id: bytes(r.kept) for r in s.kept_bytes(docs).collect()}
    assert kept == {1: b"x" * 60, 2: b"head  tail"}


@pytest.mark.parametrize("size", [0, 1])
def test_empty(spark, no_docs, size):
    docs = no_docs if not size else spark.createDataFrame([(None, None)], "doc_id bigint, text string")
    assert s.dedup_digest(docs).count() == size


def test_segments_rows_for_themselves_share_no_group(spark):
    """Small input partitions: every segment is the first of its partition."""
    passage = "".join(chr(97 + i * i % 26) + str(i) for i in range(60))
    rows = [(i, f"{i} {passage} {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, key_text string").repartition(12).selectExpr(
        "doc_id", "xxhash64(key_text) as key", "key_text as text")
    sent = docs.mapInArrow(lambda b: s._send_partition(b, 64, 50), s.SENT_SCHEMA).where("kind <> 'records'").collect()
    segments = {r.segment for r in sent}
    assert len(segments) == 12 and {r.kind for r in sent} == {"docs", "hits"}
    assert len({r.bin for r in sent}) == len(segments)
    assert found(s.dedup_digest(docs.select("doc_id", "text"))) == brute(rows)
