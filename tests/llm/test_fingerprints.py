import hashlib
import random

import numpy as np
import pytest

from sightline.llm import fingerprints as fp
from tests.llm.conftest import DOC_SCHEMA, prose


def shingles(text: str | None) -> set[str]:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a: str | None, b: str | None) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


TEXTS = [None, "", " \t", "one", "One two three", "a b c d", "A B C D E", "a b c d e f", prose(300), "É é Ω word " * 50, "x " * 700]


def test_shingles_are_those_of_the_text():
    """As many distinct hashes as distinct shingles, and equal sets hash alike."""
    hashes, rows = fp.shingle_hashes([(t or "").encode() for t in TEXTS])
    for i, t in enumerate(TEXTS):
        assert len(set(hashes[rows == i].tolist())) == len(shingles(t)), t
    assert set(hashes[rows == 10].tolist()) and (rows == 10).sum() == 696
    again, _ = fp.shingle_hashes([b"a  B\nc d  e"])
    assert again.tolist() == hashes[rows == 6].tolist()


def test_long_text_is_hashed_in_pieces(monkeypatch):
    texts = [prose(900).encode(), b"w" * 5000 + b" tail", b""]
    whole = fp.word_hashes(texts)
    monkeypatch.setattr(fp, "SLICE_BYTES", 64)
    pieces = fp.word_hashes(texts)
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all()


def test_densified_bins_borrow_the_first_full_bin_of_their_order():
    rng = np.random.default_rng(1)
    order, rank = fp._orders(fp.BINS)
    assert (np.take_along_axis(rank, order, axis=1) == np.arange(fp.BINS)).all()
    for filled in (1, 2, 31, 32, 200, fp.BINS):
        minima = np.full((1, fp.BINS), fp.EMPTY)
        full = rng.choice(fp.BINS, filled, replace=False)
        minima[0, full] = rng.integers(0, 1 << 50, filled, dtype=np.uint64)
        out = fp.densify(minima)[0]
        for b in range(fp.BINS):
            donor = b if b in full else next(int(d) for d in order[b] if d in full)
            assert out[b] == minima[0, donor]


def test_likeness_estimates_the_similarity_of_the_shingle_sets():
    rng = random.Random(3)
    errors = []
    for size in (8, 60, 400, 2500):
        for share in (0.0, 0.1, 0.35, 0.5, 0.8, 0.95, 1.0):
            words = [str(rng.getrandbits(40)) for _ in range(size)]
            cut = int(size * share)
            a = " ".join(words)
            b = " ".join(words[:cut] + [str(rng.getrandbits(40)) for _ in range(size - cut)])
            x, y = fp.fingerprints([a.encode(), b.encode()])
            got = float(fp.alike(x[None], y[None])[0])
            assert abs(got - jaccard(a, b)) < 0.11
            errors.append(got - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.015 and np.sqrt(np.mean(np.square(errors))) < 0.035


def test_packing_round_trip():
    values = fp.fingerprints([(t or "").encode() for t in TEXTS])
    strings = fp.pack(values)
    assert (fp.unpack(strings) == values).all()
    assert strings[0] == strings[1] == strings[2] == "0" * fp.BINS
    assert {len(s) for s in strings} == {fp.BINS}
    assert fp.alike(values[:1], values[1:2])[0] == 1.0 and fp.alike(values[:1], values[3:4])[0] == 0.0


def brute(rows):
    """Sorted by id, nulls last; each row with the next one's start."""
    prints = {t: fp.fingerprints([(t or "").encode()]) for _, t, *_ in rows}
    out = []
    for (doc_id, text, *_), (_, following, *_) in zip(rows, rows[1:] + rows[:1]):
        t, nxt = text or "", following or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        changed = fp.fingerprints([edited.encode()])
        out.append((
            doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.pack(prints[text])[0], fp.pack(changed)[0],
            float(fp.alike(prints[text], changed)[0]), float(fp.alike(prints[text], prints[following])[0]),
        ))
    return out


def plain(rows):
    return sorted(map(repr, ((*r[:5], round(r[5], 9), round(r[6], 9)) for r in rows)))


@pytest.mark.parametrize("run_rows", [1, 3, 1000])
def test_digest_matches_brute_force(spark, run_rows):
    rng = random.Random(4)
    rows = [(i * 7 - 50, rng.choice([prose(40, 1, i), prose(9, 2, i), "", None, "é Ω " + prose(30, 3, i)])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = fp.fingerprint_digest(df, run_rows).collect()
    assert plain(map(tuple, got)) == plain(brute(sorted(rows, key=lambda r: -r[0])))


@pytest.mark.parametrize("run_rows", [1, 4, 1000])
def test_ties_nulls_and_repeated_rows(spark, edge_docs, edge_rows, run_rows):
    from pyspark.sql import functions as F

    extra = spark.createDataFrame([(8, "many", "en", "a", 4)] * 40 + [(None, "none", "en", "a", 4)] * 15, DOC_SCHEMA)
    docs = edge_docs.union(extra).selectExpr("*", "1 as m", "2 as run", "3 as copies")
    hashed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    rows = [(r.doc_id, r.text) for r in sorted(hashed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))]
    got = fp.fingerprint_digest(docs, run_rows, limit=7).collect()
    assert len(got) == len(edge_rows) + 55
    assert plain(map(tuple, got)) == plain(brute(rows))


def test_single_document_and_empty_table(spark, no_docs):
    (one,) = fp.fingerprint_digest(spark.createDataFrame([(5, "only words here")], "doc_id bigint, text string")).collect()
    assert one.near_next == 1.0
    assert one.edited_sha256 == hashlib.sha256(b"only wordsonly ").hexdigest()
    out = fp.fingerprint_digest(no_docs)
    assert out.count() == 0 and "near_next" in out.columns


def test_whole_rows_and_likeness_column(spark, edge_docs):
    from pyspark.sql import functions as F

    docs = edge_docs.selectExpr("*", "'f' as fingerprint", "map(1, 2) as `a ``b`")
    out = fp.with_fingerprint(docs)
    assert out.columns == docs.columns + ["fingerprint_1"]
    rows = out.withColumn("same", fp.likeness(out.fingerprint_1, out.fingerprint_1)).withColumn(
        "missing", fp.likeness(out.fingerprint_1, F.lit(None).cast("string"))
    ).collect()
    assert {r.same for r in rows} == {1.0} and {r.missing for r in rows} == {None}
    prints = {}
    for r in rows:
        assert prints.setdefault(r.text or "", r.fingerprint_1) == r.fingerprint_1


def test_repeat_rows_deals_out_ranges(spark):
    from sightline.llm.tables import repeat_rows

    df = spark.createDataFrame([("a", 1), ("b", 23), ("c", 0), ("d", None), ("e", 5), ("f", -2)], "k string, n bigint")
    for limit in (1, 5, 7, 100):
        got = repeat_rows(df, "n", "i", 23, limit).collect()
        assert sorted((r.k, r.i) for r in got) == sorted([("a", 0)] + [("b", i) for i in range(23)] + [("e", i) for i in range(5)])
