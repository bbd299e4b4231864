"""Quality, toxicity and language models: exact counts against plain Python,
held-out accuracy on the driver's labelled tables, and the defined cases."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import labelled, langid, quality, toxicity
from tests.conftest import SMOKE_DIR

MEDIUM = SMOKE_DIR.replace("0.001", "0.1")


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, lang, quality, toxic) of the medium tables."""
    return duckdb.connect().execute(
        f"SELECT d.doc_id, d.text, d.lang, l.quality, l.toxic FROM read_parquet('{MEDIUM}/documents.parquet') d "
        f"LEFT JOIN read_parquet('{MEDIUM}/labels.parquet') l USING (doc_id) ORDER BY hash(d.doc_id)"
    ).fetchall()


def crc(value, parts):
    return zlib.crc32(str(value).encode()) % parts


def in_pieces(score, texts, size=100):
    return [score(texts[i : i + size]) for i in range(0, len(texts), size)]


# --- quality -------------------------------------------------------------------


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            hit.update(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed)


def test_rules_match_plain_python(spark, edge_docs, edge_rows, rows):
    extra = [(i, t) for i, (_, t, *_) in enumerate(rows[:300], 1000)] + [
        (1, "a\nb\na\na \n\n\n"), (2, "w " * 15), (3, "w " * 16 + "x"), (4, " ".join("abcdefgh" * 3) + " z"),
        (5, "\x0b\x0c\x1c word one"), (6, "# * $ % & | < >"),
    ]
    docs = edge_docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    got = quality.judge(docs.selectExpr("*", "'x' as kept"), quality.QualityModel(), keep_text=False)
    assert got.columns == ["doc_id", "kept", *quality.RESULT[:6], "kept_1", "probability"]
    found = sorted((repr(r.doc_id), *r[2:8], r.kept_1) for r in got.collect())
    expected = sorted((repr(d), *brute_rules(t), not brute_rules(t)[-1]) for d, t, *_ in [*edge_rows, *extra])
    assert found == expected


def test_quality_held_out(rows):
    known = [r for r in rows if r[3] is not None]
    half = len(known) // 2
    train, test = known[:half], known[half:]
    share = np.mean([r[3] for r in known])
    model = quality.fit([r[1].encode() for r in train], [r[3] for r in train], (1 - share, share))
    parts = in_pieces(lambda t: quality._verdicts(model, t), [r[1].encode() for r in test])
    p = np.concatenate([x[7] for x in parts])
    kept = np.concatenate([x[6] for x in parts])
    y = np.array([r[3] for r in test])
    assert ((p >= quality.THRESHOLD) == y).mean() > 0.93
    assert kept[y == 1].mean() > 0.95 and kept[y == 0].mean() < 0.1
    for low, high in ((0.0, 0.5), (0.5, 1.01)):  # calibrated: mean probability near the share of good rows
        own = (p >= low) & (p < high)
        assert abs(p[own].mean() - y[own].mean()) < 0.12


def test_quality_without_labels(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, None, None)], "doc_id bigint, quality int, toxic int")
    assert quality.quality_digest(edge_docs, labels).where("kept = base_failed").count() == 0
    assert quality.quality_digest(no_docs, labels).count() == 0


# --- toxicity ------------------------------------------------------------------


def test_toxicity_held_out(rows):
    known = [r for r in rows if r[4] is not None]
    train = [r for r in known if crc(r[0], 3) != 1]
    train = [r for r in train if r[4]] + [r for r in train if not r[4]][:800]
    test = [r for r in known if crc(r[0], 3) == 1]
    model = toxicity.fit([r[1].encode() for r in train], [r[4] for r in train], [r[2] for r in train])
    s = np.concatenate(in_pieces(lambda t: toxicity.score(model, t), [r[1].encode() for r in test]))
    y = np.array([r[4] for r in test])
    order = np.argsort(np.argsort(s))
    auc = (order[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (1 - y).sum())
    assert auc > 0.97
    called = s >= toxicity.DECISION
    assert called[y == 1].mean() > 0.85 and called[y == 0].mean() < 0.03
    assert ((s >= 0) & (s <= 1)).all()
    assert toxicity.score(model, [b""])[0] < toxicity.DECISION


def test_toxicity_digest_on_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame(
        [(1, 1, 1), (2, 1, 0), (2, 1, 0), (5, 0, 0), (8, 1, 1), (None, 1, 1), (3, 1, 1)],
        "doc_id bigint, quality int, toxic int",
    )
    for docs in (edge_docs, no_docs):
        out = toxicity.toxicity_digest(docs.selectExpr("*", "1 as score"), labels)
        assert out.columns == ["doc_id", "held_out", "score", "predicted"]
        got = out.collect()
        assert len(got) == docs.count()
        for r in got:
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= toxicity.DECISION)
            assert r.held_out == (crc("" if r.doc_id is None else r.doc_id, 3) == 1)
    none = labels.limit(0)
    assert {r.predicted for r in toxicity.toxicity_digest(edge_docs, none).collect()} == {0}


def test_score_does_not_see_labels_or_other_rows(rows):
    texts = [r[1].encode() for r in rows[:60]]
    model = toxicity.fit(texts, [i % 2 for i in range(60)], [r[2] for r in rows[:60]])
    together = toxicity.score(model, texts)
    alone = np.concatenate([toxicity.score(model, [t]) for t in texts])
    assert together == pytest.approx(alone, abs=1e-5)


def test_threshold_is_in_the_widest_best_gap():
    raw, y = np.array([0.0, 1.0, 5.0, 6.0, 2.0]), np.array([0, 0, 1, 1, 0])
    assert toxicity._threshold(raw, y) == pytest.approx(3.5)


def test_sample_is_bounded_and_needs_no_text_shuffle(spark, edge_docs):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(30)], "doc_id bigint, quality int, toxic int")
    got = labelled.sample(edge_docs, labels, "toxic", 2)
    assert len(got) <= 4 and {r.y for r in got} <= {0, 1}


# --- language ------------------------------------------------------------------


def test_language_held_out(rows):
    train = [r for r in rows if crc(r[0], 4) != 2][:2400]
    test = [r for r in rows if crc(r[0], 4) == 2][:1500]
    model = langid.fit([r[1].encode() for r in train], [r[2] for r in train])
    pred, p = [], []
    for found, prob in in_pieces(lambda t: langid.score(model, t), [r[1].encode() for r in test]):
        pred += found
        p += prob.tolist()
    right = np.array([a == r[2] for a, r in zip(pred, test)])
    assert right.mean() > 0.99
    assert abs(np.mean(p) - right.mean()) < 0.03  # calibrated
    assert (model.weights == 0).mean() > 0.5  # sparse


def test_language_of_edges(spark, edge_docs, no_docs):
    out = langid.language_digest(edge_docs.selectExpr("*", "'x' as lang_pred"))
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    for r in out.collect():
        assert 0 <= r.score <= 1
        if r.doc_id in (3, 4, 6, 9):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        if r.doc_id in (1, 2, 7):
            assert r.lang_pred != "und"
        assert r.held_out == (crc("" if r.doc_id is None else r.doc_id, 4) == 2)
    assert langid.language_digest(no_docs).count() == 0
    clash = edge_docs.selectExpr("*", "0.5 as score", "'x' as lang_pred")
    kept = langid.keep_identified(clash, 0.0)
    assert kept.columns == clash.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(map(repr, [1, 2, 2, None, 5, 7, 8]))


FOREIGN = [
    "Tämä on suomenkielinen lause jossa kerrotaan säästä ja ihmisistä kaupungissa",
    "Ez egy magyar mondat az időjárásról és az emberekről a városban",
    "Αυτή είναι μια ελληνική πρόταση για τον καιρό",
    "xkcd qwrtz plmkj bvcxz ghjklm zzxq wqrt pplk jhgf dsrt",
    "To jest polskie zdanie o pogodzie i ludziach w mieście",
]


def test_languages_never_learned_are_unfamiliar(rows):
    train = [r for r in rows if crc(r[0], 4) != 2][:2400]
    test = [r for r in rows if crc(r[0], 4) == 2][:1500]
    model = langid.fit([r[1].encode() for r in train], [r[2] for r in train])
    z = np.concatenate([x[2] for x in in_pieces(lambda t: langid.score_all(model, t), [r[1].encode() for r in test])])
    assert (z < model.least_familiar).mean() <= 0.001  # texts in the learned languages stay
    _, p, foreign = langid.score_all(model, [t.encode() for t in FOREIGN])
    assert (foreign < model.least_familiar).all() and p.max() > 0.5  # though some look like one of them


def _made_up(spark, rare):
    """Three common languages of their own letters, and one of ``rare`` rows."""
    rng = np.random.default_rng(3)
    letters = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "qrstuvwx", "rr": "αβγδεζηθ"}
    word = lambda l: "".join(rng.choice(list(letters[l]), 5))
    langs = ["aa", "bb", "cc"] * 1000 + ["rr"] * rare
    rows = [(i, " ".join(word(l) for _ in range(12)), l, "s", 0) for i, l in enumerate(langs)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_a_language_with_few_rows_is_learned(spark):
    rows, docs = _made_up(spark, 8)
    assert sum(crc(r[0], 4) != 2 for r in rows if r[2] == "rr") >= 3
    got = {r.doc_id: r.lang_pred for r in langid.language_digest(docs).collect()}
    assert all(got[r[0]] == r[2] for r in rows if r[2] == "rr")
    assert np.mean([got[r[0]] == r[2] for r in rows]) > 0.99


def test_training_rows_and_document_frequencies(spark, edge_docs):
    rows, docs = _made_up(spark, 8)
    labelled = docs.selectExpr("xxhash64(doc_id, text) as h", "text as t", "lang as l")
    taken = langid.training_rows(labelled, 50)
    by = {}
    for r in labelled.collect():
        by.setdefault(r.l, []).append((r.h % (1 << 64), r.t))
    for lang, own in by.items():
        assert [(r.h % (1 << 64), r.t) for r in taken if r.l == lang] == sorted(own)[:50]
    texts = [r.text for r in edge_docs.where("text is not null").collect()] + [rows[0][1]]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    n, counts = langid.document_frequencies(frame)
    expected = np.zeros(langid.BUCKETS, int)
    for t in texts:
        expected[np.unique(langid.ngrams([t.encode()])[1])] += 1
    assert (counts == expected).all() and n == sum(bool(langid.ngrams([t.encode()])[1].size) for t in texts)


def test_no_labelled_language(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")
    assert langid.language_digest(docs).collect()[0].lang_pred == "und"


def test_ngrams_stay_in_their_text():
    together = langid.ngrams([b"ab", b"c d", b"", "é1é".encode()])
    for i, text in enumerate([b"ab", b"c d", b"", "é1é".encode()]):
        alone = langid.ngrams([text])[1]
        assert sorted(together[1][together[0] == i].tolist()) == sorted(alone.tolist())
    assert len(langid.ngrams([b"12 ,."])[1]) == 0
    assert len(langid.ngrams(["\U000E0041\U000F0000 1".encode()])[1]) == 0  # tags and private use are no letters
    assert len(langid.ngrams(["\U00020000".encode()])[1]) > 0


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """Several groups, one round of words each: every labelled text is counted,
    and words that only one group knows are learned."""
    monkeypatch.setattr(toxicity, "GROUP_ROWS", 40)
    seen = []
    calibrated = toxicity._set_thresholds
    monkeypatch.setattr(toxicity, "_set_thresholds",
                        lambda *a: (seen.append((a[-1].sum(), a[-1][a[-2]].sum())), calibrated(*a)))
    texts = [f"plain words number {i % 9} here" + (" vile insult" if i % 3 == 0 else " kind remark") for i in range(240)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    assert seen[0][0] == 240 and 0 < seen[0][1] < 240
    score = toxicity.score(model, [t.encode() for t in texts])
    assert ((score >= toxicity.DECISION) == [i % 3 == 0 for i in range(240)]).all()


def test_toxicity_trains_as_long_in_several_groups(spark, monkeypatch):
    """However many groups there are, every text is trained on EPOCHS times;
    both classes are learned though one of them is in the held quarter only."""
    passes = []
    one_round = toxicity._train_round
    monkeypatch.setattr(toxicity, "_train_round", lambda *a: (passes.append(a[-1]), one_round(*a)))
    texts = [f"plain words number {i % 9} here" + (" vile insult" if i % 3 == 0 else " kind remark") for i in range(240)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id bigint, toxic int")
    for group_rows in (5000, 40):
        monkeypatch.setattr(toxicity, "GROUP_ROWS", group_rows)
        passes.clear()
        toxicity.train(docs, labels)
        assert sum(passes) == toxicity.EPOCHS and len(passes) == toxicity.ROUNDS
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    one_class = labels.withColumn("toxic", (held & (F.col("toxic") == 1)).cast("int"))
    model = toxicity.train(docs, one_class)
    assert model.thresholds is not None
