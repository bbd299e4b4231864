"""Quality rules and a calibrated n-gram classifier.

Rules count words, symbols, repeated lines and repeated eight-word windows of
a text. Texts that pass them are judged by a logistic regression on hashed
word unigrams, word bigrams and character trigrams (byte trigrams, case
kept), each family as relative frequencies. It is trained on labelled rows and
its output is calibrated (Platt scaling, fitted on labelled rows the weights
have not seen) to the probability of good quality; a fixed threshold on that
decides.

Training uses at most ``PER_CLASS`` labelled documents of each class, weighted
back to the classes' shares among all labels; every document is scored whole,
in Arrow batches, by weights of fixed size.

Defined cases: a null or empty text has no words and fails the rules; without
labels of both classes the rules alone decide; repeated rows are judged alike;
an empty table gives an empty result; clashing extra columns are kept, new
columns get free names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.labelled import sample
from sightline.llm.tables import map_text
from sightline.llm.textkit import NON_SPACE, byte_class, join_rows, mix, prefix_sums, slices, span_hash, tokens

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
THRESHOLD = 0.2  # a text goes when it is bad with a probability over 0.8
BUCKET_BITS = 16
PER_CLASS = 2500
EPOCHS = 8
RATE = 0.2
L2 = 1e-6
FAMILIES = 3
SLICE = 512 << 10

_SYMBOL = byte_class(b"#*$%&|<>")
_FIRST_BYTE = np.array([(b & 0xC0) != 0x80 for b in range(256)], np.uint8) * NON_SPACE


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, compared exactly."""
    grams = list(zip(*(words[j:] for j in range(window))))
    count = Counter(grams)
    edge = np.zeros(len(words) + 1, np.int64)
    for i, gram in enumerate(grams):
        if count[gram] > 1:
            edge[i] += 1
            edge[i + window] -= 1
    return int((np.cumsum(edge) > 0).sum())


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


@dataclass
class Parsed:
    texts: list[bytes]
    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    counts: np.ndarray
    hashes: np.ndarray


def parse(texts: list[bytes]) -> Parsed:
    buf, offsets = join_rows(texts)
    start, end = tokens(buf, NON_SPACE)
    counts = np.diff(np.searchsorted(start, offsets))
    return Parsed(texts, buf, offsets, start, end, counts, span_hash(prefix_sums(buf), start, end))


def _sum_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def rules(p: Parsed) -> dict[str, np.ndarray]:
    """The base counts of each text. Repeated windows are found by hash;
    texts that have any are counted again exactly."""
    row = np.repeat(np.arange(len(p.texts)), p.counts)
    repeats = np.zeros(len(p.texts), np.int64)
    n = len(p.hashes) - WINDOW + 1
    if n > 0:
        window = mix(row[:n].astype(np.uint64))
        for j in range(WINDOW):
            window = window * np.uint64(0xD6E8FEB86659FD93) + p.hashes[j : j + n]
        inside = row[:n] == row[WINDOW - 1 :]
        window, owner = mix(window[inside]), row[:n][inside]
        order = np.argsort(window)
        same = window[order][1:] == window[order][:-1]
        for r in np.unique(owner[order[1:][same]]):
            repeats[r] = repeat_words(p.texts[r].split())
    return {
        "n_words": p.counts.astype(np.int64),
        "word_chars": _sum_by_row(_FIRST_BYTE[p.buf], p.offsets),
        "n_symbols": _sum_by_row(_SYMBOL[p.buf], p.offsets),
        "n_dup_lines": np.array([dup_lines(t) for t in p.texts], np.int64),
        "n_repeat_words": repeats,
    }


def features(p: Parsed) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) pairs of each feature family."""
    shift = np.uint64(64 - BUCKET_BITS)
    row = np.repeat(np.arange(len(p.texts)), p.counts)
    unigram = p.hashes >> shift
    both = row[:-1] == row[1:]
    bigram = mix(p.hashes[:-1][both] * np.uint64(3) + p.hashes[1:][both]) >> shift
    wide = p.buf.astype(np.uint64)
    code = (wide[:-2] << np.uint64(16)) | (wide[1:-1] << np.uint64(8)) | wide[2:]
    trigram = mix(code) >> shift
    # the separator after each text belongs to its last trigrams, none crosses it
    place = np.repeat(np.arange(len(p.texts)), np.diff(p.offsets))
    inside = place[:-2] == place[2:]
    return [
        (row, unigram.astype(np.int64)),
        (row[:-1][both], bigram.astype(np.int64)),
        (place[:-2][inside], trigram[inside].astype(np.int64)),
    ]


@dataclass
class QualityModel:
    weights: np.ndarray | None = None  # families x buckets
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0


def _raw(model: QualityModel, p: Parsed) -> np.ndarray:
    out = np.full(len(p.texts), model.bias)
    for f, (row, bucket) in enumerate(features(p)):
        total = np.bincount(row, minlength=len(p.texts))
        out += np.bincount(row, model.weights[f][bucket], len(p.texts)) / np.maximum(total, 1)
    return out


def probability(model: QualityModel, p: Parsed) -> np.ndarray:
    """Calibrated probability of good quality of each text."""
    if model.weights is None:
        return np.ones(len(p.texts))
    z = model.slope * _raw(model, p) + model.offset
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(texts: list[bytes], good: list[int], share: tuple[float, float], seed: int = 0) -> QualityModel:
    """Fit weights on three quarters of the texts and Platt scaling on the
    rest. ``share`` are the classes' shares among all labels."""
    if len(set(good)) < 2:
        return QualityModel()
    rng = np.random.default_rng(seed)
    target = np.array(good, float)
    rows = []
    for text in texts:
        index, value = [], []
        for f, (_, bucket) in enumerate(features(parse([text]))):
            if len(bucket):
                found, n = np.unique(bucket, return_counts=True)
                index.append(found + f * (1 << BUCKET_BITS))
                value.append(n / len(bucket))
        rows.append((np.concatenate(index), np.concatenate(value)) if index else (np.zeros(0, np.int64), np.zeros(0)))
    weight = np.where(target == 1, share[1] / target.mean(), share[0] / (1 - target.mean()))
    order = rng.permutation(len(texts))
    held, train = order[: len(order) // 4], order[len(order) // 4 :]
    w, seen = np.zeros(FAMILIES << BUCKET_BITS), np.full(FAMILIES << BUCKET_BITS, 1e-8)
    bias = 0.0
    balanced = np.where(target == 1, 0.5 / target.mean(), 0.5 / (1 - target.mean()))
    for epoch in range(EPOCHS):
        rng.shuffle(train)
        for i in train:
            index, value = rows[i]
            z = float(w[index] @ value) + bias
            wrong = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[i]) * balanced[i]
            grad = wrong * value + L2 * w[index]
            seen[index] += grad**2
            w[index] -= RATE * grad / np.sqrt(seen[index])
            bias -= 0.01 * wrong
    z = np.array([float(w[index] @ value) + bias for index, value in rows])
    pool = held if len(set(target[held])) == 2 else order
    slope, offset = _platt(z[pool], target[pool], weight[pool])
    return QualityModel(w.reshape(FAMILIES, -1).astype(np.float32), bias, slope, offset)


def _platt(z: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit of target on z by Newton steps, with Platt's
    smoothed targets and a slope that cannot turn negative."""
    n1, n0 = (target == 1).sum(), (target == 0).sum()
    y = np.where(target == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(z.std(), 1e-9)
    x, a, b = z / scale, 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        ga, gb = (r * x).sum() + 1e-3 * a, r.sum()
        haa, hab, hbb = (h * x * x).sum() + 1e-3, (h * x).sum(), h.sum() + 1e-9
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - float(np.clip(da, -2, 2)), b - float(np.clip(db, -2, 2))
        if abs(da) + abs(db) < 1e-9:
            break
    return max(a, 1e-3) / scale, b


def train(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    rows = sample(documents, labels, "quality", per_class)
    totals = {r[0]: r[1] for r in labels.where("quality in (0, 1)").groupBy("quality").count().collect()}
    good, bad = totals.get(1, 0), totals.get(0, 0)
    share = (bad / max(1, good + bad), good / max(1, good + bad))
    return fit([r.t.encode() for r in rows], [r.y for r in rows], share)


RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"]
TYPES = ["bigint"] * 5 + ["boolean", "boolean", "double"]


def judge(documents: DataFrame, model: QualityModel, text: str = "text", keep_text: bool = True) -> DataFrame:
    """All columns of ``documents`` plus the counts and the verdict."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # families x buckets floats

    def work(column: pa.Array) -> Iterator[list[pa.Array]]:
        for _, texts in slices(column, SLICE):
            yield [pa.array(values) for values in _verdicts(shared.value, texts)]

    return map_text(documents, text, list(zip(RESULT, TYPES)), work, keep_text)


def _verdicts(model: QualityModel, texts: list[bytes]) -> list[np.ndarray]:
    parsed = parse(texts)
    found = rules(parsed)
    failed = (found["n_words"] < MIN_WORDS) | (
        100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * found["n_words"]
    )
    p = probability(model, parsed)
    return [found[c] for c in RESULT[:5]] + [failed, ~failed & (p >= THRESHOLD), p]


def quality_digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the probability of every document."""
    model = train(documents, labels)
    return judge(documents.select("doc_id", "text"), model, keep_text=False)
