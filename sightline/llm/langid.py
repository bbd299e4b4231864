"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams.

N-grams of one to three characters of the lower-cased letters are hashed into
buckets. A text's features are its n-gram frequencies times their inverse
document frequencies, which are counted over all texts that may be learned
from. The classes are fitted with follow-the-regularised-leader
(per-coordinate steps, L1 and L2 penalties), so most weights are exactly zero;
a temperature, fitted on training texts that the weights have not seen, turns
scores into probabilities.

The probabilities say which of the learned languages a text is in, if it is in
one of them. Whether it is, is judged by ``familiarity``: the mean log
frequency of its n-grams (each in the language that has it most often, so that
mixed texts are familiar), in standard deviations of unseen training texts of
its length (0 for a text of fewer than ``LEAST_NGRAMS``, which cannot be
judged). Below the model's ``least_familiar``, which unseen training texts do
not reach, a text is in no learned language (``keep_identified``).

The weights are fitted on at most ``LANGUAGE_ROWS`` labelled texts of each
language (those with the smallest hash of their id and text, whole texts),
fewer if the ``MOST_LANGUAGES`` commonest would have more than ``TRAIN_ROWS``
together; so a rare language is learned as well as a common one. Scoring reads
every text whole, in Arrow batches, with weights that are sent to the tasks
once (their size is fixed by the number of buckets and languages).

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
rows with null language are not learned from; without any labelled row every
text is ``und``; with one language only, every text with a letter is that
language; repeated rows are scored alike; an empty table gives an empty
result; clashing extra columns are kept, new columns get free names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.labelled import SAMPLE_CHARS, remainder
from sightline.llm.tables import map_text, quoted
from sightline.llm.textkit import mix, slices

BUCKETS = 1 << 15
LANGUAGE_ROWS = 600
TRAIN_ROWS = 12_000
MOST_LANGUAGES = 500
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-4
BATCH = 32
EPOCHS = 4
UNKNOWN = "und"
SLICE = 256 << 10


def held_out(column: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """crc32 of the id as text, modulo ``parts``, equals ``part``."""
    return remainder(column, parts) == part


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, idf included
    bias: np.ndarray
    temperature: float
    familiar: np.ndarray  # log frequency of each bucket
    usual: tuple[float, float, float]  # familiarity: mean, variance of texts, of n-grams
    least_familiar: float = -np.inf


def _letters(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all lower-cased texts, every run of other characters one
    space, one space before and after each text; and each text's offset."""
    pieces, offsets = [], np.zeros(len(texts) + 1, np.int64)
    for i, raw in enumerate(texts):
        points = np.frombuffer(raw.decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)
        alpha = _ALPHA[np.minimum(points, len(_ALPHA) - 1)]
        keep = alpha.copy()
        keep[:-1] |= alpha[1:]  # one separator before each run of letters
        points = np.where(alpha, points, np.uint32(32))[keep]
        if points.size and alpha.any():
            points = np.concatenate([points, [np.uint32(32)]]) if points[0] == 32 else np.concatenate(
                [[np.uint32(32)], points, [np.uint32(32)]]
            )
        else:
            points = points[:0]
        pieces.append(points.astype(np.uint32))
        offsets[i + 1] = offsets[i] + len(points)
    return (np.concatenate(pieces) if pieces else np.zeros(0, np.uint32)), offsets


# letters by code point; past the table (0x323AF is the last) there are none
_ALPHA = np.array([chr(c).isalpha() for c in range(0x323B0)] + [False])


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram, n = 1..3, within its text."""
    points, offsets = _letters(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    wide = points.astype(np.uint64)
    rows, buckets = [], []
    for n in (1, 2, 3):
        count = len(points) - n + 1
        if count <= 0:
            break
        code = wide[:count].copy()
        for j in range(1, n):
            code = (code << np.uint64(21)) | wide[j : j + count]
        inside = row[:count] == row[n - 1 :]
        code, owner = code[inside], row[:count][inside]
        if n == 1:
            letters = code != np.uint64(32)
            code, owner = code[letters], owner[letters]
        rows.append(owner)
        buckets.append((mix(code + np.uint64(n)) >> np.uint64(64 - 15)).astype(np.int32))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(rows), np.concatenate(buckets)


def _sparse(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text: distinct buckets and their relative frequencies."""
    out = []
    for text in texts:
        _, bucket = ngrams([text])
        index, count = np.unique(bucket, return_counts=True)
        out.append((index, count / max(1, len(bucket))))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


SCALE = 40.0  # frequencies are small numbers; scaled to the order of one


def fit(
    texts: list[bytes], labels: list[str], seed: int = 0, frequencies: tuple[int, np.ndarray] | None = None
) -> LanguageModel:
    """Fit on labelled texts; a fifth of them sets the temperature and the
    usual familiarity only. ``frequencies``: how many documents there are, and
    how many have each bucket (of the training texts when not given)."""
    names = sorted(set(labels))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 1)), np.zeros(1), 1.0, np.zeros(BUCKETS), (0.0, 1.0, 1.0))
    target = np.array([names.index(x) for x in labels])
    features = _sparse(texts)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held, train = order[: len(order) // 5], order[len(order) // 5 :]
    if not len(held):
        held = train
    if frequencies is None:
        df = np.zeros(BUCKETS)
        for i in train:
            df[features[i][0]] += 1
        frequencies = len(train), df
    idf = np.log((1 + frequencies[0]) / (1 + frequencies[1])) + 1.0
    k = len(names)
    familiar = _familiar(features, train, target, k)
    usual, least = _usual(familiar, [texts[i] for i in held])
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(rows: np.ndarray) -> np.ndarray:
        zr, nr = z[rows], n[rows]
        active = np.where(np.abs(zr) <= L1, 0.0, zr - np.sign(zr) * L1)
        return -active / ((BETA + np.sqrt(nr)) / ALPHA + L2)

    for _ in range(EPOCHS):
        rng.shuffle(train)
        for at in range(0, len(train), BATCH):
            batch = train[at : at + BATCH]
            owner = np.concatenate([np.full(len(features[i][0]) + 1, j) for j, i in enumerate(batch)])
            index = np.concatenate([np.append(features[i][0], BUCKETS) for i in batch])
            value = np.concatenate([np.append(features[i][1] * idf[features[i][0]] * SCALE, 1.0) for i in batch])
            rows, inverse = np.unique(index, return_inverse=True)
            w = weights(rows)
            score = np.zeros((len(batch), k))
            np.add.at(score, owner, w[inverse] * value[:, None])
            wrong = _softmax(score)
            wrong[np.arange(len(batch)), target[batch]] -= 1.0
            grad = np.zeros((len(rows), k))
            np.add.at(grad, inverse, wrong[owner] * value[:, None])
            sigma = (np.sqrt(n[rows] + grad**2) - np.sqrt(n[rows])) / ALPHA
            z[rows] += grad - sigma * w
            n[rows] += grad**2
    w = weights(np.arange(BUCKETS + 1))
    dense, bias = w[:-1] * idf[:, None] * SCALE, w[-1]
    scores = np.array([(dense[i] * v[:, None]).sum(axis=0) + bias for i, v in (features[j] for j in held)])
    temperature = _temperature(scores, target[held]) if k > 1 else 1.0
    return LanguageModel(names, dense.astype(np.float32), bias, temperature, familiar, usual, least)


def _familiar(features: list, train: np.ndarray, target: np.ndarray, k: int) -> np.ndarray:
    """Log frequency of each bucket in the language that has it most often
    (texts count alike, whatever their length)."""
    share = np.zeros((k, BUCKETS))
    for i in train:
        share[target[i], features[i][0]] += features[i][1]
    texts = np.maximum(np.bincount(target[train], minlength=k), 1)[:, None]
    return np.log((share / texts + SMOOTH / BUCKETS).max(axis=0)).astype(np.float32)


SMOOTH = 0.05
FAR, FARTHEST = 8.0, 10.0
LEAST_NGRAMS = 12


def _usual(familiar: np.ndarray, texts: list[bytes]) -> tuple[tuple[float, float, float], float]:
    """Mean familiarity of texts, its variance between texts and between the
    n-grams of a text; and the least that still counts as familiar: a quarter
    farther than the farthest of these texts, between FAR and FARTHEST."""
    rows, buckets = ngrams(texts)
    total = np.bincount(rows, minlength=len(texts))
    seen = total >= LEAST_NGRAMS
    if not seen.any():
        return (0.0, 1.0, 1.0), -FAR
    value = familiar[buckets].astype(np.float64)
    mean = np.bincount(rows, value, minlength=len(texts))[seen] / total[seen]
    within = float(np.var(value - (np.bincount(rows, value, minlength=len(texts)) / np.maximum(total, 1))[rows]))
    # medians: a few texts that are mislabelled or in no language do not count
    middle = float(np.median(mean))
    between = max((1.4826 * float(np.median(np.abs(mean - middle)))) ** 2 - within * float(np.mean(1 / total[seen])), 0.01)
    usual = middle, between, max(within, 1e-3)
    z = (mean - middle) / np.sqrt(between + usual[2] / total[seen])
    return usual, -float(np.clip(1.25 * -z.min(), FAR, FARTHEST))


def _temperature(scores: np.ndarray, target: np.ndarray) -> float:
    """The divisor of the scores with the least log loss (golden section)."""

    def loss(log_t: float) -> float:
        p = _softmax(scores / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(target)), target], 1e-12)).mean()

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    while high - low > 1e-3:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def score(model: LanguageModel, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
    """Predicted language and its probability for each text."""
    return score_all(model, texts)[:2]


def score_all(model: LanguageModel, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Predicted language, its probability and the familiarity of each text."""
    rows, buckets = ngrams(texts)
    total = np.bincount(rows, minlength=len(texts))
    k = len(model.languages)
    if not k:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    # pre-count (row, bucket) pairs only where rows are long; the gather is linear
    logits = np.stack(
        [np.bincount(rows, model.weights[buckets, c], minlength=len(texts)) for c in range(k)], axis=1
    ) / np.maximum(total, 1)[:, None] + model.bias
    p = _softmax(logits / model.temperature)
    best = p.argmax(axis=1)
    found = [model.languages[b] if t else UNKNOWN for b, t in zip(best, total)]
    known = np.bincount(rows, model.familiar[buckets], minlength=len(texts)) / np.maximum(total, 1)
    middle, between, within = model.usual
    z = (known - middle) / np.sqrt(between + within / np.maximum(total, 1))
    return found, np.where(total > 0, p[np.arange(len(texts)), best], 0.0), np.where(total >= LEAST_NGRAMS, z, 0.0)


def document_frequencies(labelled: DataFrame) -> tuple[int, np.ndarray]:
    """How many texts (column ``t``) have a letter, and how many have each
    bucket: one partial count a task, added up by Spark."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS + 1, np.int64)  # the last: texts
        for batch in batches:
            for _, texts in slices(batch.column(0), SLICE):
                for at in range(0, len(texts), 128):
                    part = texts[at : at + 128]
                    rows, buckets = ngrams(part)
                    has = np.zeros((len(part), BUCKETS), bool)
                    has[rows, buckets] = True
                    counts[:-1] += has.sum(axis=0)
                    counts[-1] += int(has.any(axis=1).sum())
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts[found])], names=["b", "n"])

    sums = labelled.select("t").mapInArrow(partial, "b int, n bigint").groupBy("b").agg(F.sum("n").alias("n"))
    counts = np.zeros(BUCKETS + 1, np.int64)
    for r in sums.collect():  # at most one row for each bucket
        counts[r.b] = r.n
    return int(counts[-1]), counts[:-1]


def training_rows(labelled: DataFrame, rows: int = LANGUAGE_ROWS) -> list:
    """Rows (h, t, l) of each of the commonest languages: those with the
    smallest hashes. Rows far above the expected cut stay where they are."""
    counts = labelled.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(MOST_LANGUAGES)
    sizes = {r.l: r.n for r in counts.collect()}
    if not sizes:
        return []
    rows = max(1, min(rows, TRAIN_ROWS // len(sizes)))
    shares = [(lang, min(1.0, (1.2 * rows + 50) / n)) for lang, n in sizes.items()]
    near = labelled.sparkSession.createDataFrame(shares, "l string, share double")
    place = F.shiftrightunsigned(F.col("h"), 11) * F.lit(2.0**-53)
    found = labelled.join(F.broadcast(near), "l").where((place < F.col("share")) | (F.col("share") >= 1)).select("h", "t", "l")
    taken: dict[str, list] = {}
    for r in sorted(found.collect(), key=lambda r: (r.h % (1 << 64), r.t)):
        own = taken.setdefault(r.l, [])
        if len(own) < rows:
            own.append(r)
    return [r for lang in sorted(taken) for r in taken[lang]]


def train(documents: DataFrame, rows: int = LANGUAGE_ROWS, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fit on a bounded sample of each language's labelled rows, of at most
    ``SAMPLE_CHARS`` characters; document frequencies are those of all rows."""
    usable = documents.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    labelled = usable.select(
        F.xxhash64("doc_id", text).alias("h"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")
    )
    sample = training_rows(labelled.where(F.length("t") <= SAMPLE_CHARS), rows)
    if not sample:
        return fit([], [])
    return fit([r.t.encode() for r in sample], [r.l for r in sample], frequencies=document_frequencies(labelled))


def identify(documents: DataFrame, model: LanguageModel, text: str = "text", keep_text: bool = True) -> DataFrame:
    """All columns of ``documents`` plus ``lang_pred``, ``score`` and
    ``familiarity``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # buckets x languages floats

    def work(column: pa.Array) -> Iterator[list[pa.Array]]:
        for _, texts in slices(column, SLICE):
            langs, probs, familiar = score_all(shared.value, texts)
            yield [pa.array(langs, pa.string()), pa.array(probs, pa.float64()), pa.array(familiar, pa.float64())]

    new = [("lang_pred", "string"), ("score", "double"), ("familiarity", "double")]
    return map_text(documents, text, new, work, keep_text)


def language_digest(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = train(documents.where(~held_out()))
    scored = identify(documents.select("doc_id", "text"), model, keep_text=False)
    return scored.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(documents: DataFrame, least: float = 0.0) -> DataFrame:
    """The documents in a learned language: those with a letter, familiar
    n-grams, and a language of at least the probability ``least``."""
    model = train(documents.where(~held_out()))
    scored = identify(documents, model)
    pred, prob, familiar = scored.columns[-3:]
    return scored.where(
        (F.col(pred) != UNKNOWN) & (F.col(prob) >= least) & (F.col(familiar) >= model.least_familiar)
    ).select(*[quoted(c) for c in documents.columns])
