"""Toxicity by a small convolutional text classifier, trained in numpy.

Words of the lower-cased text are embedded by hashing: the sum of the vectors
of the whole word and of its first four, five and six bytes, so an inflected
form shares most of its vector with its stem. Filters of several widths slide
over the words, each keeps its largest response in the text (max pooling), and
a logistic layer reads those. The score is the logistic output shifted by a
threshold that is calibrated for the text's language, so that 0.7 is the
decision point of every language; the language is guessed from the text's own
words, never read from a column.

Training uses every labelled document. The texts are dealt into groups of
bounded size; in each of ``ROUNDS`` rounds every group trains its own copy of
the weights in a task, and the copies are averaged (a word's vector over the
groups that changed it). Language counts and thresholds are counted over all
labelled documents as well. Every document is scored whole, in Arrow batches,
by weights of fixed size.

Defined cases: null, empty and wordless texts get the score of a text without
evidence; without labels of both classes every score is 0; repeated rows are
scored alike; an empty table gives an empty result; clashing extra columns are
kept, the new column gets a free name.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.labelled import labelled_texts, remainder
from sightline.llm.tables import map_text, release_shuffles
from sightline.llm.textkit import byte_class, join_rows, prefix_sums, slices, span_hash, tokens
from sightline.session import Scratch

BUCKET_BITS = 18
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PREFIXES = (4, 5, 6)
GROUP_ROWS = 5000  # texts a task trains on
GROUP_BYTES = 24 << 20
ROUNDS = 3
EPOCHS = 12  # over all rounds
BINS = 1024  # bins of a logit unit in the calibration
MOST_LOGIT = 60
KEEP = 0.7  # share of a text's words shown in one training step
BATCH = 32
RATE = 0.05
DECISION = 0.7
SLICE = 512 << 10

_WORD = byte_class({*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)})


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of each word (words x (1 + prefixes)) and the number of
    words of each text. Bucket 0 is reserved for absent features."""
    buf, offsets = join_rows([t.lower() for t in texts])
    start, end = tokens(buf, _WORD)
    counts = np.diff(np.searchsorted(start, offsets))
    sums = prefix_sums(buf)
    shift = np.uint64(64 - BUCKET_BITS)
    columns = [span_hash(sums, start, end)]
    for size in PREFIXES:
        columns.append(span_hash(sums, start, np.minimum(end, start + size)) ^ np.uint64(size << 40))
    found = np.stack([np.maximum((c * np.uint64(0x9E3779B97F4A7C15)) >> shift, 1) for c in columns], axis=1)
    found = found.astype(np.int32)
    for i, size in enumerate(PREFIXES):
        found[end - start < size, i + 1] = 0
    return found, counts


@dataclass
class ToxicityModel:
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    languages: list[str] = field(default_factory=list)
    word_odds: np.ndarray | None = None
    thresholds: np.ndarray | None = None
    spread: float = 1.0


def _pooled(model: ToxicityModel, words: np.ndarray, counts: np.ndarray) -> tuple:
    """Max-pooled filter responses of each text, their word positions, and the
    padded word vectors (widest - 1 zero rows after each text)."""
    pad = max(WIDTHS) - 1
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) + row * pad
    vectors = np.zeros((len(words) + len(counts) * pad + pad, DIM), np.float32)
    vectors[place] = model.embed[words].sum(axis=1)
    ends = np.cumsum(counts + pad)
    first = ends - counts - pad
    filled = counts > 0
    pooled, at = [], []
    for width, kernel, bias in zip(WIDTHS, model.filters, model.bias):
        response = vectors[: ends[-1]] @ kernel[0]
        for j in range(1, width):
            response += vectors[j : ends[-1] + j] @ kernel[j]
        if pad:  # positions after a text's last word do not compete
            past = np.ones(len(response), bool)
            past[place] = False
            response[past] = -np.inf
        best = np.full((len(counts), FILTERS), 0.0, np.float32)
        if filled.any():
            best[filled] = np.maximum.reduceat(response, first[filled], axis=0)
        pooled.append(np.where(filled[:, None], best + bias, 0.0))
        at.append((response, first, ends))
    return np.concatenate(pooled, axis=1), at, vectors, place


def logits(model: ToxicityModel, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    pooled = _pooled(model, words, counts)[0]
    return np.maximum(pooled, 0) @ model.out + model.out_bias


def _language(model: ToxicityModel, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Index of the language whose words the text's words look most like."""
    row = np.repeat(np.arange(len(counts)), counts)
    odds = [np.bincount(row, model.word_odds[words[:, 0], c], len(counts)) for c in range(len(model.languages))]
    return np.argmax(np.stack(odds, axis=1), axis=1)


def score(model: ToxicityModel, texts: list[bytes]) -> np.ndarray:
    words, counts = features(texts)
    if model.thresholds is None:
        return np.zeros(len(texts))
    raw = logits(model, words, counts)
    shift = model.thresholds[_language(model, words, counts)]
    centre = np.log(DECISION / (1 - DECISION))
    return 1 / (1 + np.exp(-np.clip((raw - shift) * model.spread + centre, -40, 40)))


class _Adagrad:
    def __init__(self, shape):
        self.seen = np.full(shape, 1e-6, np.float32)

    def step(self, value: np.ndarray, grad: np.ndarray) -> None:
        self.seen += grad**2
        value -= RATE * grad / np.sqrt(self.seen)


def _untrained(rng: np.random.Generator) -> ToxicityModel:
    model = ToxicityModel(
        embed=rng.normal(0, 0.01, (1 << BUCKET_BITS, DIM)).astype(np.float32),
        filters=[rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        bias=[np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        out=np.abs(rng.normal(0, 0.3, FILTERS * len(WIDTHS))).astype(np.float32),
        out_bias=-1.0,
    )
    model.embed[0] = 0
    return model


def _first_steps(model: ToxicityModel) -> dict:
    return {
        "embed": np.full(model.embed.shape, 1e-6, np.float32),
        "filters": [_Adagrad(f.shape) for f in model.filters],
        "bias": [_Adagrad(b.shape) for b in model.bias],
        "out": _Adagrad(model.out.shape),
    }


def _class_weight(target: np.ndarray, share: float) -> np.ndarray:
    return np.where(target == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))


def _train_epochs(model: ToxicityModel, steps: dict, cached: list, rows: np.ndarray, target: np.ndarray,
                  weight: np.ndarray, rng: np.random.Generator, epochs: int) -> None:
    for _ in range(epochs):
        rng.shuffle(rows)
        for at in range(0, len(rows), BATCH):
            some = rows[at : at + BATCH]
            _train_batch(model, [_thinned(cached[i][0], rng) for i in some], target[some], weight[some], steps)


def fit(texts: list[bytes], toxic: list[int], langs: list[str | None], seed: int = 0) -> ToxicityModel:
    """One group in memory: train on three quarters of the labelled texts,
    calibrate on the rest (``train`` does this for a table)."""
    rng = np.random.default_rng(seed)
    model = _untrained(rng)
    target = np.array(toxic, np.float32)
    if len(set(toxic)) < 2:
        return model
    cached = [features([t]) for t in texts]
    order = rng.permutation(len(texts))
    train, held = order[len(order) // 4 :], order[: len(order) // 4]
    _train_epochs(model, _first_steps(model), cached, train, target, _class_weight(target, target.mean()), rng, EPOCHS)
    _fit_languages(model, cached, langs)
    _calibrate(model, cached, target, train, held)
    return model


def _thinned(words: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A text with words left out at random: a text with several telling words
    teaches each of them, not only the one found first."""
    words = words[rng.random(len(words)) < KEEP]
    return words, np.array([len(words)])


def _train_batch(model: ToxicityModel, batch: list, target: np.ndarray, weight: np.ndarray, steps: dict) -> None:
    words = np.concatenate([w for w, _ in batch])
    counts = np.concatenate([c for _, c in batch])
    pooled, at, vectors, place = _pooled(model, words, counts)
    active = np.maximum(pooled, 0)
    p = 1 / (1 + np.exp(-np.clip(active @ model.out + model.out_bias, -30, 30)))
    wrong = ((p - target) * weight / len(batch)).astype(np.float32)
    back = np.where(pooled > 0, wrong[:, None] * model.out[None, :], 0).astype(np.float32)
    word_at = np.full(len(vectors), -1, np.int64)
    word_at[place] = np.arange(len(words))
    grad_rows, grad_values = [], []
    for k, width in enumerate(WIDTHS):
        response, first, ends = at[k]
        grad = back[:, k * FILTERS : (k + 1) * FILTERS]
        kernel_grad = np.zeros_like(model.filters[k])
        for d in np.flatnonzero((counts > 0) & grad.any(axis=1)):
            best = first[d] + response[first[d] : ends[d]].argmax(axis=0)
            for j in range(width):
                kernel_grad[j] += vectors[best + j].T * grad[d]
                used = word_at[np.minimum(best + j, len(word_at) - 1)]
                real = used >= 0
                grad_rows.append(words[used[real]])
                grad_values.append((model.filters[k][j] * grad[d]).T[real])
        steps["filters"][k].step(model.filters[k], kernel_grad)
        steps["bias"][k].step(model.bias[k], grad.sum(axis=0))
    steps["out"].step(model.out, (active * wrong[:, None]).sum(axis=0).astype(np.float32))
    model.out_bias -= RATE * float(wrong.sum())
    if grad_rows:
        rows = np.concatenate(grad_rows)
        values = np.repeat(np.concatenate(grad_values)[:, None, :], rows.shape[1], axis=1).reshape(-1, DIM)
        unique, inverse = np.unique(rows.ravel(), return_inverse=True)
        grad = np.zeros((len(unique), DIM), np.float32)
        np.add.at(grad, inverse, values)
        grad[unique == 0] = 0
        steps["embed"][unique] += grad**2
        model.embed[unique] -= RATE * grad / np.sqrt(steps["embed"][unique])


def _set_languages(model: ToxicityModel, counts: np.ndarray) -> None:
    """Smoothed log frequencies of hashed words in each language."""
    odds = np.log((counts + 0.05) / (counts + 0.05).sum(axis=0))
    model.word_odds = (odds - odds.mean(axis=1, keepdims=True)).astype(np.float32)


def _fit_languages(model: ToxicityModel, cached: list, langs: list[str | None]) -> None:
    model.languages = sorted({x for x in langs if x is not None}) or [""]
    counts = np.zeros((1 << BUCKET_BITS, len(model.languages)))
    for (words, _), lang in zip(cached, langs):
        if lang is not None:
            counts[:, model.languages.index(lang)] += np.bincount(words[:, 0], minlength=1 << BUCKET_BITS)
    _set_languages(model, counts)


def _threshold(raw: np.ndarray, target: np.ndarray, times: np.ndarray | None = None) -> float:
    """Middle of the widest interval of thresholds with the fewest errors;
    ``times`` tells how often a value and class occur."""
    times = np.ones(len(raw)) if times is None else times
    order = np.argsort(raw, kind="stable")
    value, ones, zeros = raw[order], (target * times)[order], ((1 - target) * times)[order]
    errors = np.concatenate([[0], np.cumsum(ones)]) + np.concatenate([[zeros.sum()], zeros.sum() - np.cumsum(zeros)])
    edge = np.concatenate([[value[0] - 1], value, [value[-1] + 1]])
    gap = np.where(errors == errors.min(), np.diff(edge), -1)
    best = int(gap.argmax())
    return float((edge[best] + edge[best + 1]) / 2)


def _set_thresholds(model: ToxicityModel, raw: np.ndarray, lang: np.ndarray, target: np.ndarray, held: np.ndarray,
                    times: np.ndarray) -> None:
    """A threshold for each language, on texts the weights have not seen; on
    all texts for a language (or in total) that has too few of a class."""

    def enough(rows: np.ndarray) -> bool:
        return min(times[rows & (target == 1)].sum(), times[rows & (target == 0)].sum()) >= 10

    pool = held if enough(held) else np.ones(len(raw), bool)
    common = _threshold(raw[pool], target[pool], times[pool])
    model.thresholds = np.full(len(model.languages), common)
    for i in range(len(model.languages)):
        own = pool & (lang == i)
        if enough(own):
            model.thresholds[i] = _threshold(raw[own], target[own], times[own])
    margin = np.abs(raw - model.thresholds[lang])[pool]
    order = np.argsort(margin, kind="stable")
    reached = np.cumsum(times[pool][order])
    median = margin[order][np.searchsorted(reached, reached[-1] / 2)]
    model.spread = float(2.0 / max(median, 1e-3))


def _calibrate(model: ToxicityModel, cached: list, target: np.ndarray, train: np.ndarray, held: np.ndarray) -> None:
    raw = np.array([logits(model, w, c)[0] for w, c in cached])
    lang = np.array([_language(model, w, c)[0] for w, c in cached])
    unseen = np.zeros(len(cached), bool)
    unseen[held] = True
    _set_thresholds(model, raw, lang, target, unseen, np.ones(len(cached)))


# ---- training on a table --------------------------------------------------------

WIDE = 2 * DIM  # a row of weights: a word's vector and its squared gradients
PACKED = "k int, " + ", ".join(f"v{i} float" for i in range(WIDE))


def _dense(model: ToxicityModel, steps: dict) -> list[np.ndarray]:
    """The weights and squared gradients that are not per word."""
    seen = [s.seen for s in (*steps["filters"], *steps["bias"], steps["out"])]
    return [*model.filters, *model.bias, model.out, *seen]


def _pack(model: ToxicityModel, steps: dict, touched: np.ndarray) -> pa.Table:
    """Rows (k, values): a word's bucket as k, below 0 pieces of the rest."""
    flat = np.concatenate([*[x.ravel() for x in _dense(model, steps)], [model.out_bias]]).astype(np.float32)
    rest = np.zeros((math.ceil(len(flat) / WIDE), WIDE), np.float32)
    rest.ravel()[: len(flat)] = flat
    values = np.concatenate([np.concatenate([model.embed[touched], steps["embed"][touched]], axis=1), rest])
    keys = np.concatenate([touched, -1 - np.arange(len(rest))]).astype(np.int32)
    return pa.table([pa.array(keys), *[pa.array(values[:, i]) for i in range(WIDE)]],
                    names=["k", *[f"v{i}" for i in range(WIDE)]])


def _unpack(model: ToxicityModel, steps: dict, table: pa.Table) -> None:
    keys = table["k"].to_numpy()
    values = np.stack([table[f"v{i}"].to_numpy() for i in range(WIDE)], axis=1).astype(np.float32)
    words, rest = keys >= 0, keys < 0
    model.embed[keys[words]], steps["embed"][keys[words]] = values[words, :DIM], values[words, DIM:]
    flat, at = values[rest][np.argsort(-keys[rest])].ravel(), 0
    for part in _dense(model, steps):
        part[...] = flat[at : at + part.size].reshape(part.shape)
        at += part.size
    model.out_bias = float(flat[at])


def _train_round(rows: DataFrame, model: ToxicityModel, steps: dict, share: float, number: int, epochs: int) -> None:
    """Every group trains a copy of the weights; the copies are averaged."""
    shared = rows.sparkSession.sparkContext.broadcast((model, steps))

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("t", "ascending")])
        own, mine = copy.deepcopy(shared.value)
        target = table["y"].to_numpy().astype(np.float32)
        cached = [features([t]) for t in table["t"].to_pylist()]
        rng = np.random.default_rng([number, table["g"][0].as_py()])
        _train_epochs(own, mine, cached, np.arange(len(cached)), target, _class_weight(target, share), rng, epochs)
        touched = np.flatnonzero((own.embed != shared.value[0].embed).any(axis=1))
        return _pack(own, mine, touched)

    trained = rows.where(~F.col("held")).select("g", "h", "t", "y").groupBy("g").applyInArrow(work, PACKED)
    averaged = trained.groupBy("k").agg(*[F.avg(f"v{i}").cast("float").alias(f"v{i}") for i in range(WIDE)])
    _unpack(model, steps, averaged.toArrow())
    shared.unpersist()


def _count_languages(rows: DataFrame, model: ToxicityModel) -> None:
    """Word counts of each language over all rows."""
    names = [r.l for r in rows.where("l is not null").select("l").distinct().orderBy("l").collect()]
    model.languages = names or [""]
    place = {name: i for i, name in enumerate(names)}

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((max(len(place), 1), 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            for text, lang in zip(batch.column("t").to_pylist(), batch.column("l").to_pylist()):
                np.add.at(counts[place[lang]], features([text])[0][:, 0], 1)
        lang, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[lang, bucket])],
            names=["lang", "bucket", "n"],
        )

    found = rows.where("l is not null").select("t", "l").mapInArrow(work, "lang int, bucket int, n bigint")
    table = found.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((1 << BUCKET_BITS, len(model.languages)))
    counts[table["bucket"].to_numpy(), table["lang"].to_numpy()] = table["n"].to_numpy()
    _set_languages(model, counts)


def _calibrate_rows(rows: DataFrame, model: ToxicityModel) -> None:
    """Thresholds from the logits of all rows, counted in narrow bins."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, langs = [], []
            for text in batch.column("t").to_pylist():
                words, counts = features([text])
                raws.append(logits(shared.value, words, counts)[0])
                langs.append(_language(shared.value, words, counts)[0])
            at = np.floor(np.clip(np.array(raws), -MOST_LOGIT, MOST_LOGIT) * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(langs, np.int32)), batch.column("y"), batch.column("held"), pa.array(at)],
                names=["lang", "y", "held", "at"],
            )

    binned = rows.select("t", "y", "held").mapInArrow(work, "lang int, y int, held boolean, at int")
    table = binned.groupBy("lang", "y", "held", "at").count().toArrow()
    raw = (table["at"].to_numpy() + 0.5) / BINS
    target, times = table["y"].to_numpy().astype(float), table["count"].to_numpy().astype(float)
    _set_thresholds(model, raw, table["lang"].to_numpy(), target, np.array(table["held"].to_pylist(), bool), times)
    shared.unpersist()


def _size(rows: DataFrame):
    ones = F.sum("y").alias("ones")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("t")).alias("size"), ones).first()


def train(documents: DataFrame, labels: DataFrame, seed: int = 0) -> ToxicityModel:
    """Weights, language counts and thresholds from all labelled documents; a
    quarter of them, chosen by a hash, only calibrates (none does if the rest
    lacks a class). However many groups the rest is dealt into, each of its
    documents is trained on ``EPOCHS`` times."""
    model = _untrained(np.random.default_rng(seed))
    with Scratch(documents.sparkSession) as scratch:
        rows = labelled_texts(documents, labels, "toxic")
        rows = scratch.write(rows.withColumn("held", F.pmod("h", F.lit(4)) == 0), "toxicity-rows")
        size = _size(rows.where(~F.col("held")))
        if size.ones in (None, 0, size.n):
            rows = rows.withColumn("held", F.lit(False))
            size = _size(rows)
        if size.ones in (None, 0, size.n):
            return model
        groups = max(math.ceil(size.n / GROUP_ROWS), math.ceil(size.size / GROUP_BYTES))
        rows = rows.withColumn("g", F.pmod(F.xxhash64("h"), F.lit(groups)).cast("int"))
        steps = _first_steps(model)
        for number in range(ROUNDS):
            release_shuffles(documents.sparkSession)
            _train_round(rows, model, steps, size.ones / size.n, number, EPOCHS // ROUNDS)
        _count_languages(rows, model)
        _calibrate_rows(rows, model)
    return model


def score_documents(documents: DataFrame, model: ToxicityModel, text: str = "text", keep_text: bool = True) -> DataFrame:
    """All columns of ``documents`` plus ``score``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # fixed size: buckets x (DIM + languages) floats

    def work(column: pa.Array) -> Iterator[list[pa.Array]]:
        for _, texts in slices(column, SLICE):
            yield [pa.array(score(shared.value, texts), pa.float64())]

    return map_text(documents, text, [("score", "double")], work, keep_text)


def toxicity_digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted class of every document."""
    held = remainder("doc_id", 3) == 1
    model = train(documents.where(~held), labels.where(~held))
    scored = score_documents(documents.select("doc_id", "text"), model, keep_text=False)
    return scored.select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= DECISION).cast("int").alias("predicted")
    )
