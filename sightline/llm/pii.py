"""Personal data: exact patterns plus a skip-chain conditional random field.

The patterns find e-mail addresses, IP addresses, card numbers and phone
numbers. The field then labels every token that holds a digit or an at sign
(other tokens cannot be personal data of these kinds and are not variables):
neighbouring variables share chain potentials, and repeated or similar tokens
anywhere in a document (equal, or equal in their last seven digits) share skip
potentials, so what is a phone number in one place tends to be one in all.
Tokens inside pattern matches are held at their kind. Every other occurrence of
a held token shares a skip potential with each held one, however far away (a
held variable sends the same to all, so counts per kind stand for these edges);
the others are linked from one occurrence to the next. Loopy message passing
runs until no message of a document changes by ``TOLERANCE``, and tokens whose
marginal reaches ``CONFIDENCE`` become added spans (neighbouring tokens of one
kind form one).
A pattern match is never changed and an added span never overlaps one.

The potentials are fitted piecewise (edges by label association, unary weights
by pseudo-likelihood) on at most ``TRAIN_ROWS`` documents, those with the
smallest hash among the documents that have a variable. The pattern matches
are the labels, but a share ``HIDE`` of them is hidden: the tokens of a hidden
match tell their neighbours nothing, so a token must be known by itself, by
other matches or by other occurrences, as those that the patterns miss have to
be. ``evaluate`` hides matches that were not learned from and reports how many
of them the field finds and how much else it adds.

Every document is scanned whole, in slices of about ``SLICE_CHARS``
characters (a longer text is a slice of its own). Messages are kept as one row
of five numbers for each directed edge and sent in blocks of edges, so a text
dense in digits takes about half a kilobyte per token. A document whose
messages still swing after ``MOST_ROUNDS`` damped rounds is read as it stands.

Defined cases: null is the empty text, which has no spans; without training
documents only the patterns count; repeated rows get equal results; an empty
table gives an empty result; clashing extra columns are kept, new columns get
free names.
"""

from __future__ import annotations

import dataclasses
import hashlib
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.labelled import SAMPLE_CHARS, smallest_hashes
from sightline.llm.tables import map_text

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)  # 0 is "none"
TRAIN_ROWS = 3000
BUCKETS = 1 << 14
TOLERANCE = 1e-7
MOST_ROUNDS = 1000  # for messages that would swing for ever
HIDE = 0.5
SLICE_CHARS = 1 << 18
SLICE_ROWS = 256
BLOCK = 1 << 15
FEATURES = 12
CONFIDENCE = 0.9
HOLD = 30.0

_ANY = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits that fails at its first digit fails at the later ones too
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'()[]{}<>|*#$%&"

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each at sign takes the run of local characters
    before it, as far as the previous match lets it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at)
        if domain and start < at:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """Spans of all patterns, by start and then kind."""
    found: list[Span] = []
    if not _ANY.search(text):
        return found
    found += [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        # leading zeros go first: int() refuses very long digit strings
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in m.group().split("."))):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


# --- the field -----------------------------------------------------------------


@dataclass
class Graph:
    """Variables of a slice of documents and the edges between them."""

    row: np.ndarray  # document of each variable
    start: np.ndarray
    end: np.ndarray
    label: np.ndarray  # from the patterns
    match: np.ndarray  # number of the pattern match a variable is in, or -1
    bucket: np.ndarray  # variables x FEATURES
    entry: np.ndarray  # number of each variable's document and token
    chain: np.ndarray  # edges x 2
    skip: np.ndarray  # edges x 2, an occurrence and the next


def _shape(token: str) -> str:
    out = re.sub(r"[0-9]", "9", token)
    return re.sub(r"[^\W\d_]+", "a", out)


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


def _features(token: str, before: str, after: str) -> list[int]:
    core = token.strip(_EDGE)
    digits = _digits(core)
    parts = core.split(".")
    octets = len(parts) == 4 and all(re.fullmatch(r"[0-9]{1,3}", p) and int(p) <= 255 for p in parts)
    names = [
        "bias", f"shape={_shape(core)[:40]}", f"full={_shape(token)[:40]}", f"digits={min(len(digits), 20)}",
        f"at={'@' in core}", f"dots={min(core.count('.'), 5)}", f"plus={token[0] == '+'}",
        f"luhn={12 <= len(digits) <= 19 and luhn(digits)}/{len(digits) == len(core)}", f"octets={octets}",
        f"before={_shape(before)[:20]}", f"after={_shape(after)[:20]}", f"word={before.lower().strip(_EDGE)[:20]}",
    ]
    return [_bucket(n) for n in names]


def _similar(token: str) -> str:
    core = token.strip(_EDGE).lower()
    digits = _digits(core)
    return digits[-7:] if len(digits) >= 7 and "@" not in core else core


def _tokens(text: str) -> Iterator[tuple[int, int, int, str, str, str]]:
    """(number, start, end, token, token before, token after) of each token
    with a digit or an at sign."""
    before, held, number = "", None, 0
    for m in _TOKEN.finditer(text):
        token = m.group()
        if held is not None:
            yield (*held, token)
            held = None
        if _ANY.search(token):
            held = (number, m.start(), m.end(), token, before)
        before, number = token, number + 1
    if held is not None:
        yield (*held, "")


def build_graph(texts: list[str], spans: list[list[Span]]) -> Graph:
    row, start, end, label, match, entry = (array("i") for _ in range(6))
    bucket, chain, skip = array("i"), array("i"), array("i")
    matches, entries = 0, 0
    for r, text in enumerate(texts):
        if not _ANY.search(text):
            continue
        seen: dict[int, list[int]] = {}  # hash of the token -> its entry and last occurrence
        own, at, last = spans[r], 0, -2
        for number, a, b, token, before, after in _tokens(text):
            node = len(row)
            while at < len(own) and own[at][2] <= a:
                at += 1
            # a token may touch the few spans around this place
            near = range(max(0, at - 4), min(len(own), at + 8))
            found = next((i for i in near if own[i][0] < b and own[i][2] > a), None)
            row.append(r)
            start.append(a)
            end.append(b)
            label.append(0 if found is None else own[found][1] + 1)
            match.append(-1 if found is None else matches + found)
            bucket.extend(_features(token, before, after))
            if number == last + 1:
                chain.extend((node - 1, node))
            last = number
            key = xxhash.xxh64_intdigest(_similar(token).encode())
            known = seen.get(key)
            if known is None:
                seen[key] = known = array("i", (entries, node))
                entries += 1
            else:
                skip.extend((known[1], node))
                known[1] = node
            entry.append(known[0])
        matches += len(own)
    ints = [np.array(x, np.int32) for x in (row, start, end, label, match)]
    wide = np.array(bucket, np.int32).reshape(-1, FEATURES)
    pairs = [np.array(e, np.int32).reshape(-1, 2) for e in (chain, skip)]
    return Graph(*ints, wide, np.array(entry, np.int32), *pairs)


@dataclass
class FieldModel:
    unary: np.ndarray  # buckets x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray  # labels x labels, symmetric


def _unary(model: FieldModel, graph: Graph) -> np.ndarray:
    out = np.empty((len(graph.row), LABELS))
    for a in range(0, len(out), BLOCK):
        out[a : a + BLOCK] = model.unary[graph.bucket[a : a + BLOCK]].sum(axis=1)
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _association(a: np.ndarray, b: np.ndarray, labels: np.ndarray, symmetric: bool) -> np.ndarray:
    """Smoothed log ratio of how often two labels meet on an edge to how often
    they would by chance."""
    met = np.zeros((LABELS, LABELS))
    np.add.at(met, (labels[a], labels[b]), 1)
    if symmetric:
        met = (met + met.T) / 2
    chance = met.sum(axis=1, keepdims=True) * met.sum(axis=0, keepdims=True) / max(met.sum(), 1)
    return np.log((met + 0.5) / (chance + 0.5))


def fit(texts: list[str], steps: int = 300, rate: float = 0.2, l2: float = 1e-4, hide: float = HIDE) -> FieldModel:
    """Piecewise: the edge potentials are label associations over all edges,
    then the unary weights maximise each variable's likelihood given the
    labels of its neighbours that are not hidden."""
    model = FieldModel(np.zeros((BUCKETS, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)))
    graph = build_graph(texts, [base_spans(t) for t in texts])
    n = len(graph.row)
    if not n:
        return model
    y = graph.label
    seen = np.full(model.unary.shape, 1e-8)
    (ca, cb), (sa, sb) = graph.chain.T, graph.skip.T
    model.chain = _association(ca, cb, y, False)
    model.skip = _association(sa, sb, y, True)
    shown = ~_hidden(graph, hide)
    around = np.zeros((n, LABELS))
    for source, target, table in ((ca, cb, model.chain), (cb, ca, model.chain.T), (sa, sb, model.skip), (sb, sa, model.skip)):
        tells = shown[source]
        np.add.at(around, target[tells], table[y[source[tells]]])
    for _ in range(steps):
        wrong = _softmax(_unary(model, graph) + around)
        wrong[np.arange(n), y] -= 1
        grad = l2 * model.unary
        for a in range(0, n, BLOCK):
            np.add.at(grad, graph.bucket[a : a + BLOCK], wrong[a : a + BLOCK, None, :] / n)
        seen += grad**2
        model.unary -= rate * grad / np.sqrt(seen)
    return model


def _hidden(graph: Graph, share: float, seed: int = 0) -> np.ndarray:
    """Variables of a random share of the pattern matches."""
    draw = np.random.default_rng(seed).random(int(graph.match.max(initial=-1)) + 1) < share
    return (graph.match >= 0) & draw[graph.match] if len(draw) else np.zeros(len(graph.row), bool)


def _send(total: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum-product message of each row of beliefs through a potential."""
    top = total.max(axis=1, keepdims=True)
    out = np.log(np.exp(total - top) @ np.exp(table))
    return out - out.max(axis=1, keepdims=True)


def marginals(model: FieldModel, graph: Graph, rounds: int = MOST_ROUNDS) -> np.ndarray:
    """Label marginals by loopy sum-product message passing (damped), each
    document until its messages rest."""
    belief = _unary(model, graph)
    if not len(belief):
        return belief
    held = graph.label > 0
    belief[held, graph.label[held]] += HOLD
    if held.any():  # every other occurrence hears each held one directly
        told = np.zeros((int(graph.entry.max()) + 1, LABELS))
        np.add.at(told, (graph.entry[held], graph.label[held]), 1)
        heard = np.flatnonzero(~held & told.any(axis=1)[graph.entry])
        belief[heard] += told[graph.entry[heard]] @ model.skip
    skip = graph.skip[~held[graph.skip].any(axis=1)]
    ends = np.concatenate([graph.chain, skip])
    if not len(ends):
        return _softmax(belief)
    # directed edges: all in one direction, then all in the other
    source, target = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
    half = len(ends)
    reverse = np.concatenate([np.arange(half, 2 * half, dtype=np.int32), np.arange(half, dtype=np.int32)])
    kind = np.concatenate([np.zeros(len(graph.chain), np.int8), np.full(len(skip), 2, np.int8)])
    kind = np.concatenate([kind, np.where(kind == 0, 1, 2).astype(np.int8)])
    tables = (model.chain, model.chain.T, model.skip)
    message = np.zeros((2 * half, LABELS))
    for _ in range(rounds):
        total = belief.copy()
        for a in range(0, len(source), BLOCK):
            np.add.at(total, target[a : a + BLOCK], message[a : a + BLOCK])
        moving = np.zeros(int(graph.row[-1]) + 1, bool)
        step = np.empty_like(message)
        for a in range(0, len(source), BLOCK):
            own = slice(a, a + BLOCK)
            asked = total[source[own]] - message[reverse[own]]
            for k, table in enumerate(tables):
                chosen = np.flatnonzero(kind[own] == k)
                if len(chosen):
                    asked[chosen] = _send(asked[chosen], table)
            step[own] = 0.5 * (asked - message[own])
            moving[graph.row[source[own][np.abs(step[own]).max(axis=1) > TOLERANCE]]] = True
        message += step
        live = moving[graph.row[source]]
        if not live.all():
            # documents at rest leave with all their edges
            np.add.at(belief, target[~live], message[~live])
            reverse = (np.cumsum(live, dtype=np.int32) - 1)[reverse[live]]
            source, target, kind, message = source[live], target[live], kind[live], message[live]
            if not len(source):
                break
    np.add.at(belief, target, message)
    return _softmax(belief)


def added_spans(model: FieldModel, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """Spans the field adds to the pattern matches of each text."""
    return _spans_of(model, build_graph(texts, base), texts, base)


def _spans_of(model: FieldModel, graph: Graph, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    out: list[list[Span]] = [[] for _ in texts]
    if not len(graph.row):
        return out
    p = marginals(model, graph)
    label = np.where(p.max(axis=1) >= CONFIDENCE, p.argmax(axis=1), 0)
    label[graph.label > 0] = 0
    found = np.flatnonzero(label)
    joined = {int(b): int(a) for a, b in graph.chain[np.isin(graph.chain[:, 1], found)]}
    open_span: dict[int, list[int]] = {}
    for node in found:
        r, kind, text = graph.row[node], int(label[node]), texts[graph.row[node]]
        a, b = int(graph.start[node]), int(graph.end[node])
        while a < b and text[a] in _EDGE and text[a] != "(":
            a += 1
        while b > a and text[b - 1] in _EDGE and text[b - 1] != ")":
            b -= 1
        before = open_span.get(joined.get(int(node), -1))
        if before and before[1] == kind:
            before[2] = b
            open_span[int(node)] = before
        elif a < b:
            open_span[int(node)] = span = [a, kind, b, int(r)]
            out[r].append(span)
    return [_admit(spans, base[r], texts[r]) for r, spans in enumerate(out)]


LEAST_DIGITS = {1: 0, 2: 4, 3: 12, 4: 7}


def _admit(spans: list, base: list[Span], text: str) -> list[Span]:
    """Added spans that hold enough of their kind and overlap no pattern match."""
    kept = []
    for a, label, b, _ in spans:
        enough = len(_digits(text[a:b])) >= LEAST_DIGITS[label] and (label != 1 or "@" in text[a:b])
        if enough and not any(s < b and e > a for s, _, e in base):
            kept.append((a, label - 1, b))
    return kept


def evaluate(model: FieldModel, texts: list[str], share: float = 0.5, seed: int = 1) -> dict[str, int]:
    """Hides a share of the pattern matches of ``texts`` (which should not
    have been learned from) and lets the field look for them: how many are
    ``hidden``, of them ``found`` (every token of the match in an added span of
    its kind) and ``found_repeats`` of ``repeats`` (matches with a token that a
    match still shown has too), spans ``added`` in all and those of them that
    touch no match (``elsewhere``)."""
    base = [base_spans(t) for t in texts]
    graph = build_graph(texts, base)
    hidden = _hidden(graph, share, seed)
    shown = {int(e) for e in graph.entry[(graph.label > 0) & ~hidden]}
    masked = dataclasses.replace(graph, label=np.where(hidden, 0, graph.label))
    lost = {int(m) for m in graph.match[hidden]}
    visible, at = [], 0
    for spans in base:
        visible.append([s for i, s in enumerate(spans, at) if i not in lost])
        at += len(spans)
    added = _spans_of(model, masked, texts, visible)
    out = dict.fromkeys(("hidden", "found", "repeats", "found_repeats", "added", "elsewhere"), 0)
    tokens: dict[int, list[int]] = {}
    for node in np.flatnonzero(hidden):
        tokens.setdefault(int(graph.match[node]), []).append(int(node))
    for nodes in tokens.values():
        r, kind = int(graph.row[nodes[0]]), int(graph.label[nodes[0]]) - 1
        hit = all(any(k == kind and a < graph.end[v] and b > graph.start[v] for a, k, b in added[r]) for v in nodes)
        repeat = any(int(graph.entry[v]) in shown for v in nodes)
        out["hidden"] += 1
        out["found"] += hit
        out["repeats"] += repeat
        out["found_repeats"] += hit and repeat
    for spans, all_spans in zip(added, base):
        out["added"] += len(spans)
        out["elsewhere"] += sum(not any(s < b and e > a for s, _, e in all_spans) for a, _, b in spans)
    return out


def _text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def train(documents: DataFrame, rows: int = TRAIN_ROWS) -> FieldModel:
    """Fit on a bounded sample of the documents that have variables."""
    usable = documents.where(F.col("text").rlike("[0-9@]") & (F.length("text") <= SAMPLE_CHARS)).select(
        F.xxhash64("doc_id", "text").alias("h"), "text"
    )
    return fit([r.text for r in smallest_hashes(usable, rows, usable.count()).collect()])


RESULT = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
TYPES = ["bigint"] * 4 + ["string", "string", "bigint"]


def find(documents: DataFrame, model: FieldModel, text: str = "text", keep_text: bool = True) -> DataFrame:
    """All columns of ``documents`` plus pattern counts (``n_<kind>``), the
    hash of the pattern spans, all spans, and how many the field added."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # buckets x labels floats

    def work(column: pa.Array) -> Iterator[list[pa.Array]]:
        for texts in _slices(column):
            rows: list[tuple] = []
            base = [base_spans(t) for t in texts]
            for b, extra in zip(base, added_spans(shared.value, texts, base)):
                counts = [sum(k == kind for _, k, _ in b) for kind in range(len(KINDS))]
                digest = hashlib.sha256(_text(b).encode()).hexdigest()
                rows.append((*counts, digest, _text(b + extra), len(extra)))
            yield [pa.array(c, pa.int64() if t == "bigint" else pa.string()) for c, t in zip(zip(*rows), TYPES)]

    return map_text(documents, text, list(zip(RESULT, TYPES)), work, keep_text)


def _slices(column: pa.Array) -> Iterator[list[str]]:
    """Texts of about SLICE_CHARS characters and at most SLICE_ROWS rows."""
    lengths = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
    at, total = 0, 0
    for i, n in enumerate(lengths):
        if i > at and (total + n > SLICE_CHARS or i - at >= SLICE_ROWS):
            yield [t or "" for t in column.slice(at, i - at).to_pylist()]
            at, total = i, 0
        total += n
    if at < len(lengths):
        yield [t or "" for t in column.slice(at).to_pylist()]


def pii_digest(documents: DataFrame) -> DataFrame:
    """doc_id, pattern counts, hash of the pattern spans, all spans."""
    return find(documents.select("doc_id", "text"), train(documents), keep_text=False)
