"""Benchmark decontamination with a distributed positional inverted index.

The training documents are indexed in segments: each row of the index table
holds the documents of a segment and, for every term, the sorted list of its
positions. Positions number the words of all documents of the segment, with a
gap between documents, so a phrase never crosses one. Each segment answers
phrase queries by itself: a query's offset-adjusted lists are intersected
starting with its rarest term, all queries at once. An exact occurrence has
every term at its offset; a proximity match has its first term at its start
and every other term within ``slop`` words of its offset.

The queries are windows of consecutive benchmark words. A Spark job hashes the
words of the distinct benchmark rows and cuts them into pieces of at most
``PIECE_WINDOWS`` windows. Pieces whose windows all fit into
``BROADCAST_BYTES`` (counted first) are broadcast to the segments. More of
them are routed: a piece goes to the segments that hold the corpus-rarest term
of one of its windows, and a segment's pieces stream past it after it was
decoded. Either way every segment is decoded once, in one job, whatever the
size of the benchmark. Matches that cross pieces of one long item are several
overlapping runs; hits count each word once.

Defined cases: null text has no words and matches nothing; items of fewer
words than a window are one window, items without words none; several items
may share an id and count once; an item with a null id marks words but is not
listed; repeated documents are indexed each on its own; empty tables give
empty results (documents) or no hit (benchmark); extra columns are ignored by
the digest and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.tables import ROW, ROW_ID, ROW_KEY, materialise, quoted, same_row
from sightline.llm.textkit import byte_class, join_rows, prefix_sums, slices, span_hash, tokens

WINDOW = 10
SLOP = 1
GAP = 64  # positions between documents; larger than a window plus twice any slop
SEGMENT_BYTES = 4 << 20
PIECE_WINDOWS = 64
BROADCAST_BYTES = 32 << 20  # of the windows of all pieces; their words are a tenth of them
SEARCH_BYTES = 8 << 20  # of the windows searched at a time
CANDIDATES = 1 << 20  # postings looked at together (or those of one query)

_WORD = byte_class({*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)})

INDEX_SCHEMA = (
    "segment bigint, doc_ids array<bigint>, keys array<bigint>, n_words array<bigint>, "
    "terms binary, counts binary, steps binary"
)


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of all words of the lower-cased texts, and words per text."""
    buf, offsets = join_rows([t.lower() for t in texts])
    start, end = tokens(buf, _WORD)
    return span_hash(prefix_sums(buf), start, end), np.diff(np.searchsorted(start, offsets))


def invert(terms: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms, postings of each, and the position steps of all lists."""
    order = np.argsort(terms, kind="stable")
    terms, positions = terms[order], positions[order]
    first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
    steps = np.diff(positions, prepend=0)
    steps[first] = positions[first]
    counts = np.diff(np.append(first, len(terms)))
    return terms[first], counts.astype(np.uint32), steps.astype(np.uint32)


@dataclass
class Segment:
    """Decoded postings: sorted terms and one sorted array of
    (term number << 32 | position)."""

    terms: np.ndarray
    counts: np.ndarray
    first: np.ndarray
    keys: np.ndarray

    @classmethod
    def decode(cls, terms: bytes, counts: bytes, steps: bytes) -> Segment:
        t = np.frombuffer(terms, np.uint64)
        n = np.frombuffer(counts, np.uint32).astype(np.int64)
        total = np.cumsum(np.frombuffer(steps, np.uint32).astype(np.int64))
        first = np.cumsum(n) - n
        before = np.where(first > 0, total[np.maximum(first - 1, 0)], 0) if len(t) else first
        position = total - np.repeat(before, n)
        return cls(t, n, first, (np.repeat(np.arange(len(t)), n) << 32) | position)


def search(segment: Segment, queries: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, start, exact) of the matches of equally long queries.

    ``queries`` is a matrix of term hashes. Candidates come from the list of
    each query's rarest term and are narrowed term by term, rarest first, a
    bounded number of them at a time.
    """
    nothing = np.zeros(0, np.int64)
    if not len(segment.terms) or not len(queries):
        return nothing, nothing, nothing.astype(bool)
    number = np.searchsorted(segment.terms, queries)
    number = np.minimum(number, len(segment.terms) - 1)
    live = np.flatnonzero((segment.terms[number] == queries).all(axis=1))
    number = number[live]
    order = np.argsort(segment.counts[number], axis=1, kind="stable")
    rarest = number[np.arange(len(live)), order[:, 0]]
    share = np.cumsum(segment.counts[rarest]) // CANDIDATES
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(share)) + 1, [len(live)]])
    parts = [
        _search_some(segment, number[i:j], order[i:j], rarest[i:j], live[i:j], slop) for i, j in zip(cuts[:-1], cuts[1:])
    ]
    return tuple(np.concatenate(column) for column in zip(*parts))


def _search_some(segment: Segment, number, order, rarest, names, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def within(query, offset, at, reach):
        """Whether the term at ``offset`` occurs within ``reach`` of ``at``."""
        base = number[query, offset] << 32
        here = np.searchsorted(segment.keys, base | np.maximum(at - reach, 0))
        value = segment.keys[np.minimum(here, len(segment.keys) - 1)]
        return (here < len(segment.keys)) & (value >= base) & (value <= (base | np.maximum(at + reach, 0)))

    n = segment.counts[rarest]
    query = np.repeat(np.arange(len(rarest)), n)
    nth = np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n)
    start = (segment.keys[segment.first[rarest][query] + nth] & 0xFFFFFFFF) - order[query, 0]
    # the rarest term may itself be out of its place by the slop
    for rank in range(1, order.shape[1]):
        offset = order[query, rank]
        ok = within(query, offset, start + offset, 2 * slop)
        query, start = query[ok], start[ok]
    exact = np.ones(len(query), bool)
    if slop:
        shifts = np.arange(-slop, slop + 1)
        query, start = np.repeat(query, len(shifts)), (start[:, None] + shifts).ravel()
        ok = (start >= 0) & within(query, 0, start, 0)
        pairs = np.unique(np.stack([query[ok], start[ok]]), axis=1)
        query, start = pairs
        exact = np.ones(len(query), bool)
        for offset in range(1, order.shape[1]):
            ok = within(query, offset, start + offset, slop)
            query, start, exact = query[ok], start[ok], exact[ok]
            exact &= within(query, offset, start + offset, 0)
    return names[query], start, exact


def _index_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    serial, state = TaskContext.get().partitionId() << 32, None
    for batch in batches:
        ids, keys = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()
        for row, texts in slices(batch.column("text")):
            if state is None:
                state = {"ids": [], "keys": [], "n": [], "terms": [], "at": [], "next": GAP, "bytes": 0}
            terms, counts = terms_of(texts)
            base = state["next"] + np.concatenate([[0], np.cumsum(counts + GAP)])
            row_base = base[:-1] - (np.cumsum(counts) - counts)
            state["at"].append(np.arange(len(terms)) + np.repeat(row_base, counts))
            state["terms"].append(terms)
            state["ids"] += ids[row : row + len(texts)]
            state["keys"] += keys[row : row + len(texts)]
            state["n"] += counts.tolist()
            state["next"] = int(base[-1])
            state["bytes"] += sum(map(len, texts))
            if state["bytes"] >= SEGMENT_BYTES:
                yield _close_segment(serial, state)
                serial, state = serial + 1, None
    if state is not None:
        yield _close_segment(serial, state)


def _close_segment(segment: int, state: dict) -> pa.RecordBatch:
    terms, counts, steps = invert(np.concatenate(state["terms"]), np.concatenate(state["at"]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([segment], pa.int64()),
            pa.array([state["ids"]], pa.list_(pa.int64())),
            pa.array([state["keys"]], pa.list_(pa.int64())),
            pa.array([state["n"]], pa.list_(pa.int64())),
            pa.array([terms.tobytes()], pa.binary()),
            pa.array([counts.tobytes()], pa.binary()),
            pa.array([steps.tobytes()], pa.binary()),
        ],
        names=["segment", "doc_ids", "keys", "n_words", "terms", "counts", "steps"],
    )


def build_index(documents: DataFrame) -> DataFrame:
    """The written index of all documents (``doc_id``, ``text``)."""
    source = documents.select("doc_id", F.xxhash64("text").alias("key"), "text")
    built, _ = materialise(source.mapInArrow(_index_partition, INDEX_SCHEMA), "positional-index", compression="zstd")
    return built


def indexed_documents(index: DataFrame) -> DataFrame:
    """segment, ordinal, doc_id, key, n_words of every indexed document."""
    zipped = F.arrays_zip("doc_ids", "keys", "n_words")
    return index.select("segment", F.posexplode(zipped).alias("ordinal", "d")).select(
        "segment", "ordinal", F.col("d.doc_ids").alias("doc_id"), F.col("d.keys").alias("key"),
        F.col("d.n_words").alias("n_words"),
    )


PIECE_SCHEMA = "piece bigint, bytes bigint, item_id bigint, size int, terms binary"


def _piece_partition(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Numbered pieces of at most ``PIECE_WINDOWS`` windows."""
    from pyspark import TaskContext

    number, types = TaskContext.get().partitionId() << 40, [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def close(rows: list[tuple]) -> pa.RecordBatch:
        names = ["piece", "bytes", "item_id", "size", "terms"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for batch in batches:
        rows = []
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text")):
            terms, _ = terms_of([text.as_py().encode()])
            size = min(width, len(terms))
            # consecutive pieces overlap by all but one word of a window
            for at in range(0, len(terms) - size + 1 if size else 0, PIECE_WINDOWS):
                piece = terms[at : at + PIECE_WINDOWS + size - 1]
                rows.append((number, 8 * size * (len(piece) - size + 1), item, size, piece.tobytes()))
                number += 1
                if len(rows) == 10_000:
                    yield close(rows)
                    rows = []
        if rows:
            yield close(rows)


def benchmark_pieces(benchmark: DataFrame, width: int) -> DataFrame:
    """The written pieces of the distinct items."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    return materialise(items.mapInArrow(lambda b: _piece_partition(b, width), PIECE_SCHEMA), "benchmark-pieces")[0]


def windows(pieces: list[tuple[int, bytes]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (number of the piece of each window, matrix of term hashes)."""
    found: dict[int, tuple[list, list]] = {}
    for number, (size, terms) in enumerate(pieces):
        owners, rows = found.setdefault(size, ([], []))
        view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(terms, np.uint64), size)
        rows.append(view)
        owners.append(np.full(len(view), number, np.int64))
    return {size: (np.concatenate(o), np.concatenate(r)) for size, (o, r) in found.items()}


MATCH_SCHEMA = "segment bigint, ordinal int, item_id bigint, size int, start bigint, stop bigint, kind string"


def _runs(query_item: np.ndarray, start: np.ndarray, size: int, doc_start: np.ndarray, n_words: np.ndarray) -> tuple:
    """Merge overlapping matches of an item in a document into word runs."""
    ordinal = np.searchsorted(doc_start, start, side="right") - 1
    local = start - doc_start[ordinal]
    order = np.lexsort((local, query_item, ordinal))
    ordinal, item, local = ordinal[order], query_item[order], local[order]
    new = np.ones(len(local), bool)
    new[1:] = (ordinal[1:] != ordinal[:-1]) | (item[1:] != item[:-1]) | (local[1:] > local[:-1] + size)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(local)) - 1
    return ordinal[head], item[head], local[head], np.minimum(local[tail] + size, n_words[ordinal[head]])


@dataclass
class _Open:
    """A decoded segment and where its documents start."""

    number: int
    postings: Segment
    n_words: np.ndarray
    doc_start: np.ndarray

    @classmethod
    def read(cls, batch: pa.RecordBatch, i: int) -> _Open:
        row = {c: batch.column(c)[i] for c in ("segment", "n_words", "terms", "counts", "steps")}
        n = row["n_words"].values.to_numpy().astype(np.int64)
        postings = Segment.decode(*(row[c].as_buffer() for c in ("terms", "counts", "steps")))
        return cls(row["segment"].as_py(), postings, n, GAP + np.cumsum(n + GAP) - (n + GAP))

    def matches(self, ids: list, queries: dict, slop: int) -> Iterator[pa.RecordBatch]:
        for size, (owner, matrix) in queries.items():
            query, start, exact = search(self.postings, matrix, slop)
            for kind, which in (("phrase", exact), ("proximity", ~exact)):
                if not which.any():
                    continue
                o, item, a, b = _runs(owner[query[which]], start[which], size, self.doc_start, self.n_words)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(o), self.number, np.int64)), pa.array(o.astype(np.int32)),
                        pa.array([ids[x] for x in item], pa.int64()), pa.array(np.full(len(o), size, np.int32)),
                        pa.array(a), pa.array(b), pa.array([kind] * len(o), pa.string()),
                    ],
                    names=["segment", "ordinal", "item_id", "size", "start", "stop", "kind"],
                )


def match(index: DataFrame, shared: Broadcast, slop: int = 0) -> DataFrame:
    """Matches of broadcast benchmark pieces: segment, ordinal, item_id, words
    of a window, first and last word (exclusive) and kind: ``phrase``, or
    ``proximity`` for windows that only match within ``slop``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = [item for item, _, _ in shared.value], None
        for batch in batches:
            for i in range(batch.num_rows):
                queries = queries or windows([(size, terms) for _, size, terms in shared.value])
                yield from _Open.read(batch, i).matches(ids, queries, slop)

    return index.select("segment", "n_words", "terms", "counts", "steps").mapInArrow(run, MATCH_SCHEMA)


def _dictionary_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            terms = np.frombuffer(batch.column("terms")[i].as_buffer(), np.int64)
            counts = np.frombuffer(batch.column("counts")[i].as_buffer(), np.uint32).astype(np.int64)
            segment = np.full(len(terms), batch.column("segment")[i].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(segment), pa.array(counts)], names=["term", "segment", "n"])


def _term_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            terms = np.unique(np.frombuffer(batch.column("terms")[i].as_buffer(), np.int64))
            piece = np.full(len(terms), batch.column("piece")[i].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(terms)], names=["piece", "term"])


def _rarest_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, term) of the corpus-rarest terms of the windows of a piece;
    ``known`` are the piece's terms that the corpus has, with their counts."""
    for batch in batches:
        for i in range(batch.num_rows):
            known = batch.column("known")[i].values
            term, n = (known.field(c).to_numpy(zero_copy_only=False) for c in ("term", "n"))
            order = np.argsort(term)
            term, n = term[order], n[order]
            terms = np.frombuffer(batch.column("terms")[i].as_buffer(), np.int64)
            rows = np.lib.stride_tricks.sliding_window_view(terms, batch.column("size")[i].as_py())
            at = np.minimum(np.searchsorted(term, rows), len(term) - 1)
            at = at[(term[at] == rows).all(axis=1)]
            if not len(at):
                continue
            rare = np.unique(term[at[np.arange(len(at)), np.argmin(n[at], axis=1)]])
            piece = np.full(len(rare), batch.column("piece")[i].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(rare)], names=["piece", "term"])


def routes(index: DataFrame, pieces: DataFrame) -> DataFrame:
    """Distinct (segment, piece) of the segments that hold the corpus-rarest
    term of a window of a piece, all of whose terms the corpus has. No other
    segment can hold a match of the piece."""
    dictionary = index.select("segment", "terms", "counts").mapInArrow(
        _dictionary_partition, "term bigint, segment bigint, n bigint"
    )
    wanted = pieces.select("piece", "terms").mapInArrow(_term_partition, "piece bigint, term bigint")
    frequency = dictionary.groupBy("term").agg(F.sum("n").alias("n"))
    known = wanted.join(frequency, "term").groupBy("piece").agg(F.collect_list(F.struct("term", "n")).alias("known"))
    rarest = pieces.join(known, "piece").select("piece", "size", "terms", "known").mapInArrow(
        _rarest_partition, "piece bigint, term bigint"
    )
    return dictionary.join(rarest, "term").select("segment", "piece").distinct()


def match_routed(index: DataFrame, pieces: DataFrame, slop: int = 0) -> DataFrame:
    """The matches of ``match`` for pieces of any number: each segment is
    followed, in one sorted partition, by the pieces routed to it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, waiting, filled = None, [], [], 0

        def answer() -> Iterator[pa.RecordBatch]:
            if waiting:
                yield from here.matches(ids, windows(waiting), slop)

        for batch in batches:
            after = batch.column("piece").to_pylist()
            for i, piece in enumerate(after):
                if piece is None or filled >= SEARCH_BYTES:
                    yield from answer()
                    ids, waiting, filled = [], [], 0
                if piece is None:
                    here = _Open.read(batch, i)
                    continue
                ids.append(batch.column("item_id")[i].as_py())
                waiting.append((batch.column("size")[i].as_py(), batch.column("terms")[i].as_py()))
                filled += batch.column("bytes")[i].as_py()
        yield from answer()

    none = {"piece": "bigint", "bytes": "bigint", "item_id": "bigint", "size": "int"}
    segments = index.select(
        "segment", "n_words", "terms", "counts", "steps", *[F.lit(None).cast(t).alias(c) for c, t in none.items()]
    )
    routed = routes(index, pieces).join(pieces, "piece")
    rows = segments.unionByName(routed, allowMissingColumns=True)
    return rows.repartition("segment").sortWithinPartitions("segment", F.col("piece").asc_nulls_first()).mapInArrow(
        run, MATCH_SCHEMA
    )


def matches(
    index: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = 0, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """The written matches of all benchmark windows: segment, ordinal,
    item_id, size, start, stop, kind."""
    if width + 2 * slop >= GAP:
        raise ValueError(f"a window and twice the slop must stay below {GAP} words")
    pieces = benchmark_pieces(benchmark, width)
    if (pieces.agg(F.sum("bytes").alias("n")).first()["n"] or 0) > broadcast_bytes:
        return materialise(match_routed(index, pieces, slop), "benchmark-matches")[0]
    rows = [(r["item_id"], r["size"], bytes(r["terms"])) for r in pieces.select("item_id", "size", "terms").collect()]
    shared = index.sparkSession.sparkContext.broadcast(rows)  # counted above
    found, _ = materialise(match(index, shared, slop), "benchmark-matches")
    shared.destroy()
    return found


def _covered(runs: str):
    """Number of words in a union of [start, stop) runs."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("end"))

    def add(state, run):
        gain = F.greatest(run["stop"] - F.greatest(run["start"], state["end"]), F.lit(0).cast("bigint"))
        return F.struct((state["n"] + gain).alias("n"), F.greatest(state["end"], run["stop"]).alias("end"))

    return F.aggregate(F.array_sort(runs), zero, add)["n"]


def hits(found: DataFrame) -> DataFrame:
    """Per document with a match: n_hit words in phrases and their items, and
    n_near words in windows of ``WINDOW`` words that match as a phrase or by
    proximity."""
    phrase, near = F.col("kind") == "phrase", F.col("size") == WINDOW
    grouped = found.groupBy("segment", "ordinal").agg(
        F.collect_set(F.when(phrase, F.struct("start", "stop"))).alias("_runs"),
        F.collect_set(F.when(near, F.struct("start", "stop"))).alias("_near"),
        F.array_sort(F.collect_set(F.when(phrase, F.col("item_id").cast("string")))).alias("items"),
    )
    return grouped.select("segment", "ordinal", _covered("_runs").alias("n_hit"), _covered("_near").alias("n_near"), "items")


def contamination_digest(documents: DataFrame, benchmark: DataFrame, slop: int = SLOP) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; n_near:
    words in a phrase or proximity match of a whole window."""
    index = build_index(documents)
    found = hits(matches(index, benchmark, slop=slop))
    joined = indexed_documents(index).join(found, ["segment", "ordinal"], "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit, n_near = (F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_hit", "n_near"))
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        n_near.alias("n_near"),
    )


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a phrase match. A verdict depends on the text
    alone, so the matched documents are taken out by id and text hash."""
    index = build_index(documents)
    marked = matches(index, benchmark).where("kind = 'phrase'").select("segment", "ordinal").distinct()
    bad, _ = materialise(
        indexed_documents(index).join(marked, ["segment", "ordinal"]).select(
            F.col("doc_id").alias(ROW_ID), F.col("key").alias(ROW_KEY)
        ).distinct(),
        "contaminated",
    )
    keyed = documents.select(
        F.xxhash64("text").alias(ROW_KEY),
        F.col("doc_id").alias(ROW_ID),
        F.struct(*[quoted(c) for c in documents.columns]).alias(ROW),
    )
    return keyed.alias("r").join(bad.alias("b"), same_row("r", "b"), "left_anti").select(f"{ROW}.*")
