"""Exact removal of repeated byte strings with logarithmic suffix-array indexes.

A byte is removed if a string of ``length`` bytes that covers it also starts
in a document with a smaller id. Strings are judged on the input.

The work is spread by content. Every window of ``length`` bytes picks its
anchor, the leftmost of its ``ANCHOR``-byte grams with the least hash, so
equal windows pick equal anchors. Consecutive windows with one anchor form a
record (their bytes, the anchor's place in them), and records are shuffled to
bins by the anchor's hash: all equal windows of the corpus meet in one bin,
while a byte travels about four times, compressed, instead of ``length`` times.

A bin is an index family. Identical records are folded into one with their
least document id, records that share no half of a window around their anchor
with another are settled at once, and the rest arrive in batches in order of
that id. Each batch gets a suffix array of its windows (sorted by their bytes),
is merge-scanned against the levels of the family, which tells the least id of
each window for good, and joins them; two levels of like size merge, so their
sizes grow geometrically and each window is merged a logarithmic number of
times.

Equal records within one slice of a task are folded before the shuffle: a
passage that a third of all documents share is sent once per slice. Anchors
that a sample shows to be frequent do not make one group: their records are
split in two and go to groups by the anchor and half a window before or after
it (``split_heavy``).

``SuffixIndex`` keeps the records of batches of documents as tables, one per
level, so that a later batch is settled against all earlier ones without
indexing them again; levels of like size are merged there too.

Defined cases: null text is the empty text; a null id is larger than every
other (it removes nothing from others, null ids do not remove each other);
rows that share an id do not remove from each other, and identical rows get
the same result; texts shorter than a string keep every byte; texts of any
length are cut into overlapping pieces; an empty table gives an empty result;
extra columns are ignored by the digest.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.tables import materialise, release_shuffles
from sightline.llm.textkit import mix, powers, prefix_sums, span_hash, text_bytes
from sightline.session import delete_path, path_exists

LENGTH = 50
ANCHOR = 12
PIECE = 1 << 20
FLUSH_BYTES = 8 << 20
BIN_BYTES = 8 << 20
SPREAD = 4  # bytes of records per byte of text, rounded up
MIN_BINS = 64
LEVEL = 3
LAST_ID = (1 << 63) - 1
BATCH_RECORDS = 4096
SAMPLE_BYTES = 64 << 20
MOST_HEAVY = 1 << 16
INDEXED = -(1 << 62)  # the segment of records that are in an index already
POSITION_BITS = np.uint64(22)

SENT_SCHEMA = "bin bigint, segment bigint, kind string, content binary"
FOUND_SCHEMA = "segment bigint, kind string, content binary"
RUNS_SCHEMA = "doc_id bigint, key bigint, runs binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of any types in one compressed blob."""
    head = struct.pack("<I", len(arrays))
    body = b""
    for a in arrays:
        raw = np.ascontiguousarray(a).tobytes()
        head += struct.pack("<4sQ", a.dtype.str[1:].encode().ljust(4), len(raw))
        body += raw
    return zstandard.ZstdCompressor(level=LEVEL).compress(head + body)


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<I", data)[0]
    at, out = 4 + 12 * n, []
    for i in range(n):
        kind, size = struct.unpack_from("<4sQ", data, 4 + 12 * i)
        out.append(np.frombuffer(data, np.dtype(kind.decode().strip()), size // np.dtype(kind.decode().strip()).itemsize, at))
        at += size
    return out


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each span, one after the other."""
    ends = np.cumsum(sizes)
    out = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    if not len(out):
        return out
    filled = sizes > 0
    s, n, e = starts[filled], sizes[filled], ends[filled]
    out[0] = s[0]
    out[e[:-1]] = s[1:] - s[:-1] - n[:-1] + 1
    return np.cumsum(out, out=out)


# --- records of a slice of documents -----------------------------------------


@dataclass
class Records:
    """Runs of windows that share an anchor: document (ordinal), first byte in
    it, bytes, the anchor's place in them, and the anchor's hash."""

    ordinal: np.ndarray
    start: np.ndarray
    size: np.ndarray
    rel: np.ndarray
    anchor: np.ndarray
    at: np.ndarray  # first byte in the slice's buffer

    def rows(self, chosen: np.ndarray) -> Records:
        return Records(*(getattr(self, f)[chosen] for f in ("ordinal", "start", "size", "rel", "anchor", "at")))


def records(buf: np.ndarray, sums: np.ndarray, piece_at: np.ndarray, piece_len: np.ndarray, length: int) -> Records:
    """Records of the pieces of a buffer (ordinal: piece number, start: within
    the piece)."""
    choices = length - ANCHOR + 1
    n = len(buf) - ANCHOR + 1
    gram = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * powers(len(sums))[1][:n])
    key = ((gram >> POSITION_BITS) << POSITION_BITS) | np.arange(n, dtype=np.uint64)
    # least of `choices` consecutive keys, by doubling
    low, span = key, 1
    while span * 2 <= choices:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < choices:
        low = np.minimum(low[: len(low) - (choices - span)], low[choices - span :])
    anchor_at = (low & np.uint64((1 << int(POSITION_BITS)) - 1)).astype(np.int64)
    windows = np.maximum(piece_len - length + 1, 0)
    first = _ragged(piece_at, windows)
    if not len(first):
        none = np.zeros(0, np.int64)
        return Records(none, none, none, none, none.astype(np.uint64), none)
    piece = np.repeat(np.arange(len(piece_at)), windows)
    chosen = anchor_at[first]
    new = np.ones(len(first), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (piece[1:] != piece[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(first)) - 1
    at, owner = first[head], piece[head]
    return Records(
        owner, at - piece_at[owner], first[tail] - at + length, chosen[head] - at, gram[chosen[head]], at
    )


def half_window(length: int) -> int:
    """Any window holds its anchor and, before or after it, so many bytes."""
    return -(-(length - ANCHOR) // 2)


def split_heavy(
    r: Records, group: np.ndarray, sums: np.ndarray, heavy: np.ndarray, length: int
) -> tuple[Records, np.ndarray, np.ndarray]:
    """Records of heavy anchors in two: the windows with half of their other
    bytes before the anchor, and the rest, which have half of them after it.
    Either part goes to the group of the anchor with that half, so an anchor
    that is everywhere is spread over its contexts, and equal windows still
    meet. Returns the records, their groups and which record each comes from."""
    half = half_window(length)
    is_heavy = np.isin(r.anchor, heavy)
    first = np.where(is_heavy, np.clip(r.rel - half + 1, 0, r.size - length + 1), 0)
    before = np.flatnonzero(is_heavy & (first > 0))
    after = np.flatnonzero(is_heavy & (first < r.size - length + 1))
    light = np.flatnonzero(~is_heavy)
    parent = np.concatenate([light, before, after])
    skipped = np.concatenate([np.zeros(len(light) + len(before), np.int64), first[after]])
    size = np.concatenate([r.size[light], first[before] + length - 1, r.size[after] - first[after]])
    middle = r.at + r.rel
    spread = np.concatenate([
        group[light],
        span_hash(sums, middle[before] - half, middle[before] + ANCHOR),
        span_hash(sums, middle[after], middle[after] + ANCHOR + half),
    ])
    parts = r.rows(parent)
    parts = Records(parts.ordinal, parts.start + skipped, size, parts.rel - skipped, parts.anchor, parts.at + skipped)
    return parts, spread, parent


@dataclass
class Outbox:
    """Records of one segment, by bin, until it is sent."""

    segment: int
    doc_ids: list[int] = field(default_factory=list)
    keys: list[int] = field(default_factory=list)
    bins: dict[int, list[tuple]] = field(default_factory=dict)
    settled: list[tuple] = field(default_factory=list)
    size: int = 0
    heavy: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def add(self, docs: list[tuple[int, int, bytes]], bins: int, length: int) -> None:
        """``docs``: (document's ordinal, offset of the piece in it, bytes)."""
        buf = np.frombuffer(b"\n".join(d[2] for d in docs) + b"\n", np.uint8)
        lens = np.array([len(d[2]) for d in docs], np.int64)
        at = np.cumsum(lens + 1) - lens - 1
        self.size += int(lens.sum())
        if len(buf) < length or lens.max() < length:
            return
        sums = prefix_sums(buf)
        r = records(buf, sums, at, lens, length)
        ordinal = np.array([d[0] for d in docs], np.int64)[r.ordinal]
        start = r.start + np.array([d[1] for d in docs], np.int64)[r.ordinal]
        ids = np.array(self.doc_ids, np.int64)[ordinal]
        sent = self._fold(r, sums, ids, ordinal, start)
        r, ids, ordinal, start = r.rows(sent), ids[sent], ordinal[sent], start[sent]
        group = mix(r.anchor)
        if len(self.heavy):
            whole = r.at
            r, group, parent = split_heavy(r, group, sums, self.heavy, length)
            ids, ordinal, start = ids[parent], ordinal[parent], start[parent] + r.at - whole[parent]
        target = (group % np.uint64(bins)).astype(np.int64)
        order = np.argsort(target, kind="stable")
        content = buf[_ragged(r.at[order], r.size[order])]
        edge = np.concatenate([[0], np.cumsum(r.size[order])])
        cut = np.flatnonzero(np.diff(target[order], prepend=-1))
        for a, b in zip(cut, np.append(cut[1:], len(order))):
            rows = order[a:b]
            self.bins.setdefault(int(target[rows[0]]), []).append((
                ids[rows], ordinal[rows].astype(np.uint32), start[rows].astype(np.int64),
                r.size[rows].astype(np.uint8), r.rel[rows].astype(np.uint8), content[edge[a] : edge[b]],
            ))

    def _fold(self, r: Records, sums: np.ndarray, ids: np.ndarray, ordinal: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Settle records that equal one of a smaller document of the slice;
        the others are to be sent."""
        text = span_hash(sums, r.at, r.at + r.size) + r.rel.astype(np.uint64)
        order = np.lexsort((ids, text))
        same = text[order]
        head = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
        least = np.repeat(ids[order[head]], np.diff(np.append(head, len(order))))
        repeat = ids[order] > least
        gone = order[repeat]
        self.settled.append((ordinal[gone].astype(np.uint32), start[gone], r.size[gone].astype(np.int64)))
        return np.sort(order[~repeat])

    def send(self) -> pa.RecordBatch:
        rows = []
        # rows for the segment itself pass through the bins' shuffle unread, as
        # a group of their own: its size is bounded by the segment's
        own = -1 - self.segment
        docs = pack(np.array(self.doc_ids, np.int64), np.array(self.keys, np.int64))
        rows.append((own, "docs", docs))
        if self.settled:
            rows.append((own, "hits", pack(*(np.concatenate(c) for c in zip(*self.settled)))))
        for number, parts in self.bins.items():
            rows.append((number, "records", _pack_records(*(np.concatenate(c) for c in zip(*parts)))))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in rows], pa.int64()),
                pa.array([self.segment] * len(rows), pa.int64()),
                pa.array([x[1] for x in rows], pa.string()),
                pa.array([x[2] for x in rows], pa.binary()),
            ],
            names=["bin", "segment", "kind", "content"],
        )


def _pack_records(ids, ordinal, start, size, rel, content) -> bytes:
    """Ids and ordinals as steps, which are small within a slice."""
    small = start.astype(np.uint32) if len(start) and start.max() < 1 << 32 else start
    steps = np.diff(ids.view(np.uint64), prepend=np.uint64(0)), np.diff(ordinal.astype(np.int64), prepend=0)
    return pack(*steps, small, size, rel, content)


def _unpack_records(blob: bytes) -> tuple:
    ids, ordinal, start, size, rel, content = unpack(blob)
    return np.cumsum(ids).view(np.int64), np.cumsum(ordinal), start.astype(np.int64), size, rel, content


NO_ANCHORS = np.zeros(0, np.uint64)


def _send_partition(
    batches: Iterable[pa.RecordBatch], bins: int, length: int, heavy: np.ndarray = NO_ANCHORS
) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    serial, box, waiting, waiting_bytes = TaskContext.get().partitionId() << 24, None, [], 0
    for batch in batches:
        ids, keys, column = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), batch.column("text")
        for i in range(batch.num_rows):
            if box is None:
                box = Outbox(serial, heavy=heavy)
                serial += 1
            text = text_bytes(column.slice(i, 1))[0]
            box.doc_ids.append(LAST_ID if ids[i] is None else ids[i])
            box.keys.append(keys[i])
            # pieces overlap by length - 1 bytes: every window is in one piece
            for offset in range(0, max(len(text) - length + 1, 1), PIECE):
                piece = text[offset : offset + PIECE + length - 1]
                if waiting and waiting_bytes + len(piece) > PIECE:
                    box.add(waiting, bins, length)
                    waiting, waiting_bytes = [], 0
                waiting.append((len(box.doc_ids) - 1, offset, piece))
                waiting_bytes += len(piece) + 1
            if box.size + waiting_bytes >= FLUSH_BYTES:
                box.add(waiting, bins, length)
                yield box.send()
                box, waiting, waiting_bytes = None, [], 0
    if box is not None:
        if waiting:
            box.add(waiting, bins, length)
        yield box.send()


# --- the index family of a bin -----------------------------------------------


def suffix_array(windows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows in byte order, and the least document id of each."""
    order = np.argsort(windows, kind="stable")
    windows, ids = windows[order], ids[order]
    head = np.flatnonzero(np.concatenate([[True], windows[1:] != windows[:-1]]))
    return windows[head], np.minimum.reduceat(ids, head)


class Family:
    """Levels of sorted windows whose sizes grow geometrically. Batches are
    taken in order of their document ids, so the least id of a window is known
    when its batch has been scanned against the levels."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def scan(self, windows: np.ndarray) -> np.ndarray:
        """Least document id of each window over all levels (merge scan of
        sorted windows)."""
        least = np.full(len(windows), LAST_ID, np.int64)
        for level, ids in self.levels:
            at = np.minimum(np.searchsorted(level, windows), len(level) - 1)
            np.minimum(least, np.where(level[at] == windows, ids[at], LAST_ID), out=least)
        return least

    def take(self, windows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """A new batch: gets its suffix array, is merge-scanned against the
        levels and joins them; like sizes merge. Returns the least id of each
        of its windows over the batch and all before it."""
        if not len(windows):
            return np.zeros(0, np.int64)
        array, own = suffix_array(windows, ids)
        least = np.minimum(own, self.scan(array))
        self.levels.append((array, least))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            (a, x), (b, y) = self.levels.pop(), self.levels.pop()
            self.levels.append(suffix_array(np.concatenate([b, a]), np.concatenate([y, x])))
        return least[np.searchsorted(array, windows)]


def _windows(content: np.ndarray, at: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """The windows of each record as fixed-length byte strings."""
    view = np.lib.stride_tricks.sliding_window_view(content, length)
    # a trailing byte of one keeps NUL bytes at a window's end significant
    out = np.ones((int(count.sum()), length + 1), np.uint8)
    out[:, :length] = view[_ragged(at, count)]
    return out.view(f"S{length + 1}").ravel()


def _fold_key(content: np.ndarray, at: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of short spans, from their bytes in eight-byte lanes."""
    out = mix(size.astype(np.uint64) + np.uint64(seed))
    padded = np.concatenate([content, np.zeros(128, np.uint8)])
    for lane in range(0, int(size.max(initial=0)), 8):
        value = np.zeros(len(at), np.uint64)
        for j in range(8):
            inside = lane + j < size
            byte = np.where(inside, padded[at + lane + j], 0).astype(np.uint64)
            value |= byte << np.uint64(8 * j)
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + value)
    return out


def _contested(content: np.ndarray, at: np.ndarray, rel: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Entries that may share a window with another entry. A shared window
    holds the anchor and, on one side of it at least, half of the rest: the
    entries then agree on the anchor with that half before or after it."""
    half = half_window(length)
    out = np.zeros(len(at), bool)
    for before in (half, 0):
        able = np.flatnonzero((rel >= before) & (size - rel >= ANCHOR + half - before))
        start = at[able] + rel[able] - before
        key = _fold_key(content, start, np.full(len(able), ANCHOR + half), 2)
        _, group, members = np.unique(key, return_inverse=True, return_counts=True)
        out[able] |= members[group] > 1
    return out


def settle_bin(blobs: list[tuple[int, bytes]], length: int) -> Iterator[tuple[int, bytes]]:
    """(segment, hits) of all records of a bin."""
    parts = [(segment, *_unpack_records(blob)) for segment, blob in blobs]
    segment = np.concatenate([np.full(len(p[1]), p[0], np.int64) for p in parts])
    ids, ordinal, start, size, rel, content = (np.concatenate([p[i] for p in parts]) for i in range(1, 7))
    size, rel = size.astype(np.int64), rel.astype(np.int64)
    at = np.cumsum(size) - size

    # identical records: one entry with the least id
    text = _fold_key(content, at, size, 1) + rel.astype(np.uint64)
    _, entry_of_first, entry = np.unique(text, return_index=True, return_inverse=True)
    least = np.full(len(entry_of_first), LAST_ID, np.int64)
    np.minimum.at(least, entry, ids)
    contested = _contested(content, at[entry_of_first], rel[entry_of_first], size[entry_of_first], length)

    # windows of contested entries go through the family, batch by batch, in
    # order of their ids
    rows = np.flatnonzero(contested)
    rows = rows[np.argsort(least[rows], kind="stable")]
    count = size[entry_of_first] - length + 1
    family, window_least, total = Family(), [], 0
    window_at = np.zeros(len(least), np.int64)
    for a in range(0, len(rows), BATCH_RECORDS):
        e = rows[a : a + BATCH_RECORDS]
        windows = _windows(content, at[entry_of_first[e]], count[e], length)
        window_least.append(family.take(windows, np.repeat(least[e], count[e])))
        window_at[e] = total + np.cumsum(count[e]) - count[e]
        total += len(windows)
    all_least = np.concatenate(window_least) if window_least else np.zeros(0, np.int64)

    plain = np.flatnonzero(~contested[entry] & (least[entry] < ids))
    mixed = np.flatnonzero(contested[entry])
    n = count[entry[mixed]]
    owner = np.repeat(mixed, n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    gone = all_least[window_at[entry[owner]] + offset] < ids[owner]
    owner, offset = owner[gone], offset[gone]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(owner)) - 1 if len(owner) else head
    row = np.concatenate([plain, owner[head]])
    first = np.concatenate([start[plain], start[owner[head]] + offset[head]])
    span = np.concatenate([size[plain], offset[tail] - offset[head] + length])
    for s in np.unique(segment[row]):
        if s == INDEXED:  # of a batch that was settled when it came
            continue
        own = segment[row] == s
        yield int(s), pack(ordinal[row[own]].astype(np.uint32), first[own], span[own].astype(np.int64))


# --- joining the hits of a document -------------------------------------------


def merge_segment(doc_ids: np.ndarray, keys: np.ndarray, ordinal: np.ndarray, first: np.ndarray, span: np.ndarray) -> tuple:
    """(document number, its maximal removed runs as pairs) of a segment."""
    if not len(ordinal):
        return ordinal, np.zeros((0, 2), np.int64)
    order = np.lexsort((first, ordinal))
    ordinal, first, stop = ordinal[order].astype(np.int64), first[order], (first + span)[order]
    # running end within each document
    reach = np.maximum.accumulate(stop + (ordinal << 40)) - (ordinal << 40)
    new = np.ones(len(ordinal), bool)
    new[1:] = (ordinal[1:] != ordinal[:-1]) | (first[1:] > reach[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(ordinal)) - 1
    return ordinal[head], np.stack([first[head], reach[tail]], axis=1)


def heavy_anchors(source: DataFrame, total: int, length: int) -> np.ndarray:
    """Anchors whose records would fill more than half a bin, as far as a
    sample of about ``SAMPLE_BYTES`` of text tells, at most ``MOST_HEAVY`` of
    them. Which anchors count as heavy decides where their records go, never
    the result."""
    if total * SPREAD <= BIN_BYTES // 2:
        return NO_ANCHORS
    share = min(1.0, SAMPLE_BYTES / total)
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "key"), 11) * F.lit(2.0**-53)
    sample = source.where(place < share) if share < 1 else source

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            for i in range(batch.num_rows):
                text = text_bytes(batch.column("text").slice(i, 1))[0]
                for offset in range(0, max(len(text) - length + 1, 0), PIECE):
                    piece = text[offset : offset + PIECE + length - 1]
                    buf = np.frombuffer(piece + b"\n", np.uint8)
                    r = records(buf, prefix_sums(buf), np.zeros(1, np.int64), np.array([len(piece)]), length)
                    seen.append((r.anchor, r.size))
                    held += len(r.anchor)
                    if held > 1 << 20:
                        yield _anchor_sizes(seen)
                        seen, held = [], 0
        if held:
            yield _anchor_sizes(seen)

    counted = sample.mapInArrow(count, "anchor bigint, bytes bigint").groupBy("anchor").agg(F.sum("bytes").alias("bytes"))
    least = share * BIN_BYTES / 2
    rows = counted.where(F.col("bytes") > least).orderBy(F.desc("bytes"), "anchor").limit(MOST_HEAVY).collect()
    return np.sort(np.array([r.anchor for r in rows], np.int64).view(np.uint64))


def _anchor_sizes(seen: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    anchor, size = (np.concatenate(c) for c in zip(*seen))
    unique, entry = np.unique(anchor, return_inverse=True)
    sizes = np.bincount(entry, weights=size).astype(np.int64)
    often = np.bincount(entry) > 1  # one record in about 70 MB of text makes no anchor heavy
    return pa.RecordBatch.from_arrays(
        [pa.array(unique[often].view(np.int64)), pa.array(sizes[often])], names=["anchor", "bytes"]
    )


def _settle(key: tuple, table: pa.Table, length: int) -> pa.Table:
    kinds = table.column("kind").to_pylist()
    segments, contents = table.column("segment").to_pylist(), table.column("content").to_pylist()
    out = [(s, k, c) for s, k, c in zip(segments, kinds, contents) if k != "records"]
    blobs = [(s, c) for s, k, c in zip(segments, kinds, contents) if k == "records"]
    if blobs:
        out += [(s, "hits", c) for s, c in settle_bin(blobs, length)]
    return pa.table({
        "segment": pa.array([x[0] for x in out], pa.int64()),
        "kind": pa.array([x[1] for x in out], pa.string()),
        "content": pa.array([x[2] for x in out], pa.binary()),
    })


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    docs, hits = None, []
    for kind, content in zip(table.column("kind").to_pylist(), table.column("content").to_pylist()):
        if kind == "docs":
            docs = unpack(content)
        else:
            hits.append(unpack(content))
    ids, keys, runs = [], [], []
    if hits:
        ordinal, pairs = merge_segment(*docs, *(np.concatenate(c) for c in zip(*hits)))
        cut = np.flatnonzero(np.diff(ordinal, prepend=-1))
        for a, b in zip(cut, np.append(cut[1:], len(ordinal))):
            doc = int(docs[0][ordinal[a]])
            ids.append(None if doc == LAST_ID else doc)
            keys.append(int(docs[1][ordinal[a]]))
            runs.append(pairs[a:b].astype("<i8").tobytes())
    return pa.table({
        "doc_id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.int64()), "runs": pa.array(runs, pa.binary())
    })


def bins_for(total: int) -> int:
    """Bins for so many bytes of text."""
    return max(MIN_BINS, -(-total * SPREAD // BIN_BYTES))


def repeated_runs(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, key, runs) of every document that loses bytes; ``key`` is the
    text's xxhash64, ``runs`` packed little-endian (start, stop) int64 pairs.
    A written table."""
    spark = documents.sparkSession
    source = documents.select("doc_id", F.xxhash64("text").alias("key"), "text")
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bins = bins_for(total)
    heavy = spark.sparkContext.broadcast(heavy_anchors(source, total, length))
    sent = source.mapInArrow(lambda b: _send_partition(b, bins, length, heavy.value), SENT_SCHEMA)
    found = sent.groupBy("bin").applyInArrow(lambda k, t: _settle(k, t, length), FOUND_SCHEMA)
    found, _ = materialise(found, "suffix-hits", compression="none")
    release_shuffles(spark)
    merged = found.groupBy("segment").applyInArrow(_merge, RUNS_SCHEMA)
    runs, _ = materialise(merged.dropDuplicates(["doc_id", "key"]), "suffix-runs")
    return runs


DIGEST_SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _digest_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, removed, spans, sums = [], [], [], [], []
        for i in range(batch.num_rows):
            text = text_bytes(batch.column("text").slice(i, 1))[0]
            kept, pairs = _keep(text, batch.column("runs")[i].as_py())
            ids.append(batch.column("doc_id")[i].as_py())
            sizes.append(len(text))
            removed.append(len(text) - len(kept))
            spans.append(len(pairs))
            sums.append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(spans, pa.int64()), pa.array(sums, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _keep(text: bytes, runs: bytes | None) -> tuple[bytes, np.ndarray]:
    pairs = np.frombuffer(runs or b"", "<i8").reshape(-1, 2)
    at, pieces = 0, []
    for a, b in pairs:
        pieces.append(text[at:a])
        at = b
    pieces.append(text[at:])
    return b"".join(pieces), pairs


def with_runs(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, text and packed removed runs (null: none) of every document."""
    runs = repeated_runs(documents, length).withColumnRenamed("doc_id", "_doc").withColumnRenamed("key", "_key")
    release_shuffles(documents.sparkSession)
    keyed = documents.select("doc_id", "text", F.xxhash64("text").alias("key"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key"))
    return keyed.join(runs, same, "left").select("doc_id", "text", "runs")


def kept_bytes(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id and the remaining bytes of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [
                _keep(t, r)[0] for t, r in zip(text_bytes(batch.column("text")), batch.column("runs").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kept, pa.binary())], names=["doc_id", "kept"]
            )

    return with_runs(documents, length).mapInArrow(run, "doc_id bigint, kept binary")


def dedup_digest(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the hash of what is kept."""
    return with_runs(documents, length).mapInArrow(_digest_partition, DIGEST_SCHEMA)


# --- an index that outlives a batch --------------------------------------------


LEVEL_SCHEMA = "bin bigint, content binary"


def _merge_levels(key: tuple, table: pa.Table) -> pa.Table:
    """One blob of the distinct records of a bin, each with its least id."""
    parts = [_unpack_records(blob) for blob in table.column("content").to_pylist()]
    ids, _, _, size, rel, content = (np.concatenate([p[i] for p in parts]) for i in range(6))
    wide = size.astype(np.int64)
    at = np.cumsum(wide) - wide
    text = _fold_key(content, at, wide, 1) + rel.astype(np.uint64)
    order = np.lexsort((ids, text))
    kept = np.sort(order[np.concatenate([[True], text[order[1:]] != text[order[:-1]]])])
    none = np.zeros(len(kept), np.int64)
    blob = _pack_records(ids[kept], none, none, size[kept], rel[kept], content[_ragged(at[kept], wide[kept])])
    return pa.table({"bin": pa.array([key[0].as_py()], pa.int64()), "content": pa.array([blob], pa.binary())})


class SuffixIndex:
    """Records of earlier batches below a folder, in levels whose sizes grow
    geometrically. The number of bins is fixed when the index is made, for
    about ``expected_bytes`` of text."""

    def __init__(self, spark: SparkSession, root: str, expected_bytes: int = 0, length: int = LENGTH):
        self.spark, self.root, self.length = spark, root.rstrip("/"), length
        self.bins, self.levels, self.version = bins_for(expected_bytes), [], 0
        if path_exists(spark, f"{self.root}/manifest"):
            rows = spark.read.parquet(f"{self.root}/manifest")
            self.version = rows.agg(F.max("version")).first()[0]
            rows = rows.where(F.col("version") == self.version).orderBy("place").collect()
            self.bins, self.length = rows[0].bins, rows[0].length
            self.levels = [(r.path, r.bytes) for r in rows if r.path is not None]

    def _commit(self) -> None:
        """The manifest of a version names all its levels, oldest first; the
        newest version counts, so a batch that fails half way leaves the index
        as it was."""
        self.version += 1
        rows = [(i, p, n, self.bins, self.length) for i, (p, n) in enumerate(self.levels)] or [(0, None, 0, self.bins, self.length)]
        kinds = "place int, path string, bytes bigint, bins bigint, length int"
        self.spark.createDataFrame(rows, kinds).coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/manifest/version={self.version}"
        )

    def _write_level(self, rows: DataFrame) -> tuple[str, int]:
        path = f"{self.root}/level-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path, self.spark.read.parquet(path).agg(F.sum(F.octet_length("content"))).first()[0] or 0

    def add_batch(self, documents: DataFrame) -> DataFrame:
        """(doc_id, key, runs) of the batch's documents that lose bytes: those
        covered by a string that an indexed document, or one of the batch with
        a smaller id, holds. Then the batch is part of the index; what earlier
        batches lost stays as it was. Ids should grow from batch to batch; a
        string held by a larger indexed id is not removed."""
        source = documents.select("doc_id", F.xxhash64("text").alias("key"), "text")
        bins, length = self.bins, self.length
        sent, sent_path = materialise(
            source.mapInArrow(lambda b: _send_partition(b, bins, length), SENT_SCHEMA), "suffix-batch"
        )
        rows = sent
        for path, _ in self.levels:
            held = self.spark.read.schema(LEVEL_SCHEMA).parquet(path)
            rows = rows.unionByName(held.select(
                "bin", F.lit(INDEXED).cast("long").alias("segment"), F.lit("records").alias("kind"), "content"
            ))
        found, found_path = materialise(
            rows.groupBy("bin").applyInArrow(lambda k, t: _settle(k, t, length), FOUND_SCHEMA), "suffix-batch-hits"
        )
        runs, _ = materialise(
            found.groupBy("segment").applyInArrow(_merge, RUNS_SCHEMA).dropDuplicates(["doc_id", "key"]), "suffix-batch-runs"
        )
        old = []
        self.levels.append(self._write_level(sent.where("kind = 'records'").select("bin", "content")))
        while len(self.levels) > 1 and self.levels[-2][1] <= 2 * self.levels[-1][1]:
            newer, older = self.levels.pop(), self.levels.pop()
            both = self.spark.read.schema(LEVEL_SCHEMA).parquet(newer[0], older[0])
            self.levels.append(self._write_level(both.groupBy("bin").applyInArrow(_merge_levels, LEVEL_SCHEMA)))
            old += [newer[0], older[0]]
        self._commit()
        delete_path(self.spark, sent_path, found_path, *old)
        return runs
