"""Document fingerprints: one-permutation MinHash in packed low-order bits.

Words (ASCII lower case, split at ASCII white space) make shingles of five;
fewer words make one shingle. Every shingle is hashed once: the top bits of
its hash choose one of ``BINS`` bins, which keeps its least hash. An empty bin
borrows from a full bin by optimal densification: each bin has its own random
order of all bins and takes the first full one, so two texts borrow alike as
often as their shingle sets are alike. Of each bin ``BITS`` low-order bits are
kept, mixed with the bin's number so that borrowed values do not agree by one
accident everywhere, and packed into a hex string. Bins of unlike sets agree
with probability 2**-BITS; ``likeness`` takes that bias out.

``with_edited`` also fingerprints each text with its last third replaced by
the start of the next document by descending id. The neighbour is found
without a global sort of the texts: a sample of the narrow (id, text hash)
keys gives the first key of each of a number of runs, every document is sent
to the task of its run (the first of a run also to the run before it), sorted
there and streamed past its neighbour in Arrow batches. A row repeated more
often than a fraction of a run is aggregated first and travels once with its
count.

Defined cases: null is the empty text; a text without words has the
fingerprint of zeros, which is like itself (1) and unlike any other (0); null
ids come after all others, together with the least long; documents that share
an id are ordered by the hash of their text, repeated rows are each other's
neighbours; a single document is its own neighbour; an empty table gives an
empty result; extra columns are ignored by the digest and kept by
``with_fingerprint``, whose new column gets the next free name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.tables import REPEAT_RANGE, map_text, materialise, repeat_rows
from sightline.llm.textkit import BASE, NON_SPACE, SLICE_BYTES, join_rows, mix, prefix_sums, row_of, slices, span_hash, tokens

BINS = 512
BITS = 4
SHINGLE = 5
RUN_ROWS = 8192
MOST_RUNS = 100_000
SAMPLE_A_RUN = 16
LONG_MAX = (1 << 63) - 1


# ---- fingerprint -----------------------------------------------------------


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of the lower-cased texts. A long text is
    hashed in pieces cut between words, so that memory follows the piece."""
    buf, offsets = join_rows([t.lower() for t in texts])
    starts, ends = tokens(buf, NON_SPACE)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE_BYTES, side="right")))
        base = starts[at]
        sums = prefix_sums(buf[base : ends[to - 1]])
        out[at:to] = span_hash(sums, starts[at:to] - base, ends[at:to] - base)
        at = to
    return out, row_of(offsets, starts)


def shingle_hashes(texts: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle; a text of fewer words has one."""
    words, rows = word_hashes(texts)
    counts = np.bincount(rows, minlength=len(texts))
    padded = np.concatenate([words, np.zeros(width - 1, np.uint64)])
    owner = np.concatenate([rows, np.full(width - 1, -1)])
    n = len(words)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = h * BASE + np.where(owner[j : j + n] == rows, padded[j : j + n], np.uint64(0))
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    index = np.arange(n) - first[rows]
    keep = index <= np.maximum(counts - width, 0)[rows]
    return mix(h[keep]), rows[keep]


def _orders(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Each bin's random order of all bins, and its inverse (ranks)."""
    if bins not in _order_cache:
        rng = np.random.default_rng(bins)
        order = rng.permuted(np.tile(np.arange(bins, dtype=np.int32), (bins, 1)), axis=1)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.tile(np.arange(bins, dtype=np.int32), (bins, 1)), axis=1)
        _order_cache[bins] = order, rank
    return _order_cache[bins]


_order_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}
EMPTY = np.uint64((1 << 64) - 1)


def densify(minima: np.ndarray) -> np.ndarray:
    """Fill the empty bins of every row that has a full one."""
    out = minima.copy()
    full = minima != EMPTY
    sizes = full.sum(axis=1)
    order, rank = _orders(minima.shape[1])
    few = sizes < 32
    for r in np.flatnonzero(few & (sizes > 0)):  # few full bins: the best of them by rank
        donors = np.flatnonzero(full[r])
        empty = np.flatnonzero(~full[r])
        out[r, empty] = minima[r, donors[rank[np.ix_(empty, donors)].argmin(axis=1)]]
    rows, bins = np.nonzero(~full & ~few[:, None])
    step = 0
    while len(rows):  # many full bins: the first tries succeed
        donors = order[bins, step]
        got = full[rows, donors]
        out[rows[got], bins[got]] = minima[rows[got], donors[got]]
        rows, bins = rows[~got], bins[~got]
        step += 1
    return out


def fingerprints(texts: list[bytes], bins: int = BINS, width: int = SHINGLE) -> np.ndarray:
    """One row of ``bins`` values of BITS bits for each text."""
    hashes, rows = shingle_hashes(texts, width)
    shift = np.uint64(64 - (bins - 1).bit_length())
    minima = np.full(len(texts) * bins, EMPTY)
    cell = rows * bins + (hashes >> shift).astype(np.int64)
    np.minimum.at(minima, cell, hashes & ((np.uint64(1) << shift) - np.uint64(1)))
    minima = minima.reshape(-1, bins)
    wordless = (minima == EMPTY).all(axis=1)
    low = mix(densify(minima) ^ ((np.arange(bins, dtype=np.uint64) + np.uint64(1)) * BASE)) & np.uint64((1 << BITS) - 1)
    low[wordless] = 0
    return low.astype(np.uint8)


def pack(values: np.ndarray) -> list[str]:
    """Hex strings of rows of 4-bit values."""
    packed = (values[:, 0::2] << 4) | values[:, 1::2]
    return [row.tobytes().hex() for row in packed]


def unpack(strings: list[str]) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex("".join(strings)), np.uint8).reshape(len(strings), -1)
    out = np.empty((len(strings), packed.shape[1] * 2), np.uint8)
    out[:, 0::2], out[:, 1::2] = packed >> 4, packed & 15
    return out


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of the shingle sets behind rows of values."""
    chance = 2.0**-BITS
    agree = (a == b).mean(axis=1)
    out = np.clip((agree - chance) / (1 - chance), 0.0, 1.0)
    none = ~a.any(axis=1) != ~b.any(axis=1)  # one of the two has no words
    return np.where(none, 0.0, out)


def likeness(left: Column, right: Column) -> Column:
    """Likeness of two fingerprint columns of equal width; null if either is."""

    @F.pandas_udf("double")
    def compare(a: pd.Series, b: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=a.index, dtype=object)
        have = a.notna() & b.notna()
        if have.any():
            out[have] = alike(unpack(a[have].tolist()), unpack(b[have].tolist()))
        return out.where(have, None)

    return compare(left, right)


def with_fingerprint(df: DataFrame, name: str = "fingerprint", text: str = "text") -> DataFrame:
    """All columns of ``df`` plus the fingerprint of its text column."""

    def work(column: pa.Array) -> Iterator[list[pa.Array]]:
        for _, texts in slices(column):
            yield [pa.array(pack(fingerprints(texts)))]

    return map_text(df, text, [(name, "string")], work)


# ---- neighbours ------------------------------------------------------------


def _order_keys(df: DataFrame) -> DataFrame:
    """doc_id, text and the order: ``o1`` falls with the id, nulls last."""
    return df.select(
        "doc_id",
        "text",
        F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(LONG_MAX)).alias("o1"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("o2"),
    )


def run_starts(keys: DataFrame, run_rows: int) -> list[tuple[int, int]]:
    """First keys of runs of about ``run_rows`` rows, at most ``MOST_RUNS`` of
    them, from a hash sample of the distinct keys (o1, o2, m)."""
    totals = keys.agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("rows"), F.min(F.struct("o1", "o2")).alias("least")).first()
    if not totals.n:
        return []
    runs = min(MOST_RUNS, -(-int(totals.rows) // run_rows))
    share = min(1.0, SAMPLE_A_RUN * runs / totals.n)
    place = F.shiftrightunsigned(F.xxhash64("o1", "o2"), 11) * F.lit(2.0**-53)
    light = F.least(F.col("m"), F.lit(run_rows))
    found = keys.where(place < share) if share < 1 else keys.where(F.lit(runs > 1))
    rows = sorted((r.o1, r.o2, r.w) for r in found.select("o1", "o2", light.alias("w")).collect())
    each = sum(w for *_, w in rows) / runs if rows else 1
    starts, seen = [(totals.least.o1, totals.least.o2)], 0
    for o1, o2, w in rows:
        if seen >= each * len(starts) and (o1, o2) > starts[-1]:
            starts.append((o1, o2))
        seen += w
    return starts


def run_of(starts: list[tuple[int, int]], o1: np.ndarray, o2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The run of each key, and whether the key is the first of its run."""
    s1, s2 = (np.array([s[i] for s in starts], np.int64) for i in (0, 1))
    low, high = np.searchsorted(s1, o1, "left"), np.searchsorted(s1, o1, "right")
    run = high - 1
    for value in np.unique(o1[low < high]):  # ids that are a run's first
        rows = np.flatnonzero(o1 == value)
        a, b = low[rows[0]], high[rows[0]]
        run[rows] = a + np.searchsorted(s2[a:b], o2[rows], "right") - 1
    return run, (s1[run] == o1) & (s2[run] == o2)


EDITED_SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, copies bigint"


class _Walk:
    """Documents of a run in order, each held until its neighbour comes."""

    def __init__(self) -> None:
        self.held: tuple | None = None  # (doc_id, copies, text, values)

    def rows(self, ids: list, copies: list, peeks: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        prints = fingerprints(texts)
        pairs = []  # (doc_id, copies, text, values, next text, next values)
        for doc_id, m, peek, text, values in zip(ids, copies, peeks, texts, prints):
            if self.held is not None:
                pairs.append((*self.held, text, values))
            self.held = None if peek else (doc_id, 1, text, values)
            if not peek and m > 1:  # equal rows are each other's neighbours
                pairs.append((doc_id, m - 1, text, values, text, values))
        if not pairs:
            return
        edited, sizes = [], []
        for _, _, text, _, following, _ in pairs:
            plain = text.decode()
            cut = len(plain) // 3
            sizes.append(len(plain))
            edited.append((plain[: len(plain) - cut] + following.decode()[:cut]).encode())
        own, other = (np.stack([p[i] for p in pairs]) for i in (3, 5))
        changed = fingerprints(edited)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p[0] for p in pairs], pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                pa.array(pack(own)),
                pa.array(pack(changed)),
                pa.array(alike(own, changed)),
                pa.array(alike(own, other)),
                pa.array([p[1] for p in pairs], pa.int64()),
            ],
            names=[f.split()[0] for f in EDITED_SCHEMA.split(", ")],
        )


def _walk_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk = _Walk()
    for batch in batches:
        ids, copies, peeks = (batch.column(c).to_pylist() for c in ("doc_id", "m", "peek"))
        for start, texts in slices(batch.column(batch.schema.get_field_index("text"))):
            to = start + len(texts)
            yield from walk.rows(ids[start:to], copies[start:to], peeks[start:to], texts)


def with_edited(documents: DataFrame, run_rows: int = RUN_ROWS) -> tuple[DataFrame, int]:
    """The digest columns of every document and ``copies``, how many equal
    rows a result row stands for; and the largest number of copies."""
    spark = documents.sparkSession
    keyed = _order_keys(documents)
    keys, _ = materialise(
        keyed.groupBy("doc_id", "o1", "o2").agg(F.count(F.lit(1)).alias("m")), "fingerprint-keys"
    )
    starts = run_starts(keys, run_rows)
    if not starts:
        return spark.createDataFrame([], EDITED_SCHEMA), 0
    most = int(keys.agg(F.max("m")).first()[0])
    crowd = max(1, run_rows // 4)
    rows = keyed.withColumn("m", F.lit(1).cast("long"))
    if most > crowd:  # such rows travel once; a run holds about four of them, so they are few
        on = ["o1", "o2", "no_id"]
        mine = rows.withColumn("no_id", F.col("doc_id").isNull())
        crowded = F.broadcast(keys.where(F.col("m") > crowd).select("o1", "o2", F.col("doc_id").isNull().alias("no_id")))
        once = mine.join(crowded, on, "left_semi").groupBy("doc_id", *on).agg(
            F.first("text").alias("text"), F.count(F.lit(1)).alias("m")
        )
        rows = mine.join(crowded, on, "left_anti").unionByName(once).drop("no_id")
    shared = spark.sparkContext.broadcast(starts)
    last = len(starts) - 1

    @F.pandas_udf("run int, first boolean")
    def place(o1: pd.Series, o2: pd.Series) -> pd.DataFrame:
        run, first = run_of(shared.value, o1.to_numpy(), o2.to_numpy())
        return pd.DataFrame({"run": run.astype(np.int32), "first": first})

    before = F.when(F.col("p.run") == 0, F.lit(last)).otherwise(F.col("p.run") - 1).cast("int")
    own = F.struct(F.col("p.run").alias("run"), F.lit(False).alias("peek"))
    ahead = F.struct(before.alias("run"), F.lit(True).alias("peek"))
    placed = rows.withColumn("p", place("o1", "o2")).withColumn(
        "at", F.explode(F.when(F.col("p.first"), F.array(own, ahead)).otherwise(F.array(own)))
    )
    parts = len(starts)  # a task holds one run, however many there are
    walked = (
        placed.select("doc_id", "text", "m", "o1", "o2", "at.run", "at.peek")
        .repartitionById(parts, F.col("run"))
        .sortWithinPartitions("run", "peek", "o1", "o2")
        .select("doc_id", "text", "m", "peek")
        .mapInArrow(_walk_runs, EDITED_SCHEMA)
    )
    return walked, most


def fingerprint_digest(documents: DataFrame, run_rows: int = RUN_ROWS, limit: int = REPEAT_RANGE) -> DataFrame:
    """One row per document."""
    edited, most = with_edited(documents.select("doc_id", "text"), run_rows)
    if most > limit:
        edited, _ = materialise(edited, "fingerprint-edited")
    return repeat_rows(edited, "copies", "copy", most, limit).drop("copies", "copy")
