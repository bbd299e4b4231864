"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's 64-bit fingerprint is the bitwise majority of the XXH64 values of its
word shingles. Two fingerprints at most ``2r`` bits apart have a word in the
middle that is at most ``r`` bits from both, so if every fingerprint emits all
variants within ``r`` bits, linked fingerprints meet on a shared variant, and
fingerprints that share one are linked (never more than ``2r`` bits apart).

Only distinct fingerprints take part, so exact copies cost nothing, and at
most 1 + 64 + 2016 of them can share a variant. Variants are shuffled by
block: the 64 bits are dealt into ``k`` groups and a word's block is the
parity of each group. A fingerprint goes once to each block within ``r``
parity flips of its own, and there stands for exactly its variants in that
block, which the block's task writes out, sorts and links: each bucket is
linked as a star to its least member, every link is checked against the bit
distance, and a block hands on a spanning forest only. ``k`` follows the
number of fingerprints so that a block's variants stay few; any bit flip
changes the block, so a crowd of near copies spreads over blocks.

Defined cases: null, empty and wordless texts have fingerprint 0 and link like
any other; fewer words than a shingle make one shingle; a null doc_id is never
a component's id unless all its documents have none (then null); repeated rows
give repeated result rows; an empty table gives an empty result; extra columns
are ignored by the digest and kept by ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.components import components
from sightline.llm.tables import ROW, ROW_ID, ROW_KEY, distinct_rows, keyed_rows, map_text, materialise, same_row
from sightline.llm.textkit import slices

BITS = 64
SHINGLE = 4
DISTANCE = 4
HASH_SEED = 42
BLOCK_VARIANTS = 500_000


def shingle_digests(text: bytes, width: int = SHINGLE) -> bytes:
    """Big-endian XXH64 of every shingle of the lower-cased words."""
    words = text.lower().split()  # bytes: lowers A-Z, splits at ASCII white space
    if not words:
        return b""
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        return digest(b" ".join(words), HASH_SEED)
    plain = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends + 1 - sizes
    spans = zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist())
    return b"".join([digest(plain[a:b], HASH_SEED) for a, b in spans])


def fingerprints(texts: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """uint64 fingerprint of each text."""
    digests = [shingle_digests(t, width) for t in texts]
    counts = np.array([len(d) // 8 for d in digests], np.int64)
    ones = np.zeros((len(texts), BITS), np.int64)
    filled = np.flatnonzero(counts)
    if filled.size:
        bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8)).view(np.uint64).reshape(-1, 8)
        # eight byte counters per lane: sum at most 255 rows before widening
        first = np.concatenate([[0], np.cumsum(counts[filled])])
        cuts = np.concatenate([np.arange(a, b, 255) for a, b in zip(first[:-1], first[1:])])
        partial = np.add.reduceat(bits, cuts, axis=0).view(np.uint8).reshape(-1, BITS).astype(np.int64)
        owner = np.searchsorted(first, cuts, side="right") - 1
        np.add.at(ones, filled[owner], partial)
    packed = np.packbits((2 * ones > counts[:, None]).astype(np.uint8), axis=1)
    return np.ascontiguousarray(packed).view(">u8").ravel().astype(np.uint64)


def with_fingerprint(df: DataFrame, name: str = "fp", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """``df`` without its text column plus the fingerprint as a signed long."""

    def work(column: pa.Array) -> Iterator[list[pa.Array]]:
        for _, texts in slices(column):
            yield [pa.array(fingerprints(texts, width).view(np.int64))]

    return map_text(df, text, [(name, "bigint")], work, keep_text=False)


def block_bits(n: int, radius: int) -> int:
    """Parity groups for n fingerprints: about BLOCK_VARIANTS a block."""
    ball = sum(math.comb(BITS, j) for j in range(radius + 1))
    return min(30, max(4, math.ceil(math.log2(max(1, n * ball / BLOCK_VARIANTS)))))


def group_masks(k: int) -> list[int]:
    """The 64 bits dealt into k groups."""
    return [sum(1 << b for b in range(BITS) if b % k == g) for g in range(k)]


def parity_block(fp: Column, k: int) -> Column:
    """Block of a fingerprint: the parity of each bit group."""
    block = F.lit(0).cast("long")
    for g, mask in enumerate(group_masks(k)):
        signed = mask - (1 << 64) if mask >> 63 else mask
        parity = F.bit_count(fp.bitwiseAND(F.lit(signed))).bitwiseAND(F.lit(1))
        block = block.bitwiseOR(F.shiftleft(parity.cast("long"), g))
    return block


def _flips(k: int, radius: int) -> list[int]:
    return [sum(1 << g for g in c) for j in range(radius + 1) for c in combinations(range(k), j)]


def _variant_masks(k: int, radius: int) -> dict[int, np.ndarray]:
    """For each block difference, the bit flips (up to radius) that cause it."""
    found: dict[int, list[int]] = {}
    for j in range(radius + 1):
        for bits in combinations(range(BITS), j):
            change = 0
            for b in bits:
                change ^= 1 << (b % k)
            found.setdefault(change, []).append(sum(1 << b for b in bits))
    return {c: np.array(m, np.uint64) for c, m in found.items()}


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member reachable from each of n items over links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _blocks(own: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(own), np.int64)
    for g, mask in enumerate(group_masks(k)):
        out |= (_popcount(own & np.uint64(mask)) & 1) << g
    return out


def link_block(block: int, fps: np.ndarray, k: int, distance: int, masks: dict[int, np.ndarray]) -> tuple:
    """Forest links (member, root) among the fingerprints sent to a block."""
    fps = np.unique(fps)
    change = _blocks(fps, k) ^ block
    variants, owners = [], []
    for c in np.unique(change):
        who = np.flatnonzero(change == c)
        flips = masks.get(int(c))
        if flips is not None:
            variants.append((fps[who][:, None] ^ flips[None, :]).ravel())
            owners.append(np.repeat(who, len(flips)))
    if not variants:
        return fps[:0], fps[:0]
    variant, owner = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(variant, kind="stable")
    variant, owner = variant[order], owner[order]
    new = np.concatenate([[True], variant[1:] != variant[:-1]])
    head = owner[np.flatnonzero(new)[np.cumsum(new) - 1]]
    met = ~new
    pairs = np.unique(np.stack([head[met], owner[met]], axis=1), axis=0)
    a, b = pairs[:, 0], pairs[:, 1]
    near = _popcount(fps[a] ^ fps[b]) <= distance
    root = _forest(len(fps), a[near], b[near])
    member = np.flatnonzero(root != np.arange(len(fps)))
    return fps[member], fps[root[member]]


def links(distinct: DataFrame, n: int, distance: int = DISTANCE) -> DataFrame:
    """(a, b) spanning links between distinct fingerprints ``fp``, whose
    connected components are those of all pairs within ``distance``."""
    radius = -(-distance // 2)
    k = block_bits(n, radius)
    flips = F.array(*[F.lit(m).cast("long") for m in _flips(k, radius)])
    sent = distinct.withColumn("_home", parity_block(F.col("fp"), k)).select(
        F.explode(F.transform(flips, lambda m: F.col("_home").bitwiseXOR(m))).alias("block"), "fp"
    )

    def link(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        a, b = link_block(key[0].as_py(), fps, k, distance, _masks(k, radius))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return sent.groupBy("block").applyInArrow(link, "a bigint, b bigint")


_mask_cache: dict[tuple[int, int], dict[int, np.ndarray]] = {}


def _masks(k: int, radius: int) -> dict[int, np.ndarray]:
    if (k, radius) not in _mask_cache:
        _mask_cache[(k, radius)] = _variant_masks(k, radius)
    return _mask_cache[(k, radius)]


def component_ids(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of a written
    table with ``doc_id`` and ``fp``; root is the component's least fp."""
    distinct, _ = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = components(links(distinct, distinct.count(), distance))
    rooted, _ = materialise(
        distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "least", F.coalesce("root", "fp").alias("root")
        ),
        "simhash-rooted",
    )
    least, _ = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    ids, _ = materialise(rooted.join(least, "root").select("fp", "root", "component_id"), "simhash-components")
    return ids


def near_duplicates(documents: DataFrame, distance: int = DISTANCE, width: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints, _ = materialise(with_fingerprint(documents.select("doc_id", "text"), width=width), "simhash-prints")
    return prints.join(component_ids(prints, distance), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(documents: DataFrame, distance: int = DISTANCE, width: int = SHINGLE) -> DataFrame:
    """The rows of ``documents``, one per component: that of the smallest
    doc_id (null last; of rows that share it, that of the smallest row hash).
    Only keys are shuffled to decide; the kept rows meet the texts by key."""
    keyed = keyed_rows(documents)
    texts = keyed.select(ROW_KEY, F.col(ROW_ID).alias("doc_id"), F.col(f"{ROW}.text").alias("text"))
    prints, _ = materialise(with_fingerprint(texts, width=width), "simhash-prints")
    ids = component_ids(prints.select("doc_id", "fp"), distance)
    first = F.min(
        F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col(ROW_KEY).alias("k"))
    )
    kept = (
        prints.join(ids, "fp")
        .groupBy("root")
        .agg(first.alias("_first"))
        .select(F.col("_first.d").alias(ROW_ID), F.col("_first.k").alias(ROW_KEY))
    )
    kept, _ = materialise(kept, "simhash-kept")
    survivors = keyed.alias("r").join(kept.alias("k"), same_row("r", "k"), "left_semi")
    return distinct_rows(survivors).select(f"{ROW}.*")
