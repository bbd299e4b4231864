"""Merkle dataset manifest as a postorder append log.

Every row is a leaf (SHA-256 of its encoded columns). The leaves of a group
(``lang``) in order of doc_id make a tree: each run of ``FAN`` consecutive
nodes becomes their parent until one node is left, the subroot; the subroots in
order of their group make the tree of the root.

Aligned builders each own a run of ``BLOCK`` consecutive leaves and append
nodes in the order in which they are complete, a parent right after its last
child: that is postorder. A builder's nodes are one segment of the log; block
roots are the leaves of the next tier of builders until a tree has one node.
A segment holds digests only: where the node (level, index) stands follows in
closed form from the sizes of the subtrees before it (``log_position``), in a
segment and in the whole log alike, so proof extraction addresses siblings by
position and stores no pointers. ``proof_positions`` and ``lookup_proof`` read
the proof of one leaf out of a written log.

Leaf positions are counted without a window over a whole group: rows are
range-partitioned by (group, doc_id), counted per partition and group, and
numbered inside each partition. Identical rows are counted first, and expanded
when every copy has a position.

Defined cases: null columns are encoded as ``-`` and null is a group of its own
that comes first; null doc_ids come first in their group, rows that share an
id are ordered by their leaf, repeated rows are leaves each; a lone leaf is its
group's subroot and a lone subroot the root (its proof is the hash of
nothing); an empty table gives an empty result; extra columns are no part of a
leaf and are ignored.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.tables import REPEAT_RANGE, materialise, repeat_rows

FAN = 8
TIER = 3  # levels a builder completes
BLOCK = FAN**TIER
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = "root"  # the name of the tree of subroots


def digest_of(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---- addresses -------------------------------------------------------------


def levels_of(leaves: int) -> int:
    """Levels above the leaves until one node is left."""
    up = 0
    while leaves > 1:
        leaves, up = -(-leaves // FAN), up + 1
    return up


def log_position(level: int, index: int, leaves: int, levels: int) -> int:
    """Place in postorder of a node of a tree of ``leaves`` leaves that has
    ``levels`` levels above them.

    Before it come, of its own level and those below, all nodes over leaves up
    to its last one, and of each level above the nodes that are complete
    before its first leaf."""
    width = FAN**level
    end = min((index + 1) * width, leaves)
    below = sum(-(-end // FAN**j) for j in range(level + 1))
    above = sum(index * width // FAN**j for j in range(level + 1, levels + 1))
    return below + above - 1


def sibling_positions(leaf: int, leaves: int, levels: int) -> list[tuple[list[int], list[int]]]:
    """For each level, the positions of the siblings before and after the node
    that stands over ``leaf``."""
    out = []
    index, count = leaf, leaves
    for level in range(levels):
        first = index // FAN * FAN
        places = {i: log_position(level, i, leaves, levels) for i in range(first, min(first + FAN, count)) if i != index}
        out.append(([p for i, p in places.items() if i < index], [p for i, p in places.items() if i > index]))
        index, count = index // FAN, -(-count // FAN)
    return out


# ---- builders --------------------------------------------------------------


def build_segment(leaves: list[str], levels: int) -> list[str]:
    """Digests of the subtree over ``leaves`` in order of completion."""
    log: list[str] = []
    waiting: list[list[str]] = [[] for _ in range(levels + 1)]

    def complete(level: int, digest: str) -> None:
        log.append(digest)
        waiting[level].append(digest)
        if level < levels and len(waiting[level]) == FAN:
            close(level)

    def close(level: int) -> None:
        children, waiting[level] = waiting[level], []
        complete(level + 1, digest_of(children))

    for leaf in leaves:
        complete(0, leaf)
    for level in range(levels):  # the last runs are shorter
        if waiting[level]:
            close(level)
    return log


SEGMENT = "tree string, tier int, block bigint, leaves int, levels int, digests array<string>"


def _build(key: tuple, table: pa.Table) -> pa.Table:
    tree, block = (k.as_py() for k in key)
    table = table.sort_by("position")
    leaves = table.column("digest").to_pylist()
    total = table.column("total")[0].as_py()
    levels = TIER if total > BLOCK else levels_of(total)
    return pa.table({
        "tree": [tree], "tier": pa.array([table.column("tier")[0].as_py()], pa.int32()), "block": [block],
        "leaves": pa.array([len(leaves)], pa.int32()), "levels": pa.array([levels], pa.int32()),
        "digests": pa.array([build_segment(leaves, levels)], pa.list_(pa.string())),
    })


def build_tiers(leaves: DataFrame, largest: int, name: str) -> list[DataFrame]:
    """The segments of every tier of a table (tree, position, digest, total);
    ``total`` is the number of leaves of the tree, ``largest`` the largest of
    them. A tree takes part in a tier while it has more than one node."""
    tiers = []
    nodes = leaves.select("tree", "position", "digest", "total")
    while largest > 1:
        rows = nodes.where("total > 1").withColumn("tier", F.lit(len(tiers))).withColumn(
            "block", F.expr(f"position div {BLOCK}")
        )
        segments, _ = materialise(rows.groupBy("tree", "block").applyInArrow(_build, SEGMENT), f"merkle-{name}{len(tiers)}")
        tiers.append(segments)
        totals = nodes.where("total > 1").groupBy("tree").agg(
            F.expr(f"(max(total) + {BLOCK - 1}) div {BLOCK}").alias("total")
        )
        nodes = segments.select("tree", F.col("block").alias("position"), F.element_at("digests", -1).alias("digest")).join(
            totals, "tree"
        )
        largest = -(-largest // BLOCK)
    return tiers


def tree_roots(leaves: DataFrame, tiers: list[DataFrame]) -> DataFrame:
    """(tree, subroot): the last digest of the block that is a whole tree."""
    lone = leaves.where("total = 1").select("tree", F.col("digest").alias("subroot"), F.lit(-1).alias("tier"))
    tops = [t.where("block = 0").select("tree", F.element_at("digests", -1).alias("subroot"), "tier") for t in tiers]
    for top in tops:
        lone = lone.unionByName(top)
    return lone.groupBy("tree").agg(F.max_by("subroot", "tier").alias("subroot"))


# ---- proofs ----------------------------------------------------------------


class _Path:
    """Siblings of the leaves of one segment, addressed in closed form."""

    _addresses: dict[tuple[int, int, int], list] = {}

    def __init__(self, digests: list[str], leaves: int, levels: int):
        self.digests, self.leaves, self.levels = digests, leaves, levels

    def siblings(self, leaf: int) -> list[tuple[str, str]]:
        key = (leaf, self.leaves, self.levels)
        if key not in self._addresses:
            if len(self._addresses) > 4 * BLOCK:
                self._addresses.clear()
            self._addresses[key] = sibling_positions(*key)
        at = self.digests
        return [("".join([at[p] for p in before]), "".join([at[p] for p in after])) for before, after in self._addresses[key]]


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for before, after in path:
        digest = hashlib.sha256((before + digest + after).encode()).hexdigest()
    return digest


PATH = "array<struct<before:string,after:string>>"


def _pairs(path: list[dict] | None) -> list[tuple[str, str]]:
    return [(p["before"], p["after"]) for p in path or []]


def block_paths(segments: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, position, path) of every leaf of ``segments``: the siblings
    inside the segment, then those in ``above`` (tree, block, path), which has
    the path of each segment's root."""

    def extend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                inside = _Path(row["digests"], row["leaves"], row["levels"])
                upper = row["path"] or []
                paths = [
                    [{"before": b, "after": a} for b, a in inside.siblings(i)] + upper for i in range(row["leaves"])
                ]
                positions = [row["block"] * BLOCK + i for i in range(row["leaves"])]
                kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["tree"]] * len(paths)), pa.array(positions, pa.int64()), pa.array(paths, kind)],
                    names=["tree", "position", "path"],
                )

    joined = segments.join(above, ["tree", "block"], "left")
    return joined.mapInArrow(extend, f"tree string, position bigint, path {PATH}")


def anchors(tiers: list[DataFrame], top: DataFrame, name: str) -> DataFrame:
    """(tree, block, path) of the roots of the lowest tier's segments, from
    the highest tier down; ``top`` has (tree, path) of the subroots."""
    above = top.select("tree", F.lit(0).cast("long").alias("block"), "path")
    for i in range(len(tiers) - 1, 0, -1):
        # a tree that is whole in a lower tier takes its path from the top there
        paths, _ = materialise(
            block_paths(tiers[i], above).select("tree", F.col("position").alias("block"), "path"), f"merkle-{name}-paths{i}"
        )
        whole = top.join(tiers[i].select("tree").distinct(), "tree", "left_anti")
        above = paths.unionByName(whole.select("tree", F.lit(0).cast("long").alias("block"), "path"))
    return above


PROVED = "doc_id bigint, leaf string, proof_sha256 string, folded_root string, tree string"


def _prove(key: tuple, rows: pa.Table, segment: pa.Table) -> pa.Table:
    """Proof and folded root of every row of a block."""
    if not rows.num_rows:
        return pa.table({f.split()[0]: pa.array([], pa.int64() if "bigint" in f else pa.string()) for f in PROVED.split(", ")})
    (seg,) = segment.to_pylist()
    inside, upper = _Path(seg["digests"], seg["leaves"], seg["levels"]), _pairs(seg["path"])
    tail = "".join(b + a for b, a in upper)
    block = key[1].as_py()
    out: dict[str, list] = {"doc_id": [], "leaf": [], "proof_sha256": [], "folded_root": []}
    for doc_id, position, leaf, shown in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "position", "digest", "shown"))):
        path = inside.siblings(position - block * BLOCK)
        out["doc_id"].append(doc_id)
        out["leaf"].append(leaf)
        out["proof_sha256"].append(digest_of([b + a for b, a in path] + [tail]))
        out["folded_root"].append(fold(fold(shown, path), upper))
    ids = pa.array(out.pop("doc_id"), pa.int64())
    return pa.table({"doc_id": ids, **out, "tree": [key[0].as_py()] * len(ids)})


# ---- leaves ----------------------------------------------------------------


def encoded(column: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """Leaf of a row of ``documents`` with ``text`` in place of its text."""
    fields = [encoded(text if c == "text" else F.col(c)) for c in COLUMNS]
    return F.sha2(F.concat(*fields), 256)


def number_rows(units: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``first``, the number of rows of the same ``tree`` before a unit,
    and ``total``, those of the tree. ``units`` has ``m`` rows each, should be
    a written table and distinct in (tree, *order)."""
    spread = units.repartitionByRange(F.col("tree"), *order).withColumn("part", F.spark_partition_id())
    spread, _ = materialise(spread, f"merkle-{name}-spread")
    parts = spread.groupBy("tree", "part").agg(F.sum("m").alias("rows"))
    # a row for each partition and each tree; a tree's partitions are neighbours
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0))).withColumn(
        "total", F.sum("rows").over(Window.partitionBy("tree"))
    )
    inside = Window.partitionBy("tree", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        spread.withColumn("upto", F.sum("m").over(inside))
        .join(offsets.drop("rows"), ["tree", "part"])
        .withColumn("first", F.col("offset") + F.col("upto") - F.col("m"))
        .drop("upto", "offset", "part")
    )


def document_leaves(documents: DataFrame, limit: int = REPEAT_RANGE) -> tuple[DataFrame, int]:
    """(tree, position, digest, shown, doc_id, lang, total) of every document,
    and the size of the largest tree. ``shown`` is the leaf as a proof will be
    asked for it: that of the tampered row where 3 divides the CRC of the id."""
    ids = F.col("doc_id").cast("string")
    tampered = F.coalesce(F.crc32(ids.cast("binary")) % 3 == 0, F.lit(False))
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "lang",
        encoded(F.col("lang")).alias("tree"),
        leaf_digest(F.col("text")).alias("digest"),
        F.when(tampered, leaf_digest(lowered)).otherwise(leaf_digest(F.col("text"))).alias("shown"),
    )
    units, _ = materialise(
        rows.groupBy("tree", "lang", "doc_id", "digest", "shown").agg(F.count(F.lit(1)).alias("m")), "merkle-units"
    )
    numbered, _ = materialise(
        number_rows(units, [F.col("doc_id").asc_nulls_first(), F.col("digest")], "documents"), "merkle-numbered"
    )
    sizes = numbered.agg(F.max("m").alias("most"), F.max("total").alias("largest")).first()
    leaves = repeat_rows(numbered, "m", "copy", int(sizes.most or 0), limit)
    return leaves.withColumn("position", F.col("first") + F.col("copy")).drop("first", "copy", "m"), int(sizes.largest or 0)


def build_manifest(leaves: DataFrame, largest: int) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """The log of the groups (segments of each tier), that of the tree of
    subroots, and (tree, subroot, root, path) of each group, where ``path``
    leads from the subroot to the root."""
    tiers = build_tiers(leaves, largest, "tier")
    langs = leaves.where("position = 0").select("tree", "lang")
    subroots, _ = materialise(
        tree_roots(leaves, tiers).join(langs, "tree").select(
            F.lit(TOP).alias("tree"), F.col("tree").alias("group"), F.col("lang"), F.col("subroot").alias("digest"),
            F.lit(1).cast("long").alias("m"),
        ),
        "merkle-subroots",
    )
    # binary order: UTF-8 bytewise, null first
    order = [F.col("lang").cast("binary").asc_nulls_first()]
    ranked, _ = materialise(number_rows(subroots, order, "subroots").withColumnRenamed("first", "position"), "merkle-ranked")
    groups = int(ranked.agg(F.max("total")).first()[0] or 0)
    top_tiers = build_tiers(ranked, groups, "top")
    root = tree_roots(ranked, top_tiers).select(F.col("subroot").alias("root"))
    start = root.select(F.lit(TOP).alias("tree"), F.expr(f"CAST(array() AS {PATH})").alias("path"))
    if top_tiers:
        paths = block_paths(top_tiers[0], anchors(top_tiers, start, "top")).select("position", "path")
    else:
        paths = start.select(F.lit(0).cast("long").alias("position"), "path")
    # one row: the tree of subroots
    named = root.select(F.lit(TOP).alias("tree"), "root")
    proved = ranked.join(paths, "position").join(F.broadcast(named), "tree")
    top, _ = materialise(
        proved.select(F.col("group").alias("tree"), F.col("digest").alias("subroot"), "root", "path"), "merkle-roots"
    )
    return tiers, top_tiers, top


def manifest_digest(documents: DataFrame, limit: int = REPEAT_RANGE) -> DataFrame:
    """Leaf, roots, proof and verification of every document."""
    leaves, largest = document_leaves(documents, limit)
    leaves, _ = materialise(leaves, "merkle-leaves")
    tiers, _, top = build_manifest(leaves, largest)
    # a lone leaf has no segment: its path is that of its subroot
    lone = leaves.where("total = 1").join(top.select("tree", "path"), "tree").select(
        "doc_id", F.col("digest").alias("leaf"), _proof(F.col("path")).alias("proof_sha256"),
        _fold(F.col("shown"), F.col("path")).alias("folded_root"), "tree",
    )
    proved = lone
    if tiers:
        segments = tiers[0].join(anchors(tiers, top, "tier"), ["tree", "block"]).groupBy("tree", "block")
        rows = leaves.where("total > 1").withColumn("block", F.expr(f"position div {BLOCK}"))
        many = rows.groupBy("tree", "block").cogroup(segments).applyInArrow(_prove, PROVED)
        proved = many.unionByName(lone)
    return proved.join(top.drop("path"), "tree").select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _proof(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def _fold(leaf: Column, path: Column) -> Column:
    return F.aggregate(path, leaf, lambda acc, p: F.sha2(F.concat(p["before"], acc, p["after"]), 256))


# ---- the log as a table ----------------------------------------------------


def log_table(tiers: list[DataFrame], sizes: DataFrame) -> DataFrame:
    """(tree, position, digest): every node at its place in the tree's
    postorder. ``sizes`` has (tree, total), the number of leaves."""

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                total, base = row["total"], row["tier"] * TIER
                levels = levels_of(total)
                positions = []
                for level in range(0 if row["tier"] == 0 else 1, row["levels"] + 1):
                    first = row["block"] * BLOCK // FAN**level
                    for i in range(-(-row["leaves"] // FAN**level)):
                        own = log_position(level, i, row["leaves"], row["levels"])
                        positions.append((log_position(base + level, first + i, total, levels), row["digests"][own]))
                positions.sort()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["tree"]] * len(positions)),
                        pa.array([p for p, _ in positions], pa.int64()),
                        pa.array([d for _, d in positions]),
                    ],
                    names=["tree", "position", "digest"],
                )

    segments = tiers[0]
    for tier in tiers[1:]:
        segments = segments.unionByName(tier)
    return segments.join(sizes.select("tree", "total"), "tree").mapInArrow(place, "tree string, position bigint, digest string")


def proof_positions(leaf: int, total: int) -> list[tuple[list[int], list[int]]]:
    """Places in a tree's log of the siblings that prove a leaf."""
    return sibling_positions(leaf, total, levels_of(total))


def lookup_proof(log: DataFrame, tree: str, leaf: int, total: int) -> list[tuple[str, str]]:
    """The path of one leaf read out of a log: an ``IN`` filter over at most
    seven positions a level, which Parquet can answer from its statistics."""
    places = proof_positions(leaf, total)
    wanted = [p for before, after in places for p in before + after]
    found = {r.position: r.digest for r in log.where((F.col("tree") == tree) & F.col("position").isin(wanted)).collect()}
    return [("".join(found[p] for p in b), "".join(found[p] for p in a)) for b, a in places]
