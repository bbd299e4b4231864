import hashlib
import string
import zlib

import pytest

from sightline.llm import merkle
from sightline.llm.tables import materialise
from tests.llm.conftest import DOC_SCHEMA

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encode(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text) -> str:
    doc_id, _, lang, source, n_chars = row
    return sha(*map(encode, (doc_id, source, lang, n_chars, text)))


def climb(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(*below[i : i + 8]) for i in range(0, len(below), 8)])
    return levels


def path_of(levels, i):
    out = []
    for nodes in levels[:-1]:
        first = i // 8 * 8
        run = nodes[first : first + 8]
        out.append(("".join(run[: i - first]), "".join(run[i - first + 1 :])))
        i //= 8
    return out


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    groups: dict = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        ranked = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        trees[g] = ranked, climb([leaf_of(r, r[1]) for r in ranked])
    top = climb([trees[g][1][-1][0] for g in order])
    root = top[-1][0]
    out = []
    for at, g in enumerate(order):
        ranked, levels = trees[g]
        for i, row in enumerate(ranked):
            path = path_of(levels, i) + path_of(top, at)
            leaf = leaf_of(row, row[1])
            shown = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                shown = leaf_of(row, None if row[1] is None else row[1].translate(LOWER))
            folded = shown
            for before, after in path:
                folded = sha(before, folded, after)
            proof = sha(*(b + a for b, a in path))
            out.append((row[0], leaf, levels[-1][0], root, proof, folded, folded == root))
    return out


def check(spark, rows, limit=1 << 20, parts=5):
    df = spark.createDataFrame(rows, DOC_SCHEMA).repartition(parts)
    got = [tuple(r) for r in merkle.manifest_digest(df, limit).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))
    return got


@pytest.mark.parametrize("leaves", [1, 2, 7, 8, 9, 63, 64, 65, 512, 513, 700, 4097])
def test_closed_form_positions_are_those_of_the_log(leaves):
    """Every node of a tree, by its position, against a plain postorder walk."""
    nodes = [str(i) for i in range(leaves)]
    levels = climb(nodes)
    log = []

    def walk(level, i):
        if level:
            for child in range(i * 8, min(i * 8 + 8, len(levels[level - 1]))):
                walk(level - 1, child)
        log.append(levels[level][i])

    walk(len(levels) - 1, 0)
    assert merkle.build_segment(nodes, merkle.levels_of(leaves)) == log
    for level, row in enumerate(levels):
        for i, digest in enumerate(row):
            assert log[merkle.log_position(level, i, leaves, len(levels) - 1)] == digest
    for i in {0, leaves // 2, leaves - 1}:
        path = [("".join(log[p] for p in b), "".join(log[p] for p in a)) for b, a in merkle.proof_positions(i, leaves)]
        assert path == path_of(levels, i)
        assert merkle.fold(nodes[i], path) == levels[-1][0]


def rows_of(counts: dict, start=0):
    out, doc_id = [], start
    for lang, n in counts.items():
        for _ in range(n):
            out.append((doc_id, f"Text {doc_id} É" if doc_id % 5 else None, lang, "AbC" if doc_id % 2 else None, doc_id % 11))
            doc_id += 1
    return out


def test_digest_over_several_tiers_and_groups(spark):
    """Lone leaves, whole blocks, a block of one leaf, two tiers, a null group."""
    counts = {"en": 1100, None: 9, "de": 1, "É": 513, "a": 512, "ab": 8, "z": 65, "B": 2, "c": 3, "d": 1}
    got = check(spark, rows_of(counts))
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)
    # only rows whose text changed fail
    assert all(r[-1] or zlib.crc32(str(r[0]).encode()) % 3 == 0 for r in got)


def test_ties_nulls_and_repeated_rows(spark, edge_rows):
    rows = [r[:5] for r in edge_rows] + [(7, "again", "fr", None, 1)] * 30 + [(None, "N", None, None, None)] * 12
    check(spark, rows, limit=7)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(3, "A", "en", "s", 1)], [(3, "A", "en", "s", 1)] * 2])
def test_small_tables(spark, rows):
    got = check(spark, rows, parts=1) if rows else merkle.manifest_digest(spark.createDataFrame([], DOC_SCHEMA)).collect()
    assert len(got) == len(rows)


def test_extra_columns_are_no_part_of_a_leaf(spark, edge_docs):
    more = edge_docs.selectExpr("*", "'x' as digest", "map(1, 2) as tree", "1 as m")
    assert sorted(map(repr, merkle.manifest_digest(more).collect())) == sorted(map(repr, merkle.manifest_digest(edge_docs).collect()))


def test_log_table_and_single_proof(spark):
    rows = rows_of({"en": 1300, "de": 40, "fr": 1})
    leaves, largest = merkle.document_leaves(spark.createDataFrame(rows, DOC_SCHEMA))
    leaves, _ = materialise(leaves, "test-leaves")
    tiers, _, top = merkle.build_manifest(leaves, largest)
    assert len(tiers) == 2
    sizes = leaves.select("tree", "total").distinct()
    log, _ = materialise(merkle.log_table(tiers, sizes).repartitionByRange("tree", "position"), "test-log")
    stored = {}
    for r in log.collect():
        assert stored.setdefault((r.tree, r.position), r.digest) == r.digest
    roots = {r.tree: r.subroot for r in top.collect()}
    for tree, total in (("2:en", 1300), ("2:de", 40)):
        assert sorted(p for t, p in stored if t == tree) == list(range(sum(t == tree for t, _ in stored)))
        for leaf in (0, 39, total - 1):
            row = leaves.where(f"tree = '{tree}' and position = {leaf}").first()
            path = merkle.lookup_proof(log, tree, leaf, total)
            assert merkle.fold(row.digest, path) == roots[tree]
