import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from sightline.llm import components, simhash
from tests.llm.conftest import prose


def brute_fingerprint(text: str | None) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps: list[int], distance: int) -> list[int]:
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= distance:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(fps))]


TEXTS = [None, "", " \t", "one", "One two three", "a b c d", "A B C D E", prose(300), "É é Ω word " * 50, "x " * 700]


def test_fingerprints():
    got = simhash.fingerprints([(t or "").encode() for t in TEXTS])
    assert [int(x) for x in got] == [brute_fingerprint(t) for t in TEXTS]


def crowd(seed: int, n: int) -> list[int]:
    """Random words, chains of small steps, and a crowd around one centre."""
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(n)]
    for step in (1, 3, 4, 5):
        fp = rng.getrandbits(64)
        for _ in range(12):
            fps.append(fp)
            for b in rng.sample(range(64), step):
                fp ^= 1 << b
    centre = rng.getrandbits(64)
    for _ in range(150):
        fp = centre
        for b in rng.sample(range(64), rng.randint(0, 5)):
            fp ^= 1 << b
        fps.append(fp)
    return fps + [0, (1 << 64) - 1]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_all_pairs(spark, seed):
    fps = crowd(seed, 300)
    rows = [(i, int(np.uint64(fp).astype(np.int64))) for i, fp in enumerate(fps)]
    prints = spark.createDataFrame(rows, "doc_id bigint, fp bigint").repartition(3)
    limit = 4
    ids = {r.fp: r.component_id for r in simhash.component_ids(prints, limit).collect()}
    least = {}
    for i, root in enumerate(brute_components(fps, limit)):
        least.setdefault(root, i)
    expected = [least[root] for root in brute_components(fps, limit)]
    first = {}
    for i, fp in enumerate(fps):
        first.setdefault(fp, i)
    assert [ids[fp] for _, fp in rows] == expected


def test_variants_of_all_blocks_are_the_ball():
    for k in (4, 9, 13):
        masks = simhash._masks(k, 2)
        assert sum(map(len, masks.values())) == 1 + 64 + 64 * 63 // 2
        assert set(masks) <= set(simhash._flips(k, 2))


def test_long_chain_of_components(spark):
    n = 400
    edges = [(i, i + 1) for i in range(n)] + [(1000 + i, 2000) for i in range(300)] + [(7, 7)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(n + 1))
    assert all(got[1000 + i] == 1000 for i in range(300)) and got[2000] == 1000


def test_edge_rows(edge_docs, edge_rows):
    rows = simhash.near_duplicates(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    fps = [brute_fingerprint(t) for _, t, *_ in edge_rows]
    roots = brute_components(fps, 4)
    least = {r: min((edge_rows[i][0] for i in range(len(fps)) if roots[i] == r and edge_rows[i][0] is not None),
                    default=None) for r in roots}
    expected = sorted((str(edge_rows[i][0]), f"{fps[i]:016x}", str(least[roots[i]])) for i in range(len(fps)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows) == expected


def test_keep_one(edge_docs, edge_rows):
    docs = edge_docs.selectExpr("*", "'x' as fp", "1 as _row_key", "2 as _row", "doc_id as component_id")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    fps = [brute_fingerprint(t) for _, t, *_ in edge_rows]
    roots = brute_components(fps, 4)
    rows = kept.collect()
    assert len(rows) == len(set(roots))
    found = sorted(str(r.doc_id) for r in rows)
    least = [min((edge_rows[i][0] for i in range(len(fps)) if roots[i] == r and edge_rows[i][0] is not None),
                 default=None) for r in set(roots)]
    assert found == sorted(map(str, least))


def test_empty(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.keep_one(no_docs).count() == 0
