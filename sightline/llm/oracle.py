"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(column: str) -> str:
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


_NEXT = ", ".join(f"lead(word, {j}) OVER w" for j in range(1, 10))

_NEAR = " AND ".join(f"list_contains(ws[greatest(s + {j - 1}, 1):s + {j + 1}], g[{j + 1}])" for j in range(1, 10))

OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words('text')} AS ws FROM documents),
b AS (SELECT row_number() OVER () AS bid, item_id, {_words('text')} AS ws FROM benchmark),
dw AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
bw AS (SELECT bid, item_id, least(10, len(ws)) AS k, len(ws) AS n,
              unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM b),
bg AS (SELECT DISTINCT item_id, k, array_to_string(g[1:k], ' ') AS gram FROM (
         SELECT item_id, k, n, p, [word, {_NEXT}] AS g FROM bw WINDOW w AS (PARTITION BY bid ORDER BY p))
       WHERE p + k - 1 <= n),
sizes AS (SELECT DISTINCT k FROM bg),
dg AS (SELECT rid, p, k, array_to_string(g[1:k], ' ') AS gram FROM (
         SELECT rid, p, [word, {_NEXT}] AS g FROM dw WINDOW w AS (PARTITION BY rid ORDER BY p)), sizes
       WHERE g[k] IS NOT NULL),
m AS (SELECT rid, p, k, item_id FROM dg JOIN bg USING (k, gram)),
hit AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM m) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM m WHERE item_id IS NOT NULL) GROUP BY rid),
q AS (SELECT row_number() OVER () AS qid, string_split(gram, ' ') AS g
      FROM (SELECT DISTINCT gram FROM bg WHERE k = 10)),
freq AS (SELECT word, count(*) AS f FROM dw GROUP BY word),
seed AS (SELECT qid, arg_min(j, f) AS j, arg_min(word, f) AS word
         FROM (SELECT qid, unnest(g) AS word, generate_subscripts(g, 1) AS j FROM q) JOIN freq USING (word)
         GROUP BY qid HAVING count(*) = 10),
c AS (SELECT DISTINCT rid, qid, p - j + 1 + o AS s FROM seed JOIN dw USING (word), (VALUES (-1), (0), (1)) AS t(o)),
near AS (SELECT rid, s, len(ws) AS n FROM c JOIN d USING (rid) JOIN q USING (qid)
         WHERE s BETWEEN 1 AND len(ws) AND ws[s] = g[1] AND {_NEAR}),
nh AS (SELECT rid, count(DISTINCT x) AS n_near
       FROM (SELECT rid, unnest(range(s, least(s + 10, n + 1))) AS x FROM near) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid) LEFT JOIN nh USING (rid)
"""

OP4 = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest,
                  CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS DISTINCT FROM page_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM f
"""

# strings of 50 bytes are put together from runs of 2, 4, 8, ... bytes (hex)
OP7 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT rid, doc_id, unnest(hs) AS c1, generate_subscripts(hs, 1) AS i
      FROM (SELECT rid, doc_id, regexp_extract_all(hex(encode(t)), '..') AS hs FROM d)),
b2 AS (SELECT *, c1 || lead(c1, 1) OVER w AS c2 FROM b WINDOW w AS (PARTITION BY rid ORDER BY i)),
b4 AS (SELECT *, c2 || lead(c2, 2) OVER w AS c4 FROM b2 WINDOW w AS (PARTITION BY rid ORDER BY i)),
b8 AS (SELECT * EXCLUDE (c4), c4 || lead(c4, 4) OVER w AS c8 FROM b4 WINDOW w AS (PARTITION BY rid ORDER BY i)),
b16 AS (SELECT * EXCLUDE (c8), c8 || lead(c8, 8) OVER w AS c16 FROM b8 WINDOW w AS (PARTITION BY rid ORDER BY i)),
b50 AS (SELECT rid, doc_id, i, c1, c16 || lead(c16, 16) OVER w || lead(c16, 32) OVER w || lead(c2, 48) OVER w AS c50
        FROM b16 WINDOW w AS (PARTITION BY rid ORDER BY i)),
first AS (SELECT c50, min(doc_id) AS least FROM b50 WHERE c50 IS NOT NULL GROUP BY c50),
gone AS (SELECT rid, i, c1, coalesce(max(CASE WHEN least < doc_id THEN 1 ELSE 0 END)
                OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS g
         FROM b50 LEFT JOIN first USING (c50)),
spans AS (SELECT *, CASE WHEN g = 1 AND coalesce(lag(g) OVER (PARTITION BY rid ORDER BY i), 0) = 0 THEN 1 ELSE 0 END AS s
          FROM gone),
r AS (SELECT rid, sum(g) AS n_removed, sum(s) AS n_spans,
             coalesce(string_agg(c1, '' ORDER BY i) FILTER (WHERE g = 0), '') AS kept FROM spans GROUP BY rid)
SELECT doc_id, CAST(strlen(t) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN r USING (rid)
"""

# CRC-32 of the decimal id in steps of four bits; the table of a step follows
# from the polynomial
_LEVELS = 8  # 8 ** 8 leaves of a group


def _nibble(i: int) -> int:
    for _ in range(4):
        i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
    return i


_TABLE = "[" + ", ".join(f"{_nibble(i)}::BIGINT" for i in range(16)) + "]"
_NIBBLES = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c) & 15, ascii(c) >> 4]))"
_CRC = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, {_NIBBLES}),
          lambda acc, nib: xor(acc >> 4, ({_TABLE})[CAST((xor(acc, nib) & 15) + 1 AS BIGINT)])), 4294967295::BIGINT)"""


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _tree(name: str, leaves: str) -> str:
    """Levels ``name``0.. of the trees over ``leaves`` (tree, i, d, n): each
    node with its siblings before and after it (none in a finished tree)."""
    steps = [f"{name}n0 AS ({leaves})"]
    for k in range(_LEVELS + 1):
        run = "PARTITION BY tree, i // 8 ORDER BY i ROWS BETWEEN"
        steps.append(
            f"{name}{k} AS (SELECT tree, i, d, n, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,"
            f" coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}n{k})"
        )
        steps.append(
            f"{name}n{k + 1} AS (SELECT tree, i // 8 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i))"
            f" ELSE any_value(d) END AS d, (any_value(n) + 7) // 8 AS n FROM {name}n{k} GROUP BY tree, i // 8)"
        )
    return ",\n".join(steps)


def _climb(name: str, out: str, source: str) -> str:
    """Folds ``source`` (tree, i, acc, proof, ...) up the levels of a tree."""
    steps, before = [], source
    for k in range(_LEVELS + 1):
        steps.append(
            f"{out}{k} AS (SELECT s.* REPLACE (CASE WHEN t.n > 1 THEN sha256(t.b || s.acc || t.a) ELSE s.acc END AS acc,"
            f" s.proof || t.b || t.a AS proof, s.i // 8 AS i) FROM {before} s JOIN {name}{k} t ON s.tree = t.tree AND s.i = t.i)"
        )
        before = f"{out}{k}"
    return ",\n".join(steps)


OP13 = f"""
WITH d AS (SELECT doc_id, lang, {_field('lang')} AS tree, {_leaf('text')} AS leaf,
                  CASE WHEN doc_id IS NOT NULL AND {_CRC} % 3 = 0 THEN {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")}
                       ELSE {_leaf('text')} END AS shown FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
             count(*) OVER (PARTITION BY tree) AS n FROM d),
{_tree('g', 'SELECT tree, i, leaf AS d, n FROM p')},
s AS (SELECT tree, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS gi, count(*) OVER () AS gn
      FROM gn{_LEVELS} JOIN (SELECT DISTINCT tree, lang FROM d) USING (tree)),
{_tree('r', "SELECT 'root' AS tree, gi AS i, subroot AS d, gn AS n FROM s")},
f AS (SELECT tree, tree AS own, doc_id, leaf, i, shown AS acc, '' AS proof FROM p),
{_climb('g', 'f', 'f')},
h AS (SELECT 'root' AS tree, own, doc_id, leaf, s.gi AS i, acc, proof, subroot FROM f{_LEVELS} JOIN s ON own = s.tree),
{_climb('r', 'h', 'h')}
SELECT doc_id, leaf, subroot, x.d AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = x.d AS verified
FROM h{_LEVELS} CROSS JOIN (SELECT d FROM rn{_LEVELS}) x
"""

ORACLE: dict[str, str] = {
    "op2_decontamination": OP2,
    "op4_warc": OP4,
    "op7_suffix_dedup": OP7,
    "op13_merkle": OP13,
}
