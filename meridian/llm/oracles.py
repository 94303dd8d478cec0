"""DuckDB twins of the operators that SQL can express, from their definitions.

CRC-32 is not among DuckDB's functions: its table follows from the polynomial,
and a text's value from a fold over its bytes.
"""

from __future__ import annotations

_STEP = "CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END"


def _crc_table() -> str:
    """``crc_table(t)``: one row with the list of the 256 values."""
    levels = ["SELECT i, CAST(i AS BIGINT) AS c FROM range(256) r(i)"]
    for _ in range(8):
        levels.append(f"SELECT i, {_STEP.format(c='c')} AS c FROM ({levels[-1]})")
    return f"crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM ({levels[-1]}))"


def crc32(text: str, t: str = "t") -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a non-empty text; ``t`` is the table's list."""
    code = f"hex(encode({text}))"
    byte = lambda i: f"CAST('0x' || substr({code}, 2 * {i} + 1, 2) AS BIGINT)"
    octets = f"list_transform(range(0, octet_length(encode({text}))), lambda i: {byte('i')})"
    return f"xor(4294967295, list_reduce({octets}, lambda c, b: xor({t}[(xor(c, b) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT)))"


_WORDS = r"list_filter(regexp_split_to_array(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

OP12 = f"""
WITH {_crc_table()},
doc_words AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
doc_counts AS MATERIALIZED (SELECT r, w, count(*) AS c FROM (SELECT r, unnest(ws) AS w FROM doc_words) GROUP BY r, w),
item_counts AS MATERIALIZED (SELECT w, count(*) AS c FROM (SELECT unnest({_WORDS.format(text="coalesce(text, '')")}) AS w FROM benchmark) GROUP BY w),
vocabulary AS MATERIALIZED (SELECT w, {crc32("w")} % 10000 AS b FROM (SELECT w FROM doc_counts UNION SELECT w FROM item_counts) CROSS JOIN crc_table),
s_of AS (SELECT b, sum(c) AS n FROM doc_counts JOIN vocabulary USING (w) GROUP BY b),
t_of AS (SELECT b, sum(c) AS n FROM item_counts JOIN vocabulary USING (w) GROUP BY b),
totals AS (SELECT coalesce((SELECT sum(n) FROM s_of), 0) + 10000 AS s_all, coalesce((SELECT sum(n) FROM t_of), 0) + 10000 AS t_all),
gain AS MATERIALIZED (SELECT b, CAST(floor(1000 * ln(CAST((coalesce(t_of.n, 0) + 1) AS DOUBLE) * CAST(s_all AS DOUBLE) / (CAST((coalesce(s_of.n, 0) + 1) AS DOUBLE) * CAST(t_all AS DOUBLE)))) AS BIGINT) AS g
    FROM range(10000) u(b) LEFT JOIN s_of USING (b) LEFT JOIN t_of USING (b) CROSS JOIN totals),
summed AS (SELECT r, sum(c) AS n, sum(c * g) AS total FROM doc_counts JOIN vocabulary USING (w) JOIN gain USING (b) GROUP BY r),
scored AS MATERIALIZED (
    SELECT r, doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features,
           CAST(CASE WHEN n IS NULL THEN 0 WHEN total >= 0 OR total % n = 0 THEN total // n ELSE total // n - 1 END AS BIGINT) AS weight,
           CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
    FROM doc_words LEFT JOIN summed USING (r)),
drawn AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS k, count(*) OVER () AS n FROM drawn WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 10 * n // 100 THEN k END AS rank FROM drawn LEFT JOIN ranked USING (r)
"""


def _part(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE octet_length(encode(CAST({column} AS VARCHAR))) || ':' || CAST({column} AS VARCHAR) END"


def _leaf(text: str = "text") -> str:
    return f"sha256({' || '.join(map(_part, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Trees are tables of nodes, a level at a time; a leaf's way up lists the node to replace at every level.
OP13 = f"""
WITH RECURSIVE {_crc_table()},
leaves AS MATERIALIZED (
    SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
    FROM (SELECT doc_id, lang, {_leaf()} AS leaf, CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_leaf(_LOWER)} END AS bad
          FROM documents CROSS JOIN crc_table)),
nodes(tree, lvl, pos, n, h) AS (
    SELECT lang, 0, pos, n, leaf FROM leaves
    UNION ALL
    SELECT tree, lvl + 1, pos // 8, (min(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, lvl, pos // 8),
subroots AS MATERIALIZED (SELECT tree, h AS subroot, lvl AS height, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(lvl, pos, n, h) AS (
    SELECT 0, pos, n, subroot FROM subroots
    UNION ALL
    SELECT lvl + 1, pos // 8, (min(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY lvl, pos // 8),
runs AS MATERIALIZED (SELECT tree, lvl, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM nodes WHERE n > 1 GROUP BY ALL),
top_runs AS MATERIALIZED (SELECT lvl, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM tops WHERE n > 1 GROUP BY ALL),
way(r, tree, lvl, pos, proof, now) AS (
    SELECT r, lang, 0, pos, '', coalesce(bad, leaf) FROM leaves
    UNION ALL
    SELECT w.r, w.tree, w.lvl + 1, w.pos // 8,
           w.proof || array_to_string(hs[1:w.pos % 8], '') || array_to_string(hs[w.pos % 8 + 2:8], ''),
           sha256(array_to_string(hs[1:w.pos % 8], '') || w.now || array_to_string(hs[w.pos % 8 + 2:8], ''))
    FROM way w JOIN runs u ON u.tree IS NOT DISTINCT FROM w.tree AND u.lvl = w.lvl AND u.run = w.pos // 8),
arrived AS MATERIALIZED (SELECT w.r, w.proof, w.now, s.pos, s.subroot FROM way w JOIN subroots s ON s.tree IS NOT DISTINCT FROM w.tree AND s.height = w.lvl),
top_way(r, lvl, pos, proof, now) AS (
    SELECT r, 0, pos, proof, now FROM arrived
    UNION ALL
    SELECT w.r, w.lvl + 1, w.pos // 8,
           w.proof || array_to_string(hs[1:w.pos % 8], '') || array_to_string(hs[w.pos % 8 + 2:8], ''),
           sha256(array_to_string(hs[1:w.pos % 8], '') || w.now || array_to_string(hs[w.pos % 8 + 2:8], ''))
    FROM top_way w JOIN top_runs u ON u.lvl = w.lvl AND u.run = w.pos // 8),
root AS (SELECT h AS root, lvl AS height FROM tops WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(t.proof) AS proof_sha256, t.now AS folded_root, t.now = root AS verified
FROM leaves JOIN arrived USING (r) JOIN top_way t USING (r) JOIN root ON t.lvl = root.height
"""

ORACLE = {"op12_importance_resampling": OP12, "op13_merkle_manifest": OP13}
