"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .secrets import RULES

WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP5 = f"""
WITH w AS (SELECT doc_id, coalesce({WORDS}, []) AS ws FROM documents),
starts AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 34), ' ') AS passage FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35) s),
often AS (SELECT passage FROM starts GROUP BY passage HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM starts SEMI JOIN often USING (passage)) g),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w) x ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN removed r USING (doc_id) LEFT JOIN kept k USING (doc_id)"""

_NORMAL = rf"coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
OP8 = f"""
WITH w AS (SELECT doc_id, {_NORMAL} AS ws FROM documents),
items AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM (SELECT item_id, {_NORMAL} AS ws FROM benchmark) b WHERE len(ws) > 0),
passages AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS passage FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM items) s),
starts AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS passage FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM passages) l WHERE len(ws) >= n) s),
hits AS (SELECT doc_id, starts.n, i, item_id FROM starts JOIN passages USING (n, passage)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) h GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) d GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items, sha256(coalesce(f.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM w LEFT JOIN hit_words h USING (doc_id) LEFT JOIN found f USING (doc_id)"""

_BITS = "CAST(('0x' || substr(md5({}), 1, 13)) AS BIGINT)"
OP9 = f"""
WITH sizes AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
rates AS (SELECT s, CAST(1 AS DOUBLE) / (SELECT count(*) FROM sizes) * (SELECT sum(n) FROM sizes) / n AS rate FROM sizes),
parts AS (SELECT s, rate, CAST(CASE WHEN rate > 8 THEN floor(rate / 8) ELSE 0 END AS INT) AS whole FROM rates),
draws AS (SELECT s, n, CASE WHEN n = 0 THEN rate - 8 * whole ELSE 8 END AS mean FROM (SELECT s, rate, whole, unnest(range(0, whole + 1)) AS n FROM parts) q),
terms AS (SELECT s, n, k, exp(-mean + CASE WHEN k = 0 THEN 0 ELSE k * ln(greatest(mean, 1e-300)) END - CASE WHEN k = 0 THEN 0 ELSE lgamma(k + 1) END) AS term FROM draws, (SELECT unnest(range(0, 48)) AS k) t),
below AS (SELECT s, n, k, sum(term) OVER (PARTITION BY s, n ORDER BY k ROWS UNBOUNDED PRECEDING) AS below FROM terms),
counted AS (SELECT d.doc_id, count(*) AS n FROM documents d JOIN below b ON b.s = coalesce(d.source, '') AND {_BITS.format("'mix' || CASE WHEN b.n = 0 THEN '' ELSE '/' || b.n END || ':' || coalesce(CAST(d.doc_id AS VARCHAR), '')")} / CAST(4503599627370496 AS DOUBLE) >= b.below GROUP BY d.doc_id),
copies AS (SELECT doc_id, CAST(n AS INT) AS n_copies, CAST(unnest(range(1, CAST(n AS BIGINT) + 1)) AS INT) AS copy_no FROM counted)
SELECT d.*, c.n_copies, c.copy_no, {_BITS.format("'mix/order:' || d.doc_id || '/' || c.copy_no")} AS shuffle_key FROM copies c JOIN documents d USING (doc_id)"""


def _matches(number: int, kind: str, pattern: str) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    test = {"assign": f"length(regexp_extract(m, {p}, 2)) >= 6", "access": "length(m) >= 20"}.get(kind, "TRUE")
    return f"""SELECT doc_id, {number} AS number, '{kind}' AS kind, first, first + length(m) AS last FROM (
        SELECT doc_id, m, sum(length(piece) + length(m)) OVER (PARTITION BY doc_id ORDER BY k) - length(m) AS first FROM (
            SELECT doc_id, unnest(range(1, len(ms) + 1)) AS k, unnest(ms) AS m, unnest(list_slice(pieces, 1, len(ms))) AS piece FROM (
                SELECT doc_id, regexp_extract_all(text, {p}) AS ms, string_split_regex(text, {p}) AS pieces FROM documents WHERE regexp_matches(text, {p})) a) b) c WHERE {test}"""


_SPAN = "kind || ':' || CAST(first AS BIGINT) || ':' || CAST(last AS BIGINT)"
OP10 = f"""
WITH spans AS ({" UNION ALL ".join(_matches(i, r.kind, r.pattern) for i, r in enumerate(RULES))}),
summed AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg({_SPAN}, ',' ORDER BY first, number) FILTER (WHERE number < 3) AS base, string_agg({_SPAN}, ',' ORDER BY first, number) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN summed USING (doc_id)"""

_CRC = """(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(id) + 1), lambda i: CAST(ascii(substr(id, i, 1)) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT) for i in range(8)]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


def _field(x: str) -> str:
    return f"coalesce(CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(name: str, levels: int) -> str:
    """CTEs {name}0 (t, i, n, d) and what stands above: level after level while a tree has several nodes, and each node's siblings on its left and right."""
    out = []
    for k in range(levels):
        out.append(f"""{name}s{k} AS (SELECT t, i, n, coalesce(string_agg(d, '') OVER (PARTITION BY t, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
            coalesce(string_agg(d, '') OVER (PARTITION BY t, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k} WHERE n > 1)""")
        out.append(f"{name}{k + 1} AS (SELECT t, i // 16 AS i, (n + 15) // 16 AS n, sha256(string_agg(d, '' ORDER BY i)) AS d FROM {name}{k} WHERE n > 1 GROUP BY t, i // 16, n UNION ALL SELECT t, i, n, d FROM {name}{k} WHERE n = 1)")
    return ",\n".join(out)


def _climb(rows: str, name: str, levels: int, tree: str, index: str) -> str:
    """rows with path and folded carried through the levels of their tree."""
    for k in range(levels):
        rows = f"""(SELECT x.* EXCLUDE (path, folded), path || coalesce(s.l || s.r, '') AS path, CASE WHEN s.t IS NULL THEN folded ELSE sha256(s.l || folded || s.r) END AS folded
            FROM {rows} x LEFT JOIN {name}s{k} s ON s.t = x.{tree} AND s.i = x.{index} // {16**k})"""
    return rows


#: Trees of up to 16 ** 6 rows and 16 ** 3 sources.
OP11 = f"""
WITH ids AS (SELECT *, CAST(doc_id AS VARCHAR) AS id FROM documents),
leafs AS (SELECT doc_id, source, {_leaf("text")} AS leaf, CASE WHEN xor({_CRC}, 4294967295) % 5 = 0 AND text IS NOT NULL THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS claim FROM ids),
placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leafs),
a0 AS (SELECT t, i, n, leaf AS d FROM placed),
{_levels("a", 6)},
b0 AS (SELECT 0 AS t, t AS i, (SELECT count(DISTINCT t) FROM placed) AS n, d FROM a6),
{_levels("b", 3)},
proofs AS (SELECT * FROM {_climb(_climb("(SELECT *, 0 AS z, '' AS path, coalesce(claim, leaf) AS folded FROM placed)", "a", 6, "t", "i"), "b", 3, "z", "t")} p)
SELECT doc_id, leaf, a6.d AS subroot, b3.d AS root, sha256(path) AS proof_sha256, folded AS folded_root, folded = b3.d AS verified FROM proofs p JOIN a6 ON a6.t = p.t, b3"""

OP12 = """
WITH good AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
scored AS (SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS alike, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM good a, good c WHERE a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS k FROM scored WHERE alike) p WHERE k <= 5),
ranked AS (SELECT anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS k
    FROM positives JOIN (SELECT * FROM scored WHERE NOT alike) s USING (anchor_id) WHERE 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(k AS INT) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE k <= 10"""

OP13 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
    row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

ORACLES = {"op5_substring_dedup": OP5, "op8_decontamination": OP8, "op9_poisson_mix": OP9, "op10_secret_scan": OP10, "op11_merkle_manifest": OP11, "op12_hard_negatives": OP12, "op13_exact_dedup": OP13}
