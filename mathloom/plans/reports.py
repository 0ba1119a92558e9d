"""Reports over gates and repairs: aggregates, sets, top-k, diagnosis, responses."""

from __future__ import annotations

from ..functions.dialect import has
from ..operators import classify, gates, lines, reconstruct, repair
from .expressions import DISTINCT, _noise_nodes, gate_rows
from .structure import tokens

def _violations(d):
    """Labels per rule set, counted over fragments, with totals."""
    sets = (("latex_corruption", gates.latex_corruption), ("pre_repair", gates.pre_repair), ("split_words", gates.split_words), ("malformed_tags", gates.malformed_tags))
    marked = [d.each(gate(d, "payload"), f"concat('{name}:', y)") for name, gate in sets]
    hits = f"SELECT n_fragments, hit FROM (SELECT f.*, {d.concat_arrays(*marked)} AS hits FROM {DISTINCT}) g {d.explode('hits', 'hit')}"
    split = f"SELECT substr(hit, 1, strpos(hit, ':') - 1) AS rule_set, substr(hit, strpos(hit, ':') + 1) AS label, n_fragments FROM ({hits}) h".replace("strpos(", "strpos(" if d.name == "duckdb" else "instr(")
    return f"SELECT rule_set, label, sum(n_fragments) AS n FROM ({split}) v GROUP BY GROUPING SETS ((rule_set, label), (rule_set), ())"


def _outcomes(d):
    return f"SELECT outcome, kind, sum(n_fragments) AS n FROM ({gate_rows(d)}) g GROUP BY GROUPING SETS ((outcome, kind), (outcome), (kind), ())"


def _symbol_frequency(d):
    return f"SELECT kind, count(*) AS n, count(DISTINCT token) AS n_distinct FROM {tokens(d)} t GROUP BY kind"


def _tags(d):
    return f"SELECT tag, count(*) AS n FROM (SELECT tag FROM fragments {d.explode(d.extract_all('payload', '<(m[a-z]+)', 1), 'tag')}) t GROUP BY tag"


def _best(d):
    return f"SELECT doc_id, {d.max_by('payload', 'length(trim(payload))', '-fragment_id')} AS best, max(length(trim(payload))) AS n_chars FROM fragments GROUP BY doc_id"


def _confidence(d):
    row = f"CASE WHEN {gates.corrupt_strict(d, 'payload')} THEN 0.25 WHEN {d.size(gates.latex_corruption(d, 'payload'))} > 0 THEN 0.5 ELSE 0.9 END"
    return f"SELECT kind, count(*) AS n, round(avg(CAST(c AS DOUBLE)), 6) AS mean_confidence, min(c) AS least, max(c) AS most FROM (SELECT kind, CAST({row} AS DOUBLE) AS c FROM fragments) t GROUP BY kind"


def _notes(d):
    return f"SELECT conv_id, {d.join(d.ordered('text', 'turn'), ' ')} AS notes, count(*) AS n FROM conversations GROUP BY conv_id"


def _agreement(d):
    return f"SELECT quality, sum(CASE WHEN g THEN 1 ELSE 0 END) AS gibberish, sum(CASE WHEN g THEN 0 ELSE 1 END) AS readable FROM (SELECT l.quality, {classify.gibberish(d, 'd.text', 0.6)} AS g FROM labels l JOIN documents d ON d.doc_id = l.doc_id) t GROUP BY quality"


#: Every repair of an expression, by query, and every table of its rules: distinct patterns in their order.
REPAIRS = {**repair.CHAINS, **lines.CHAINS, **reconstruct.CHAINS, "repair_noise_nodes": _noise_nodes}
RULE_TABLES = {
    f"{part.__name__.rpartition('.')[2]}.{name.lower()}": (part, tuple(dict.fromkeys(pattern for pattern, _ in getattr(part, name))))
    for part, names in (
        (repair, "CLASSIC_CLEAN CLASSIC_NORMALIZE LETTER_COMMANDS SPELLED_COMMANDS SCRIPT_SPACING SHRED_TABLE SPACED_COMMANDS FORCED_TABLE SYMBOLS SPACING STACKREL READABLE MERGED NOISE BROKEN_COMMANDS XML_TEXT SANITIZE SAFE INVALID_TOKENS OCR_PATTERNS BROAD"),
        (lines, "CUT_ENDS DISPLAY"),
        (reconstruct, "CLEAN SCRIPTS FRACTIONS STRUCTURE ARGUMENTS FENCES LIMITS OPERATORS COMMANDS NOTATION"),
    )
    for name in names.split()
}


def _rule_hits(d):
    """For every repair (rule 0) the fragments that it changes; for every rule of every table the fragments, as they are given, that it matches, and how often it does."""
    found = [f"CASE WHEN {chain(d, 'payload')} <> payload THEN '{name}|0|1' END" for name, chain in REPAIRS.items()]
    listed = [("", 0), *((name, 0) for name in REPAIRS)]
    for name, (part, patterns) in RULE_TABLES.items():
        for k, pattern in enumerate(patterns, 1):
            own = reconstruct.edged(d, pattern) if part is reconstruct else pattern
            found.append(f"CASE WHEN {d.match('payload', own)} THEN concat('{name}|{k}|', {d.size(d.extract_all('payload', own, 0))}) END")
            listed.append((name, k))
    # each expression counts for the empty name
    hits = f"SELECT n_fragments, hit FROM (SELECT f.*, {d.compact(d.array(d.lit('|0|1'), *found))} AS hits FROM {DISTINCT}) g {d.explode('hits', 'hit')}"
    cut = f"SELECT n_fragments, {d.at(d.split('hit', '[|]'), '1')} AS name, CAST({d.at(d.split('hit', '[|]'), '2')} AS INT) AS k, CAST({d.at(d.split('hit', '[|]'), '3')} AS BIGINT) AS times FROM ({hits}) h"
    summed = f"SELECT name, k, sum(n_fragments) AS n_changed, sum(n_fragments * times) AS n_hits, count(*) AS n FROM ({cut}) c GROUP BY name, k"
    every = ", ".join(f"('{name}', {k})" for name, k in listed)
    joined = f"SELECT r.rule_set, r.rule, coalesce(s.n_changed, 0) AS n_changed, coalesce(s.n_hits, 0) AS n_hits, coalesce(max(CASE WHEN r.rule_set = '' THEN s.n END) OVER (), 0) AS n_expressions FROM (VALUES {every}) AS r(rule_set, rule) LEFT JOIN ({summed}) s ON s.name = r.rule_set AND s.k = r.rule"
    return f"SELECT rule_set, rule, n_changed, n_hits, n_expressions FROM ({joined}) j WHERE rule_set <> ''"


def _dedupe(d):
    return f"SELECT min(fragment_id) AS fragment_id, {d.max_by('payload', '-fragment_id')} AS payload FROM fragments GROUP BY trim(payload)"


def _overlap(d):
    words = "(SELECT DISTINCT lang, lower(word) AS word FROM (SELECT lang, word FROM documents " + d.explode(d.split("text", "[^A-Za-z]+"), "word") + ") x WHERE length(word) > 2)"
    return f"SELECT word FROM {words} a WHERE lang = 'en' INTERSECT SELECT word FROM {words} b WHERE lang = 'fr' EXCEPT SELECT word FROM {words} c WHERE lang = 'de'"


def _stage(d):
    """The first failing stage of recognition, reconstruction and conversion, against the expected text: a row a fragment."""
    texts = "(SELECT payload FROM fragments GROUP BY payload)"
    return f"""SELECT fragment_id, CASE WHEN trim(raw) = '' THEN 'ocr' WHEN gib THEN 'ocr' WHEN n_latex > 0 THEN 'reconstruction' WHEN corrupt THEN 'conversion' WHEN expected IS NOT NULL AND latex <> expected THEN 'mismatch' ELSE 'none' END AS stage,
            CASE WHEN trim(raw) = '' THEN 'critical' WHEN gib OR n_latex > 3 OR corrupt THEN 'high' WHEN n_latex > 0 THEN 'low' ELSE 'none' END AS severity
        FROM (SELECT f.fragment_id, f.payload AS raw, r.latex, b.text AS expected, {classify.gibberish(d, 'f.payload', 0.6)} AS gib, r.n_latex, r.corrupt
              FROM fragments f JOIN (SELECT payload, latex, {d.size(gates.latex_corruption(d, 'latex'))} AS n_latex, {gates.corrupt_strict(d, 'latex')} AS corrupt FROM (SELECT payload, {repair.CHAINS['repair_letter_commands'](d, 'payload')} AS latex FROM {texts} x) y) r ON r.payload = f.payload
              LEFT JOIN benchmark b ON b.item_id = f.fragment_id) t"""


def _worst(d):
    inner = f"SELECT f.*, {d.size(gates.latex_corruption(d, 'payload'))} AS a, {d.size(gates.split_words(d, 'payload'))} AS b, {d.size(gates.malformed_tags(d, 'payload'))} AS c FROM {DISTINCT}"
    return f"SELECT payload, {gates.corruption_score(d, 'a', 'b', 'c')} AS score, a + b + c AS n_labels FROM ({inner}) g ORDER BY score DESC, n_labels DESC, payload LIMIT 25"


def _last_log(d):
    """The last five roles of a conversation, and whether it has over 200 turns: five rows of each are gathered, not all."""
    ranked = "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations"
    return f"SELECT conv_id, {d.join(d.ordered('role', 'turn', 'role'), ' / ')} AS last_5, max(CASE WHEN n > 200 THEN 1 ELSE 0 END) AS cut FROM ({ranked}) t WHERE k <= 5 GROUP BY conv_id"


TEMPLATES = {
    "agg_formulas_per_page": (("detections",), lambda d: "SELECT p.page_id, count(x.box_id) AS n FROM pages p LEFT JOIN detections x ON x.page_id = p.page_id GROUP BY GROUPING SETS ((p.page_id), ())"),
    "agg_violations": (("fragments",), _violations), "agg_outcomes": (("fragments",), _outcomes), "agg_symbol_frequency": (("fragments",), _symbol_frequency), "agg_tag_histogram": (("fragments",), _tags),
    "agg_best_candidate": (("fragments",), _best), "agg_confidence": (("fragments",), _confidence), "agg_notes_concat": ((), _notes), "agg_label_agreement": ((), _agreement), "audit_rule_hits": (("fragments",), _rule_hits),
    "win_dedupe_variants": (("fragments",), _dedupe), "set_symbol_overlap": ((), _overlap), "set_union_sources": (("fragments",), lambda d: "SELECT 'fragment' AS source, fragment_id AS id, payload FROM fragments UNION ALL SELECT 'page' AS source, page_id AS id, url AS payload FROM pages"),
    "set_new_documents": ((), lambda d: "SELECT text FROM documents WHERE doc_id % 2 = 1 EXCEPT SELECT text FROM documents WHERE doc_id % 2 = 0"),
    "diag_stage": (("fragments",), _stage), "topk_worst": (("fragments",), _worst),
    "limit_log": ((), _last_log),
}
