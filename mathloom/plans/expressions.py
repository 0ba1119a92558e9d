"""Row-wise queries: classification, gates, repairs, over the expressions of `fragments`."""

from __future__ import annotations

from ..functions.dialect import chain, count_of
from ..functions.normal import strip_marks
from ..operators import classify, gates, lines, reconstruct, repair
from . import gatekeeper
from .fixer import PROMPT

#: Distinct expressions are judged once; the counts of their fragments come along.
DISTINCT = "(SELECT payload, kind, count(*) AS n_fragments FROM fragments GROUP BY payload, kind) f"


def _over(columns, source="fragments f", keys="f.fragment_id"):
    return ("fragments",), lambda d: f"SELECT {keys}, {columns(d)} FROM {source}"


def _labels(gate):
    """Labels of a gate, in order, and whether there is any, for each distinct expression."""

    def body(d):
        return f"SELECT payload, kind, n_fragments, {d.size('labels')} > 0 AS violated, {d.size('labels')} AS n_labels, {d.join('labels', ' | ')} AS labels FROM (SELECT f.*, {gate(d, 'payload')} AS labels FROM {DISTINCT}) g"

    return ("fragments",), body


def _repair(chain):
    def body(d):
        return f"SELECT payload, kind, n_fragments, repaired, repaired <> payload AS changed FROM (SELECT f.*, {chain(d, 'payload')} AS repaired FROM {DISTINCT}) g"

    return ("fragments",), body


def _disagreement(d):
    return f"""SELECT a AS structure_first, b AS delimiter_first, count(*) AS n FROM (SELECT {classify.structure_first(d, 'payload')} AS a, {classify.delimiter_first(d, 'payload')} AS b FROM fragments) t GROUP BY a, b"""


def _score(d):
    inner = f"SELECT f.*, {d.size(gates.latex_corruption(d, 'payload'))} AS n_latex, {d.size(gates.split_words(d, 'payload'))} AS n_split, {d.size(gates.malformed_tags(d, 'payload'))} AS n_malformed FROM {DISTINCT}"
    return f"SELECT payload, kind, n_fragments, n_latex, n_split, n_malformed, {gates.corruption_score(d, 'n_latex', 'n_split', 'n_malformed')} AS score FROM ({inner}) g"


def _critical(d):
    return f"SELECT payload, kind, {gates.critical(d, 'labels')} AS critical, {d.size('labels')} AS n_labels FROM (SELECT f.*, {gates.validate_strict(d, 'payload')} AS labels FROM {DISTINCT}) g"


def _false_positive(d):
    return f"""SELECT payload, kind, {d.join('real', ' | ')} AS labels, {d.any('real', "contains(y, 'spelled') OR contains(y, 'split')")} AS severe
        FROM (SELECT g.*, {gates.real_faults(d, 'labels')} AS real FROM (SELECT f.*, {gates.latex_corruption(d, 'payload')} AS labels FROM {DISTINCT}) g) h"""


def _variants(d):
    views = gates.lenient(d, "payload")
    columns = ", ".join(f"{v} AS v_{k}" for k, v in views.items())
    return f"SELECT v_a, v_b, v_c, v_d, v_e, count(*) AS n FROM (SELECT {columns} FROM fragments) t GROUP BY v_a, v_b, v_c, v_d, v_e"


def _combined(d):
    return f"""SELECT payload, kind, n_strict = 0 AND n_structure = 0 AND NOT corrupt AND n_spelled = 0 AS valid, n_strict, n_structure, corrupt, n_spelled
        FROM (SELECT f.*, {d.size(gates.validate_strict(d, 'payload'))} AS n_strict, {d.size(gates.mathml_structure(d, 'payload'))} AS n_structure, {gates.corrupt_strict(d, 'payload')} AS corrupt, {d.size(gates.spelled_words(d, 'payload'))} AS n_spelled FROM {DISTINCT}) g"""


def _mathml_route(d):
    return f"""SELECT payload, kind, CASE WHEN trim(payload) = '' OR NOT contains(payload, '<math') THEN 'mathml_input'
            WHEN {d.size(gates.machine_written(d, 'payload'))} > 0 THEN 'gatekeeper_llm_detection' WHEN {d.size(gates.operator_tags(d, 'payload'))} > 0 THEN 'gatekeeper_operator_validation'
            WHEN {gates.corrupt_strict(d, 'payload')} OR {d.size(gates.mathml_structure(d, 'payload'))} > 0 OR {d.size(gates.spelled_words(d, 'payload'))} > 0 THEN 'mathml_corrupted' ELSE 'clean' END AS route
        FROM {DISTINCT}"""


def gate_rows(d) -> str:
    """A shorter LaTeX gate for gate_recheck and agg_outcomes, distinct expression by expression: strip, two detectors, repair, judge again, verdict. The whole gate is that of `gatekeeper`."""
    stripped = d.sub("payload", r"^\s*\$+|\$+\s*\z", "")
    judged = f"SELECT f.*, trim({stripped}) AS latex, {gates.clean_first(d, f'trim({stripped})')} AS clean FROM {DISTINCT}"
    detected = f"SELECT j.*, CASE WHEN clean THEN 0 ELSE {d.size(gates.latex_corruption(d, 'latex'))} + {d.size(gates.pre_repair(d, 'latex'))} END AS n_found FROM ({judged}) j"
    fixed = f"SELECT e.*, CASE WHEN n_found = 0 THEN latex ELSE {repair.apply(repair.LETTER_COMMANDS)(d, 'latex')} END AS fixed FROM ({detected}) e"
    spelled = f"SELECT x.*, CASE WHEN n_found = 0 THEN fixed ELSE {repair.apply(repair.SPELLED_COMMANDS)(d, 'fixed')} END AS spelt FROM ({fixed}) x"
    rest = gates.real_faults(d, gates.latex_corruption(d, "spelt"))
    again = f"SELECT s.*, CASE WHEN n_found = 0 THEN 0 ELSE {d.size(rest)} END AS n_left FROM ({spelled}) s"
    final = f"SELECT a.*, CASE WHEN clean THEN spelt ELSE {repair.apply(repair.SPACING)(d, 'spelt')} END AS final FROM ({again}) a"
    return f"""SELECT payload, kind, n_fragments, clean, n_found, n_left, final,
            CASE WHEN final = '' THEN 'empty_input' WHEN n_left > 3 THEN 'corruption_after_repair' WHEN {gates.truncated(d, 'final')} THEN 'truncation' WHEN {d.size(gates.latex_syntax(d, 'final'))} > 0 THEN 'latex_syntax' ELSE 'accepted' END AS outcome
        FROM ({final}) y"""


def _flagship(d):
    """The whole gate of `gatekeeper`, with all its detectors, repair, balancing and normalisation: distinct expressions by outcome."""
    judged = gatekeeper.verdict_sql(d, "(SELECT payload, count(*) AS n_fragments FROM fragments GROUP BY payload)")
    return f"SELECT coalesce(stage_failed, 'accepted') AS outcome, clean, used_repair, sum(n_fragments) AS n_fragments, count(*) AS n_expressions FROM {judged} v GROUP BY coalesce(stage_failed, 'accepted'), clean, used_repair"


def _recheck(d):
    return f"SELECT payload, CASE WHEN n_left = 0 THEN 'accept' WHEN n_left <= 3 THEN 'accept with warning' ELSE 'fail closed' END AS decision, n_found, n_left FROM ({gate_rows(d)}) g"


def _ingest(d):
    kind = classify.structure_first(d, "payload")
    return f"""SELECT payload, kind_found, CASE WHEN kind_found = 'mathml' AND {gates.corrupt_strict(d, 'payload')} THEN 'recover' WHEN kind_found = 'mathml' AND contains(payload, '<mtext>') AND contains(payload, {d.lit(chr(92))}) THEN 'recover_mtext'
            WHEN kind_found = 'mathml' THEN 'pass_through' WHEN kind_found = 'latex' AND {d.size(gates.latex_corruption(d, 'payload'))} > 0 THEN 'convert_only' WHEN kind_found = 'latex' THEN 'repair_safe' WHEN kind_found = 'plain' THEN 'reconstruct' ELSE 'empty' END AS route
        FROM (SELECT f.*, {kind} AS kind_found FROM {DISTINCT}) g"""


def _xml_issues(d):
    """What makes an expression poor MathML, and what it might stand for."""
    empty = [f"CASE WHEN {d.match('payload', f'<{t}>[ ]*</{t}>')} THEN 'empty {t}' END" for t in ("mi", "mn", "mo", "mtext")]
    issues = d.compact(d.array("CASE WHEN trim(payload) = '' THEN 'empty' END", "CASE WHEN NOT contains(payload, '<math') THEN 'no root' END", f"CASE WHEN {count_of(d, 'payload', '<math')} <> {count_of(d, 'payload', '</math>')} THEN 'unclosed root' END", *empty))
    hints = d.compact(d.array(f"CASE WHEN {d.match('payload', gates._letters('sum'))} THEN 'sum' END", f"CASE WHEN {d.match('payload', gates._letters('left'))} THEN 'left' END", "CASE WHEN contains(payload, '<mfrac') THEN 'frac' END"))
    return f"SELECT payload, kind, n_fragments, {d.join(issues, ' | ')} AS issues, {d.join(hints, ' | ')} AS suggestions FROM {DISTINCT}"


def _noise_nodes(d, x):
    """Empty leaves go, twice, and rows with one child give way to it."""
    return chain(d, x, ((r"<(mi|mn|mo|mrow|mtext)>[ ]*</(mi|mn|mo|mrow|mtext)>", ""), (r"<(mi|mn|mo|mrow|mtext)>[ ]*</(mi|mn|mo|mrow|mtext)>", ""), (r"<mrow>(<m[ino]>[^<]*</m[ino]>)</mrow>", r"\1"), (r"<mo>[.;,\\]</mo>", "")))


def _labelled_limits(d):
    return f"SELECT payload, {d.join(d.slice('labels', '1', '3'), ' | ')} AS first_3, {d.join(d.slice('labels', '1', '15'), ' | ')} AS first_15 FROM (SELECT f.*, {gates.latex_corruption(d, 'payload')} AS labels FROM {DISTINCT}) g"


TEMPLATES = {
    "classify_structure_first": _over(lambda d: f"{classify.structure_first(d, 'payload')} AS source_type"),
    "classify_delimiter_first": _over(lambda d: f"{classify.delimiter_first(d, 'payload')} AS source_type"),
    "classify_disagreement": (("fragments",), _disagreement),
    "flag_real_broken_latex": _over(lambda d: f"{classify.has_real_latex(d, 'payload')} AS real_latex, {classify.has_broken_latex(d, 'payload')} AS broken_latex"),
    "flag_gibberish": ((), lambda d: f"SELECT doc_id, {classify.gibberish(d, 'text')} AS gibberish, {classify.gibberish(d, 'text', 0.6)} AS gibberish_loose FROM documents"),
    "proj_wrap_plain_text": _over(lambda d: f"{classify.wrap_plain_text(d, 'payload')} AS wrapped"),
    "filter_placeholders": (("fragments",), lambda d: f"SELECT fragment_id, payload FROM fragments WHERE trim(payload) <> '' AND payload NOT IN ({', '.join(map(d.lit, classify.PLACEHOLDERS))})"),
    "flag_structural": _over(lambda d: f"{classify.structural(d, 'payload')} AS structural"),
    "flag_incomplete_rows": _over(lambda d: f"{classify.incomplete_rows(d, 'payload', 'payload')} AS incomplete"),
    "proj_error_code": _over(lambda d: f"""{classify.error_code(d, "concat('<math data-error=" + '"' + "', kind, '" + '"' + "></math>')")} AS error_code"""),
    "proj_preview": _over(lambda d: f"{classify.preview(d, 'CASE WHEN kind = ' + d.lit('mathml') + ' THEN payload ELSE ' + d.lit('') + ' END', 'trim(payload)')} AS preview"),
    "proj_namespace_display": _over(lambda d: f"{classify.namespace_display(d, 'payload')} AS mathml"),
    "proj_strip_tags": ((), lambda d: f"SELECT page_id, {classify.strip_tags(d, 'html')} AS text FROM pages"),
    "proj_xml_escape": _over(lambda d: f"{classify.xml_escape(d, 'payload')} AS escaped"),
    "proj_wrap_mtext": _over(lambda d: f"{classify.wrap_mtext(d, 'payload')} AS mathml"),
    "proj_count_substring": _over(lambda d: f"{count_of(d, 'payload', '{')} AS n_open, {count_of(d, 'payload', '}')} AS n_close, {count_of(d, 'payload', '<mi>')} AS n_mi"),
    "proj_prefer_latex": _over(lambda d: "coalesce(nullif(trim(CASE WHEN kind = 'latex' THEN payload END), ''), nullif(trim(CASE WHEN kind = 'mathml' THEN payload END), ''), '') AS chosen"),
    "proj_review_prompt": _over(lambda d: f"CASE WHEN {gates.validity_reason(d, 'payload')} <> 'valid' THEN concat({d.lit(PROMPT[0])}, payload, {d.lit(PROMPT[1])}) END AS prompt"),
    "proj_strip_accents": ((), lambda d: f"SELECT doc_id, {strip_marks(d, 'text')} AS plain FROM documents"),
    "proj_code_point": ((), lambda d: f"SELECT doc_id, {d.cp('text')} AS code_point, {d.char(d.cp('text'))} AS first_char FROM documents WHERE text <> ''"),
    "flag_shredded_views": _over(lambda d: f"{classify.shredded_latex(d, 'payload')} AS views"),
    "sink_mathml_reject_empty": _over(lambda d: "trim(payload) = '' AS rejected, CASE WHEN trim(payload) = '' THEN 'empty input' END AS reason"),
    "gate_spelled_words": _labels(gates.spelled_words), "gate_validate_strict": _labels(gates.validate_strict), "gate_machine_written": _labels(gates.machine_written), "gate_operator_tags": _labels(gates.operator_tags),
    "gate_spelling_hack": _labels(gates.spelling_hack), "gate_pre_repair": _labels(gates.pre_repair), "gate_latex_structure": _labels(gates.latex_structure), "gate_mathml_structure": _labels(gates.mathml_structure),
    "gate_latex_corruption": _labels(gates.latex_corruption), "gate_split_words": _labels(gates.split_words), "gate_malformed_tags": _labels(gates.malformed_tags), "gate_latex_syntax": _labels(gates.latex_syntax),
    "gate_corrupt_strict": (("fragments",), lambda d: f"SELECT payload, kind, n_fragments, {gates.corrupt_strict(d, 'payload')} AS corrupt FROM {DISTINCT}"),
    "gate_corruption_score": (("fragments",), _score), "gate_clean_first": (("fragments",), lambda d: f"SELECT payload, kind, n_fragments, {gates.clean_first(d, 'payload')} AS clean FROM {DISTINCT}"),
    "gate_truncation": (("fragments",), lambda d: f"SELECT payload, kind, n_fragments, {gates.truncated(d, 'payload')} AS truncated FROM {DISTINCT}"),
    "gate_critical": (("fragments",), _critical), "gate_false_positive_filter": (("fragments",), _false_positive), "gate_variant_agreement": (("fragments",), _variants),
    "gate_shredded_latex": (("fragments",), lambda d: f"SELECT payload, kind, {classify.shredded_latex(d, 'payload')} AS views FROM {DISTINCT}"),
    "gate_validity_reason": (("fragments",), lambda d: f"SELECT payload, kind, {gates.validity_reason(d, 'payload')} AS reason FROM {DISTINCT}"),
    "gate_combined_report": (("fragments",), _combined), "gate_mathml_route": (("fragments",), _mathml_route), "gate_latex_end_to_end": (("fragments",), _flagship), "gate_recheck": (("fragments",), _recheck), "route_ingest": (("fragments",), _ingest),
    "gate_xml_issues": (("fragments",), _xml_issues), "repair_noise_nodes": _repair(_noise_nodes),
    "limit_labels": (("fragments",), _labelled_limits),
    "repair_shred": ((), lambda d: f"SELECT doc_id, {d.sub('text', r'([A-Za-z])_?([0-9]+|[A-Za-z])', chr(92) + '1_{' + chr(92) + '2}')} AS shredded FROM documents"),
    **{name: _repair(chain) for name, chain in (repair.CHAINS | lines.CHAINS | reconstruct.CHAINS).items()},
}

