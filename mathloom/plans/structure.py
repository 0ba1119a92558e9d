"""Queries that take expressions apart: rows, cells, tokens, runs, elements, entities, pages."""

from __future__ import annotations

import html.entities

from ..functions.dialect import has
from ..operators import classify, layout

# Categories of entities and patterns of their lower-cased names.
CATEGORIES = (("greek", "alpha|beta|gamma|delta|epsilon|theta|lambda|mu|pi|sigma|omega"), ("arrow", "arr"), ("accent", "acute|grave|circ|tilde|uml|cedil"), ("relation", "^(lt|gt|le|ge|ne|equiv|asymp|cong|sim)$"), ("set", "^(cap|cup|sub|sup|sube|supe|isin|notin|empty)$"), ("quote", "quo"), ("space", "sp$"), ("fraction", "frac"))
#: Distinct expressions with a number of their own.
EXPRESSIONS = "(SELECT min(fragment_id) AS expr_id, payload FROM fragments GROUP BY payload) f"
# Letter runs and the commands they stand for; symbols and their commands.
COMMANDS = ("left", "right", "frac", "sum", "min", "max", "equiv", "mathbb", "begin", "end", "array", "cdot", "ldots", "forall", "times", "leq", "geq", "neq")
SYMBOLS = (("α", "alpha"), ("β", "beta"), ("γ", "gamma"), ("δ", "delta"), ("θ", "theta"), ("λ", "lambda"), ("π", "pi"), ("σ", "sigma"), ("ω", "omega"), ("≤", "leq"), ("≥", "geq"), ("≠", "neq"), ("≡", "equiv"), ("∈", "in"), ("∑", "sum"), ("∞", "infty"), ("→", "to"), ("×", "times"), ("·", "cdot"), ("±", "pm"))


def entities(d) -> str:
    """(seq, name, code_point): Python's table of named characters, single ones, in name order."""
    names = [(n, cp) for n, cp in sorted(html.entities.name2codepoint.items())]
    rows = ", ".join(f"({i}, {d.lit(n)}, {cp})" for i, (n, cp) in enumerate(names))
    return f"(SELECT seq, name, code_point, {d.char('code_point')} AS ch FROM (VALUES {rows}) AS v(seq, name, code_point)) e"


def symbols(d) -> str:
    rows = ", ".join(f"({d.lit(c)}, {d.lit(chr(92) + n)})" for c, n in SYMBOLS)
    return f"(VALUES {rows}) AS s(ch, command)"


#: A token of MathML, and all tokens of a text.
TAGGED = r"<m(?:i|o|n|text)>[^<]*</m(?:i|o|n|text)>"
TOKEN = TAGGED + r"|\\?[A-Za-z]+|[0-9]+|\\?[^\sA-Za-z0-9]"
#: Single letters that go on with a run, and a run as one match: an identifier and these, or any other token.
GOES_ON = r"(?:\s*(?:<mi>[^<]</m(?:i|o|n|text)>|[A-Za-z](?![A-Za-z])))*"
RUN = rf"<mi>[^<]*</m(?:i|o|n|text)>{GOES_ON}|{TAGGED}|[A-Za-z]+{GOES_ON}|\\[A-Za-z]+|[0-9]+|\\?[^\sA-Za-z0-9]"
#: The tokens of a run that holds tags, without these, as group 1.
IN_RUN = r"(?:<mi>)?((?<=<mi>)[^<]*|[A-Za-z]+)(?:</m(?:i|o|n|text)>)?"


def _parts(d) -> str:
    return f"CASE WHEN contains(payload, '<math') THEN {d.extract_all('payload', TAGGED, 0)} ELSE {d.extract_all('payload', TOKEN, 0)} END"


def _kind(d, part: str) -> str:
    """The kind of a token in Spark, by its first character; texts are compared by their bytes."""
    return f"CASE WHEN startswith({part}, '<m') THEN {d.extract(part, '<(m[a-z]+)>', 1)} WHEN startswith({part}, {d.lit(chr(92))}) THEN 'command' WHEN {part} >= '0' AND {part} < ':' THEN 'mn' WHEN {part} >= 'A' AND {part} < '[' OR {part} >= 'a' AND {part} < '{{' THEN 'mi' ELSE 'mo' END"


def _token(d, part: str) -> str:
    return f"CASE WHEN startswith({part}, '<m') THEN {d.sub(part, '<[^>]*>', '')} ELSE {part} END"


def tokens(d) -> str:
    """(expr_id, pos, kind, token): tokens of MathML in page order, else commands, numbers and characters."""
    if d.name == "spark":
        # not by explode(): an array that is no column is not computed below the grouping, and a lambda would keep the rest from being compiled
        return f"(SELECT expr_id, pos, {_kind(d, 'part')} AS kind, {_token(d, 'part')} AS token FROM {EXPRESSIONS} LATERAL VIEW posexplode({_parts(d)}) t_part AS pos, part)"
    digit, letter = d.match("part", "^[0-9]"), d.match("part", "^[A-Za-z]")
    return f"""(SELECT expr_id, pos, CASE WHEN part LIKE '<m%' THEN {d.extract('part', '<(m[a-z]+)>', 1)} WHEN substr(part, 1, 1) = {d.lit(chr(92))} THEN 'command' WHEN {digit} THEN 'mn' WHEN {letter} THEN 'mi' ELSE 'mo' END AS kind,
            CASE WHEN part LIKE '<m%' THEN {d.sub('part', '<[^>]*>', '')} ELSE part END AS token FROM {EXPRESSIONS} {d.explode(_parts(d), 'part', 'pos')})"""


def neighbours(d) -> str:
    """(expr_id, pos, kind, token, b, a, next): tokens with the kinds before and after and the token after, in Spark.

    The array of an expression's tokens is laid beside itself, one place on and one place back, before it is
    exploded, so that tokens are neither shuffled nor sorted. Beyond the ends the kind is that of no identifier and no number.
    """
    beside = "arrays_zip(parts, concat(array(CAST(NULL AS STRING)), parts), slice(parts, 2, size(parts)))"
    rows = f"(SELECT expr_id, pos, z.parts AS part, z.`1` AS part_before, z.`2` AS part_after FROM (SELECT expr_id, {_parts(d)} AS parts FROM {EXPRESSIONS}) p LATERAL VIEW posexplode({beside}) t_part AS pos, z WHERE z.parts IS NOT NULL)"
    return f"(SELECT expr_id, pos, {_kind(d, 'part')} AS kind, {_token(d, 'part')} AS token, {_kind(d, 'part_before')} AS b, {_kind(d, 'part_after')} AS a, {_token(d, 'part_after')} AS next FROM {rows} z)"


def run_rows(d) -> str:
    """(expr_id, nth, toks, word, n): runs of identifiers, numbered from 0 among all runs, each matched whole in the text, in Spark.

    A run ends where the text does, so its number needs no count over tokens. `toks` are its tokens where it holds
    tags; otherwise null, and `flat` has the tokens with a blank between them.
    """
    text = f"CASE WHEN contains(payload, '<math') THEN array_join({d.extract_all('payload', TAGGED, 0)}, '') ELSE payload END"
    found = f"SELECT expr_id, nth, part FROM {EXPRESSIONS} LATERAL VIEW posexplode({d.extract_all(text, RUN, 0)}) t_part AS nth, part WHERE {_kind(d, 'part')} = 'mi'"
    split = f"SELECT expr_id, nth, CASE WHEN contains(part, '<') THEN {d.extract_all('part', IN_RUN, 1)} END AS toks, {d.sub('part', chr(92) + 's+', ' ')} AS flat FROM ({found}) f"
    return f"(SELECT expr_id, nth, toks, flat, CASE WHEN toks IS NULL THEN replace(flat, ' ', '') ELSE array_join(toks, '') END AS word, CAST(CASE WHEN toks IS NULL THEN 1 + length(flat) - length(replace(flat, ' ', '')) ELSE size(toks) END AS BIGINT) AS n FROM ({split}) s)"


def token_arrays(d) -> str:
    """(expr_id, kinds, toks): the tokens of tokens() as two arrays, a row an expression that has any.

    What a token's neighbours decide is read from these, so that tokens are neither shuffled nor sorted.
    """
    return f"(SELECT expr_id, transform(parts, part -> {_kind(d, 'part')}) AS kinds, transform(parts, part -> {_token(d, 'part')}) AS toks FROM (SELECT expr_id, {_parts(d)} AS parts FROM {EXPRESSIONS}) p WHERE size(parts) > 0)"


def run_arrays(d) -> str:
    """(expr_id, kinds, toks, found): with the runs of runs() in order, each (first, from 1; n; kind; word)."""
    goes_on = "i > 1 AND kinds[i - 1] = 'mi' AND length(toks[i - 1]) = 1 AND kinds[i - 2] = 'mi'"
    begun = f"(SELECT *, filter(sequence(1, size(toks)), i -> NOT ({goes_on})) AS begins FROM {token_arrays(d)} t)"
    sized = f"(SELECT expr_id, kinds, toks, transform(begins, (b, j) -> named_struct('first', b, 'n', coalesce(get(begins, j + 1), size(toks) + 1) - b)) AS spans FROM {begun} b)"
    return f"(SELECT expr_id, kinds, toks, transform(spans, s -> named_struct('first', s.first, 'n', CAST(s.n AS BIGINT), 'kind', kinds[s.first - 1], 'word', CASE WHEN s.n = 1 THEN toks[s.first - 1] ELSE array_join(slice(toks, s.first, s.n), '') END)) AS found FROM {sized} s)"


def letters(d) -> str:
    """(expr_id, pos, letter): the letters of the identifiers of MathML, and whether each goes on from the one before."""
    return f"""(SELECT expr_id, pos, token, kind, CASE WHEN kind = 'mi' AND length(token) = 1 AND lag(kind) OVER (PARTITION BY expr_id ORDER BY pos) = 'mi' THEN 0 ELSE 1 END AS starts FROM {tokens(d)} t)"""


def runs(d) -> str:
    return f"(SELECT expr_id, pos, token, kind, sum(starts) OVER (PARTITION BY expr_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM {letters(d)} l)"


def _letter_runs(d):
    names = ", ".join(d.lit(c) for c in COMMANDS)
    collapsed = f"CASE WHEN n >= 3 AND lower(word) IN ({names}) THEN concat({d.lit(chr(92))}, lower(word)) ELSE word END AS collapsed"
    if d.name == "spark":
        return f"SELECT expr_id, CAST(nth + 1 AS BIGINT) AS run, word, n, {collapsed} FROM {run_rows(d)} r"
    return f"""SELECT expr_id, run, word, n, {collapsed}
        FROM (SELECT expr_id, run, {d.join(d.ordered('token', 'pos'), '')} AS word, count(*) AS n FROM {runs(d)} r WHERE kind = 'mi' GROUP BY expr_id, run) g"""


def _pairs(d):
    if d.name == "spark":
        # only runs of several tokens are sorted: they alone put the tokens after them further on than their number
        before = "coalesce(sum(n - 1) OVER (PARTITION BY expr_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        several = f"SELECT expr_id, nth, n, coalesce(toks, split(flat, ' ')) AS toks FROM {run_rows(d)} r WHERE n > 1"
        placed = f"SELECT expr_id, CAST(nth + {before} AS INT) AS first, toks FROM ({several}) s"
        return f"SELECT expr_id, first + k AS pos, concat(tok, '_{{', get(toks, k + 1), '}}') AS paired FROM ({placed}) p LATERAL VIEW posexplode(slice(toks, 1, size(toks))) t_tok AS k, tok WHERE k % 2 = 0 AND k + 1 < size(toks)"
    return f"""SELECT expr_id, pos, concat(token, '_{{', after, '}}') AS paired
        FROM (SELECT expr_id, pos, token, run, row_number() OVER (PARTITION BY expr_id, run ORDER BY pos) AS k, lead(token) OVER (PARTITION BY expr_id, run ORDER BY pos) AS after FROM {runs(d)} r WHERE kind = 'mi') p
        WHERE k % 2 = 1 AND after IS NOT NULL"""


def _neighbours(d):
    beside = neighbours(d) if d.name == "spark" else f"(SELECT t.*, lag(kind) OVER w AS b, lead(kind) OVER w AS a, lead(token) OVER w AS next FROM {tokens(d)} t WINDOW w AS (PARTITION BY expr_id ORDER BY pos))"
    return f"""SELECT expr_id, pos, token, CASE WHEN token = '.' AND NOT (coalesce(b, '') = 'mn' AND coalesce(a, '') = 'mn') THEN 'lone dot' WHEN token = 'l' AND next = ']' THEN 'l before bracket' WHEN kind = 'mn' AND b = 'mi' AND a = 'mi' THEN 'digit between letters'
            WHEN kind = 'mi' AND length(token) = 1 AND next IN (']', ')') THEN 'letter before closer' ELSE 'keep' END AS verdict
        FROM {beside} n"""


def _depth(d):
    if d.name == "spark":
        # between brackets the depth stays, and before the first one it is 0
        turns = "transform(filter(toks, t -> t IN ('(', ')')), t -> CASE WHEN t = '(' THEN 1L ELSE -1L END)"
        first = "CASE WHEN toks[0] IN ('(', ')') THEN CAST(NULL AS BIGINT) ELSE 0L END"
        folded = f"aggregate({turns}, named_struct('depth', 0L, 'deepest', {first}, 'lowest', {first}), (a, t) -> named_struct('depth', a.depth + t, 'deepest', greatest(a.deepest, a.depth + t), 'lowest', least(a.lowest, a.depth + t)))"
        return f"SELECT expr_id, s.deepest, s.lowest, greatest(-s.lowest, 0L) AS unmatched_closers, s.depth - least(s.lowest, 0L) AS missing_closers FROM (SELECT expr_id, {folded} AS s FROM {token_arrays(d)} a) f"
    return f"""SELECT expr_id, max(depth) AS deepest, min(depth) AS lowest, greatest(-min(depth), 0) AS unmatched_closers, max(CASE WHEN last = 1 THEN depth END) - least(min(depth), 0) AS missing_closers
        FROM (SELECT expr_id, sum(CASE token WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY expr_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS depth, row_number() OVER (PARTITION BY expr_id ORDER BY pos DESC) AS last FROM {tokens(d)} t) s GROUP BY expr_id"""


def _lines(d):
    return f"SELECT expr_id, row_no, {layout.line_text(d, 'line')} AS latex, {layout.label(d, 'line')} AS label FROM {EXPRESSIONS} {d.explode(layout.rows(d, 'payload'), 'line', 'row_no')} WHERE {layout.multi_line(d, 'payload')}"


def _cells(d):
    rows = f"(SELECT expr_id, row_no, line FROM {EXPRESSIONS} {d.explode(layout.rows(d, 'payload'), 'line', 'row_no')} WHERE {layout.matrix(d, 'payload')} OR {layout.multi_line(d, 'payload')}) r"
    return f"SELECT expr_id, row_no, col_no, trim(cell) AS latex FROM {rows} {d.explode(d.split('line', '&'), 'cell', 'col_no')} WHERE trim(line) <> ''"


def _elements(d):
    def joined(tag):
        return d.join(d.extract_all("payload", f"<{tag}>([^<]*)</{tag}>", 1), ",")

    subs = d.join(d.extract_all("payload", r"<msub><m[in]>[^<]*</m[in]><m[in]>[^<]*</m[in]></msub>", 0), ",")
    return f"SELECT expr_id, {joined('mi')} AS variables, {joined('mo')} AS operators, {joined('mn')} AS numbers, {d.sub(subs, '<[^>]*>', ' ')} AS subscripts FROM {EXPRESSIONS} WHERE contains(payload, '<math')"


def _template(which, name):
    def body(d):
        _, groups, least, canonical = layout.TEMPLATES[which]
        return f"SELECT expr_id, cues, CASE WHEN cues >= {least} THEN {d.lit(canonical)} ELSE payload END AS latex FROM (SELECT f.*, {layout.cues(d, 'payload', groups)} AS cues FROM {EXPRESSIONS}) g"

    return ("fragments",), body


def _fixer(name):
    def body(d):
        patterns, least, canonical = layout.FIXER_TEMPLATES[name]
        low = d.sub("lower(payload)", r"\s+", " ")
        cues = " + ".join(f"CASE WHEN {d.match('low', p)} THEN 1 ELSE 0 END" for p in patterns)
        return f"SELECT expr_id, cues, CASE WHEN cues >= {least} THEN {d.lit(canonical)} ELSE payload END AS latex FROM (SELECT g.*, {cues} AS cues FROM (SELECT f.*, {low} AS low FROM {EXPRESSIONS}) g) h"

    return ("fragments",), body


def _cue_join(d):
    """Expressions and the cue tables that they meet, in one pass, with a confidence by the number of cues."""
    n = f"CAST({d.extract('hit', ':([0-9]+)', 1)} AS INT)"
    return f"""SELECT expr_id, {d.extract('hit', '^([a-z_]+)', 1)} AS template, {n} AS hits, round(least(1.0, 0.5 + 0.05 * {n}), 3) AS confidence
        FROM (SELECT expr_id, hit FROM (SELECT f.*, {layout.cue_hits(d, 'payload')} AS found FROM {EXPRESSIONS}) g {d.explode('found', 'hit')}) h"""


def _decode(d):
    """Named, decimal and hexadecimal references of pages, each decoded once; unknown names, and numbers of no character, stay."""
    found = d.extract_all("html", r"&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]*);", 0)
    refs = f"(SELECT reference, count(*) AS n FROM (SELECT reference FROM pages {d.explode(found, 'reference')}) x GROUP BY reference) r"
    code = f"coalesce(CAST(nullif({d.extract('reference', '^&#([0-9]+);', 1)}, '') AS INT), {d.from_hex(d.extract('reference', '^&#[xX]([0-9a-fA-F]+);', 1))})"
    valid = "code > 0 AND code <= 1114111 AND NOT (code BETWEEN 55296 AND 57343)"
    return f"""SELECT reference, n, CASE WHEN {valid} THEN {d.char(f"CASE WHEN {valid} THEN code ELSE 63 END")} ELSE coalesce(ch, reference) END AS decoded
        FROM (SELECT reference, n, {code} AS code FROM {refs}) c LEFT JOIN {entities(d)} ON reference = concat('&', name, ';')"""


def _normalize(d):
    """Pages with their tags kept and the text between them decoded, then escaped; unknown references count as text."""
    token = r"<[^>]*(?:>|\z)|&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]*);"
    code = f"coalesce(CAST(nullif({d.extract('y', '^&#([0-9]+);', 1)}, '') AS INT), {d.from_hex(d.extract('y', '^&#[xX]([0-9a-fA-F]+);', 1))})"
    valid = f"{code} > 0 AND {code} <= 1114111 AND NOT ({code} BETWEEN 55296 AND 57343)"
    named = [(f"&{n};", chr(cp)) for n, cp in sorted(html.entities.name2codepoint.items())]
    decoded = f"CASE WHEN {valid} THEN {d.char(f'CASE WHEN {valid} THEN {code} ELSE 63 END')} ELSE coalesce({d.lookup(named, 'y')}, y) END"
    pieces = d.each(d.extract_all("html", token, 0), f"CASE WHEN substr(y, 1, 1) = '<' THEN y ELSE {classify.xml_escape(d, decoded)} END")
    return f"SELECT page_id, {d.interleave(d.each(d.split('html', token), classify.xml_escape(d, 'y')), pieces)} AS text FROM pages"


def _encode(d):
    chars = d.extract_all("text", r"[^\x00-\x7F]", 0)
    last = f"(SELECT code_point AS cp, {d.max_by('name', 'seq')} AS name FROM {entities(d)} GROUP BY code_point) n"
    return f"""SELECT ch, n, coalesce(concat('&', name, ';'), concat('&#x', lpad({d.hex('cp0')}, 4, '0'), ';')) AS encoded FROM (SELECT ch, {d.cp('ch')} AS cp0, count(*) AS n FROM (SELECT ch FROM documents {d.explode(chars, 'ch')}) c GROUP BY ch) c LEFT JOIN {last} ON cp0 = cp"""


def _characters(d) -> str:
    """(cp, n): characters beyond ASCII of the documents."""
    return f"(SELECT {d.cp('ch')} AS cp, count(*) AS n FROM (SELECT ch FROM documents {d.explode(d.extract_all('text', r'[^\\x00-\\x7F]', 0), 'ch')}) c GROUP BY {d.cp('ch')}) u"


def _named_references(d) -> str:
    """(name, n): named references of the pages."""
    return f"(SELECT name, count(*) AS n FROM (SELECT name FROM pages {d.explode(d.extract_all('html', '&([A-Za-z][A-Za-z0-9]*);', 1), 'name')}) x GROUP BY name) r"


def _reference(d):
    return f"SELECT code_point, max(n) AS n, min(name) AS first_name, {d.max_by('name', 'seq')} AS last_name, count(*) AS n_names FROM {_characters(d)} JOIN {entities(d)} ON cp = code_point GROUP BY code_point"


def _consistency(d):
    """Names that differ in case alone and stand for different characters, one of which the documents use."""
    e = entities(d)
    return f"SELECT a.name AS name_a, b.name AS name_b, a.code_point AS code_a, b.code_point AS code_b, u.n FROM {_characters(d)} JOIN {e[:-2]} a ON u.cp = a.code_point JOIN {e[:-2]} b ON lower(a.name) = lower(b.name) WHERE a.code_point <> b.code_point"


def _symbol_lookup(d):
    return f"SELECT token, n, coalesce(command, token) AS latex FROM (SELECT token, count(*) AS n FROM {tokens(d)} t GROUP BY token) c LEFT JOIN {symbols(d)} ON token = ch"


def _categories(d):
    found = d.compact(d.array(*[f"CASE WHEN {d.match('lower(name)', p)} THEN '{c}' END" for c, p in CATEGORIES]))
    known = f"SELECT r.name, r.n FROM {_named_references(d)} JOIN {entities(d)} ON r.name = e.name"
    return f"SELECT category, sum(n) AS n, count(*) AS n_names FROM (SELECT category, n FROM (SELECT name, n FROM ({known}) k) q {d.explode(found, 'category')}) c GROUP BY category"


def _recover_tokens(d):
    """Tokens of an expression strung together again, letter runs as commands, with a confidence."""
    names = ", ".join(d.lit(c) for c in COMMANDS)
    if d.name == "spark":
        command = f"r.kind = 'mi' AND r.n >= 3 AND lower(r.word) IN ({names})"
        joined = f"array_join(transform(found, r -> CASE WHEN {command} THEN concat({d.lit(chr(92))}, lower(r.word)) ELSE r.word END), ' ')"
        return f"""SELECT expr_id, {joined} AS latex, CASE WHEN exists(found, r -> {command}) THEN 0.9 WHEN size(found) > 1 THEN 0.5 ELSE 0.25 END AS confidence FROM {run_arrays(d)} f"""
    words = f"""SELECT expr_id, run, min(pos) AS pos, max(kind) AS kind, {d.join(d.ordered('token', 'pos'), '')} AS word, count(*) AS n FROM {runs(d)} r GROUP BY expr_id, run"""
    piece = f"CASE WHEN kind = 'mi' AND n >= 3 AND lower(word) IN ({names}) THEN concat({d.lit(chr(92))}, lower(word)) ELSE word END"
    return f"""SELECT expr_id, latex, CASE WHEN n_commands > 0 THEN 0.9 WHEN n_tokens > 1 THEN 0.5 ELSE 0.25 END AS confidence
        FROM (SELECT expr_id, {d.join(d.ordered(piece, 'pos'), ' ')} AS latex, sum(CASE WHEN kind = 'mi' AND n >= 3 AND lower(word) IN ({names}) THEN 1 ELSE 0 END) AS n_commands, count(*) AS n_tokens FROM ({words}) w GROUP BY expr_id) g"""


def _repair_tokens(d):
    """Glyph swaps on tokens: > alone is an equals sign, U between tokens a union, \\P the letter P."""
    swap = " ".join(f"WHEN token = {d.lit(a)} THEN {d.lit(b)}" for a, b in ((">", "="), ("U", "∪"), (chr(92) + "P", "P"), ("—", "-"), ("–", "-"), ("‘", "'"), ("’", "'"), ("∙", "·"), ("€", "∈")))
    return f"SELECT expr_id, pos, kind, token, CASE {swap} ELSE token END AS repaired FROM {tokens(d)} t"


TEMPLATES = {
    "filter_formula_size": (("detections",), lambda d: "SELECT page_id, box_id, x, y, w, h FROM detections WHERE w * h > 200 AND w > 30 AND h > 10"),
    "filter_detector_geometry": (("detections",), lambda d: "SELECT page_id, box_id, x, y, w, h FROM detections WHERE w * h >= 200 AND w * h <= 0.5 * page_w * page_h AND h > 0 AND CAST(w AS DOUBLE) / h BETWEEN 0.3 AND 10 AND density BETWEEN 0.05 AND 0.8"),
    "filter_words": (("words",), lambda d: "SELECT page_id, seq, text, confidence FROM words WHERE trim(text) <> '' AND confidence >= 30.0 AND w >= 5 AND h >= 5"),
    "proj_normalize_boxes": (("detections",), lambda d: "SELECT page_id, box_id, least(x, x - 40 + w) AS x0, least(y, y - 20 + h) AS y0, abs(w - 40) AS w0, abs(h - 20) AS h0, abs(w - 40) > 10 AND abs(h - 20) > 10 AS selectable FROM detections"),
    "proj_clamp_crop": (("detections",), lambda d: "SELECT page_id, box_id, cx, cy, cw, ch, cw < 5 OR ch < 5 AS rejected FROM (SELECT page_id, box_id, greatest(0, least(x, 999)) AS cx, greatest(0, least(y, 1399)) AS cy, least(w, 1000 - greatest(0, least(x, 999))) AS cw, least(h, 1400 - greatest(0, least(y, 1399))) AS ch FROM detections) c"),
    "win_formula_number": (("detections",), lambda d: "SELECT page_id, box_id, concat('page', CAST(page_id AS STRING), '_formula', CAST(row_number() OVER (PARTITION BY page_id ORDER BY y, x, box_id) AS STRING)) AS name FROM detections"),
    "sort_reading_order": (("detections",), lambda d: "SELECT page_id, box_id, row_number() OVER (PARTITION BY page_id ORDER BY y, x, box_id) AS place FROM detections"),
    "src_page_expand": ((), lambda d: f"SELECT doc_id, page_no, concat('doc', CAST(doc_id AS STRING), '_page_', CAST(page_no AS STRING), '.png') AS image FROM documents {d.explode(d.numbers('1', 'CAST(1 + floor(n_chars / 3000) AS INT)'), 'page_no')}"),
    "join_missing_documents": ((), lambda d: "SELECT l.doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.doc_id = l.doc_id + 1)"),
    "explode_lines": (("fragments",), _lines), "explode_cells": (("fragments",), _cells), "classify_layout": (("fragments",), lambda d: f"SELECT expr_id, {layout.multi_line(d, 'payload')} AS multi_line, {layout.matrix(d, 'payload')} AS matrix FROM {EXPRESSIONS}"),
    "route_layout": (("fragments",), lambda d: f"SELECT expr_id, {layout.route(d, 'payload')} AS route FROM {EXPRESSIONS}"), "extract_label": (("fragments",), lambda d: f"SELECT expr_id, {layout.label(d, 'payload')} AS label FROM {EXPRESSIONS}"),
    "extract_elements": (("fragments",), _elements), "tokenize": (("fragments",), lambda d: f"SELECT expr_id, pos, kind, token FROM {tokens(d)} t"),
    "win_letter_runs": (("fragments",), _letter_runs), "win_pair_subscripts": (("fragments",), _pairs), "win_neighbor_noise": (("fragments",), _neighbours), "win_bracket_depth": (("fragments",), _depth),
    "template_power": _template(0, "power"), "template_fixer": _fixer("fixer"), "template_channel": _fixer("channel"), "template_cue_join": (("fragments",), _cue_join),
    "template_trigger": (("fragments",), lambda d: f"SELECT expr_id, {has(d, 'payload', chr(92) + 'l_{', chr(92) + 'r_{', chr(92) + 'f_{', chr(92) + 's_{', chr(92) + 'm_{', 'l_{e}', 'r_{i}g')} OR {d.match('payload', r'\\[a-z]\s[a-z]\s[a-z]')} AS triggered FROM {EXPRESSIONS}"),
    "entity_decode": ((), _decode), "entity_encode": ((), _encode), "entity_reference": ((), _reference), "entity_consistency": ((), _consistency), "agg_entity_categories": ((), _categories), "symbol_lookup": (("fragments",), _symbol_lookup),
    "recover_tokens": (("fragments",), _recover_tokens), "repair_tokens": (("fragments",), _repair_tokens),
    "proj_entity_normalize": ((), _normalize),
}
