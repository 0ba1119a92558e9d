"""Repair chains: ordered rewriting rules as nested native expressions."""

from __future__ import annotations

import re

from ..functions.dialect import Spark, chain, count_of, has
from ..functions.normal import strip_marks
from .gates import spelled

END = r"([^A-Za-z0-9_]|\z)"  # a word ends here; the character after it is kept as the rule's last group

# Rewriting rules (pattern, replacement), in order.
CLASSIC_SYMBOLS = "[¥€¢©®™ºª×¿¡§¶•°«»“”‘’–—…·‚„`´∆≈≠∞√∂]"
CLASSIC_CLEAN = ((CLASSIC_SYMBOLS, ""), (r"\+\+", "+"), ("--", "-"), (r"([0-9])\s+([0-9])", r"\1\2"), (r"\s+", " "), (r"e-1" + END, r"e^{-1}\1"), ("yos", "y_{o}s"), (r"r\( \(", "r("))
CLASSIC_NORMALIZE = ((r"r\(([^\n]*?)\)", r"r_v^{(t)}(\1)"),)
LETTER_COMMANDS = (
    (r"\\c_\{a\}l" + END, r"\\cal\1"), (r"\\l_\{o\}\s*n_\{g\}\s*r_\{i\}\s*g_\{h\}\s*t_\{a\}\s*r_\{r\}\s*o_\{w\}", r"\\longrightarrow"), (r"\\l_\{e\}f_\{t\}", r"\\left"),
    (r"\\r_\{i\}g_\{h\}t" + END, r"\\right\1"), (r"\\s_\{u\}m" + END, r"\\sum\1"), (r"\\m_\{a\}t_\{h\}b_\{b\}", r"\\mathbb"), (r"\\e_\{q\}u_\{i\}v" + END, r"\\equiv\1"),
    (r"\\f_\{r\}a_\{c\}", r"\\frac"), (r"\\b_\{e\}g_\{i\}n" + END, r"\\begin\1"), (r"\\e_\{n\}d" + END, r"\\end\1"), (r"\\a_\{r\}r_\{a\}y" + END, r"\\array\1"), (r"\\c_\{d\}\s*o_\{t\}", r"\\cdot"),
)
# Those of the spelled commands that stand before no brace take the blanks after them along.
_BEFORE_NO_BRACE = ("sum", "min", "max", "in")
_SPELLED = {
    "equiv": "eq ui v", "sum": "su m", "min": "mi n", "max": "ma x", "frac": "fr ac", "left": "le ft", "right": "ri gh t", "long": "lo ng",
    "mathbb": "ma th bb", "neq": "ne q", "ldots": "ld ot s", "bigcup": "bi gc up", "in": "in",
}


def _spelled_rules(word: str, groups: str) -> tuple:
    pattern = "(?i)" + spelled(*groups.split())
    if word not in _BEFORE_NO_BRACE:
        return ((pattern, rf"\\{word}"),)
    # the character after the word is part of the match, so words side by side need a second turn
    return ((pattern + r"\s*([^\s{]|\z)", rf"\\{word}\1"),) * 2


SPELLED_COMMANDS = tuple(rule for word, groups in _SPELLED.items() for rule in _spelled_rules(word, groups))


def _shredded(word: str, units: str, slashed: bool = False, tail: str = "") -> tuple[str, str]:
    """The rule of a command cut into units: backslashes and blanks between the units, or nothing and one backslash or none;
    where `slashed`, a backslash before any unit as well."""
    parts = [re.sub(r"([{}])", r"\\\1", u) for u in units.split()]
    forms = [r"\\+" + r"\s*".join(parts), *([r"\\+" + r"\\?".join(parts)] if slashed else []), r"\\?" + "".join(parts)]
    return f"(?i)(?:{'|'.join(forms)}){tail}", rf"\\{word}"


_SCRIPT = r"(\\?[a-z])\s*_\s*\{([^}]+)\}"
_NEXT_SCRIPT = r"(\\?[a-z])\s*_\s*\{"
#: Blanks between subscripted letters go, in three turns, so that the table finds them side by side.
SCRIPT_SPACING = (
    (r"(?i)\\+e_\{n\}\s+d\s+array", r"\\end{array}"),
    *((_SCRIPT + r"\s+" + _NEXT_SCRIPT, r"\1_{\2}\3_{"),) * 3,
    (_SCRIPT + r"\s+" + _SCRIPT + r"\s+" + _NEXT_SCRIPT, r"\1_{\2}\3_{\4}\5_{"),
    (_SCRIPT + r"\s*" + _SCRIPT + r"\s+([a-z]+)", r"\1_{\2}\3_{\4}\5"),
)
#: Fixed value: what each of these rules needs, a script and a letter with blanks between.
SCRIPT_AND_BLANK = r"\}\s+\\?[A-Za-z]"
# The braces of an array's end come out escaped by the table, and plain by the first rule above.
_END_ARRAY = r"\\end\\{array\\}"
SHRED_TABLE = (
    (r"(?i)\\m_\{a\}t_\{h\}r_\{m\}\{e_\{r\}r_\{o\}r\}", r"\\mathrm{error}"),
    (r"(?i)\\m_\{a\}t_\{h\}r_\{m\}\{P_\{r\}\}", r"\\mathrm{Pr}"),
    (r"(?i)\\m_\{a\}t_\{h\}r_\{m\}", r"\\mathrm"),
    _shredded("mathbb", "m_{a} t_{h} b_{b}", slashed=True),
    _shredded("mathbf", "m_{a} t_{h} b_{[fs]}", slashed=True),
    _shredded("math", "m_{a} t_{h}", slashed=True),
    _shredded("left", "l_{e} f_{t}", slashed=True),
    _shredded("right", "r_{i} g_{h} t", slashed=True, tail=r"\}?"),
    _shredded("sum", "s_{u} m"),
    _shredded("frac", "f_{r} a_{c}"),
    (r"(?i)\\?p_\{r\}", r"\\Pr"),
    _shredded("bigcup", "b_{i} g_{c} u_{p}"),
    _shredded("in", "i_{n}"),
    _shredded("neq", "n_{e} q"),
    (r"(?i)\\?l_\{d\}o_\{t\}s", r"\\ldots"),
    (r"(?i)\\?d_\{o\}t_\{s\}", r"\\ldots"),
    _shredded("forall", "f_{o} r_{a} l_{l}", slashed=True),
    _shredded("quad", "q_{q} u_{a} d"),
    (r"(?i)\\?q_\{u\}a_\{d\}", r"\\quad"),
    (r"(?i)\\+e_\{n\}\s*d\s*array|\\+e_\{n\}d\s+\\?a_\{r\}\\?r_\{a\}y|\\?e_\{n\}d\s*array", _END_ARRAY),
    (r"(?i)\\?a_\{r\}\\?r_\{a\}y", "array"),
    (r"(?i)\\+e_\{n\}\s*d\s+array|\\?e_\{n\}d\s+array", _END_ARRAY),  # those whose array has just been put together
    (r"(?i)\\+e_\{n\}\s+d", r"\\end "),
    (r"(?i)\\?e_\{n\}d", r"\\end"),
)
#: A command whose letters stand apart, up to a character that no word holds.
SPACED = r"\\\s*[a-zA-Z](?:\s+[a-zA-Z]){2,}"
#: Commands whose letters stand apart, doubled fences and runs of quads.
SPACED_COMMANDS = (
    (r"(?i)\\l\s+e\s+f\s+t" + END, r"\\left\1"),
    (r"(?i)(^|[^A-Za-z0-9_\\])l\s+e\s+f\s+t" + END, r"\1\\left\2"),
    (r"(?i)\\\s*f\s*r\s*a\s*c", r"\\frac"),
    (r"(?i)\\\s*s\s*u\s*m", r"\\sum"),
    (r"\\left\\left", r"\\left"),
    (r"\\right\\right", r"\\right"),
    (r"\\quad(\s*\\quad)+", r"\\quad"),
)
FORCED_TABLE = tuple(
    ("(?i)\\\\*" + r"\s*".join(rf"{u[0]}_\{{{u[1]}\}}" if len(u) == 2 else u for u in units.split()), rf"\\{word}")
    for word, units in (("mathrm", "ma th rm"), ("mathbb", "ma th bb"), ("mathbf", "ma th bf"), ("math", "ma th"), ("left", "le ft"), ("right", "ri gh t"), ("sum", "su m"))
)
SYMBOLS = ((r"\.\.\.", r"\\ldots"), ("!=", r"\\neq"), ("<=|≤", r"\\leq"), (">=|≥", r"\\geq"), ("\u00a0", " "), (r"\s+", " "))
SPACING = ((r"\\!+", ""), (r"\\quad+", ""), (r"\\qquad+", ""), (r"\\(mathrm|text)\s*\{\s*~\s*\}", ""), (r"\\hspace\s*\{[^}]+\}", ""), (r"\\hskip\s*[0-9.]+(pt|em|ex|mu)", ""), (r"\\[,:;]", ""))
_STACK = r"\\stackrel\s*\{\s*\}\s*\{\s*\}\s*"
STACKREL = (
    (_STACK + r"\\longrightarrow\s*_\s*\{([^}]+)\}", r"\\xrightarrow[\1]{}"), (_STACK + r"\\longleftarrow\s*_\s*\{([^}]+)\}", r"\\xleftarrow[\1]{}"), (_STACK + r"\\longrightarrow" + END, r"\\xrightarrow{}\1"), (_STACK + r"\\longleftarrow" + END, r"\\xleftarrow{}\1"),
    (r"\\stackrel\s*\{\s*\\longrightarrow\s*\}\s*\{([^}]+)\}", r"\\xrightarrow{\1}"), (r"\\stackrel\s*\{([^}]+)\}\s*\{\s*\\longrightarrow\s*\}", r"\\xrightarrow{\1}"),
    (r"\\stackrel\s*\{([^}]+)\}\s*\{([^}]*[∈=<>≤≥(][^}]*)\}", r"\\xrightarrow[\2]{\1}"), (r"\\stackrel\s*\{([^}]+)\}\s*\{([^}∈=<>≤≥(]+)\}", r"\\xrightarrow{\1}"),
)
READABLE = ((r"\\equiv", "≡"), (r"\\sum", "∑"), (r"\\in", "∈"), (r"\\mathbb\{Z\}", "ℤ"), (r"\\mathbb\{([A-Z])\}", r"\1"), (r"\\left", ""), (r"\\right", ""), (r"\\cdot", "·"), (r"\\times", "×"), (r"\\leq", "≤"), (r"\\geq", "≥"), (r"\\neq", "≠"), (r"\s+", " "))
MERGED = (
    (r"\(([^,]+),\s*\\j\s*\)", r"(\1, j)"), (r"\\j([,}\])\s])", r"j\1"), (r"\\j\s*([a-zA-Z])", r"j \1"), (r"\\j\s*\\in", r"j \\in"), (r"\\subseteqT\s*\\leqt", r"0 \\leq \\tau \\leq t"), (r"\\in([A-Z])", r"\\in \1"),
    (r"\\subseteqT([^\\]|\z)", r"\\subseteq \\tau\1"), (r"\\(subseteq|subset|supseteq|supset)([A-Z])", r"\\\1 \2"), (r"\\leq([a-zA-Z])", r"\\leq \1"), (r"\\geq([a-zA-Z])", r"\\geq \1"),
)
NOISE = (*MERGED, (r"(\\displaystyle\s*){2,}", r"\\displaystyle "), (r"\\left\.", ""), (r"\\right\.", ""), (r"\\left\\\|", r"\\left|"), (r"\\right\\\|", r"\\right|"), (r"\\(left|right)\s+\\", r"\\\1\\"), (r"\\(left|right)\s*\z", ""), (r"(\\qquad\s*){2,}", " "))
BROKEN_COMMANDS = ((r"\\f\s+rac", r"\\frac"), (r"\\s\s+um", r"\\sum"), (r"\\l\s+eft", r"\\left"), (r"\\r\s+ight", r"\\right"), (r"\\m\s+athbb", r"\\mathbb"), (r"\\e\s+quiv", r"\\equiv"), (r"\\P" + END, r"P\1"), (r"_\s*_", "_"), (r"\^\s*\^", "^"), (r"_\{\s*\}", ""))
XML_TEXT = ((r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), (r"<mi>\\([A-Za-z]+)</mi>", r"<mi>\1</mi>"), (r"(</msub>){2,}", "</msub>"), (r"<\z", ""))
SANITIZE = (("…", r"\\ldots"), (r"\.{3,}", r"\\ldots"), (r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), (r"\\(left|right)\s+([(\[|)\]])", r"\\\1\2"))
SAFE = (
    ("[•·●○■□◦€£¥©®™¿¡«»\ufffd]", ""), (r"\s+", " "), (r"^ | \z", ""), ("__+", "_"), (r"([A-Za-z0-9])_\s*([A-Za-z0-9])", r"\1_{\2}"), (r"_([),\]])", r"\1"), (r"\^([),\]])", r"\1"),
)
INVALID_TOKENS = ((r"<(mi|mtext)>\\[A-Za-z]+</(mi|mtext)>", r"<\1></\2>"), ("<mi>(Iniln|mln)</mi>", "<mi>min</mi>"), ("<mi>m</mi><mi>l</mi><mi>n</mi>", "<mi>min</mi>"))
RETAG = (r"<mi>\s*([=+<>|(){}\[\],;:!/*±×÷·≤≥≠≡≈∈∉⊂⊃∪∩∑∏∫→←-])\s*</mi>", r"<mo>\1</mo>")
OCR_PATTERNS = (
    (r"l\s*é\s*\]", "[l]"), ("€", ""), ("¢", ""), ("»", ""), ("«", ""), ("é", "e"), ("É", "E"), ("à", "a"), ("è", "e"), ("ù", "u"), ("ô", "o"), ("î", "i"), ("ç", "c"), ("ñ", "n"),
    ("α", "alpha"), ("β", "beta"), ("γ", "gamma"), ("π", "pi"), ("θ", "theta"), ("λ", "lambda"), ("μ", "mu"), ("σ", "sigma"), ("∞", "infty"), ("∑", "sum"), ("∫", "int"), ("√", "sqrt"),
    ("≤", "le"), ("≥", "ge"), ("≠", "ne"), ("≈", "approx"), ("±", "pm"), ("×", "times"), ("÷", "div"), ("∂", "partial"), ("∇", "nabla"), ("∏", "prod"),
)
BROAD = (("α", r"\\alpha "), ("β", r"\\beta "), ("γ", r"\\gamma "), ("δ", r"\\delta "), ("ε", r"\\epsilon "), ("θ", r"\\theta "), ("λ", r"\\lambda "), ("μ", r"\\mu "), ("π", r"\\pi "), ("σ", r"\\sigma "), ("φ", r"\\phi "), ("ω", r"\\omega "), ("≤", r"\\leq "), ("≥", r"\\geq "), ("≠", r"\\neq "), ("≡", r"\\equiv "), ("∈", r"\\in "), ("∑", r"\\sum "), ("∞", r"\\infty "), ("→", r"\\to "), (r"l_\{e\}\]", "[t]"), (r"4T", "t"), (r"\s+", " "))
NOISE_CHARACTERS = "€£¥¢©®™§¶•°«»¿¡¤¦¨¬¯"


def apply(rules):
    """An operator (dialect, SQL text) -> SQL text for a rule list."""
    return lambda d, x: chain(d, x, rules)


def _where(d: Spark, x: str, needed: str, body) -> str:
    """body of x, which changes no text without a match of a plainer pattern, so that Spark tries that one first."""
    if d.name != "spark":
        return body(x)
    return d.once(x, lambda y: f"CASE WHEN {d.match(y, needed)} THEN {body(y)} ELSE {y} END")


def classic_clean(d: Spark, x: str) -> str:
    return f"trim({chain(d, strip_marks(d, x), CLASSIC_CLEAN)})"


def classic_structure(d: Spark, x: str) -> str:
    first = d.sub(x, r"(^|[^A-Za-z0-9_])1\s*n\s*[-−]\s*1" + END, r"\1\\frac{1}{n}\2")
    return d.once(first, lambda first: _led(d, first))


def _led(d: Spark, first: str) -> str:
    led = f"CASE WHEN contains({first}, 't=0') AND contains({first}, 'n') THEN concat({d.lit(chr(92) + 'frac{1}{n} ' + chr(92) + 'sum_{t=0}^{n-1} ')}, {first}) ELSE {first} END"
    return f"replace(replace({led}, '| <', '<'), '[r(', '[ r(')"


def classic_normalize(d: Spark, x: str) -> str:
    return d.once(chain(d, x, CLASSIC_NORMALIZE), lambda y: _squared(d, y))


def _squared(d: Spark, y: str) -> str:
    squared = f"CASE WHEN contains({y}, '[') AND contains({y}, ']') THEN replace({y}, ']', ']^2') ELSE {y} END"
    return f"trim(replace({squared}, '< P', {d.lit(chr(92) + 'le P')}))"


def close_braces(d: Spark, x: str) -> str:
    """Missing closing braces are appended; up to as many as are too many are cut from the end."""
    more = f"greatest(CAST({count_of(d, x, '{')} - {count_of(d, x, '}')} AS INT), 0)"
    return f"concat({x}, repeat('}}', {more}))"


def safe(d: Spark, x: str) -> str:
    """Marks and characters that recognition puts in go, with one pair of dollar signs around; scripts are braced or dropped.

    Missing closing braces are appended, and of those too many what stands at the end is cut.
    """
    bare = d.sub(x, r"^\s+|\s+\z", "")
    inside = "CASE WHEN length(y) > 1 AND y LIKE '$%$' THEN substr(y, 2, length(y) - 2) WHEN y = '$' THEN '' ELSE y END"
    off = brace_difference(d, "y")
    cut = f"least(length({d.extract('y', r'[}]*' + chr(92) + 'z', 0)}), greatest(-{off}, 0))"
    evened = f"concat(substr(y, 1, length(y) - {cut}), repeat('}}', greatest({off}, 0)))"
    stripped = _bound(d, _bound(d, bare, inside), strip_marks(d, "y"))
    if d.name == "spark":
        # most texts are ASCII, begin and end without blanks and have even braces; what is left of the rules asks for a script's mark
        bare = d.once(x, lambda y: f"CASE WHEN ascii({y}) <= 32 OR ascii(right({y}, 1)) <= 32 THEN {d.sub(y, r'^\s+|\s+\z', '')} ELSE {y} END")
        plain = _where(d, _bound(d, bare, inside), r"[^\x00-\x7F]", lambda y: d.sub(strip_marks(d, y), *SAFE[0]))
        ends = d.once(d.sub(plain, *SAFE[1]), lambda y: f"CASE WHEN startswith({y}, ' ') OR endswith({y}, ' ') THEN {d.sub(y, *SAFE[2])} ELSE {y} END")
        return f"trim({_bound(d, chain(d, ends, SAFE[3:]), f'CASE WHEN {off} = 0 THEN y ELSE {evened} END')})"
    return f"trim({_bound(d, chain(d, stripped, SAFE), evened)})"


def brace_difference(d: Spark, x: str) -> str:
    """Opening less closing braces."""
    return f"CAST({count_of(d, x, '{')} - {count_of(d, x, '}')} AS INT)"


def auto_balance(d: Spark, x: str) -> str:
    """One to three missing braces are put before the last \\end{ or at the end, or after the first \\begin{...} or at the start; beyond that the text stays."""
    off = brace_difference(d, x)
    more, fewer = f"repeat('}}', greatest({off}, 0))", f"repeat('{{', greatest(-{off}, 0))"
    head = d.extract(x, r"(?s)^(.*)\\end\{", 1)
    closed = f"CASE WHEN contains({x}, {d.lit(chr(92) + 'end{')}) THEN concat({head}, {more}, substr({x}, length({head}) + 1)) ELSE concat({x}, {more}) END"
    first = d.extract(x, r"(?s)^(.*?\\begin\{[^}]+\})", 1)
    opened = f"concat({first}, {fewer}, substr({x}, length({first}) + 1))"
    return f"CASE WHEN {off} BETWEEN 1 AND 3 THEN {closed} WHEN {off} BETWEEN -3 AND -1 THEN {opened} ELSE {x} END"


def _bound(d: Spark, x: str, body: str) -> str:
    """`body`, an expression in y, with x computed once for it."""
    return d.at(d.each(d.array(x), body), "1")


def _drop_rights(d: Spark, y: str, n: str) -> str:
    """y without the last n of the fences \\right}, \\right) and \\right] at its end; a fence before another command stays."""
    fences = d.extract_all(y, r"\\right[}\])][^\\]*", 0)
    tail = d.extract(y, r"((?:\\right[}\])][^\\]*)+)\z", 1)
    units = d.extract_all(tail, r"\\right[}\])][^\\]*", 0)
    kept = f"greatest({d.size(units)} - {n}, 0)"
    head = f"substr({y}, 1, length({y}) - length({tail}))"
    cut = d.sub(d.join(d.slice(units, f"{kept} + 1", d.size(units)), ""), r"\\right[}\])]", "")
    return f"CASE WHEN {d.size(fences)} = 0 OR {tail} = '' THEN {y} ELSE concat({head}, {d.join(d.slice(units, '1', kept), '')}, {cut}) END"


def _even(d: Spark, x: str, y: str, opener: str, closer: str) -> str:
    """x with as many closers appended as y, the text before, lacks if these are over two, or up to five cut from the end if over two are too many."""
    off = f"CAST({count_of(d, y, opener)} - {count_of(d, y, closer)} AS INT)"
    fewer = " ".join(f"WHEN {off} {test} THEN {d.sub(x, rf'[{closer}]{{1,{n}}}\z'.replace('[]]', r'\]'), '')}" for test, n in (("= -3", 3), ("= -4", 4), ("<= -5", 5)))
    return f"CASE WHEN {off} > 2 THEN concat({x}, repeat('{closer}', {off})) {fewer} ELSE {x} END"


def pre_balance(d: Spark, x: str) -> str:
    """Letter commands, then truncated ends cut, then fences, braces and brackets evened out.

    Fences too many go from the end; of those missing one is appended, the partner of the
    last \\left. Braces and brackets are counted before that and mended if off by more than two.
    """
    whole = chain(d, x, (*LETTER_COMMANDS, *((rf"\\{w}\z", "") for w in ("q", "qu", "su", "le", "ri", "fr", "ma")), (r"\\[a-z]{1,2}\z", "")))
    off = f"({d.size(d.extract_all('y', r'\\left[^a-zA-Z]', 0))} - {d.size(d.extract_all('y', r'\\right[^a-zA-Z]', 0))})"
    last = d.extract("y", r"(?s)^.*\\left([^a-zA-Z])", 1)
    partner = f"CASE {last} WHEN '(' THEN ')' WHEN '[' THEN ']' WHEN '|' THEN '|' WHEN '.' THEN '.' ELSE '}}' END"
    fenced = f"CASE WHEN {off} < 0 THEN {_drop_rights(d, 'y', f'(-{off})')} WHEN {off} > 0 THEN concat(y, {d.lit(chr(92) + 'right')}, {partner}) ELSE y END"
    return _bound(d, whole, _even(d, _even(d, fenced, "y", "{", "}"), "y", "[", "]"))


def joined_commands(d: Spark, x: str) -> str:
    """Commands of three or more letters that stand apart, as one word."""
    whole = SPACED + r"(?:[^A-Za-z0-9_]|\z)"
    letters = d.extract("y", SPACED, 0)
    by = d.each(d.extract_all(x, whole, 0), f"replace(y, {letters}, {d.sub(letters, chr(92) + 's+', '')})")
    return f"CASE WHEN {d.match(x, whole)} THEN {d.interleave(d.split(x, whole), by)} ELSE {x} END"


def shred_table(d: Spark, x: str, passes: int = 3) -> str:
    """Commands with their letters apart, the table of split commands, in three turns, then doubled fences and runs of quads.

    Of more than five quads that are left the first two stay, side by side. Texts without
    a subscript, a backslash or `left` in single letters are left as they are.
    """
    tight = _where(d, joined_commands(d, x), SCRIPT_AND_BLANK, lambda y: chain(d, y, SCRIPT_SPACING))
    whole = chain(d, chain(d, tight, SHRED_TABLE, passes), SPACED_COMMANDS)
    mark = chr(1)
    rest = chain(d, d.extract("y", r"(?s)^.*?\\quad+(.*)\z", 1), ((r"\\quad+", mark), (rf"{mark}(\s*{mark})+", mark), (rf"^\s*{mark}|{mark}\s*\z|^\s*\z", ""), (mark, " ")))
    few = f"concat({d.extract('y', r'(?s)^(.*?)\\quad', 1)}, {d.lit(chr(92) + 'quad' + chr(92) + 'quad')}, {rest})"
    quads = _bound(d, whole, f"CASE WHEN {count_of(d, 'y', chr(92) + 'quad')} > 5 THEN {few} ELSE y END")
    return f"CASE WHEN {has(d, x, '_', chr(92))} OR {d.match(x, r'(?i)l\s+e\s+f\s+t')} THEN {quads} ELSE {x} END"


SUBSCRIPT_RUN = r"(?:[A-Za-z]_\{[A-Za-z0-9]\}){2,}"


def collapse_subscripts(d: Spark, x: str) -> str:
    """Each run of two or more subscripted letters becomes one upright word: the bases, then the subscripts."""
    word = f"concat({d.lit(chr(92) + 'mathrm{')}, {d.sub('y', r'_\{.\}', '')}, {d.sub('y', r'[A-Za-z]_\{(.)\}', chr(92) + '1')}, '}}')"
    return f"CASE WHEN {d.match(x, SUBSCRIPT_RUN)} THEN {d.interleave(d.split(x, SUBSCRIPT_RUN), d.each(d.extract_all(x, SUBSCRIPT_RUN, 0), word))} ELSE {x} END"


def stackrel(d: Spark, x: str) -> str:
    return f"CASE WHEN {has(d, x, chr(92) + 'xrightarrow', chr(92) + 'xleftarrow')} THEN {x} ELSE {chain(d, x, STACKREL)} END"


def readable(d: Spark, x: str) -> str:
    return f"trim({chain(d, x, READABLE)})"


def extract_payload(d: Spark, x: str) -> str:
    """The first mtext, or the text of the tokens, or all text between tags."""
    tokens = d.sub(d.sub(x, r"<msub><m[ion]>([^<]*)</m[ion]><m[ion]>([^<]*)</m[ion]></msub>", r"\1_{\2}"), "<[^>]+>", " ")
    if d.name == "spark":  # most texts hold no tag
        tokens = f"CASE WHEN contains({x}, '<') THEN {tokens} ELSE {x} END"
    return f"CASE WHEN contains({x}, '<mtext>') THEN {d.extract(x, '<mtext>([^<]*)</mtext>', 1)} ELSE trim({d.sub(tokens, ' +', ' ')}) END"


def strip_noise_characters(d: Spark, x: str) -> str:
    return d.sub(x, f"[{NOISE_CHARACTERS}]", "")


#: A depth below any that braces can come back from.
BELOW = -1_000_000_000


def outer_braces(d: Spark, x: str) -> str:
    """The first and the last brace of a text go, with the blanks inside, if its braces are even and none closes too early."""
    turns = d.each(d.extract_all(x, "[{}]", 0), "CASE WHEN y = '{' THEN 1 ELSE -1 END")
    depth = d.fold(turns, "0", f"CASE WHEN a < 0 THEN {BELOW} ELSE a + y END")
    return f"CASE WHEN {d.match(x, r'(?s)^[{].*[}]' + chr(92) + 'z')} AND {depth} = 0 THEN trim(substr({x}, 2, length({x}) - 2)) ELSE {x} END"


def unwrap_array(d: Spark, x: str) -> str:
    body = d.extract(x, r"(?s)\\begin\{array\}\s*(?:\{[^}]*\})?(.*?)(?:\\end\{array\}|\z)", 1)
    return f"CASE WHEN contains({x}, {d.lit(chr(92) + 'begin{array}')}) THEN trim({body}) ELSE {x} END"


def ocr_errors(d: Spark, x: str) -> str:
    """Texts with commands lose only currency signs; others also accents' marks, quotes and controls."""
    light = d.sub(x, "[€£¥¢]", "")
    full = chain(d, x, (("[€£¥¢“”„`´]", ""), (r"\p{Mn}", ""), ("i€E", "i \\\\in E"), (r"[^\x09\x0A\x20-\x7E\x{A0}-\x{FFFF}]", "")))
    return f"CASE WHEN {d.match(x, r'\\[a-zA-Z]{2,}')} THEN {light} ELSE {full} END"


def conservative(d: Spark, x: str) -> str:
    greek = tuple((rf"(^|[^A-Za-z\\]){g}{END}", rf"\1\\{g}\2") for g in ("sum", "int", "alpha", "beta", "gamma", "delta", "theta", "lambda", "mu", "pi", "sigma", "omega"))
    return f"CASE WHEN {d.match(x, r'\\[a-zA-Z]{2,}|[{}^_]')} THEN {x} ELSE {chain(d, x, greek)} END"


#: Sets, and what shows that their letters stand for them.
SETS = (("R", "ℝ", "mathbb{R}"), ("Z", "ℤ", "mathbb{Z}"))
#: Fixed value: how far back a letter looks for a variant that has been set.
LOOK_BACK = 50


def _open_scripts(d: Spark, before: str) -> str:
    """Whether a text leaves a subscript or a superscript open."""
    return "(" + " OR ".join(f"{count_of(d, before, f'<{t}')} > {count_of(d, before, f'</{t}>')}" for t in ("msub", "msup")) + ")"


def double_struck(d: Spark, x: str) -> str:
    """The letters of sets get their variant where the set is named, except inside of scripts.

    The text is cut at the letter. Each piece but the last is followed by one; what stands before it are
    the pieces up to there, in which scripts are counted.
    """
    variant = 'mathvariant="double-struck"'
    for letter, *names in SETS:
        mark = f"<mi>{letter}</mi>"
        pieces = d.split(x, mark)
        before = d.join(d.slice(pieces, "1", "y"), mark)
        plain = f"{_open_scripts(d, before)} OR contains(right({before}, {LOOK_BACK}), '{variant}')"
        chosen = f"CASE WHEN y = {d.size(pieces)} THEN '' WHEN {plain} THEN '{mark}' ELSE '<mi {variant}>{letter}</mi>' END"
        places = d.numbers("1", d.size(pieces))
        by = d.each(places, chosen)
        x = f"CASE WHEN {has(d, x, *names)} AND contains({x}, '{mark}') THEN {d.interleave(pieces, by)} ELSE {x} END"
    return x


def numeric_entities(d: Spark, x: str) -> str:
    """Numeric references of ASCII letters and digits alone in an identifier."""
    for code in (*range(48, 58), *range(65, 91), *range(97, 123)):
        x = f"replace({x}, '<mi>&#x{code:05X};</mi>', '<mi>{chr(code)}</mi>')"
    return x


#: Operators by query name.
CHAINS = {
    "repair_classic_clean": classic_clean, "repair_classic_structure": classic_structure, "repair_classic_normalize": classic_normalize,
    "repair_classic_chain": lambda d, x: classic_normalize(d, classic_structure(d, classic_clean(d, x))),
    "repair_safe": safe, "repair_ocr_errors": ocr_errors, "repair_conservative": conservative,
    "repair_spelled_to_command": apply(SPELLED_COMMANDS), "repair_letter_commands": apply(LETTER_COMMANDS), "repair_pre_balance": pre_balance, "repair_auto_balance": auto_balance,
    "repair_collapse_subscripts": collapse_subscripts, "repair_shred_table": shred_table, "repair_shred_forced": lambda d, x: chain(d, collapse_subscripts(d, x), FORCED_TABLE),
    "repair_symbols": apply(SYMBOLS), "repair_extract_payload": extract_payload, "repair_xml_text": apply(XML_TEXT), "repair_sanitize": apply(SANITIZE), "repair_fixer_primitives": lambda d, x: close_braces(d, chain(d, x, BROKEN_COMMANDS)),
    "repair_stackrel": stackrel, "repair_strip_spacing": apply(SPACING), "repair_numeric_entities": numeric_entities, "repair_double_struck": double_struck, "proj_readable": readable,
    "repair_merged_commands": apply(MERGED), "repair_ocr_noise": apply(NOISE), "repair_outer_braces": outer_braces, "repair_operator_tags": apply((RETAG,)),
    "repair_invalid_tokens": apply(INVALID_TOKENS), "repair_noise_chars": strip_noise_characters, "repair_ocr_patterns": apply(OCR_PATTERNS), "repair_broad": apply(BROAD), "repair_unwrap_array": unwrap_array,
}
