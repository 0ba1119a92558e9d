"""Quality gates: rule tables over expressions, each with the labels that fire, in the order of its rules."""

from __future__ import annotations

from ..functions.dialect import Spark, any_match, count_of, fired, has

#: What stands before and after a word on its own, not led by a backslash and not followed by a brace.
ALONE, NO_BRACE = r"(?:^|[^A-Za-z0-9_\\])", r"(?:\s*\z|\s+[^\s{]|[^A-Za-z0-9_\s{])"


def spelled(*groups: str, gap: str = r"\s*") -> str:
    """Letters strung as base and subscript: spelled('eq', 'ui', 'v') finds e_q u_i v with any braces and blanks."""
    parts = [rf"{g[0]}\s*_\s*\{{?\s*{g[1]}\s*\}}?" if len(g) == 2 else g for g in groups]
    return gap.join(parts)


# The rules of each gate, (pattern, label), in the order in which labels are given.
SPELLING_PRE = (
    (r"(\\[a-zA-Z]+)?(_\{?[a-zA-Z]\}?){3,}", "split-letter"),
    ("(?i)" + spelled("eq", "ui", "v"), "split equiv"), ("(?i)" + spelled("su", "m") + r"\s*([^\s{]|\z)", "split sum"), ("(?i)" + spelled("mi", "n") + r"\s*([^\s{]|\z)", "split min"),
    ("(?i)" + spelled("lo", "ng"), "split long"), ("(?i)" + spelled("ri", "gh", "ta"), "split right"),
    *((f"(?i){ALONE}{w}{NO_BRACE}", f"{w} as text") for w in ("equiv", "sum", "min", "max")),
)
LATEX_CORRUPTION = (
    ("(?i)" + spelled("eq", "ui", "v"), "split equiv"), ("(?i)" + spelled("lo", "ng", "ri", "gh", "ta"), "split longrighta"), ("(?i)" + spelled("su", "m") + r"\s*([^\s{]|\z)", "split sum"),
    ("(?i)" + spelled("ma", "th", "bb"), "split mathbb"), (r"(?i)[a-z]_\{[a-z]\}[a-z]_\{[a-z]\}[a-z]([^,}]|\z)", "letter-by-letter subscripts"),
    (r"(?i)\\[a-z]_\{[a-z]\}[a-z]_\{[a-z]\}[a-z]\s*([^\sa-zA-Z_0-9,}]|\z)", "shredded command"),
    (r"(?i)[a-z]_\{[a-z]\}[a-z]_\{[a-z]\}[a-z]_\{[a-z]\}([^,}]|\z)", "alphabet as subscript"), (r"(?i)_\{[a-z]\}[a-z]_\{[a-z]\}[a-z]_\{[a-z]\}([^,}]|\z)", "repeated letter subscripts"),
    (r"(?i)[a-z]_\{[a-z]_\{[a-z]\}[a-z]_\{[a-z]\}\}", "nested subscript word"),
    (f"(?i){ALONE}(left|right|sum|frac|mathbb|equiv|in){NO_BRACE}", "broken operator"), (r"(?i)\\[a-z]\s+[a-z]\s+[a-z]", "spaced command"), (r"(?i)\\[a-z]_\{[a-z]\}\s+[a-z]", "broken command"),
    (f"(?i){ALONE}sum{NO_BRACE}", "sum as text"), (r"(?i)m\s*a\s*t\s*h\s*b\s*Z", "Z via characters"),
    (r"(?i)\\sum\s*\{[^}]*\}([^_^]|\z)", "sum missing bounds"), (r"(?i)\\sum([^{_^]|\z)", "sum missing scripts"), (r"(?i)_\s*\{[^}]*=\s*[^}]*\}", "potential: = in subscript"),
)
SPELLING_HACK = (
    (r"(?i)[a-z]_\{?[a-z]\}?[a-z]_\{?[a-z]\}?[a-z]", "chained subscripts"), (r"(?i)\\[a-z]_\{[a-z]\}", "subscripted command letter"),
    (r"(?i)\\[a-z]\s+[a-z]\s+[a-z]", "spaced letters"), (r"(?i)[a-z]\s*_\s*[a-z]\s+[a-z]\s*_\s*[a-z]", "loose subscripts"),
    *(("(?i)" + spelled(*g), "spelled " + "".join(g)) for g in (("eq", "ui", "v"), ("su", "m"), ("mi", "n"), ("ma", "x"), ("fr", "ac"), ("le", "ft"), ("ri", "gh", "t"), ("lo", "ng"), ("ma", "th", "bb"), ("ne", "q"), ("bi", "gc", "up"))),
)
CLEAN_FORBIDDEN = (
    r"(?i)[a-zA-Z]_\{[a-zA-Z]\}\s*[a-zA-Z]_\{[a-zA-Z]\}", "(?i)" + spelled("su", "m") + r"([^A-Za-z0-9_]|\z)", r"(?i)s_\{u\}\s*m",
    *("(?i)" + spelled(*g) for g in (("fr", "ac"), ("le", "ft"), ("ri", "gh", "t"), ("eq", "ui", "v"), ("ma", "th", "bb"), ("le", "q"))),
    r"(?i)[a-z]_\{[a-z]\}\s*[a-z]_\{[a-z]\}\s*[a-z]_\{[a-z]\}", r"\\[a-z]+\s*\z", r"\{[^}]*\z",
)
GARBLED = ("cxcuvec", "cxcu", "cxc", "cx", "cuvec", "vecu")
TRUNCATED = (r"\\[a-z]{1,3}\z", r"\\(lef|rig|fra)\z", r"\\mathbb\{[^}]+\}_\z")


def _msub_chain(*pairs: str) -> str:
    parts = [f"<msub><mi>{p[0]}</mi>.*?<mi>{p[1]}</mi>.*?</msub>" if len(p) == 2 else f"<mi>{p}</mi>" for p in pairs]
    return "(?is)" + ".*?".join(parts)


def _letters(word: str) -> str:
    return "".join(f"<mi>{c}</mi>" for c in word)


SPELLED_MATHML = (
    *((_msub_chain(*g), f"{''.join(g)} spelled via msub") for g in (("lo", "ng"), ("ri", "gh", "t"), ("ar", "ro", "w"), ("su", "m"), ("eq", "ui", "v"), ("ma", "th", "bb"))),
    (r"(?is)<msub><mi>i</mi>.*?<mi>n</mi>.*?</msub>\s*([^\s<]|\z)", "in spelled via msub"),
    (_msub_chain("fo", "ra", "ll"), "forall spelled via msub"),
    (r"(?i)(<msub><mi>[a-z]</mi>.*?<mi>[a-z]</mi>.*?</msub>\s*){3,}", "3+ single-letter msub"),
)
MSUB_WORDS = "left right sum frac math long text arrow equiv mathbb forall".split()
CORRUPT_LITERALS = ("<msub><mi>l</mi>", "<msub><mi>s</mi>", "long", "math b", *map(_letters, ("left", "right", "sum", "frac", "math")), "[object Object]")
CORRUPT_PATTERNS = (
    r"(<mi>\s*[a-zA-Z]\s*</mi>\s*){4,}", r"(?i)(<msub><mi>[a-z]</mi><mi>[a-z]</mi></msub>\s*){3,}",
    r"(?i)<msub><mi>e</mi><mi>q</mi></msub>.*?<msub><mi>u</mi><mi>i</mi></msub>.*?<mi>v</mi>", r"(?i)<msub><mi>s</mi><mi>u</mi></msub>.*?<mi>m</mi>",
    r"(?i)<msub><mi>m</mi><mi>a</mi></msub>.*?<msub><mi>t</mi><mi>h</mi></msub>.*?<msub><mi>b</mi><mi>b</mi></msub>", r"(?i)<msub><mi>(left|right|sum|frac|math|long|text)</mi>",
)
STRICT_RULES = (
    (CORRUPT_PATTERNS[2], "equiv via msub"), (CORRUPT_PATTERNS[3], "sum via msub"), (CORRUPT_PATTERNS[4], "mathbb via msub"), (CORRUPT_PATTERNS[1], "repeated single-letter subscripts"),
    *((f"(?i)<msub><mi>{a}</mi><mi>{b}</mi>", f"word {w} spelled with msub") for a, b, w in (("l", "e", "left"), ("r", "i", "right"), ("s", "u", "sum"), ("f", "r", "frac"), ("m", "a", "math"))),
    *((f"(?i)<msub>{_letters(w)}", f"{w} via letters in msub") for w in ("equiv", "mathb")),
    *((f"(?i){_letters(w)}", f"{w} via letters") for w in ("equiv", "sum", "mathb")),
    (r"<mi>\s*[=+×÷±∓≤≥≠≡≈∈∉⊂⊃∪∩-]", "operator in mi"), (r"<mi>\s*[∑∏∫∂∇∞√]", "math operator in mi"), *((rf"<mi>\s*[{c}]", f"{c} in mi") for c in "=+∑∈≡"),
    *((rf"(?i)<{t}>\s*(left|right|sum|frac|equiv|mathbb|long)\s*</{t}>", f"word in {t}") for t in ("mtext", "mi")),
)
OPERATORS = "= + - × ÷ ± ≤ ≥ ≠ ≡ ∈ ∑ ∫".split()
STRUCTURE_LATEX = (
    (f"(?i){ALONE}(equiv|sum|min|max|left|right|frac){NO_BRACE}", "bare operator word"), (r"\\[a-z]\s*_\s*\{?[a-z]", "fragmented command"),
)
SUBSCRIPT_WORDS_ALLOWED = "in eq ne le ge".split()
STRUCTURE_MATHML = (
    *((f"(?i)<msub><mi>{w}</mi>", f"{w} in msub") for w in ("left", "right", "sum", "frac")), *((f"(?i){_letters(w)}", f"{w} as letters") for w in ("left", "right", "sum", "equiv")),
    *((rf"<mi>\s*{c}\s*</mi>", f"{n} not in mo") for c, n in (("=", "equals"), (r"\+", "plus"), ("∑", "sum"), ("∈", "in"))),
)
SPLIT_WORDS = ((CORRUPT_PATTERNS[0], "consecutive letters"), *((f"(?i)<msub><mi>{c}</mi>", f"split {n}") for c, n in (("l", "left or long"), ("s", "sum"), ("f", "frac"), ("r", "right"))))
MI_WORDS = "math left right frac sum prod int partial long".split()
FAKE_SUBSCRIPTS = "left right sum frac math long text error".split()
PAIRS_MALFORMED, PAIRS_STRICT = "msub msup mrow mfrac munder mover".split(), "msub msup mrow munderover munder".split()
CRITICAL = (r"\frac{", "spelled via", "[object Object]", "LaTeX commands", "array environment", "word in mtext", "via letters", r"<mtext>.*\\")


def _words_found(d: Spark, x: str, pattern: str, allowed: list[str], label: str) -> str:
    """A label for each match whose word is in a list."""
    names = ", ".join(d.lit(w) for w in allowed)
    return d.each(d.keep(d.extract_all(x, pattern, 1), f"lower(y) IN ({names})"), f"concat({d.lit(label + ': ')}, y)")


def _unbalanced(d: Spark, x: str, tags, counts: bool) -> str:
    def item(t: str) -> str:
        a, b = count_of(d, x, f"<{t}>"), count_of(d, x, f"</{t}>")
        label = f"concat('unbalanced {t} (', {a}, ' open, ', {b}, ' close)')" if counts else f"'unbalanced {t}'"
        return f"CASE WHEN {a} <> {b} THEN {label} END"

    return d.compact(d.array(*map(item, tags)))


def _if(d: Spark, test: str, labels: str) -> str:
    return f"CASE WHEN {test} THEN {labels} ELSE {d.compact(d.array('CAST(NULL AS VARCHAR(99))' if d.name == 'duckdb' else 'CAST(NULL AS STRING)'))} END"


def pre_repair(d, x, squeezed=None):
    return fired(d, x, SPELLING_PRE, squeezed)


def latex_corruption(d, x, squeezed=None):
    return fired(d, x, LATEX_CORRUPTION, squeezed)


def spelling_hack(d, x, squeezed=None):
    return fired(d, x, SPELLING_HACK, squeezed)


def spelled_words(d, x):
    return d.concat_arrays(fired(d, x, SPELLED_MATHML), _words_found(d, x, "(?i)<msub><mi>([a-z]{2,})</mi>", MSUB_WORDS, "word in msub"))


def corrupt_strict(d, x):
    return f"(contains({x}, '<math') AND ({has(d, x, *CORRUPT_LITERALS)} OR {any_match(d, x, CORRUPT_PATTERNS)}))"


def validate_strict(d, x):
    content = d.sub(d.sub(x, "<[^>]+>", ""), r"\s+", "")
    more = d.compact(d.array(
        f"CASE WHEN {has(d, x, '&#x2211;', '∑')} AND NOT {has(d, x, '<munderover>', '<munder>')} AND {d.match(x, '<msub><mo>.*?(&#x2211;|∑).*?</mo>')} THEN 'sum needs munder' END",
        f"CASE WHEN {d.match(x, r'(?i)<mi>\s*in\s*</mi>')} AND NOT {has(d, x, '&#x2208;', '∈')} THEN 'in must be an operator' END",
        f"CASE WHEN {d.match(x, r'(?i)<mi>\s*sum\s*</mi>')} AND NOT {has(d, x, '&#x2211;', '∑')} THEN 'sum must be an operator' END",
        f"CASE WHEN NOT {has(d, x, 'xmlns=', 'xmlns:')} THEN 'missing namespace' END",
    ))
    last = d.compact(d.array(
        f"CASE WHEN {d.match(x, r'(?s)<mtext[^>]*>[^<]*<(msub|msup|mfrac|munder|mover|mroot|mtable|mtr|mtd|mrow|mi|mo|mn)')} THEN 'mtext contains structure' END",
        f"CASE WHEN {d.match(x, r'<mtext>.*\\[a-zA-Z]+\{')} THEN 'mtext contains LaTeX commands' END",
        f"CASE WHEN contains({x}, '[object Object]') THEN '[object Object]' END",
        f"CASE WHEN {d.match(x, r'<mtext>.*\\begin\{array\}')} THEN 'mtext contains array environment' END",
    ))
    full = d.concat_arrays(fired(d, x, STRICT_RULES), more, _unbalanced(d, x, PAIRS_STRICT, False), last)
    elements = d.match(x, "<(mi|mn|mo)[^>]*>|<mfrac|<msup|<msub")
    return f"""CASE WHEN NOT contains({x}, '<math') THEN {d.array("'empty or invalid MathML'")}
        WHEN {content} = '' AND {d.match(x, r'(?is)<math[^>]*>\s*(<(mtable|mrow)[^>]*/>)?\s*</math>')} THEN {d.array("'no mathematical content'")}
        WHEN length({content}) < 3 AND NOT {elements} THEN {d.array("'empty structure'")} ELSE {full} END"""


def machine_written(d, x):
    return d.compact(d.array(f"CASE WHEN contains({x}, '<!--') THEN 'comment' END", f"CASE WHEN {count_of(d, x, '<mrow>')} > 50 THEN 'many mrow' END", f"CASE WHEN {d.match(x, r'>\s{3,}<')} THEN 'odd whitespace' END", f"CASE WHEN contains({x}, 'xml:space') THEN 'xml:space' END"))


def operator_tags(d, x):
    rules = tuple((rf"<mi>\s*[{o}]\s*</mi>", f"{o} must be an operator") for o in OPERATORS)
    return f"CASE WHEN {x} = '' THEN {d.array(d.lit('empty'))} ELSE {fired(d, x, rules)} END"


def latex_structure(d, x):
    subs = d.extract_all(x, r"_\{([a-zA-Z]{2,})\}", 1)
    allowed = ", ".join(d.lit(w) for w in SUBSCRIPT_WORDS_ALLOWED)
    return d.concat_arrays(fired(d, x, STRUCTURE_LATEX), d.each(d.keep(subs, f"lower(y) NOT IN ({allowed})"), "concat('word subscript: ', y)"))


def mathml_structure(d, x):
    return fired(d, x, STRUCTURE_MATHML)


def split_words(d, x):
    full = d.concat_arrays(fired(d, x, SPLIT_WORDS), _words_found(d, x, "<mi>([a-z]{2,})</mi>", MI_WORDS, "split word in mi"), _words_found(d, x, "(?i)<msub><mi>([a-z]{2,})</mi>", FAKE_SUBSCRIPTS, "fake subscript"))
    return _if(d, f"contains({x}, '<mi>')", full)


def malformed_tags(d, x):
    def unless(parts, pattern, label, more="TRUE"):
        return f"CASE WHEN NOT {has(d, x, *parts)} AND {more} AND {d.match(x, pattern)} THEN '{label}' END"

    no_in = ("<mo>&#x2208;</mo>", "<mo>∈</mo>", "<mo>&#x02208;</mo>")
    rest = d.compact(d.array(
        f"CASE WHEN {d.match(x, r'<mtext>.*\\[a-zA-Z]+\{.*\}</mtext>')} THEN 'mtext contains LaTeX commands' END",
        unless(("\\sum", "<mo>&#x2211;</mo>", "<mo>∑</mo>"), "(?i)" + _letters("sum"), "sum split"),
        unless(("<mo>&#x2261;</mo>", "<mo>≡</mo>", "<mo>&#x02261;</mo>"), "(?i)" + _letters("equiv"), "equiv split"),
        unless(no_in, "(?i)" + _letters("in"), "in split"),
        unless((*no_in, 'mathvariant="double-struck"', "&#x02124;"), r"(?i)math\s+b\s+Z|" + _letters("math") + ".*<mi>b</mi>", "Z corrupted"),
    ))
    return _if(d, f"contains({x}, '<math')", d.concat_arrays(_unbalanced(d, x, PAIRS_MALFORMED, True), rest))


def corruption_score(d, n_latex: str, n_split: str, n_malformed: str) -> str:
    """From the numbers of labels of latex_corruption, split_words and malformed_tags."""
    def part(n: str, weight: float) -> str:
        return f"CASE WHEN {n} > 0 THEN CAST({weight} AS DOUBLE) + CAST(0.1 AS DOUBLE) * ({n} - 1) ELSE CAST(0 AS DOUBLE) END"

    return f"round(least(CAST(1 AS DOUBLE), {part(n_latex, 0.4)} + {part(n_split, 0.3)} + {part(n_malformed, 0.3)}), 6)"


def clean_first(d, x, squeezed=None):
    garbled = rf"({d.match(x, r'(?i)\\mathrm\{[a-z]{6,}[^}]*\}')} AND {has(d, f'lower({x})', *GARBLED)})"
    return f"(trim({x}) <> '' AND NOT {any_match(d, x, CLEAN_FORBIDDEN, squeezed)} AND NOT {garbled} AND abs({count_of(d, x, '{')} - {count_of(d, x, '}')}) <= 5)"


def latex_syntax(d, x):
    a, b = count_of(d, x, "{"), count_of(d, x, "}")
    rules = d.compact(d.array(
        f"CASE WHEN trim({x}) = '' THEN 'empty' END", f"CASE WHEN trim({x}) <> '' AND {a} <> {b} THEN concat('unbalanced braces: ', {a}, ' open, ', {b}, ' close') END",
        f"CASE WHEN {d.match(x, r'\\\z')} THEN 'invalid command' END", f"CASE WHEN {d.match(x, r'_\s*\{[^}]*\z')} THEN 'unclosed subscript' END", f"CASE WHEN {d.match(x, r'\^\s*\{[^}]*\z')} THEN 'unclosed superscript' END",
    ))
    return rules


def truncated(d, x):
    return rf"(({count_of(d, x, '{')} > {count_of(d, x, '}')} AND {d.match(x, r'\{+\s*\z')}) OR {any_match(d, x, TRUNCATED)})"


def critical(d, labels: str) -> str:
    return d.any(labels, has(d, "y", *CRITICAL))


def real_faults(d, labels: str) -> str:
    """Labels without the merely potential ones."""
    return d.keep(labels, "NOT contains(y, 'potential:')")


def lenient(d, x) -> dict[str, str]:
    """Five milder views of corrupt MathML."""
    four = d.match(x, r"(<mi>\s*[a-zA-Z]\s*</mi>\s*){4,}")
    return {
        "a": f"({four} OR {has(d, x, '<msub><mi>l</mi>', '<msub><mi>s</mi>')})",
        "b": f"({four} OR contains({x}, {d.lit(chr(92))}))",
        "c": f"({d.size(fired(d, x, SPLIT_WORDS))} > 0)",
        "d": f"({has(d, x, *map(_letters, ('left', 'right', 'frac', 'sum')))} OR {d.match(x, '(?i)<msub><mi>[lrfs]</mi><mi>[eiru]</mi>')})",
        "e": f"({d.match(x, '(?i)' + _letters('sum'))} AND NOT contains({x}, '∑'))",
    }


# What makes an expression invalid, (pattern, reason), in order.
INVALID = (
    (r"_\{[^{}]*_\{[^{}]*\}[^{}]*\}", "double_subscript"),
    (r"([A-Za-z]_\{[A-Za-z]\}){3,}", "letter_by_letter"),
    (r"\\[a-zA-Z]\s*_\s*\{?[a-zA-Z]", "broken_command_fragment"),
)


def validity_reason(d, x):
    """The first reason for which an expression is invalid, or `valid`."""
    cases = " ".join(f"WHEN {d.match(x, p)} THEN '{reason}'" for p, reason in INVALID)
    return f"CASE WHEN trim({x}) = '' THEN 'empty' WHEN {count_of(d, x, '{')} <> {count_of(d, x, '}')} THEN 'unbalanced_braces' {cases} ELSE 'valid' END"
