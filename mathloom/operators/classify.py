"""Input types, filters and plain projections. Each function takes a dialect and SQL texts and gives a SQL text."""

from __future__ import annotations

from ..functions.dialect import Spark, any_match, count_of, has

#: Tags that mark MathML, characters that mark mathematics, placeholders of failed recognition.
MATHML_TAGS = ("<mi", "<mo", "<mn", "<mrow", "<msub", "<mfrac")
STRUCTURAL_TAGS = ("<mfrac", "<msup", "<msub", "<msqrt", "<mtable", "<munder", "<mover")
MATH_CHARACTERS = "=+-*/^_{}[]()\\<>≤≥≠∑∫√∞±"
PLACEHOLDERS = (r"\text{OCR failed}", r"\text{No text detected}")


def structure_first(d: Spark, x: str) -> str:
    return f"""CASE WHEN trim({x}) = '' THEN 'empty'
        WHEN (contains({x}, '<math') AND contains({x}, '</math')) OR {has(d, x, *MATHML_TAGS)} THEN 'mathml'
        WHEN {d.match(x, r"\\[A-Za-z]+|[_^]|[$]")} THEN 'latex' ELSE 'plain' END"""


def delimiter_first(d: Spark, x: str) -> str:
    return f"""CASE WHEN trim({x}) = '' THEN 'empty' WHEN contains({x}, '$') OR {d.match(x, r"\\[A-Za-z]+")} THEN 'latex'
        WHEN (contains({x}, '<math') AND contains({x}, '</math')) OR {has(d, x, *MATHML_TAGS)} THEN 'mathml' ELSE 'plain' END"""


def has_real_latex(d: Spark, x: str) -> str:
    return d.match(x, r"\\[a-zA-Z]{2,}|[{}^_]")


def has_broken_latex(d: Spark, x: str) -> str:
    unequal = f"{count_of(d, x, '{')} <> {count_of(d, x, '}')}"
    fences = rf"{count_of(d, x, chr(92) + 'left')} <> {count_of(d, x, chr(92) + 'right')}"
    return f"({d.match(x, r'\\[a-zA-Z]\z')} OR {d.match(x, r'\\q([^a-zA-Z]|\z)')} OR {unequal} OR {fences})"


def gibberish(d: Spark, x: str, share: float = 0.7) -> str:
    upper = f"CAST(length({x}) - length({d.sub(x, '[A-Z]', '')}) AS DOUBLE) / greatest(length({x}), 1)"
    return f"(length({x}) > 10 AND {upper} > {share} AND NOT {d.match(x, r'[=+*/()\[\]{}-]')})"


def wrap_plain_text(d: Spark, x: str) -> str:
    """Text without any mathematical character becomes \\text{...} with LaTeX specials escaped."""
    escaped = x
    for a, b in (("\\", "\\textbackslash "), ("&", "\\&"), ("%", "\\%"), ("$", "\\$"), ("#", "\\#"), ("~", "\\textasciitilde ")):
        escaped = f"replace({escaped}, {d.lit(a)}, {d.lit(b)})"
    math = has(d, x, *MATH_CHARACTERS)
    return f"CASE WHEN {math} THEN {x} ELSE concat({d.lit(chr(92) + 'text{')}, {escaped}, '}}') END"


def error_code(d: Spark, x: str) -> str:
    return f"nullif({d.extract(x, 'data-error=\"([^\"]*)\"', 1)}, '')"


def preview(d: Spark, mathml: str, latex: str) -> str:
    def cut(x: str, n: int) -> str:
        return f"replace(CASE WHEN length({x}) > {n} THEN concat(substr({x}, 1, {n}), '...') ELSE {x} END, {d.lit(chr(10))}, ' ')".replace(d.lit(chr(10)), "chr(10)")

    return f"CASE WHEN {mathml} <> '' THEN {cut(mathml, 80)} WHEN {latex} <> '' THEN {cut(latex, 60)} ELSE 'pending' END"


def namespace_display(d: Spark, x: str) -> str:
    xmlns = "http://www.w3.org/1998/Math/MathML"
    named = f"""CASE WHEN contains({x}, 'xmlns') THEN {x} ELSE replace({x}, '<math', '<math xmlns="{xmlns}"') END"""
    inline = f"""replace({named}, 'display="inline"', 'display="block"')"""
    return f"""CASE WHEN contains({named}, 'display=') THEN {inline} ELSE replace({named}, '<math', '<math display="block"') END"""


def strip_tags(d: Spark, x: str) -> str:
    return f"trim({d.sub(d.sub(x, '<[^>]+>', ' '), '[ \\t\\n\\r\\f]+', ' ')})"


def incomplete_rows(d: Spark, mathml: str, latex: str) -> str:
    expected = f"greatest(1, {count_of(d, latex, chr(92) * 2)} + (length({latex}) - length(replace({latex}, chr(10), ''))) + 1)"
    return f"(contains({mathml}, '<mtable') AND {count_of(d, mathml, '<mtr>')} < {expected})"


def xml_escape(d: Spark, x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = f"replace({x}, {d.lit(a)}, {d.lit(b)})"
    return x


def wrap_mtext(d: Spark, x: str) -> str:
    return f"""concat('<math xmlns="http://www.w3.org/1998/Math/MathML"><mrow><mtext>', {xml_escape(d, x)}, '</mtext></mrow></math>')"""


def structural(d: Spark, x: str) -> str:
    return has(d, x, *STRUCTURAL_TAGS)


def shredded_latex(d: Spark, x: str) -> str:
    """The predicates of three places: strict, wider, and loosely spaced words."""
    strict = any_match(d, x, (r"\\[a-z]_\{[a-z]\}", r"[a-z]_\{[a-z]\}[a-z]_\{[a-z]\}", r"\\[a-z]_[a-z]"))
    wide = any_match(d, x, (r"[a-zA-Z]_\{[a-zA-Z]\}[a-zA-Z]_\{[a-zA-Z]\}", r"l_\{e\}f_\{t\}", r"r_\{i\}g_\{h\}t", r"f_\{r\}a_\{c\}", r"m_\{a\}t_\{h\}"))
    loose = any_match(d, x, tuple("(?i)" + r"\s*_?\s*\{?".join(w) for w in ("left", "right", "frac", "sum", "math", "equiv", "begin")))
    return f"concat(CAST({strict} AS INT), ':', CAST({wide} AS INT), ':', CAST({loose} AS INT))"


#: Literal spellings of these words letter by letter in MathML.
def letters(word: str) -> str:
    return "".join(f"<mi>{c}</mi>" for c in word)
