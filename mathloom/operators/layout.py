"""Layout of multi-row expressions, labels, templates: SQL texts in a dialect."""

from __future__ import annotations

from ..functions.dialect import Spark, count_of, has

ENVIRONMENTS = "array aligned align gather cases split multline eqnarray".split()
MATRICES = "matrix bmatrix pmatrix vmatrix Vmatrix Bmatrix".split()
# Equation labels, in the order in which they are tried.
LABELS = (r"^\s*\(([0-9]+(?:\.[0-9]+)*[a-z]?)\)", r"^\s*\[([0-9]+(?:\.[0-9]+)*)\]", r"^\s*([0-9]+\.[0-9]+)\s", r"\\tag\{([^}]*)\}", r"\(([0-9]+(?:\.[0-9]+)*)\)")
# Cues over lower-cased text, how many are needed, and the canonical formula.
TEMPLATES = (
    ("power", (("r_v", "r("), ("frac", "1/n", "1 n"), ("sum", "t=0"), ("^2", "]^2", "squared"), ("le p", "<= p", "< p"), ("y_0", "y_{t-1}", "t-1")), 3, r"\frac{1}{n} \sum_{t=0}^{n-1} [ r_v^{(t)}(y_0,\ldots,y_{t-1}) ]^2 \le P"),
)

# Cues as patterns over lower-cased text with single blanks, how many are needed, and the canonical formula.
FIXER_TEMPLATES = {
    "fixer": ((r"p[_\s]?error|perror|p_error", r"bigcup|u_\{i=1\}|u_\{i\}", r"w[_\s]?i|g[_\s]?i", r"y[_\s]?d|y_\{d\}", r"\[0\]|n-1|t=0"), 3, r"\frac{1}{n} \sum_{t=0}^{n-1} \left[ r_v^{(t)}\!\left( y_0, \ldots, y_{t-1} \right) \right]^2 \le P"),
    "channel": ((r"y_?j\[?t", r"h_\{i,j\}|h_\\\{i,j\}|x_\[t\]|x\[t\]|x_i\[t\]", r"z_?j\[?t"), 2, r"Y_{j}[t]=\sum_{i\in I(j)} h_{i,j}[t] X_{i}[t] + Z_{j}[t]"),
}
# Tables of cues, of which three must come, and the groups of the all-of rule, of each of which one must come.
ERROR_CUES = ("p_error", "perror", "p_e", r"\p_r", "pr[", "pr(", "pr{", r"\cup", "⋃", "!=", "≠", "g_{i}", "y_{a}", "y_{d}", "i=1")
CHANNEL_CUES = ("y_", "x_", "z_", "l]", "l_{e}", "l_{d}", "l_{l}", "[e]", "hag", "so ", "ss", "sp", "s_p", "251")
POWER_GROUPS = (("rv",), ("y0",), ("t-1",), (r"\sum", "s_u", "s_{u}", "sum"), ("1n", r"\frac", "frac{1}{n}"), ("]^2", "}^{2}", "^{2}"))


def multi_line(d: Spark, x: str) -> str:
    return f"({has(d, x, *(chr(92) + 'begin{' + e for e in ENVIRONMENTS))} OR {count_of(d, x, chr(92) * 2)} > 1)"


def matrix(d: Spark, x: str) -> str:
    return f"({has(d, x, *(chr(92) + 'begin{' + e + '}' for e in MATRICES))} OR {d.match(x, r'\\left[\[(|]\s*\\begin\{array\}')})"


def route(d: Spark, x: str) -> str:
    a, b = count_of(d, x, r"\begin{"), count_of(d, x, r"\end{")
    return f"CASE WHEN trim({x}) = '' THEN 'empty' WHEN {a} <> {b} THEN 'open_array' WHEN {matrix(d, x)} THEN 'matrix' WHEN {multi_line(d, x)} THEN 'multi' ELSE 'single' END"


def label(d: Spark, x: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({d.extract(x, p, 1)}, '')" for p in LABELS) + ")"


def body(d: Spark, x: str) -> str:
    """What an environment holds, without its column specification; the text itself without one."""
    inner = d.extract(x, r"(?s)\\begin\{[a-zA-Z]+\*?\}\s*(?:\{[^}]*\})?(.*?)\\end\{", 1)
    return f"CASE WHEN contains({x}, {d.lit(chr(92) + 'begin{')}) AND {inner} <> '' THEN {inner} ELSE {x} END"


def rows(d: Spark, x: str) -> str:
    return d.split(body(d, x), r"\\\\|\n")


def line_text(d: Spark, x: str) -> str:
    return f"trim({d.sub(d.sub(d.sub(x, '[{}&]', ''), r'^\s*\([0-9.]+\)', ''), r'[,;]\s*\z', '')})"


def cues(d: Spark, x: str, groups) -> str:
    return " + ".join(f"CASE WHEN {has(d, f'lower({x})', *g)} THEN 1 ELSE 0 END" for g in groups)


def cue_hits(d: Spark, x: str) -> str:
    """Array of `template:hits` for the cue tables that x meets; the channel's and the power formula's are read without blanks."""

    def count(text: str, groups) -> str:
        return "(" + " + ".join(f"CASE WHEN {has(d, text, *g)} THEN 1 ELSE 0 END" for g in groups) + ")"

    tables = (
        ("error_probability", "y[1]", [(c,) for c in ERROR_CUES], 3),
        ("power", "y[2]", POWER_GROUPS, len(POWER_GROUPS)),
        ("channel", "y[2]", [(c,) for c in CHANNEL_CUES], 3),
    )
    first = 0 if d.name == "spark" else 1
    counts = d.array(*[count(text.replace("[1]", f"[{first}]").replace("[2]", f"[{first + 1}]"), groups) for _, text, groups, _ in tables])
    # each text is lower-cased and counted once
    low = d.each(d.array(f"lower({x})"), d.array("y", "replace(y, ' ', '')"))
    counted = d.each(low, counts)
    named = d.array(*[f"CASE WHEN y[{first + i}] >= {least} THEN concat('{name}:', CAST(y[{first + i}] AS STRING)) END" for i, (name, _, _, least) in enumerate(tables)])
    return d.compact(d.at(d.each(counted, named), "1"))
