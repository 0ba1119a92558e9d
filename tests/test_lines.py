"""Repairs of lines and cells, on golden rows and against a plain reader of braces."""

import random
import re

from mathloom.operators import lines
from tests.test_engine import evaluate


def test_lines(spark):
    cases = {
        r"(i, \j) \inE": r"(i, j) \in E", r"x_{": r"x_{}", r"x_{{{ ": r"x_{{{ }}", "{{{{": "{{{{", "}a": "a", "}}a": "a", "}}}a": "}}}a", "a}": "a}",
        r"\left(a": r"\left(a\right)", r"\left[\left(a": r"\left[\left(a\right)\right]", r"\left\{a": r"\left\{a\right}", r"\left(\left[\left|\left.a": r"\left(\left[\left|\left.a",
        r"\leftarrow \left(a": r"\leftarrow \left(a\right)", r"\leftarrow a": r"\leftarrow a", r"a \fra": "a", r"a \lef ": "a", r"a \in": "a", r"a \beta": r"a \beta",
        r"{{{a} } } ": "{{{a}}", r"\right}\right} ": r"\right}", "": "", "  a ": "a", r"a \rig \fra": "a",
    }
    assert dict(zip(cases, evaluate(spark, lines.line, *cases))) == cases
    assert evaluate(spark, lines.line, None) == [None]


def test_cells(spark):
    cases = {
        "{cc} a": "a", r"\displaystyle \displaystyle\displaystyle x": r"\displaystyle x", "{l}{{x}}": "{x}", "{l}{{{x}}}": "", r"\overline{{{h}}}": r"\overline{{h}}", r"\overline{{h}}": r"\overline{{h}}",
        r"a + \hat{{{{b}}}}": r"a + \hat{{{b}}}", r"\hat{{{a}b}}": r"\hat{{{a}b}}", r"\hat{{{a}{b}}}": r"\hat{{a}{b}}", r"x_{a": r"x_{a}", "x}}": "x", "x{{{{{{": "x{{{{{{",
        r"\frac{a}{b": r"\frac{a}{b}", "  ": "  ", "": "", r"a \x{{{{{{": "a", r"{{{{{{ \x{b": r"{{{{{{ \x{b}", r"} \x{a}": r"} \x{a}",
    }
    assert dict(zip(cases, evaluate(spark, lines.cell, *cases))) == cases
    assert evaluate(spark, lines.cell, None) == [None]


def lighter(text):
    """Commands from right to left, each with the brace that closes its argument."""
    for command in reversed(list(re.finditer(r"\\[a-zA-Z]+\{", text))):
        depth, end = 1, command.end()
        while end < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[end], 0)
            end += 1
        inside = text[command.end() : end - 1]
        lead, trail = len(inside) - len(inside.lstrip("{")), len(inside) - len(inside.rstrip("}"))
        if depth == 0 and lead == trail >= 2:
            text = text[: command.end()] + inside[1:-1] + text[end - 1 :]
    return text


def test_arguments_against_a_plain_reader(spark):
    rng = random.Random(3)
    parts = ["{", "{", "{{{", "}", "}", "}}}", "\\a", "\\bc", "x", " ", "\\hat{{{"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(16))) for _ in range(5000)]
    texts += ["\\a" + "{" * k + s + "}" * k for k in range(1, 8) for s in ("", "x", "x{y}z", "\\b{{{y}}}", "x}{y")]
    assert sum(lighter(t) != t for t in texts) > 100
    assert evaluate(spark, lines.lighter_arguments, *texts) == [lighter(t) for t in texts]
