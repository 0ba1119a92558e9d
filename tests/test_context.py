"""Rewrites that depend on what stands around, and decomposition against Python's own."""

import sys
import unicodedata

from mathloom.functions import normal
from mathloom.operators import repair
from tests.test_engine import evaluate


def reference(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn")


def test_decomposition_of_every_code_point(spark):
    chars = [chr(cp) for cp in range(sys.maxunicode + 1) if not 0xD800 <= cp <= 0xDFFF]
    texts = ["|".join(chars[i : i + 2000]) for i in range(0, len(chars), 2000)] + ["", "plain", None, "ﬁn é 각 ½ — x́", "각가힣"]
    got = evaluate(spark, normal.strip_marks, *texts)
    for text, plain in zip(texts, got):
        assert plain == (None if text is None else "|".join(map(reference, text.split("|")))), text and text[:20]


def test_decomposition_in_repairs(spark):
    assert evaluate(spark, repair.CHAINS["repair_classic_clean"], "Ｐ é ﬁ") == ["P e fi"]
    assert evaluate(spark, repair.CHAINS["repair_safe"], "$ é x̂_ i $") == ["e x_{i}"]


def test_outer_braces(spark):
    cases = {"{a}": "a", "{ {{{{b}}}} }": "{{{{b}}}}", "{a}{b}": "a}{b", "{a}}{": "{a}}{", "{a": "{a", "a}": "a}", "{}": "", "": "", "{{a}": "{{a}", "{a} {b}}": "{a} {b}}", "}{": "}{", "{a\nb}": "a\nb"}
    assert dict(zip(cases, evaluate(spark, repair.CHAINS["repair_outer_braces"], *cases))) == cases


def test_double_struck_outside_of_scripts(spark):
    r, z, dr, dz = "<mi>R</mi>", "<mi>Z</mi>", '<mi mathvariant="double-struck">R</mi>', '<mi mathvariant="double-struck">Z</mi>'
    filler = "<mo>" + "x" * 50 + "</mo>"
    cases = {
        f"ℝ{r}": f"ℝ{dr}", f"{r}": f"{r}", f"ℝ<msub>{r}<mi>i</mi></msub>{r}": f"ℝ<msub>{r}<mi>i</mi></msub>{dr}", f"mathbb{{Z}}{z}{filler}<msup>{z}</msup>{r}": f"mathbb{{Z}}{dz}{filler}<msup>{z}</msup>{r}",
        f"ℝℤ{r}{z}{filler}{r}": f"ℝℤ{dr}{z}{filler}{dr}", f"ℝ{dr}{r}": f"ℝ{dr}{r}", "": "", f"ℝ<msubsup>{r}</msubsup>{r}": f"ℝ<msubsup>{r}</msubsup>{r}",
    }
    assert dict(zip(cases, evaluate(spark, repair.CHAINS["repair_double_struck"], *cases))) == cases
