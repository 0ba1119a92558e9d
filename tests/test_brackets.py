"""Brackets against a plain stack, and MathML rows against a tree."""

import random
import xml.etree.ElementTree as ET

import pytest

from mathloom.operators import brackets
from mathloom.plans import bracketing
from tests.test_engine import evaluate

PARTNER = {")": "(", "]": "[", "}": "{"}


def plain_stack(text):
    stack, gone, escaped = [], [], False
    for at, ch in enumerate(text):
        if escaped:
            escaped = False
        elif ch == "\\":
            escaped = True
        elif ch in "([{":
            stack.append((at, ch))
        elif ch in PARTNER:
            if stack and stack[-1][1] == PARTNER[ch]:
                stack.pop()
            else:
                gone.append(at)
    kept = "".join(c for i, c in enumerate(text) if i not in set(gone))
    return gone, [at for at, _ in stack], kept + "".join({"(": ")", "[": "]", "{": "}"}[c] for _, c in reversed(stack))


@pytest.mark.parametrize("block", [1, 3, 512])
def test_stack_matches_brute_force(spark, block):
    rng = random.Random(block)
    texts = ["".join(rng.choice("()[]{}xé\\ 𝔸\n") for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", None, "\\", "(" * 60, ")" * 60, "([{" * 20 + "}])" * 19]
    rows = spark.createDataFrame(list(enumerate(texts)), "own INT, payload STRING")
    got = {r["own"]: r["brackets"] for r in bracketing.with_brackets(rows, block=block).collect()}
    for i, text in enumerate(texts):
        assert (got[i]["unmatched"], got[i]["unclosed"], got[i]["mended"]) == plain_stack(text or "")


def test_long_text(spark):
    text = "(a[b]" * 20_000 + ")" * 10_000
    row = bracketing.with_brackets(spark.createDataFrame([(text,)], "payload STRING")).first()["brackets"]
    assert row["unmatched"] == [] and len(row["unclosed"]) == 10_000 and row["mended"] == text + ")" * 10_000


def mended_tree(text):
    root = ET.fromstring(text)
    for row in root.iter():
        if row.tag not in ("math", "mrow"):
            continue
        stack, children = [], []
        for child in list(row):
            mark = (child.text or "").strip() if child.tag == "mo" else ""
            if mark in ("(", "[", "{", "|"):
                stack.append(mark)
            elif mark in PARTNER:
                if not stack or stack[-1] != PARTNER[mark]:
                    continue
                stack.pop()
            children.append(child)
        for opener in reversed(stack):
            closer = ET.Element("mo")
            closer.text = {"(": ")", "[": "]", "{": "}", "|": "|"}[opener]
            children.append(closer)
        row[:] = children
    return ET.tostring(root, encoding="unicode", short_empty_elements=False)


def test_rows_match_a_tree(spark):
    rng = random.Random(4)

    def element(depth):
        if depth == 0 or rng.random() < 0.6:
            return rng.choice(["<mi>x</mi>", "<mn>1</mn>", "<mo>+</mo>", *(f"<mo>{c}</mo>" for c in "()[]{}|")])
        tag = rng.choice(["mrow", "mrow", "msup", "mfrac"])
        return f"<{tag}>{''.join(element(depth - 1) for _ in range(rng.randint(0, 4)))}</{tag}>"

    texts = [f"<math>{''.join(element(3) for _ in range(rng.randint(0, 6)))}</math>" for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "done INT, payload STRING")
    got = {r["done"]: r["mended"] for r in bracketing.mend_rows(rows).collect()}
    assert got == {i: mended_tree(t) for i, t in enumerate(texts)}


def test_rows_with_limits(spark):
    raw = "<mrow><mo>∑</mo><mo>_</mo><mi>i</mi><mo>=</mo><mn>1</mn><mo>^</mo><mi>n</mi><mo>(</mo><mi>a</mi><mi>i</mi></mrow>"
    texts = [raw, None, "", "no tags (", "<mrow><mo> ) </mo></mrow>"]
    got = {r["i"]: r["mended"] for r in bracketing.mend_rows(spark.createDataFrame(list(enumerate(texts)), "i INT, payload STRING")).collect()}
    assert got == {0: raw.replace("</mrow>", "<mo>)</mo></mrow>"), 1: None, 2: "", 3: "no tags (", 4: "<mrow></mrow>"}


def test_syntax_errors(spark):
    texts = (r"a_{b", "x^ {y_{1} z", r"a \ ", "\\", "", "a_{b}^{c", "{", r"\frac{a}{b}")
    assert evaluate(spark, lambda d, x: d.join(brackets.syntax_errors(d, x), " | "), *texts) == [
        "Unbalanced braces: 1 open, 0 close | Unclosed subscript at position 1", "Unbalanced braces: 2 open, 1 close", "", "Invalid LaTeX command pattern detected", "Empty LaTeX string",
        "Unbalanced braces: 2 open, 1 close | Unclosed superscript at position 5", "Unbalanced braces: 1 open, 0 close", "",
    ]


def test_long_texts_without_brackets(spark):
    rows = spark.createDataFrame([("words " * 50_000,), (r"\( " * 50_000,)], "payload STRING")
    assert [r["brackets"]["unclosed"] for r in bracketing.with_brackets(rows).collect()] == [[], []]
