"""Heuristic reconstruction and post-processing, on golden rows followed by hand, in both dialects."""

import duckdb

from mathloom.functions.dialect import DUCK
from mathloom.operators import reconstruct, repair
from tests.test_engine import evaluate

HEURISTIC = {
    "  ": r"\text{No text detected}", "": r"\text{No text detected}", "hello": "hello", "a+b": "$a + b$", "1 2 3 = x": "$123 = x$", "3/4": r"\frac{3}{4}", "x^2 + y": "$x^{2} + y$",
    r"\l_{e}f_{t}": r"\left", r"\l_e f_t": r"\left", r"\s_u m": r"\sum", "s_u m": r"\sum", "c1n": r"\frac{1}{n}",
    "1/n S": r"\frac{1}{n} \sum_{t=0}^{n-1}", "11S": r"\frac{1}{n} \sum_{t=0}^{n-1}", "1/n S [abcdef]<= P": r"\frac{1}{n} \sum_{t=0}^{n-1}\left[abcdef\right]^2\le P",
    "Yj]=Xi]": "$Y_{j}] = X_{i}]$", "Y_l]=Z;(d]": "$Y_{l}[t] = Z_j[d]$", "|x|": r"\left|x\right|", "i e Z(j)": r"$i \in Z(j)$", "e-1": "$e^{-1}$", "{a": "${a$}", "a}": "{$a}$",
    "yos+1": "$y_{o}s + 1$", "r(y_0 s) sum 1/n": reconstruct.MEAN_POWER, "é + ñ": "$e + n$", "t=3": "$_{t=3}$", "a  ==  b = =": "$a = b$", "^{a_{b}+c} - d": "$^{a_{b}+c} - d$",
    "a ? < P": r"$a \le P$".replace("$", ""), "_{_{x}}": "$_{x}$", "a ++ b -- c": "$a + b - c$",
}
POST = {
    " ": r"\text{No text detected}", "abc": r"\text{abc}", "5% off": r"\text{5\% off}", "a_b": "$a_{b}$", "x1 + 2/3": r"$x_{1} + \f_{r}a_{c}{2}{3}$", "1/2/2024": "$1/2/2024$",
    r"\frac{1}{2}": r"\frac{1}{2}", "sum + 1": "$s_{u}m + 1$", "$x$+1": "$x$+1", "2^10": "$2^{10}$", r"\alpha + \beta{x} x1": r"\alpha + \beta{x} x1",
}
SAFE = {
    "": "", "  ": "", "$": "", "$$": "", " $ a+b $ ": "a+b", "$a": "$a", "x__y": "x_{y}", "x_ y": "x_{y}", "a_b_c": "a_{b}_c", "f(a_)": "f(a)", "f(a^, b_])": "f(a, b])", "^^)": "^)",
    "é•·●○■□◦€£¥©®¿¡«» x": "e x", "{a": "{a}", "{{a}": "{{a}}", "a}}": "a", "a}b}": "a}b", "}a": "}a", "a\t\n b": "a b", "{a}}}": "{a}", "a \ufffd": "a",
}


def test_golden_rows(spark):
    for template, cases in ((reconstruct.heuristic, HEURISTIC), (reconstruct.post_process, POST), (repair.safe, SAFE)):
        assert dict(zip(cases, evaluate(spark, template, *cases))) == cases
        assert evaluate(spark, template, None) == [None]


def test_both_dialects(spark):
    texts = [*HEURISTIC, *POST, *SAFE, "Σ 1 / ((n - 1)) 2 - S - [r(y_o s + e^{-1})", "é_a ∑ x/y", "a" * 3000 + "[" * 300, "^{" + "_{a" * 200, "^{" + "_{a}" * 200 + " - "]
    con = duckdb.connect()
    for template in (reconstruct.heuristic, reconstruct.post_process, repair.safe):
        there = con.execute(f"SELECT {template(DUCK, 'x')} FROM (SELECT unnest(range(len($1))) AS i, unnest($1) AS x) t ORDER BY i", [texts]).fetchall()
        assert evaluate(spark, template, *texts) == [y for (y,) in there]
