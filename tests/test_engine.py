"""The engine's queries against DuckDB on the smallest tables, and the rules on single expressions."""

import decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from mathloom.functions.dialect import SPARK
from mathloom.operators import classify, gates, layout, repair
from mathloom.plans.registry import ORACLES, QUERIES
from mathloom.sources import sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = int(v) if v == int(v) else float(v)
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def evaluate(spark, template, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, x STRING")
    return [r["y"] for r in df.select("i", F.expr(template(SPARK, "x")).alias("y")).orderBy("i").collect()]


def test_sniffing(spark):
    texts = (r"\frac{1}{n}", "x_i + y^2", "$x+y$", "This is OCR text 123", "   ", "<math><mi>x</mi></math>")
    assert evaluate(spark, classify.structure_first, *texts) == ["latex", "latex", "latex", "plain", "empty", "mathml"]
    assert evaluate(spark, classify.delimiter_first, *texts) == ["latex", "plain", "latex", "plain", "empty", "mathml"]


def test_repairs(spark):
    assert evaluate(spark, repair.CHAINS["repair_letter_commands"], r"\f_{r}a_{c}{1}{n} \s_{u}m", r"\l_{o}n_{g}r_{i}g_{h}t_{a}r_{r}o_{w}") == [r"\frac{1}{n} \sum", r"\longrightarrow"]
    assert evaluate(spark, repair.CHAINS["repair_stackrel"], r"a \stackrel{x}{\longrightarrow} b") == [r"a \xrightarrow{x} b"]
    assert evaluate(spark, repair.CHAINS["repair_merged_commands"], r"(i, \j) \inE, x \leqt") == [r"(i, j) \in E, x \leq t"]
    assert evaluate(spark, repair.CHAINS["repair_auto_balance"], r"\frac{a}{b", "a}}", "{{{{") == [r"\frac{a}{b}", "{{a}}", "{{{{"]
    spaced = evaluate(spark, repair.CHAINS["repair_strip_spacing"], r"a \, b \quad c \mathrm{~} d \!")
    assert evaluate(spark, repair.CHAINS["repair_strip_spacing"], *spaced) == spaced


def test_shredded_table(spark):
    cases = {
        r"\s_{u}m \l_{e}f_{t} \r_{i}g_{h}t \f_{r}a_{c} \m_{a}t_{h}b_{b}": r"\sum \left\right \frac\mathbb",
        r"\m_{a} t_{h} b_{f}{x}": r"\mathbf{x}", r"\m_{a}\t_{h}\b_{b}{R}": r"\mathbb{R}", r"\m_{a}t_{h}r_{m}{e_{r}r_{o}r}": r"\mathrm{error}", r"\m_{a}t_{h}r_{m}{P_{r}}": r"\mathrm{Pr}",
        r"\e_{n} d array": r"\end{array}", r"\e_{n}darray": r"\end\{array\}", r"e_{n}d a_{r}r_{a}y": r"\end\{array\}", r"e_{n}d x": r"\end x",
        r"\f_{o}\r_{a}\l_{l} = x": r"\forall = x", r"\f_{o}\r_{a}\l_{l} x": r"\forallx", r"q_{q}u_{a}d q_{u}a_{d} = z": r"\quad = z", r"l_{d}o_{t}s": r"\ldots", r"n_{e}q b_{i}g_{c}u_{p}": r"\neq \bigcup",
        r"\left\left( a \right\right)": r"\left( a \right)", "x l e f t (": r"x \left (", r"a\l e f t(": r"a\left(", r"\ s u m is": r"\sum is", r"\f r a c{a}": r"\frac{a}",
        " ".join(rf"{c} \quad" for c in "abcdefg"): r"a \quad\quad b   c   d   e   f   g ", "plain text": "plain text",
    }
    assert dict(zip(cases, evaluate(spark, repair.CHAINS["repair_shred_table"], *cases))) == cases


def test_subscript_runs_of_any_length(spark):
    cases = {"m_{a}t_{h}": r"\mathrm{mtah}", "a_{b}c_{d}e_{f}g_{h}i_{j}k_{1} + x_{y} + p_{q}r_{s}": r"\mathrm{acegikbdfhj1} + x_{y} + \mathrm{prqs}", "x_{i}": "x_{i}", "": ""}
    assert dict(zip(cases, evaluate(spark, repair.CHAINS["repair_collapse_subscripts"], *cases))) == cases


def test_pre_balance(spark):
    cases = {
        r"a + b \q": "a + b ", r"\left( x": r"\left( x\right)", r"\left[ x \left\{ y": r"\left[ x \left\{ y\right}", r"x \right) y \right] z": "x  y  z",
        r"\left( x \right) \right]": r"\left( x \right) ", r"\right) \alpha": r"\right) \alpha", "{{{a": "{{{a}}}", "{{a": "{{a", "a}}}}": "a", "a}}": "a}}", "a}}}}}}}": "a}}", "[[[a": "[[[a]]]", "a]]]": "a",
    }
    assert dict(zip(cases, evaluate(spark, repair.CHAINS["repair_pre_balance"], *cases))) == cases


def test_spelled_commands_and_patterns(spark):
    assert evaluate(spark, repair.CHAINS["repair_spelled_to_command"], "e_q u_i v s_u m", "s_{u}m x", "s_{u}ms_{u}m", "s_u m {x}", "l_d o_t s") == [r"\equiv \sum", r"\sumx", r"\sum\sum", "s_u m {x}", r"\ldots"]
    assert evaluate(spark, repair.CHAINS["repair_ocr_patterns"], "l é ]", "x € y", "π ≤ é") == ["[l]", "x  y", "pi le e"]


def test_gates(spark):
    assert evaluate(spark, gates.truncated, r"\mathbb{R}_", r"a + b \q", r"\sum_{i=1} {{", "x = y") == [True, True, True, False]
    assert evaluate(spark, lambda d, x: d.size(gates.latex_corruption(d, x)), "e_q u_i v s_u m", r"Y_j[t] \equiv 3") == [2, 0]
    assert evaluate(spark, gates.corrupt_strict, "<math><mi>l</mi><mi>e</mi><mi>f</mi><mi>t</mi></math>", "<math><mi>x</mi></math>", "long") == [True, False, False]
    assert evaluate(spark, lambda d, x: d.size(gates.validate_strict(d, x)), '<math xmlns="http://www.w3.org/1998/Math/MathML"><mrow><mo>&#x2261;</mo></mrow></math>', '<math xmlns="m"><mtable /></math>') == [0, 1]
    assert evaluate(spark, gates.clean_first, r"\frac{1}{n}", r"s_{u}m", " ") == [True, False, False]


# the word tests use no look-around; they must agree with the form that does
@pytest.mark.parametrize("word", ["sum", "min"])
def test_word_rule_without_look_around(spark, word):
    import itertools
    import re

    rewritten = f"(?i){gates.ALONE}{word}{gates.NO_BRACE}"
    original = re.compile(rf"(?<!\\)\b{word}\b(?!\s*\{{)", re.I)
    texts = ["".join(p) for p in itertools.product(["", "\\", "a", " ", "_"], [word, word.upper()], ["", " ", "{", "  {", "x", "_", "\n", "}"])]
    got = evaluate(spark, lambda d, x: d.match(x, rewritten), *texts)
    assert got == [bool(original.search(t)) for t in texts]


def test_labels_and_routes(spark):
    assert evaluate(spark, layout.label, "(2.1) x = y", "x = y", r"a \tag{7}") == ["2.1", None, "7"]
    assert evaluate(spark, layout.route, r"\begin{bmatrix} a \end{bmatrix}", r"\begin{array}{c} a", "x", "") == ["matrix", "open_array", "single", "empty"]


def test_xml_round_trip(spark, tmp_path):
    rows = [(1, r"\frac{a}{b} < c", None, 1, 2, 3, 4), (2, None, "<math/>", 5, 6, 7, 8)]
    sinks.write_equations_xml(spark.createDataFrame(rows, "id INT, latex STRING, mathml STRING, x INT, y INT, w INT, h INT"), str(tmp_path / "x"))
    got = {r["_id"]: r for r in sinks.read_equations_xml(spark, str(tmp_path / "x")).collect()}
    assert got[1]["latex"] == r"\frac{a}{b} < c" and got[2]["mathml"] == "<math/>" and got[2]["bounding_box"]["_h"] == 8


def test_catalogue(spark):
    from mathloom.functions import catalogue

    df = spark.createDataFrame([(1, r"\s_{u}m"), (2, "x")], "i INT, payload STRING")
    got = df.select("i", catalogue.column("repair_letter_commands", "payload").alias("r"), catalogue.rewrite("payload", [("x", "y")]).alias("w"), catalogue.labels("payload", [("x", "has x")]).alias("l")).orderBy("i").collect()
    assert got[0]["r"] == r"\sum" and got[1]["w"] == "y" and got[1]["l"] == ["has x"]
    assert set(catalogue.OPERATORS) >= set(repair.CHAINS)

    def make():
        return lambda text: "<math/>" if text == "x" else 1 / 0

    done = {r["i"]: (r["mathml"], r["error_code"]) for r in catalogue.convert_batch(df, make).collect()}
    assert done == {1: ("", "conversion-failed"), 2: ("<math/>", None)}


def test_entity_page(spark):
    from mathloom.sources.entity_page import parse_entities

    def row(*cells):
        return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"

    page = "<table>" + row("head") + row('<font size="7">α</font>', '<font size="7">??</font>', "x") + row("alpha", "beta") + row("x3B1", "x3B2", "x0") + row("#945;", "#946;") + row("tail") + "</table>"
    got = parse_entities(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id INT, html STRING")).orderBy("seq").collect()
    assert [(r["seq"], r["name"], r["ch"]) for r in got] == [(0, "alpha", "α"), (1, "beta", "β")]


def test_cue_tables(spark):
    texts = ("P_error = Pr[ a != b ]", "r_v y_0 t-1", r"\frac{1}{n} \sum_{t=0}^{n-1} [rv(y0, t-1)]^2", "Y_{j}l_{e}] = X_{i}[e]", "x")
    got = evaluate(spark, lambda d, x: d.join(layout.cue_hits(d, x), " "), *texts)
    assert got == ["error_probability:4", "", "power:6", "channel:4", ""]
