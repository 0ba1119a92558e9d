"""Recovery of broken MathML: whole rows, written from the rules."""

from mathloom.plans import recovery
from tests.test_engine import evaluate

MTEXT = "<math><mtext>{}</mtext></math>"


def rows(spark, texts, make=None):
    df = spark.createDataFrame(list(enumerate(texts)), "raw INT, payload STRING")
    return {texts[r["raw"]]: r["recovered"] for r in recovery.recover(df, make=make).collect()}


def test_rows(spark):
    cases = {
        # what is found inside: LaTeX in a text (.1), between delimiters (.05), commands (.15) or not (.05), wrapped (.05)
        MTEXT.format(r"$\frac{a}{b}$"): (r"\frac{a}{b}", 0.35), MTEXT.format(r"see \(x + y\) here"): ("x + y", 0.15), MTEXT.format("x + y,"): ("x + y", 0.1), "a ≤ b != c ...": (r"a \le b \neq c \ldots", 0.2),
        MTEXT.format(r"\s_{u}m x"): (r"\sum x", 0.3), "l e f t x": (r"\left x", 0.2), "w = m o d": ("w = mod", 0.1), "a b, n o t c": ("a b, notc", 0.1), r"\l e f t( a": (r"\left( a)", 0.2), "m_{a}t_{h}": (r"\math", 0.2), "p_{a}q_{h}": (r"\mathrm{pqah}", 0.2),
        "f(x": ("f(x)", 0.1), "x)": ("(x)", 0.1), "{{a}": ("{{a}}", 0.1), "a}": ("{a}", 0.1), r"\quad \quad \quad x": (r"\quad x", 0.2), "": ("", 0.0), None: ("", 0.0), r"\mathrm{a b}": (r"\mathrm{a b}", 0.2),
    }
    got = rows(spark, list(cases))
    assert {t: (r["latex"], r["confidence"]) for t, r in got.items()} == cases
    assert got["f(x"]["mathml"].endswith("<mtext>f(x)</mtext></mrow></math>") and got[None]["mathml"] == "" and not got["f(x"]["converted"]


def test_conversion_by_a_hook(spark):
    def make():
        return lambda text: f"<math>{text}</math>" if "x" in text else 1 / 0

    got = rows(spark, ["$x$", "$y$", "", r"\mathrm{a b} \ sum"], make)
    assert got[r"\mathrm{a b} \ sum"]["latex"] == r"\mathrm{ab} \sum"
    assert (got["$x$"]["mathml"], got["$x$"]["confidence"], got["$x$"]["converted"]) == ("<math>x</math>", 1.0, True)
    assert (got["$y$"]["confidence"], got["$y$"]["converted"]) == (0.15, False) and got[""]["mathml"] == ""


def test_reasons(spark):
    texts = (MTEXT.format(r"\frac"), "<mi>a</mi><mi> b</mi><mi>\\c</mi> <mi>d</mi>", "a_{b}c_{d}", r"<mi>\x</mi>", r"\\left(", "s u m", "x = y", "")
    got = evaluate(spark, lambda d, x: d.join(recovery.reasons(d, x), " | "), *texts)
    assert got == [
        r"mtext contains LaTeX commands | backslash tokens in MathML tags | shredded pattern: f\s*r\s*a\s*c", r"shredded letter sequences in <mi> tags | backslash tokens in MathML tags", "letter-by-letter subscript patterns", "backslash tokens in MathML tags",
        r"double-escaped LaTeX commands | shredded pattern: l\s*e\s*f\s*t", r"shredded pattern: s\s*u\s*m", "", "",
    ]


def test_many_quads(spark):
    text = " ".join(rf"{c} \quad" for c in "abcdefghijkl")
    assert evaluate(spark, recovery.few_quads, text, r"a\quad b") == [r"a \quad\quadb c d e f g h i j k l", r"a\quad b"]


def test_estimates_and_their_profile(spark):
    from mathloom.functions.dialect import SPARK
    from mathloom.plans import recovery

    rows = [("x", "x", "<mi>", 0.2), ("x", r"\frac{a}{b}", "<mi>", 0.5), ("x", "x", "<msub>", 0.6), ("L e ft", r"\Pr", "<mfrac>", 0.765), (r"\Sum", "x", "", 0.17), ("", "", "", 0.2), ("x", r"\left(", "<munder>", 0.9)]
    df = spark.createDataFrame(rows, "raw STRING, latex STRING, mathml STRING, want DOUBLE")
    assert [(r.got, r.want) for r in df.selectExpr("want", f"{recovery.estimate(SPARK, 'raw', 'latex', 'mathml')} AS got").collect() if r.got != r.want] == []
    counts = {(r.kind, r.measure): r.n for r in recovery.agg_confidence_profile(spark, "/root/testdata/sf0.001").groupBy("kind", "measure").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    kinds = {k for k, _ in counts}
    assert all(counts[k, "trust"] == counts[k, "estimate"] for k in kinds) and "plain" in kinds
