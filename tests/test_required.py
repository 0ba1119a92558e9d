"""Rules run only on texts that hold what their patterns ask for, with the results of all rules on all texts."""

import re

import pytest
from pyspark.sql import functions as F

from mathloom.functions.dialect import SPARK, chain, fired
from mathloom.functions.required import beyond_ascii, required
from mathloom.operators import gates, reconstruct, repair

TEXTS = (r"\S_{u} m x", "E _ { q }\tU_i\nv", r"\\m_{a}\t_{h}b_{b}Z i_{n} x", r"\l_{e}f_{t}( a \r_{i}g_{h}t)", "the sum of MAX", "", "İ _\u212a", "\\sum {i} \\  f r a c", "s_{u}m s_{u}m 1", None)
RULES = {
    "letter commands": repair.LETTER_COMMANDS, "spelled commands": repair.SPELLED_COMMANDS, "table": (*repair.SCRIPT_SPACING, *repair.SHRED_TABLE * 3),
    "apart": repair.SPACED_COMMANDS, "noise": repair.NOISE, "marks": repair.OCR_PATTERNS, "safe": repair.SAFE, "clean": repair.CLASSIC_CLEAN,
}
GATES = {"before": gates.SPELLING_PRE, "corruption": gates.LATEX_CORRUPTION, "hacks": gates.SPELLING_HACK}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i INT, x STRING")


def plain(x, rules):
    for pattern, by in rules:
        x = SPARK.sub(x, pattern, by)
    return x


def column(texts, sql):
    return [r.y for r in texts.select("i", F.expr(sql).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize("name", RULES)
def test_chain_as_each_rule_on_each_text(texts, name):
    assert column(texts, chain(SPARK, "x", RULES[name])) == column(texts, plain("x", RULES[name]))


@pytest.mark.parametrize("name", GATES)
def test_labels_as_each_rule_on_each_text(texts, name):
    each = SPARK.compact(SPARK.array(*[f"CASE WHEN x RLIKE {SPARK.lit(p)} THEN {SPARK.lit(label)} END" for p, label in GATES[name]]))
    assert column(texts, fired(SPARK, "x", GATES[name])) == column(texts, each)


def test_strings_that_a_match_holds():
    assert required(r"(?i)\\?a_\{r\}\\?r_\{a\}y") == (("_{",), ("a_rr_ay",))
    assert required(r"\\(mathrm|text)\s*~") == (("mathrm", "text"), ())
    assert required("ab?c+d*|x") == (("a", "x"), ())
    assert required("[ab]|c") == ((), ())
    assert required(r"(a|b*)c") == (("c",), ())


def test_unread_patterns_are_always_tried():
    for pattern in (r"\p{Mn}", r"\Qa.b\E", r"[\x{A0}]z", "(?iu)k", "(?x) a b", r"\0101"):
        assert required(pattern) == ((), ())


def test_rules_are_guarded():
    """Every rule of the table of split commands is looked up before it is run."""
    assert all(any(required(p)) for p, _ in (*repair.SHRED_TABLE, *repair.SPELLED_COMMANDS, *repair.LETTER_COMMANDS, *repair.OCR_PATTERNS))
    assert not re.search(r"regexp_replace\(regexp_replace", chain(SPARK, "x", repair.SHRED_TABLE))


def test_reconstruction_is_guarded(texts):
    from mathloom.operators import reconstruct

    rules = [(reconstruct.edged(SPARK, p), by) for p, by in reconstruct.CLEAN]
    sql = reconstruct.rewritten(SPARK, "x", *reconstruct.CLEAN)
    assert "regexp_replace(regexp_replace" not in sql
    assert column(texts, sql) == column(texts, plain("x", rules))


def test_turns_of_a_table_as_the_table_repeated(texts):
    """A table in three turns stands in the plan once, and a turn begins only on texts that one of its rules may change."""
    again = ((r"ab", "ca"), (r"cac", "abb"), (r"bb+", r"ab"))
    more = texts.sparkSession.createDataFrame([(i, x) for i, x in enumerate(("cabb", "abab", "cacabb", "no", "", None))], "i INT, x STRING")
    for table, rules in ((texts, repair.SHRED_TABLE), (more, again)):
        assert column(table, chain(SPARK, "x", rules, 3)) == column(table, plain("x", rules * 3))
    assert repair.shred_table(SPARK, "x").count("forall") == chain(SPARK, "x", repair.SHRED_TABLE).count("forall")  # not thrice


def test_blanks_that_stay_are_no_match(texts):
    odd = texts.sparkSession.createDataFrame([(i, x) for i, x in enumerate((" a  b\tc\n", "\x0b\x0c\r", " ", "a b", "", None))], "i INT, x STRING")
    assert column(odd, SPARK.sub("x", r"\s+", " ")) == column(odd, "regexp_replace(x, '\\\\s+', ' ')")
    assert column(odd, SPARK.sub("x", " +", " ")) == column(odd, "regexp_replace(x, ' +', ' ')")


def test_letters_apart_are_found_by_their_neighbours(texts):
    from mathloom.plans.recovery import TWO_APART, joined_letters

    odd = texts.sparkSession.createDataFrame([(i, x) for i, x in enumerate(("a b c", "a b", "is a dog", "a\tb  c_", "x a b c_{d}", "w = m o d", "a b c d.", "1 a b c", "a1 b c d", "", None))], "i INT, x STRING")
    first = f"{SPARK.match('x', TWO_APART)} AND "
    assert first in joined_letters(SPARK, "x")
    assert column(odd, joined_letters(SPARK, "x")) == column(odd, joined_letters(SPARK, "x").replace(first, ""))


def test_safe_repair_as_all_its_rules(texts):
    """The shorter way for plain texts gives what the rules give, and a large class of characters is not tried at ASCII."""
    from mathloom.functions.normal import BEYOND_ASCII, strip_marks

    class Rules(type(SPARK)):
        name = "rules"

    odd = ("  a  b ", "$x_1$", "$", "a__b _ c", "é ½ ﬁ 각 İ ∑", "a}}", "{{a", "{a}}} }", "x_) y^]", "\t$ a $\n", " ", "", "•a●", " ", "ab•", "• a", None)
    table = texts.sparkSession.createDataFrame([(i, x) for i, x in enumerate(odd)], "i INT, x STRING")
    for operator in (repair.safe, strip_marks):
        assert column(table, operator(SPARK, "x")) == column(table, operator(Rules(), "x"))
    assert strip_marks(SPARK, "x").count(SPARK.lit(BEYOND_ASCII)[1:-1]) >= 4


def test_split_commands_as_all_rules(texts):
    """The table of split commands with its rules left out where they can't match, against all rules in their order."""

    class Rules(type(SPARK)):
        name = "rules"

        def chain(self, x, rules, turns=1):
            return plain(x, list(rules) * turns)

    odd = ("L e F t (", r"\e_{N} D array", r"\\e_{n} d array x_{i} y_{j}", "a_{b} c_{d} e_{f} g_{h} i", r"\s u m l\te f t", "s_{u}m_{a} p_{r} i_{n}", r"\quad \quad \quad x_{i}", r"\left\left x", "le f t", "m_{a} t_{h} b_{b}Z", "n_{E}q", "a_{b}", "")
    table = texts.sparkSession.createDataFrame([(i, x) for i, x in enumerate((*TEXTS, *odd))], "i INT, x STRING")
    assert column(table, repair.shred_table(SPARK, "x")) == column(table, repair.shred_table(Rules(), "x"))
    assert SPARK.lit(repair.SCRIPT_AND_BLANK) in repair.shred_table(SPARK, "x")


def test_small_classes_of_signs_are_strings():
    assert required(r"\be\s*[-−]\s*1\b") == (("-", "−"), ())
    assert required(r"\b1\s*/\s*n\b")[0] == ("/",)
    assert required(r"(?i)x[\\{]y") == (("\\", "{"), ("xy",))
    assert required(r"a[^-]b")[0] == ("a",)


def test_classes_beyond_ascii():
    assert beyond_ascii(reconstruct.INVALID) == ("'", "`") and beyond_ascii("a([é-ü]+)b") == () and required(reconstruct.INVALID) == ((), ())
    for pattern in ("[aéü]", "[^éü]", "[éü]*", "[éü]|[ab]", r"\s", r"[\sé]"):
        assert beyond_ascii(pattern) is None
    assert "octet_length" in chain(SPARK, "x", reconstruct.CLEAN)


@pytest.mark.parametrize("name", ("CLEAN", "SCRIPTS", "FRACTIONS", "STRUCTURE", "ARGUMENTS", "FENCES", "LIMITS", "OPERATORS", "COMMANDS"))
def test_reconstruction_as_each_rule_on_each_text(spark, name):
    more = (*TEXTS, "e − 1 n-1 αβ 1/n a/b", "Xi [t] x,y + [abcdef] |a| r( (", r"\left[r(y_0 s + e^{-1}) \right] _{ _{t} } ^{ t = 3 }", "é¥ 1 2 [ a ] −−", "it's", "—")
    texts = spark.createDataFrame(list(enumerate(more)), "i INT, x STRING")
    rules = [(reconstruct.edged(SPARK, p), by) for p, by in getattr(reconstruct, name)]
    assert column(texts, chain(SPARK, "x", rules)) == column(texts, plain("x", rules))
