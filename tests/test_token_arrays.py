"""Queries that read a token's neighbours from arrays: no token is shuffled, and the results are those of the windows."""

import pytest

from mathloom.functions.dialect import SPARK
from mathloom.plans import structure
from mathloom.plans.registry import QUERIES

TEXTS = ("", "abc d e", "l e f t )x(", "<math><mi>l</mi><mi>e</mi><mi>f</mi><mi>t</mi><mo>(</mo></math>", ")) a", "(", "a1 . 2", "<math></math>", r"\sum s u m", "∑ x y", None)


@pytest.mark.parametrize("name", ["recover_tokens", "win_bracket_depth"])
def test_no_windows(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


@pytest.mark.parametrize("body", [structure._recover_tokens, structure._depth])
def test_odd_texts_as_by_windows(spark, body):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "fragment_id BIGINT, payload STRING")
    texts.createOrReplaceTempView("fragments")

    class Windows(type(SPARK)):
        name = "windows"

    try:
        by_arrays, by_windows = (spark.sql(body(d)) for d in (SPARK, Windows()))
        assert by_arrays.dtypes == by_windows.dtypes
        assert sorted(by_arrays.collect()) == sorted(by_windows.collect())
    finally:
        spark.catalog.dropTempView("fragments")


MIXED = (
    "a b c", "abc d <mi>x</mi> e <mi>yz</mi>f g", "<mi>x</mi>d<mi>>" + "</mi> de", r"\<mi>x</mi> y", r"\alpha b c \\ d", "a\tb  c\n", "l . 2 ] ) 3 . 4", "<math><mi>a b</mi><mi>c</mi> x <mi></mi><mi>d</mi><mn>1</mn><mi>e</mo></math>", "il a dit", "w_{o}r_{d}s a b", " a   b", "  ", "𝐱 y z", "<mi>𝐱</mi><mi>y</mi>",
    "x1 y 2z w", "l]", "a)b", "<math><mi>x</mi><mo>]</mo><mi>l</mi><mo>)</mo></math>", "1 a 2",
)


@pytest.mark.parametrize("body", [structure._neighbours, structure._letter_runs, structure._pairs, structure._repair_tokens, structure._recover_tokens])
def test_mixed_texts_as_by_windows(spark, body):
    texts = spark.createDataFrame([(7 * i, t) for i, t in enumerate(TEXTS + MIXED)], "fragment_id BIGINT, payload STRING")
    texts.createOrReplaceTempView("fragments")

    class Windows(type(SPARK)):
        name = "windows"

    try:
        here, by_windows = (spark.sql(body(d)) for d in (SPARK, Windows()))
        assert here.dtypes == by_windows.dtypes
        assert sorted(here.collect()) == sorted(by_windows.collect()) != []
    finally:
        spark.catalog.dropTempView("fragments")


@pytest.mark.parametrize("name", ["win_neighbor_noise", "win_letter_runs", "repair_tokens"])
def test_tokens_are_not_shuffled(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Aggregate [")[0]
    assert "Window" not in plan and "Generate posexplode" in above and "lambda" not in above


def test_only_runs_of_several_tokens_are_sorted(spark):
    plan = QUERIES["win_pair_subscripts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "> 1)" in plan.split("Window [")[1]
