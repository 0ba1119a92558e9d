"""Answers of a model, envelopes and files."""

import datetime
import json

from mathloom.plans import envelopes, responses


def test_answers(spark):
    good = '{"latex": "x^2", "confidence": 0.9}'
    cases = [
        (good, "y", "accepted"), (good, " x^2 ", "unchanged"), ('{"latex": "x", "confidence": 0.5}', "y", "low confidence"), ('{"latex": "x"}', "y", "low confidence"), ('{"k": 1}', None, "no latex"),
        (f"```json\n{good}\n```", "y", "no object"), ("Here it is: " + good + " done", "y", "accepted"), ('{"latex": "x", ', "y", "no object"), ('{"latex": x}', "y", "not json"), ("{latex}", "y", "not json"),
        ("s_1 = 3", "y", "no object"), (f"import os\ns_1 = 3\n{good}", "y", "accepted"), ('{"latex": "s_1 = 3", "confidence": 0.9}', "y", "code"), (f"```python\nx={{1}}\n```\n{good}", "y", "accepted"),
        ("", "y", "no object"), (None, "y", "no object"), (good + " {", None, "accepted"), ('{"latex": "x", "confidence": "high"}', "y", "low confidence"),
    ]
    rows = spark.createDataFrame([(i, c, a) for i, (c, a, _) in enumerate(cases)], "body INT, content STRING, asked STRING")
    got = {r["body"]: r["answer"]["verdict"] for r in responses.verdicts(rows).collect()}
    assert got == {i: v for i, (_, _, v) in enumerate(cases)}


def test_files_and_rejects(spark, tmp_path):
    rows = [(1, "<math>\n<mi>x</mi>\r\n</math>"), (2, ""), (3, None), (4, "<math>\té</math>"), (None, " ")]
    df, path = spark.createDataFrame(rows, "id INT, mathml STRING"), str(tmp_path)
    now = datetime.datetime(2024, 1, 2, 3, 4, 5)
    for _ in range(2):
        assert envelopes.write_mathml(df, path, now=now) == "20240102_030405"
    got = {(r["id"], r["mathml"], r["reason"]) for r in envelopes.read_mathml(spark, path, "20240102_030405").collect()}
    assert got == {("1", rows[0][1], None), ("4", rows[3][1], None), *((k, None, envelopes.EMPTY) for k in ("2", "3", ""))}
    envelopes.write_mathml(df.limit(0), path, now=datetime.datetime(2025, 1, 1))
    assert envelopes.read_mathml(spark, path, "20250101_000000").count() == 0


def test_envelopes(spark):
    rows = [(1, 2, 5, 9, 1, 1, None, "<math/>"), (1, 1, 7, 3, 1, 1, '\\frac{"a"}', None)]
    df = spark.createDataFrame(rows, "page_id INT, box_id INT, x INT, y INT, w INT, h INT, latex STRING, mathml STRING")
    got = json.loads(envelopes.envelopes(df).first()["envelope"])
    box = {"w": 1, "h": 1}
    assert got == {"status": "success", "count": 2, "formulas": [{"latex": '\\frac{"a"}', "mathml": "", "bbox": {"x": 7, "y": 3, **box}}, {"latex": "", "mathml": "<math/>", "bbox": {"x": 5, "y": 9, **box}}]}
