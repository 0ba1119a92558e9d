"""Answers of a model: cleaned of code, parsed as JSON or refused, and accepted only where they change what was asked about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import DUCK, SPARK, Spark, chain
from ..sources.relations import run_sql, with_relations

# Fences; lines that are code (unless they begin with a brace); code inside of an object.
FENCES = ((r"(?is)```python.*?```", ""), (r"(?s)```.*?```", ""))
CODE_LINES = (r"^\s*[a-z_][a-z0-9_]*\s*=", r"^\s*(import |def |class |from |if |for |while |try |except |return )")
LATE_LINES = r"(?m)^\s*[a-z_][a-z0-9_]*\s*=\s*[^\"{\n].*$"
CODE_INSIDE = r"(^|[^A-Za-z0-9_])[sdw]_[0-9]+\s*="
#: Fixed value: confidences must be above this.
LEAST_CONFIDENCE = 0.5


def body(d: Spark, x: str) -> str:
    """The object of an answer: fences and lines of code go, then what stands from the first brace to the last one; empty if nothing does."""
    lines = d.split(chain(d, x, FENCES), "\n")
    code = " OR ".join([*(d.match("y", p) for p in CODE_LINES), f"({d.match('y', CODE_INSIDE)} AND NOT {d.match('y', r'^\s*[{]')})"])
    kept = f"array_join({d.keep(lines, f'NOT ({code})')}, chr(10))" if d.name == "spark" else f"array_to_string({d.keep(lines, f'NOT ({code})')}, chr(10))"
    return d.extract(d.sub(kept, LATE_LINES, ""), r"(?s)\{.*\}", 0)


def verdicts(answers: DataFrame, content: str = "content", asked: str = "asked") -> DataFrame:
    """answers with a struct `answer`: verdict, latex, confidence.

    An answer is refused as `no object`, `code`, or `not json` (it is parsed, not matched by shape), and
    not taken where it holds `no latex`, is of `low confidence` (0.5 or less, or none) or leaves what was
    asked about `unchanged`. A null answer is no object; without a question any expression is a change.
    """
    kept = [c for c in answers.columns if c != "answer"]
    rows = answers.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("own"), F.coalesce(F.col(f"`{content}`"), F.lit("")).alias("content"), F.trim(F.col(f"`{asked}`")).alias("asked"))
    rows = rows.withColumn("body", F.expr(body(SPARK, "content"))).withColumn("parsed", F.expr("try_parse_json(body)"))

    def got(path: str, kind: str) -> Column:
        return F.expr(f"try_variant_get(parsed, '$.{path}', '{kind}')")

    rows = rows.withColumn("latex", F.trim(got("latex", "string"))).withColumn("confidence", F.coalesce(got("confidence", "double"), F.lit(0.0)))
    verdict = (
        F.when(F.col("body") == "", "no object").when(F.expr(SPARK.match("body", CODE_INSIDE)), "code").when(F.col("parsed").isNull(), "not json")
        .when(F.coalesce("latex", F.lit("")) == "", "no latex").when(F.col("confidence") <= LEAST_CONFIDENCE, "low confidence")
        .when(F.col("latex").eqNullSafe(F.col("asked")), "unchanged").otherwise("accepted")
    )
    return rows.select(*[F.col("own").getField(c).alias(c) for c in kept], F.struct(verdict.alias("verdict"), "latex", "confidence").alias("answer"))


#: Answers and what was asked: the turn before, in a conversation; an expression of its own for each fixed answer.
def _asked(d: Spark) -> str:
    turns = "SELECT 1000000000 + conv_id * 1000 + turn AS id, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations"
    fixed = f"SELECT {d.idiv('-k', '1')} AS id, 'y' AS asked FROM (VALUES (1), (3)) v(k)"
    return f"SELECT r.id, r.content, q.asked FROM responses r LEFT JOIN ({turns} UNION ALL {fixed}) q ON q.id = r.id"


def gate_response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verdicts(run_sql(spark, sf_dir, with_relations(SPARK, ["responses"], _asked(SPARK))))
    return rows.select("id", "answer.verdict", "answer.latex", "answer.confidence")


QUERIES = {"gate_response_json": gate_response_json}

ORACLES = {
    "gate_response_json": with_relations(
        DUCK,
        ["responses"],
        f"""SELECT id, CASE WHEN body = '' THEN 'no object' WHEN {DUCK.match("body", CODE_INSIDE)} THEN 'code' WHEN NOT json_valid(body) THEN 'not json' WHEN coalesce(latex, '') = '' THEN 'no latex'
            WHEN confidence <= {LEAST_CONFIDENCE} THEN 'low confidence' WHEN latex = asked THEN 'unchanged' ELSE 'accepted' END AS verdict, latex, confidence
        FROM (SELECT *, CASE WHEN json_valid(body) THEN trim(json_extract_string(body, '$.latex')) END AS latex, coalesce(CASE WHEN json_valid(body) THEN try_cast(json_extract_string(body, '$.confidence') AS DOUBLE) END, 0) AS confidence
            FROM (SELECT id, trim(asked) AS asked, {body(DUCK, "coalesce(content, '')")} AS body FROM ({_asked(DUCK)}) a) b) c""",
    )
}
