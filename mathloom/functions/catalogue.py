"""The operators as functions of columns, for use in any DataFrame.

    from mathloom.functions.catalogue import column
    df.withColumn("clean", column("clean_first", "payload"))
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import classify, gates, layout, lines, reconstruct, repair
from .dialect import SPARK, chain, fired

OPERATORS = {
    **{f.__name__: f for f in (classify.structure_first, classify.delimiter_first, classify.has_real_latex, classify.has_broken_latex, classify.gibberish, classify.wrap_plain_text, classify.error_code, classify.namespace_display, classify.strip_tags, classify.xml_escape, classify.wrap_mtext, classify.structural)},
    **{f.__name__: f for f in (gates.spelled_words, gates.corrupt_strict, gates.validate_strict, gates.machine_written, gates.operator_tags, gates.spelling_hack, gates.pre_repair, gates.latex_structure, gates.mathml_structure, gates.latex_corruption, gates.split_words, gates.malformed_tags, gates.clean_first, gates.latex_syntax, gates.truncated, gates.validity_reason)},
    **{f"layout_{f.__name__}": f for f in (layout.multi_line, layout.matrix, layout.route, layout.label, layout.rows)},
    **repair.CHAINS,
    **lines.CHAINS,
    **reconstruct.CHAINS,
}


def column(operator: str, of: str) -> Column:
    """The operator applied to a column: a flag, a text, or an array of the labels that fire."""
    return F.expr(OPERATORS[operator](SPARK, f"`{of}`"))


def rewrite(of: str, rules: list[tuple[str, str]]) -> Column:
    """A user's own rules (pattern, replacement), in order."""
    return F.expr(chain(SPARK, f"`{of}`", rules))


def labels(of: str, rules: list[tuple[str, str]]) -> Column:
    """The labels of a user's own rules (pattern, label) that match, in order."""
    return F.expr(fired(SPARK, f"`{of}`", rules))


def convert_batch(df: DataFrame, make, source: str = "payload", into: str = "mathml") -> DataFrame:
    """A pluggable converter over a column: make() is called once a partition and gives a function from text to text.

    Rows for which it fails get an empty result with an error code. This is the one
    place of the engine where Python runs on the executors.
    """
    kept = [c for c in df.columns if c not in (into, "error_code")]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)

    def convert(batches):
        convert_one = make()
        for pdf in batches:
            out, codes = [], []
            for text in pdf[source]:
                try:
                    out.append(convert_one(text))
                    codes.append(None)
                except Exception:
                    out.append("")
                    codes.append("conversion-failed")
            yield pdf.assign(**{into: out, "error_code": codes})

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInPandas(convert, f"{fields}, `{into}` string, error_code string")
