"""All queries of the engine and the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import DUCK, SPARK
from ..sources.relations import run_sql, with_relations
from . import expressions, gatekeeper, matrices, references, reports, structure

TEMPLATES: dict[str, tuple] = {}
for part in (expressions, structure, reports, gatekeeper, references, matrices):
    TEMPLATES |= part.TEMPLATES


def _query(names, body) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_sql(spark, sf_dir, with_relations(SPARK, names, body(SPARK)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(*t) for name, t in TEMPLATES.items()}
ORACLES: dict[str, str] = {name: with_relations(DUCK, names, body(DUCK)) for name, (names, body) in TEMPLATES.items()}

from ..sources import sinks  # noqa: E402
from ..streaming import jobs  # noqa: E402
from . import bracketing, envelopes, fixer, geometry, recovery, responses  # noqa: E402

for module in (sinks, jobs, bracketing, geometry, responses, envelopes, fixer, recovery):
    QUERIES |= module.QUERIES
    ORACLES |= getattr(module, "ORACLES", {})
