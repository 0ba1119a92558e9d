"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mathloom.llm import decontaminate, language, mixing, secrets, shingles
from mathloom.llm.shared import checkpoint_dir, table

#: A document whose mean share of its likeliest language is below this has no language.
LEAST_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language (null texts, no letters, no clear majority) go."""
    model = language.train_languages(docs)
    own = {c: f"__own_{c}" for c in ("lang_pred", "lang_score") if c in docs.columns}
    found = language.identify(docs.withColumnsRenamed(own), model)
    kept = found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id stays, once.

    Near are texts whose five-word shingles have a Jaccard similarity of 0.8 or more:
    SimHash links are compared first, and an exact search finds the pairs whose
    fingerprints lie too far apart. Rows are told apart by id and text; those without
    an id are in the same search and stay only where no row of their group has one.
    """
    return shingles.kept_rows(docs, most=4)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; no document goes."""
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents, so that all sources have the same expected share, in a global random order."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
]

#: Stages 1 and 2 can't be told in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what is between them is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
