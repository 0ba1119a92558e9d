"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cuckoo, decontaminate, factorization, language, licenses, merkle, mixing, negatives, pages, secrets, simhash, substrings, winnow
from .oracles import ORACLES
from .shared import held_out_bucket, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = factorization.train_quality(docs, table(spark, sf_dir, "labels"), folds=5)
    scored = factorization.score_quality(docs, machine)
    return scored.select("doc_id", (held_out_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan_licenses(docs, licenses.train_licenses(docs))


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.fingerprint_edits(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        winnow.as_text("fp").alias("fingerprint"), winnow.as_text("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op4_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("bigint").alias("n_chars"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeats(table(spark, sf_dir, "documents"), length=35)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.train_languages(docs, folds=3, held_out=1))
    return found.select("doc_id", (held_out_bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), most=4, shingle=4)
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), window=10)
    items = F.array_join(F.array_sort("items"), ",")
    hits = decontaminate.hit_words()
    return found.select("doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(items.cast("binary"), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


def op9_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secrets.BASE]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(kind):
        return F.filter("secrets", lambda s: s["kind"] == kind)

    counts = [F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in base]
    digest = F.sha2(joined(F.filter("secrets", lambda s: s["kind"].isin(base))).cast("binary"), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", upper, lower))
    found = merkle.prove(docs, claim_text=tampered)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = negatives.whole_vectors(table(spark, sf_dir, "embeddings"))
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    found = negatives.hard_negatives(moved, anchors="vec_id % 100 = 0")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cuckoo.duplicates(cuckoo.build(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_license_scan, op3_winnowing, op4_template_removal, op5_substring_dedup, op6_language_id, op7_simhash, op8_decontamination, op9_poisson_mix, op10_secret_scan, op11_merkle_manifest, op12_hard_negatives, op13_exact_dedup)}

__all__ = ["ORACLES", "QUERIES"]
