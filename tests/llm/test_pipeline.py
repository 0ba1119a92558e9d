"""The pipeline against a brute-force version of its stages on the smallest tables, and on awkward ones."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mathloom.llm import language
from tests.llm.test_operators import CASES, ODD, SCHEMA, SF, brute_components, brute_contamination, brute_secrets
from tests.llm.test_shingles import similarity, word_runs


def brute_pipeline(spark, rows, items):
    """Rows after stages 1 to 4: (doc_id, text). Stage 1 is held against held-out languages elsewhere and taken as given here."""
    runs = {k: word_runs(t) for k, t in rows}
    keys = sorted(runs)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if 5 * min(len(runs[a]), len(runs[b])) >= 4 * max(len(runs[a]), len(runs[b])) and similarity(runs[a], runs[b]) >= 0.8]
    root = brute_components(keys, links)
    rows = [(k, t) for k, t in rows if root[k] == k]
    dirty = brute_contamination(rows, items, 10)
    return [(k, t) for k, t in rows if not dirty[k][1]]


def with_secrets(docs):
    """docs with a secret at the end of every seventh text, as the smallest table has none."""
    planted = F.concat("text", F.lit(" password = hunter2hunter "), F.md5("text"), F.lit(" and that was all"))
    return docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, planted).otherwise(F.col("text"))).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def test_stages_match_brute_force(spark):
    docs = with_secrets(spark.read.parquet(f"{SF}/documents.parquet"))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = language.train_languages(docs)
    first = corpus_pipeline.language_id(spark, docs, SF)
    labels = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    got = {r["doc_id"]: r["text"] for r in first.collect()}
    assert set(got) == {k for k, r in labels.items() if r["lang_pred"] != "und" and r["lang_score"] >= 0.5} and first.columns == docs.columns
    assert len(got) > 0.98 * docs.count()
    rows = brute_pipeline(spark, sorted(got.items()), items)
    df = first
    for name, stage in corpus_pipeline.STAGES[1:4]:
        df = spark.createDataFrame(stage(spark, df, SF).collect(), docs.schema)
        assert df.columns == docs.columns
    out = {r["doc_id"]: r for r in df.collect()}
    assert set(out) == {k for k, _ in rows}
    for key, text in rows:
        spans = [tuple(map(int, s.split(":")[1:])) for s in brute_secrets(text)]
        if not spans:
            assert out[key]["text"] == text
        for a, b in spans:
            assert text[a:b] not in out[key]["text"]
        assert out[key]["n_chars"] == len(out[key]["text"])
    assert any(brute_secrets(t) for _, t in rows)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "copy_no", "n_copies", "shuffle_key"} <= set(out.columns)
    assert out.count() == out.select("doc_id", "copy_no").distinct().count()
    assert not any(re.search(r"\b[0-9a-f]{24,}\b", r["text"]) for r in out.collect())


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_on_awkward_tables(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        kept = out.collect()
        assert len(kept) <= len(rows)
    assert corpus_pipeline.near_dedup(spark, docs, SF).where(F.col("doc_id") == 4).count() == min(1, len(rows))
    corpus_pipeline.mix_sources(spark, docs, SF).collect()
