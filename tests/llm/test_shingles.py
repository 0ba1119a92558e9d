"""Near-duplicates of the pipeline against all pairs, with a similarity computed on the words themselves."""

import random
import re

import numpy as np

import corpus_pipeline
from mathloom.llm import shingles
from tests.llm.test_operators import SCHEMA, SF, brute_components


def word_runs(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited_texts(seed, n):
    """Texts of 5 to 400 words, each with three copies in which some words are replaced."""
    draw, texts = random.Random(seed), []
    for _ in range(n):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.choice([5, 8, 12, 20, 40, 100, 400]))]
        texts.append(" ".join(words))
        for share in (0.01, 0.02, 0.03):
            texts.append(" ".join(w if draw.random() > share else f"x{draw.randrange(5000)}" for w in words))
    return texts


def test_pipeline_stage_keeps_one_of_all_near_texts(spark):
    texts = edited_texts(3, 60)
    runs = [word_runs(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if similarity(runs[a], runs[b]) >= 0.8]
    assert sum(similarity(runs[a], runs[b]) < 0.9 for a, b in links) > 20
    root = brute_components(list(range(len(texts))), links)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), None, None, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert got == {i for i in root if root[i] == i}


def test_near_sets_share_a_key_and_pass_the_sketch():
    draw = random.Random(2)
    counts = np.random.default_rng(5).integers(0, 50, 1 << shingles.COUNT_BITS)
    for size in [1, 2, 3, 5, 8, 9, 12, 20, 33, 60, 100, 333, 700, 1500]:
        for _ in range(8):
            words = [f"w{draw.randrange(10**6)}" for _ in range(size)]
            other = [w if draw.random() > 0.02 else "x" for w in words[draw.randrange(size // 9 + 1) :]] + ["end"] * draw.randrange(3)
            texts = [" ".join(words).encode(), " ".join(other).encode()]
            sets = shingles.ShingleSets(texts, counts)
            lengths, keys = sets.prefixes()
            marks, (m, n) = sets.sketches(), sets.sizes
            one, two = (shingles.ShingleSets([t]).hashes for t in texts)
            assert len(one) == len(word_runs(texts[0].decode())) == m and shingles.near(one, two) == (similarity(*(word_runs(t.decode()) for t in texts)) >= 0.8)
            if shingles.near(one, two):
                assert set(keys[: lengths[0]]) & set(keys[lengths[0] :]) and shingles.may_be_near(m, n, *marks)


def test_crowds_and_common_passages(spark):
    draw = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(w if draw.random() > 0.004 else f"z{draw.randrange(99)}" for w in base) for _ in range(150)]
    texts += [passage + " " + " ".join(f"q{draw.randrange(10**6)}" for _ in range(10)) for _ in range(150)]
    runs = [word_runs(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if similarity(runs[a], runs[b]) >= 0.8]
    root = brute_components(list(range(len(texts))), links)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), None, None, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert got == {i for i in root if root[i] == i}


def test_rows_are_told_apart_by_id_and_text(spark):
    first, second = (" ".join(f"{k}{i}" for i in range(60)) for k in "ab")
    rows = [(1, first), (1, second), (1, second), (2, first + " more"), (None, second + " more"), (None, "alone here without an id"), (None, "alone here without an id")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t), None, None, None) for k, t in rows], SCHEMA)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()), key=str)
    assert got == sorted([(1, first), (1, second), (None, "alone here without an id")], key=str)


def edited_crowd(seed, n, edits):
    """Copies of one text of 150 words, each with some words replaced, so that few are near each other."""
    draw, texts = random.Random(seed), []
    for _ in range(n):
        words = [f"b{i}" for i in range(150)]
        for at in draw.sample(range(150), edits):
            words[at] = f"z{draw.randrange(10**6)}"
        texts.append(" ".join(words))
    return texts


def test_edited_copies_are_not_paired_in_rows(spark, monkeypatch):
    texts = edited_crowd(4, 160, 3)
    runs = [word_runs(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if similarity(runs[a], runs[b]) >= 0.8]
    root = brute_components(list(range(len(texts))), links)
    assert len(set(root.values())) > 80 and len(links) > 5
    made, compare = [], shingles.near_pairs
    monkeypatch.setattr(shingles, "near_pairs", lambda pairs, *more: made.append(pairs.distinct().count()) or compare(pairs, *more))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), None, None, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert got == {i for i in root if root[i] == i}
    assert len(made) == 2 and made[1] < 5 * len(texts)  # 160 * 159 / 2 pairs share a key


def test_tiles_hold_every_pair_of_other_roots(spark, monkeypatch):
    monkeypatch.setattr(shingles, "TILE_ROWS", 8)
    texts = [t.encode() for t in edited_crowd(8, 90, 2)]
    sets = shingles.ShingleSets(texts)
    marks = list(zip(range(len(texts)), sets.sizes.tolist(), sets.sketches()))
    table = spark.createDataFrame(marks, "node bigint, size bigint, sketch binary")
    roots = [k if k % 3 else 0 for k in range(90)]
    members = [(7, k, roots[k]) for k in range(90)] + [(8, k, roots[k]) for k in range(1, 6)] + [(9, k, 0) for k in range(0, 90, 3)]
    got = shingles.pairs_in_tiles(spark.createDataFrame(members, "key bigint, node bigint, root bigint"), table, len(members)).collect()
    expected = {(a, b) for a in range(90) for b in range(a + 1, 90) if roots[a] != roots[b] and shingles.may_be_near(*(marks[a][1], marks[b][1], marks[a][2], marks[b][2]))}
    assert {(min(r), max(r)) for r in got} == expected and len(expected) > 100


def test_kept_texts_are_not_shuffled(spark):
    texts = edited_crowd(2, 12, 9) + edited_crowd(2, 3, 0)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), None, None, None) for i, t in enumerate(texts)], SCHEMA)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.near_dedup(spark, docs, SF)
        assert {r["doc_id"] for r in kept.collect()} == set(range(13))
        assert re.search("BroadcastHashJoin.*LeftAnti", kept._jdf.queryExecution().executedPlan().toString())  # no shuffle for what is surely kept
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
