"""Hard negatives by packed products against plain sums."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mathloom.llm import negatives
from mathloom.llm.queries import QUERIES


@pytest.mark.parametrize("largest", [1, 160, 40_000, 2**40, 2**62])
@pytest.mark.parametrize("components", [0, 1, 7, 64])
def test_scores_are_exact(largest, components):
    rng = random.Random(largest + components)
    vectors = np.array([[rng.randint(-largest, largest) for _ in range(components)] for _ in range(50)], np.int64).reshape(50, components)
    packed = negatives.PackedVectors(vectors, largest)
    for _ in range(5):
        anchor = [rng.choice([-largest, largest, 0, rng.randint(-largest, largest)]) for _ in range(components)]
        assert [int(x) for x in packed.score(anchor)] == [sum(int(a) * int(b) for a, b in zip(anchor, v)) for v in vectors]


def test_integers_of_several_fields():
    vectors = np.arange(3 * 5000, dtype=np.int64).reshape(5000, 3) % 301 - 150
    packed = negatives.PackedVectors(vectors, 200)
    assert len(packed.packs) == 3 and packed.width == 4
    assert (packed.score([200, -7, 3]) == vectors @ np.array([200, -7, 3])).all()


def brute(rows, positives=5, most=10):
    rows = [(k, [math.floor(256 * float(x)) for x in v], lab) for k, v, lab in rows if k is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    least = {}
    for k, v, lab in rows:
        lab = (lab + 1) % 10 if k % 7 == 0 else lab
        least[k] = min(least.get(k, (lab, v)), (lab, v))
    out = []
    for a, (lab, v) in least.items():
        if a % 100:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), k, own) for k, (own, w) in least.items() if k != a)
        for s, p, _ in [x for x in scores if x[2] == lab][:positives]:
            fit = [(k, -t) for t, k, own in scores if own != lab and 30 * -s <= 100 * -t <= 90 * -s][:most]
            out += [(a, p, i + 1, k, -s, t) for i, (k, t) in enumerate(fit)]
    return sorted(out)


def found(rows, **more):
    vectors = negatives.whole_vectors(rows)
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    out = negatives.hard_negatives(moved, anchors="vec_id % 100 = 0", **more)
    return sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = QUERIES["op12_hard_negatives"](spark, sf)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == brute(rows)


SCHEMA = "vec_id bigint, embedding array<float>, label int, anchor string, vector int, positives int"


def test_odd_rows_and_ties(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-2, 2)) / 2 for _ in range(rng.choice([4, 4, 4, 3]))], rng.randint(0, 2)) for i in range(0, 700, 4)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5], i % 2) for i in range(1001, 1300)] + [(100, [1.0, 1.0, 1.0, 1.0], 1), (300, [], 0), (500, [1.0], 2)]
    rows += [(None, [1.0], 1), (2000, None, 1), (2100, [1.0, None], 1), (2200, [1.0], None), (2300, [float("nan")], 1), (2400, [float("inf")], 1), (0, [1.0], 1), (0, [1.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    want = brute(rows)
    assert found(df) == want and len(want) > 100
    assert found(df, group_rows=7) == want
    assert found(df.limit(0)) == [] and found(df.where("label = 1 AND vec_id % 7 > 0")) == []


def test_huge_components(spark):
    rows = [(0, [3e38, 1.0], 1), (1, [3e38, 0.0], 1), (2, [1e10, 1.0], 2), (3, [0.25, 1.0], 1)]
    got = found(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA))
    assert all(-(2**63) <= r[4] < 2**63 for r in got)
