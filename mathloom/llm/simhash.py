"""SimHash near-duplicates with a generalised pigeonhole index over the fingerprints.

Fingerprints that differ in at most `most` bits are linked. Equal fingerprints are
first put into one class. The 64 bits are split into parts (bits that agree often
stand in one part); part i gets a threshold t_i >= -1 with sum(t_i + 1) = most + 1,
so two linked fingerprints differ in at most t_i bits of at least one part i. The
thresholds, unequal where that pays, come from dynamic programming over estimated
probe and candidate counts; the statistics behind them cover all fingerprints.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, join_frequent, pairs_across
from .shared import checkpoint, stage_table

BITS = 64


def simhash(words: list[bytes], shingle: int) -> int:
    """The 64-bit fingerprint of a word list: bit set where over half the shingle hashes have it."""
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        digests = xxhash.xxh64_digest(joined, 42)
        n = 1
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
        stops = [*gaps[shingle - 1 :], len(joined)]
        starts = [0, *(g + 1 for g in gaps[: len(stops) - 1])]
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, stops)])
        n = len(stops)
    rows = np.frombuffer(digests, np.uint8).reshape(n, 8)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, 255):  # sums of up to 255 bits fit a byte
        votes += np.unpackbits(rows[at : at + 255], axis=1).sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long; null and blank texts get 0."""

    def score(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.fromiter((simhash((t.as_py() or b"").lower().split(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(score, f"doc_id {kind}, fp bigint")


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set (64 x 64), over all rows."""

    def count(batches):
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for at in range(0, len(fps), 65536):
                bits = np.unpackbits(fps[at : at + 65536].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64)
                both += (bits.T @ bits).astype(np.int64)
            n += len(fps)
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS * BITS)), pa.array(both.ravel()), pa.array([n] * BITS * BITS)], ["cell", "both", "n"])

    cells = prints.select("fp").mapInArrow(count, "cell bigint, both bigint, n bigint").groupBy("cell").agg(F.sum("both").alias("both"), F.sum("n").alias("n"))
    got = cells.orderBy("cell").collect()  # 4,096 rows at any size
    if not got:
        return 0, np.zeros((BITS, BITS))
    return got[0]["n"], np.array([r["both"] for r in got], float).reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits 0 (highest) to 63 in `parts` groups of even size; each group takes the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    alike = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = math.ceil(len(left) / (parts - k))
        group = [max(left, key=lambda b: (sum(alike[b, c] for c in left if c != b), -b))]
        left.discard(group[0])
        while len(group) < size:
            nearest = max(left, key=lambda b: (alike[b, group].sum(), -b))
            group.append(nearest)
            left.discard(nearest)
        groups.append(sorted(group))
    return groups


def _variants(width: int, threshold: int) -> int:
    return sum(math.comb(width, d) for d in range(threshold + 1))


def allocate(n: int, both: np.ndarray, groups: list[list[int]], most: int, probe_cost: float = 20.0) -> tuple[float, list[int]]:
    """Least estimated cost, and the thresholds that have it: one per group, each >= -1, sum(t + 1) = most + 1.

    A part costs its probes (fingerprints times values within t bits) and its
    candidates (pairs times the chance that at most t of its bits differ, with the
    bits' own frequencies).
    """
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    costs = []
    for group in groups:
        chance = np.zeros(len(group) + 1)
        chance[0] = 1.0
        for b in group:
            chance[1:] = chance[1:] * (1 - differ[b]) + chance[:-1] * differ[b]
            chance[0] *= 1 - differ[b]
        within = np.cumsum(chance)
        costs.append([0.0] + [probe_cost * n * _variants(len(group), t) + n * n / 2 * within[min(t, len(group))] for t in range(most + 1)])
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for spent in range(most + 2 - used):
                new = (total + cost[spent], [*chosen, spent - 1])
                if used + spent not in step or new < step[used + spent]:
                    step[used + spent] = new
        best = step
    return best[most + 1]


def plan_parts(n: int, both: np.ndarray, most: int) -> list[tuple[list[int], int]]:
    """The cheapest split: bits of each part in use, and its threshold; the one with the fewest probes among equals."""
    options = []
    for parts in range(1, most + 2):
        groups = group_bits(n, both, parts)
        cost, thresholds = allocate(n, both, groups, most)
        options.append((cost, sum(_variants(len(g), t) for g, t in zip(groups, thresholds)), parts, list(zip(groups, thresholds))))
    return [(g, t) for g, t in min(options)[3] if t >= 0]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _flipped(k: int, part: Column):
    return lambda f: F.struct(F.xxhash64(F.lit(k), part.bitwiseXOR(f)).alias("key"), (f == 0).alias("own"))


def near_links(prints: DataFrame, most: int = 4, crowd: int = 256) -> DataFrame:
    """prints(fp), distinct -> links (u, v), u < v, that join all fingerprints which links of at most `most` bits join.

    Every fingerprint is indexed by its own value of each part and probes all values
    within the part's threshold. Where fewer than `crowd` meet at a value, each pair
    within `most` bits is a link (once for each part in which it meets). In a crowd all are first
    compared with its least fingerprint; only pairs that are not yet joined by that
    are compared with each other, so that a dense group gives no more links than it has members.
    """
    n, both = bit_statistics(prints)
    if n < 2:
        return prints.select(F.col("fp").alias("u"), F.col("fp").alias("v")).where(F.lit(False))
    probes, n_rows = [], 0
    for k, (group, threshold) in enumerate(plan_parts(n, both, most)):
        weights = [1 << (BITS - 1 - b) for b in group]
        part = F.col("fp").bitwiseAND(F.lit(_signed(sum(weights))))
        flips = [_signed(sum(c)) for d in range(threshold + 1) for c in itertools.combinations(weights, d)]
        probes.append(F.transform(F.array(*map(F.lit, flips)), _flipped(k, part)))
        n_rows += n * len(flips)
    near = f"bit_count(u ^ v) <= {int(most)}"
    spread = prints.select("fp", F.explode(F.flatten(F.array(*probes))).alias("at")).select(F.col("fp").alias("node"), "at.key", "at.own")
    met = spread.groupBy("key").agg(F.count("*").alias("p"), F.min(F.when(F.col("own"), F.col("node"))).alias("first"))
    met = met.where("p > 1 AND first IS NOT NULL").withColumn("weight", F.col("p"))
    meetings = stage_table(join_frequent(spread, met, "key", "weight", n_rows), "meetings")
    few = meetings.where(F.col("p") < crowd)
    index = few.where("own").select("key", F.col("node").alias("v"))
    links = few.select("key", F.col("node").alias("u")).join(index, "key").where(f"u < v AND {near}").select("u", "v")
    crowds = meetings.where(F.col("p") >= crowd)
    n_crowded = crowds.count()
    if not n_crowded:
        return links
    stars = stage_table(crowds.select(F.col("first").alias("u"), F.col("node").alias("v")).where(f"u <> v AND {near}").distinct(), "stars")
    roots = connected_components(stars)
    members = stage_table(crowds.select("key", "node", "own", "p").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "crowds")
    return links.unionByName(stars).unionByName(pairs_across(members, near, n_crowded)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def near_duplicates(docs: DataFrame, most: int = 4, shingle: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id is the smallest doc_id reached by links of at most `most` differing
    bits. Null and blank texts have fingerprint 0 and are linked like any other;
    repeated rows come back as often as they are given; rows with a null doc_id
    belong to their component but never name it (null if all its ids are null).
    An empty table gives an empty one. Other columns are not read.
    """
    prints = checkpoint(fingerprints(docs, shingle, text, doc_id))
    classes = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = checkpoint(connected_components(near_links(classes.select("fp"), most)).withColumnRenamed("node", "fp"))
    linked = classes.join(roots, "fp")
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("weight"))
    named = join_frequent(linked.select("fp", "root", "n"), names, "root", "weight", roots.count()).select("fp", "component_id", "n")
    alone = classes.join(roots, "fp", "left_anti").select("fp", F.col("least").alias("component_id"), "n")
    return join_frequent(prints, named.unionByName(alone), "fp", "n", prints.count()).select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
