"""Hard negatives by exact inner products of whole vectors, several candidates in one wide integer.

Candidates are dealt into groups, and every anchor is sent to every group: a stated set
of queries against all rows, in blocks. A group's task packs component i of many
candidates, biased to be nonnegative, into separated fields of one wide integer; the
anchor's component i multiplies it once for all of them, the products are summed over i,
and the fields of the sum, less what the bias adds, are the exact scores. Fields are as wide as the
largest component and the number of components require.

A first pass finds the nearest rows of the anchor's own label, a second, which knows
their scores, the best rows of other labels in the range that each allows. A group sends
on a few rows for each anchor, whatever its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import private, stage_table

#: Candidates of a group, about; those that are worth sending all anchors to; those whose fields share one integer.
GROUP_ROWS, LEAST_ROWS, PACKED = 100_000, 1500, 2048
MOST = 2**63 - 1


class PackedVectors:
    """Whole-number vectors, field-packed; score(anchor) gives their exact inner products."""

    def __init__(self, vectors: np.ndarray, largest_anchor: int):
        """vectors: (rows, components), of dtype object where they exceed a long. largest_anchor: the largest magnitude in any anchor."""
        self.rows, self.components = vectors.shape
        wide = vectors.astype(object)
        self.bias = max([0, *(abs(int(x)) for x in (wide.min(initial=0), wide.max(initial=0)))])
        # |sum of anchor x (candidate + bias)| is at most this
        self.offset = self.components * largest_anchor * 2 * self.bias
        bits = (2 * self.offset).bit_length()
        self.width = 4 if bits <= 32 else 8 if bits <= 64 else -(-bits // 8)
        self.packs = []
        for at in range(0, self.rows, PACKED):
            part = wide[at : at + PACKED] + self.bias
            if self.width <= 8:
                fields = np.ascontiguousarray(part.T.astype(np.uint64).astype(f"<u{self.width}"))
                packed = [int.from_bytes(row.tobytes(), "little") for row in fields]
            else:
                packed = [int.from_bytes(b"".join(int(x).to_bytes(self.width, "little") for x in row), "little") for row in part.T]
            n = len(part)
            ones = int.from_bytes((1).to_bytes(self.width, "little") * n, "little")
            self.packs.append((n, packed, ones * self.offset))

    def score(self, anchor: list[int]) -> np.ndarray:
        """Inner products with all rows; of dtype object where they may exceed a long."""
        less, found = self.offset + self.bias * sum(anchor), []
        for n, packed, total in self.packs:
            for a, p in zip(anchor, packed):
                if a:
                    total += a * p
            data = total.to_bytes(n * self.width, "little")
            if self.width == 4:
                found.append(np.frombuffer(data, "<u4").astype(np.int64) - less)
            elif self.width == 8 and less < MOST and self.offset < MOST // 4:
                found.append(np.frombuffer(data, "<u8").astype(np.int64) - less)
            else:
                found.append(np.array([int.from_bytes(data[i : i + self.width], "little") - less for i in range(0, len(data), self.width)], object))
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def first(scores: np.ndarray, which: np.ndarray, most: int) -> np.ndarray:
    """The places in `which`, ascending, of its `most` highest scores, equal ones in order of place."""
    own = scores[which]
    if len(which) > most:
        least = np.sort(own)[-most] if own.dtype == object else np.partition(own, len(own) - most)[-most]
        above = which[own > least]
        which = np.sort(np.concatenate((above, which[own == least][: most - len(above)])))
        own = scores[which]
    order = sorted(range(len(which)), key=lambda i: (-own[i], which[i]))
    return which[np.array(order, np.int64)] if order else which


def _long(x) -> int:
    return max(-MOST - 1, min(MOST, int(x)))


class _Group:
    def __init__(self, ids, labels, vectors, components: int, largest: int):
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        self.ids, self.labels = np.array(ids, np.int64)[order], np.array(labels, np.int64)[order]
        exact = np.array([[*v, *[0] * (components - len(v))] for v in vectors], np.int64).reshape(len(vectors), components)[order]
        self.packed = PackedVectors(exact, largest)


def _groups(batches, components: int, largest: int):
    """(group, anchor row) for every anchor that meets candidates; those of a group come before its anchors."""
    now, parts, group = None, None, None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("group", "vec_id", "label", "vector", "positives", "anchor")]
        for number, vec_id, label, vector, positives, anchor in zip(*columns):
            if number != now:
                now, parts, group = number, ([], [], []), None
            if not anchor:
                for part, x in zip(parts, (vec_id, label, vector)):
                    part.append(x)
                continue
            if not parts[0]:
                continue
            group = group or _Group(*parts, components, largest)
            yield group, vec_id, label, [*vector, *[0] * (components - len(vector))], positives or []


def nearest_of_label(components: int, largest: int, most: int):
    def search(batches):
        for group, anchor_id, label, vector, _ in _groups(batches, components, largest):
            which = np.flatnonzero((group.labels == label) & (group.ids != anchor_id))
            if not len(which):
                continue
            scores = group.packed.score(vector)
            found = first(scores, which, most)
            yield pa.RecordBatch.from_arrays([pa.array([anchor_id] * len(found), pa.int64()), pa.array(group.ids[found]), pa.array([_long(scores[i]) for i in found], pa.int64())], ["anchor_id", "positive_id", "positive_score"])

    return search


def in_range(components: int, largest: int, most: int, lowest: int, highest: int):
    """The first rows of other labels whose score is between lowest and highest hundredths of a positive's."""

    def search(batches):
        for group, anchor_id, label, vector, positives in _groups(batches, components, largest):
            other = np.flatnonzero(group.labels != label)
            if not len(other) or not positives:
                continue
            scores = group.packed.score(vector)
            own, out = scores[other], []
            for p in positives:
                s = p["score"]
                low, high = -(-lowest * s // 100), highest * s // 100
                for i in first(scores, other[(own >= low) & (own <= high)], most):
                    out.append((anchor_id, p["id"], p["place"], group.ids[i], s, _long(scores[i])))
            if out:
                names = ["anchor_id", "positive_id", "positive_rank", "negative_id", "positive_score", "negative_score"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    return search


def whole_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part: no null in any of them, no component null or not finite; components are floor(scale * x)."""
    named = rows.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.col(f"`{label}`").cast("bigint").alias("label"), F.col(f"`{vector}`").alias("vector"))
    finite = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    whole = F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    return named.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite).select("vec_id", "label", whole.alias("vector"))


def one_row_an_id(rows: DataFrame) -> DataFrame:
    """rows with the least (label, vector) of each vec_id; only ids that come more than once are shuffled with their vectors."""
    several = stage_table(rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "repeated-ids")
    if several.isEmpty():
        return rows
    least = rows.join(several, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row"))
    return rows.join(several, "vec_id", "left_anti").unionByName(least.select("vec_id", "row.label", "row.vector"))


def hard_negatives(rows: DataFrame, anchors: str, positives: int = 5, negatives: int = 10, lowest: int = 30, highest: int = 90, group_rows: int = GROUP_ROWS) -> DataFrame:
    """rows(vec_id, label, vector) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchors is a condition on vec_id. An anchor's positives are its nearest other rows
    of its label, its negatives for one of them the best rows of other labels
    with a score of `lowest` to `highest` hundredths of that positive's; higher scores
    come first, then smaller ids. A score that is no long counts as the nearest
    long. Rows with the same vec_id count as one, the least; vectors of different lengths are
    compared as if zeros followed; an empty table, or one without anchors or
    without a second label, gives an empty one.
    """
    rows = stage_table(one_row_an_id(rows), "whole-vectors")
    is_anchor = F.expr(anchors)
    size = F.coalesce(F.max(F.size("vector")), F.lit(0))
    # floor of a huge double is the end of the longs, whose magnitude is no long
    largest = F.coalesce(F.max(F.when(is_anchor, F.aggregate("vector", F.lit(0).cast("decimal(20,0)"), lambda m, x: F.greatest(m, F.abs(x.cast("decimal(20,0)")))))), F.lit(0))
    n, components, most = rows.agg(F.count("*"), size, largest).first()
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a small group sends on as many rows as a large one, so the number of partitions alone makes no more groups
    groups = max(min(partitions, -(-n // LEAST_ROWS)), -(-n // group_rows), 1)
    columns = ("group", "vec_id", "label", "vector", "positives", "anchor")
    found_type = "array<struct<score: bigint, id: bigint, place: int>>"
    dealt = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("group")
    candidates = rows.select(dealt, "*", F.lit(None).cast(found_type).alias("positives"), F.lit(False).alias("anchor"))

    def against_all(queries: DataFrame) -> DataFrame:
        sent = queries.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("anchor", F.lit(True))
        return candidates.select(*columns).unionByName(sent.select(*columns)).repartition("group").sortWithinPartitions("group", "anchor")

    asked = rows.where(is_anchor)
    near = against_all(asked.withColumn("positives", F.lit(None).cast(found_type))).mapInArrow(nearest_of_label(components, int(most), positives), "anchor_id bigint, positive_id bigint, positive_score bigint")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    best = stage_table(near.withColumn("place", place).where(F.col("place") <= positives), "positives")
    listed = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct(F.col("positive_score").alias("score"), F.col("positive_id").alias("id"), "place")).alias("positives"))
    queries = stage_table(asked.join(listed, "vec_id"), "anchors")
    fields = "anchor_id bigint, positive_id bigint, positive_rank bigint, negative_id bigint, positive_score bigint, negative_score bigint"
    far = against_all(queries).mapInArrow(in_range(components, int(most), negatives, lowest, highest), fields)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    kept = far.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return kept.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", F.col("positive_rank").cast("int").alias("positive_rank"))
