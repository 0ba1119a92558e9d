"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]),
so all pairwise interactions cost no more than one pass over the features present.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample, held_out_bucket

WORD_BITS = 15
WORDS = 1 << WORD_BITS
RANK = 8
BINS = 12

UPPER, LOWER, DIGITS = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57)))
BLANKS = b" \t\n\r\x0b\x0c"
HIGH = bytes(range(128, 256))
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
STRANGE = b"#$%&*<>=@\\^_`{|}~+[]/"
STATISTICS = "upper digits marks strange high blanks mean_word long_word distinct repeated_lines bangs top_word line_words ends_mark n_words n_chars n_lines metadata".split()


def statistics(text: bytes, words: list[bytes], counts: dict[bytes, int], n_chars: int | None) -> list[float]:
    """Structure statistics, each from 0 to 1; an empty text has zeros."""
    size, n = max(len(text), 1), max(len(words), 1)

    def share(chars: bytes) -> float:
        return (len(text) - len(text.translate(None, chars))) / size

    lines = [x for x in text.split(b"\n") if x]
    solid = size - size * share(BLANKS)
    return [
        share(UPPER), share(DIGITS), share(MARKS), share(STRANGE), share(HIGH), share(BLANKS),
        min(solid / n / 20, 1.0), min(max(map(len, words), default=0) / 60, 1.0),
        len(counts) / n, 1 - len(set(lines)) / max(len(lines), 1), min((text.count(b"!") + text.count(b"?")) / n, 1.0),
        max(counts.values(), default=0) / n, min(n / max(len(lines), 1) / 200, 1.0),
        sum(w[-1:] in b".,;:!?" for w in words) / n,
        math.log2(n + 1) / 24, math.log2(len(text) + 1) / 28, math.log2(len(lines) + 1) / 20,
        0.0 if n_chars is None or n_chars < 0 else math.log2(n_chars + 1) / 28,
    ]


#: Statistics are cut into BINS bins each, narrower towards 0, and each bin is a feature; then the hashed words.
SIZE = WORDS + len(STATISTICS) * BINS


def features(text: bytes | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the features present, and their values; words weigh together as much as a statistic's bin does."""
    text = text or b""
    words = text.lower().split()
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    stats = np.array(statistics(text, words, counts, n_chars))
    bins = np.minimum((np.sqrt(np.clip(stats, 0, 1)) * BINS).astype(np.int64), BINS - 1)
    structure = WORDS + np.arange(len(stats)) * BINS + bins
    if not counts:
        return structure, np.ones(len(structure))
    crc = zlib.crc32
    slots = np.fromiter((crc(w) & (WORDS - 1) for w in counts), np.int64, len(counts))
    weights = np.bincount(slots, np.log1p(np.fromiter(counts.values(), np.float64, len(counts))), WORDS)
    present = np.flatnonzero(weights)
    values = weights[present]
    values /= math.sqrt(float(values @ values))
    return np.concatenate((structure, present)), np.concatenate((np.ones(len(structure)), values))


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, which: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[which]
        sums = x @ v
        return float(self.bias + self.linear[which] @ x + 0.5 * (sums @ sums - (x * x) @ (v * v).sum(axis=1)))

    def score(self, text: bytes | None, n_chars: int | None) -> float:
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.margin(*features(text, n_chars))))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.02, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Adam on the logistic loss of a bounded list of feature rows."""
    rng = np.random.default_rng(seed)
    linear, factors, bias = np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, RANK)), 0.0
    if not rows:
        return Machine(bias, linear, np.zeros_like(factors))
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    bias = math.log(share / (1 - share))
    moments = [np.zeros_like(linear), np.zeros_like(linear), np.zeros_like(factors), np.zeros_like(factors)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            which = np.concatenate([rows[i][0] for i in chosen])
            x = np.concatenate([rows[i][1] for i in chosen])
            sizes = np.array([len(rows[i][0]) for i in chosen])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            v = factors[which]
            xv = x[:, None] * v
            sums = np.add.reduceat(xv, starts)
            margin = bias + np.add.reduceat(linear[which] * x, starts) + 0.5 * ((sums**2).sum(1) - np.add.reduceat((xv**2).sum(1), starts))
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[chosen]) / len(chosen)
            each = np.repeat(error, sizes)
            slots, inverse = np.unique(which, return_inverse=True)
            g_linear = np.bincount(inverse, each * x, len(slots)) + decay * linear[slots]
            g_full = (each * x)[:, None] * (np.repeat(sums, sizes, axis=0) - xv)
            g_factors = np.stack([np.bincount(inverse, g_full[:, f], len(slots)) for f in range(RANK)], axis=1) + decay * factors[slots]
            step += 1
            fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
            for target, grad, m, s in ((linear, g_linear, *moments[:2]), (factors, g_factors, *moments[2:])):
                m[slots] = 0.9 * m[slots] + 0.1 * grad
                s[slots] = 0.999 * s[slots] + 0.001 * grad**2
                target[slots] -= rate * (m[slots] / fix1) / (np.sqrt(s[slots] / fix2) + 1e-8)
            bias -= rate * float(error.sum())
    return Machine(bias, linear, factors)


def train_quality(docs: DataFrame, labels: DataFrame, most_rows: int = 8000, folds: int = 5, label: str = "quality") -> Machine:
    """A machine fitted on at most about `most_rows` labelled rows, chosen by a hash of the id, outside the held-out fold 0.

    Rows with a null label, or ids without a document, teach nothing; an id that is
    labelled or given several times counts as often. Without any row all scores are 0.5.
    """
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where("label IN (0, 1)").where(held_out_bucket("doc_id", folds) != 0)
    sample = bounded_sample(known, "doc_id", most_rows, "quality")
    n_chars = F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.lit(None).cast("bigint")
    rows = docs.select("doc_id", "text", n_chars.alias("n_chars")).join(sample, "doc_id").select("text", "n_chars", "label", F.xxhash64("doc_id", "text", "label").alias("at"))

    def encode(batches):
        for batch in batches:
            found = [features(t.as_py(), n) for t, n in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(2), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))], ["at", "label", "which", "x"])

    # at most about most_rows rows of features, the bound of the fit
    got = rows.mapInArrow(encode, "at bigint, label int, which array<int>, x array<float>").toArrow().sort_by([("at", "ascending"), ("label", "ascending")])
    which, x = got["which"].combine_chunks(), got["x"].combine_chunks()
    edges = which.offsets.to_numpy() if len(got) else np.zeros(1, int)
    flat, values = (which.values.to_numpy().astype(np.int64), x.values.to_numpy().astype(np.float64)) if len(got) else (None, None)
    train = [(flat[a:b], values[a:b]) for a, b in zip(edges[:-1], edges[1:])]
    return fit(train, got["label"].to_numpy().astype(float))


def score_quality(docs: DataFrame, machine: Machine, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score): from 0 to 1, higher where label 1 is likelier, for every row of docs.

    Null texts count as empty and are scored as well; n_chars, if docs has it, is the
    only metadata, and may be null. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # SIZE * (RANK + 1) numbers
    kind = docs.schema[doc_id].dataType.simpleString()
    n_chars = F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.lit(None).cast("bigint")

    def score(batches):
        model = shared.value
        for batch in batches:
            found = [model.score(t.as_py(), n) for t, n in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), n_chars.alias("n_chars")).mapInArrow(score, f"doc_id {kind}, score double")
