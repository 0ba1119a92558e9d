"""Exact substring deduplication with fixed-block anchors.

A passage of at least `length` words that occurs twice holds, in each occurrence, a
whole block of b = (length + 1) // 2 words at a multiple of b in its document. The
operator indexes those non-overlapping blocks, probes them with the windows of b
words at every position of every document, and extends the hits: around each block
found elsewhere, all windows of `length` words are compared, whole, with all others
of their kind, and consecutive ones that recur form the maximal exact repeats.

Hashes travel in packed arrays, dealt by hash range, so that a passage shared by a
third of the documents adds one entry for each group of documents and no pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage_table

_RNG = np.random.Generator(np.random.PCG64(20240607))
#: Odd multipliers of the two rolling hashes, and their inverses modulo 2^64.
MULTIPLIERS = [int(m) | 1 for m in _RNG.integers(1 << 62, 1 << 63, 2)]
INVERSES = [pow(m, -1, 1 << 64) for m in MULTIPLIERS]
#: A window of full length is known by 96 bits.
PAIR = np.dtype([("a", "<u8"), ("b", "<u4")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of some texts, end to end, and the hashes of their windows."""

    def __init__(self, texts: list[bytes | None]):
        self.split = [(t or b"").split() for t in texts]
        self.sizes = np.array([len(w) for w in self.split], np.int64)
        self.ends = np.cumsum(self.sizes)
        digest = xxhash.xxh64_digest
        self.hashes = np.frombuffer(b"".join([digest(w) for words in self.split for w in words]), ">u8").astype(np.uint64)
        n = len(self.hashes)
        self.at = np.arange(n) - np.repeat(self.ends - self.sizes, self.sizes)  # place in the own document
        self.left = np.repeat(self.ends, self.sizes) - np.arange(n)  # words from here to the end of the document

    def rolling(self, width: int, which: int = 0) -> np.ndarray:
        """Hash of the `width` words from each position on; of no meaning where left < width."""
        n = len(self.hashes)
        if n < width:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, MULTIPLIERS[which], np.uint64))))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hashes * powers, dtype=np.uint64)))
            back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - width, INVERSES[which], np.uint64))))
            return _mix((sums[width:] - sums[:-width]) * back)

    def starts(self, width: int) -> np.ndarray:
        """Positions at which `width` words of one document start."""
        return np.flatnonzero(self.left >= width)


def _twice(values: np.ndarray) -> np.ndarray:
    """Distinct values, sorted; those that come more than once are given twice."""
    found, n = np.unique(values, return_counts=True)
    return np.repeat(found, np.minimum(n, 2))


def _slices(keys: np.ndarray, bits: int):
    """(slice, first, last) of sorted 64-bit keys by their highest bits."""
    if not bits:
        yield 0, 0, len(keys)
        return
    tops = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate(([True], tops[1:] != tops[:-1], [True]))) if len(keys) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(tops[a]), int(a), int(b)


def _grouped(batches, limit: int):
    """Texts of Arrow batches (last column), in lists of about `limit` bytes."""
    held, size = [], 0
    for batch in batches:
        for value in batch.column(batch.num_columns - 1).cast(pa.binary()):
            held.append(value.as_py())
            size += len(held[-1] or b"")
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


class _Plan:
    """Sizes that follow from the corpus: slices of the hash space and groups of documents."""

    def __init__(self, docs: DataFrame, text: str, group_bytes: int, slice_words: int):
        total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
        self.groups = max(1, math.ceil(total / group_bytes))
        self.bits = min(32, max(6, math.ceil(math.log2(max(1, total / 6 / slice_words)))))


def repeated_anchors(docs: DataFrame, block: int, bits: int, text: str = "text", group_bytes: int = 3_000_000) -> DataFrame:
    """(key): 64-bit hashes of the blocks of the index that some window of another place has as well."""

    def probe(batches):
        for texts in _grouped(batches, group_bytes):
            words = Words(texts)
            rolling, starts = words.rolling(block), words.starts(block)
            windows = _twice(rolling[starts])
            blocks = np.unique(rolling[starts[words.at[starts] % block == 0]])
            for kind, keys in ((0, windows), (1, blocks)):
                rows = [(s, (keys[a:b] >> np.uint64(32 - bits)).astype(np.uint32).tobytes()) for s, a, b in _slices(keys, bits)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([kind] * len(rows)), pa.array([r[1] for r in rows], pa.binary())], ["slice", "kind", "keys"])

    def meet(slices: pa.Table) -> pa.Table:
        which = slices["slice"][0].as_py()
        kinds, blobs = slices["kind"].to_pylist(), slices["keys"].to_pylist()
        windows = np.concatenate([np.frombuffer(b, np.uint32) for k, b in zip(kinds, blobs) if k == 0])
        blocks = np.unique(np.concatenate([np.frombuffer(b, np.uint32) for k, b in zip(kinds, blobs) if k == 1] or [np.zeros(0, np.uint32)]))
        windows.sort()
        again = np.unique(windows[1:][windows[1:] == windows[:-1]])
        both = np.intersect1d(again, blocks, assume_unique=True).astype(np.int64)
        return pa.table({"key": (np.int64(which) << np.int64(32)) | both})

    packed = docs.select(text).mapInArrow(probe, "slice bigint, kind bigint, keys binary")
    return packed.groupBy("slice").applyInArrow(meet, "key bigint")


def _group(docs: DataFrame, text: str, doc_id: str, groups: int) -> DataFrame:
    return docs.select(F.pmod(F.xxhash64(doc_id, text), F.lit(groups)).alias("grp"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


def _anchor_keys(rolling: np.ndarray, bits: int) -> np.ndarray:
    return (rolling >> np.uint64(32 - bits)).astype(np.int64)


def _near_anchor(words: Words, keys: np.ndarray, block: int, length: int, bits: int) -> np.ndarray:
    """Starts of the windows of `length` words that hold a block of the index with one of the (sorted) keys."""
    rolling, starts = words.rolling(block), words.starts(block)
    own = starts[words.at[starts] % block == 0]
    hit = own[np.isin(_anchor_keys(rolling[own], bits), keys)]
    marked = np.zeros(len(words.hashes) + 1, np.int64)
    first = hit - np.minimum(length - block, words.at[hit])
    np.add.at(marked, first, 1)
    np.add.at(marked, hit + 1, -1)
    near = np.flatnonzero(np.cumsum(marked[:-1]) > 0)
    return near[words.left[near] >= length]


def _window_pairs(words: Words, starts: np.ndarray, length: int) -> np.ndarray:
    pairs = np.empty(len(starts), PAIR)
    pairs["a"], pairs["b"] = words.rolling(length, 0)[starts], words.rolling(length, 1)[starts] >> np.uint64(32)
    return pairs


def _sorted_pairs(pairs: np.ndarray) -> np.ndarray:
    return pairs[np.lexsort((pairs["b"], pairs["a"]))]


def _same_as_last(pairs: np.ndarray) -> np.ndarray:
    same = np.zeros(len(pairs), bool)
    same[1:] = (pairs["a"][1:] == pairs["a"][:-1]) & (pairs["b"][1:] == pairs["b"][:-1])
    return same


def repeats(docs: DataFrame, length: int = 35, text: str = "text", doc_id: str = "doc_id", group_bytes: int = 3_000_000, slice_words: int = 4_000_000) -> DataFrame:
    """(doc_id, n_words, spans, kept): for each row the word spans that recur, and its other words joined by one space.

    Words are runs of bytes other than ASCII white space, unchanged. spans is an
    array of {start, end}: the maximal runs of words covered by windows of `length`
    words whose word sequence also starts at another place, in the same document or
    any other, as the input has them. Null and blank texts have no words, spans or
    kept words. Rows that repeat, with the same id or another, remove each other.
    An empty table gives an empty one; other columns are not read.
    """
    if length < 2:
        raise ValueError("length must be at least 2")
    block = (length + 1) // 2
    plan = _Plan(docs, text, group_bytes, slice_words)
    bits, groups = plan.bits, plan.groups
    kind = docs.schema[doc_id].dataType.simpleString()

    anchors = stage_table(repeated_anchors(docs, block, bits, text, group_bytes), "anchors")
    by_group = _group(docs, text, doc_id, groups)

    def own_blocks(batches):
        def found_in(texts, owners):
            words = Words(texts)
            rolling, starts = words.rolling(block), words.starts(block)
            own = starts[words.at[starts] % block == 0]
            pairs = np.stack((np.repeat(np.array(owners, np.int64), words.sizes)[own], _anchor_keys(rolling[own], bits)), axis=1)
            pairs = np.unique(pairs, axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["grp", "key"])

        for batch in batches:
            texts, owners, size = [], [], 0
            for owner, value in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary())):
                texts.append(value.as_py())
                owners.append(owner)
                size += len(texts[-1] or b"")
                if size >= group_bytes:
                    yield found_in(texts, owners)
                    texts, owners, size = [], [], 0
            if texts:
                yield found_in(texts, owners)

    held = by_group.mapInArrow(own_blocks, "grp bigint, key bigint").distinct()
    hits = held.join(anchors, "key").select("grp", "key")

    def candidates(key, texts: pa.Table, keys: pa.Table) -> pa.Table:
        rows: list[tuple[int, bytes]] = []
        wanted = np.sort(keys["key"].to_numpy())
        if len(texts) and len(wanted):
            words = Words([v.as_py() for v in texts["text"].cast(pa.binary())])
            pairs = _sorted_pairs(_window_pairs(words, _near_anchor(words, wanted, block, length, bits), length))
            same = _same_as_last(pairs)
            third = np.zeros(len(pairs), bool)
            third[2:] = same[2:] & same[1:-1]
            pairs = pairs[~third]
            rows = [(s, pairs[a:b].tobytes()) for s, a, b in _slices(pairs["a"], bits)]
        return pa.table({"slice": pa.array([r[0] for r in rows], pa.int64()), "grp": pa.array([key[0].as_py()] * len(rows), pa.int64()), "pairs": pa.array([r[1] for r in rows], pa.binary())})

    grouped = by_group.groupBy("grp").cogroup(hits.groupBy("grp"))
    packed = grouped.applyInArrow(candidates, "slice bigint, grp bigint, pairs binary")

    def confirm(slices: pa.Table) -> pa.Table:
        owners, blobs = slices["grp"].to_pylist(), [np.frombuffer(b, PAIR) for b in slices["pairs"].to_pylist()]
        pairs = np.concatenate(blobs)
        owner = np.repeat(owners, [len(b) for b in blobs])
        order = np.lexsort((pairs["b"], pairs["a"]))
        pairs, owner = pairs[order], owner[order]
        same = _same_as_last(pairs)
        same[:-1] |= same[1:]
        pairs, owner = pairs[same], owner[same]
        order = np.argsort(owner, kind="stable")
        pairs, owner = pairs[order], owner[order]
        edges = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True]))) if len(owner) else np.zeros(1, int)
        # inside one group of documents the first 64 bits tell its windows apart
        found = [(int(owner[a]), np.unique(pairs["a"][a:b]).tobytes()) for a, b in zip(edges[:-1], edges[1:])]
        return pa.table({"grp": pa.array([f[0] for f in found], pa.int64()), "hashes": pa.array([f[1] for f in found], pa.binary())})

    confirmed = stage_table(packed.groupBy("slice").applyInArrow(confirm, "grp bigint, hashes binary"), "repeats")
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(key, texts: pa.Table, found: pa.Table) -> pa.Table:
        words = Words([v.as_py() for v in texts["text"].cast(pa.binary())])
        covered = np.zeros(len(words.hashes) + 1, np.int64)
        if len(found):
            known = np.concatenate([np.frombuffer(b, np.uint64) for b in found["hashes"].to_pylist()])
            starts = words.starts(length)
            starts = starts[np.isin(words.rolling(length, 0)[starts], known)]
            np.add.at(covered, starts, 1)
            np.add.at(covered, starts + length, -1)
        gone = np.cumsum(covered[:-1]) > 0
        n_words, spans, kept = [], [], []
        for own, end, size in zip(words.split, words.ends.tolist(), words.sizes.tolist()):
            mask = gone[end - size : end]
            if mask.any():
                edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8))).tolist()
                spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2])])
                own = [w for w, g in zip(own, mask.tolist()) if not g]
            else:
                spans.append([])
            n_words.append(size)
            kept.append(b" ".join(own).decode())
        return pa.table({"doc_id": texts["doc_id"], "n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, span_type), "kept": pa.array(kept, pa.string())})

    return by_group.groupBy("grp").cogroup(confirmed.groupBy("grp")).applyInArrow(cut, f"doc_id {kind}, n_words bigint, spans array<struct<start: bigint, end: bigint>>, kept string")

