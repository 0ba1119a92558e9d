"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

Documents are streamed through the automaton, which keeps at each word the longest
stretch of words ending there that some test item contains. A window is `window`
consecutive words of an item (the whole item if it is shorter, but not empty).
Test items are taken in blocks of a bounded number of words, one automaton each.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import private, stage_table

#: Bytes to word bytes: A-Z to lower case, every other ASCII byte but 0-9 and a-z to a blank.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NORMAL_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # of a text in lower case


def normal_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


class ItemAutomaton:
    """Suffix automaton of all items of a block, over word numbers."""

    def __init__(self, items: list[tuple[object, bytes | None]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        worded = [(key, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in normal_words(text)]) for key, text in items]
        worded = [(key, ids) for key, ids in worded if ids]
        for _, ids in worded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.ends: list[list[tuple[int, object]]] = [[] for _ in self.next]  # (length, item) of the windows a state stands for
        for key, ids in worded:
            want = min(window, len(ids))
            state = length = 0
            for c in ids:
                state, length = self._step(state, length, c)
                if length >= want:
                    at = state
                    while self.length[self.link[at]] >= want:
                        at = self.link[at]
                    if (want, key) not in self.ends[at]:
                        self.ends[at].append((want, key))
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        self.above: list[list[tuple[int, object]]] = [[] for _ in self.next]  # windows of the states that a state's links lead to
        for s in order:
            self.above[s] = self.above[self.link[s]] + self.ends[self.link[s]] if self.ends[self.link[s]] else self.above[self.link[s]]
        pairs = {a * len(self.vocabulary) + b for _, ids in worded for a, b in zip(ids, ids[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.least = min((min(window, len(ids)) for _, ids in worded), default=0)

    def _new(self, length: int, nexts: dict[int, int], link: int) -> int:
        self.next.append(nexts)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state reached from p by c, made to hold no longer strings than p's with c."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def _step(self, state: int, length: int, c: int) -> tuple[int, int]:
        while state and c not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if c in self.next[state]:
            return self.next[state][c], length + 1
        return 0, 0

    def windows(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set]:
        """Spans (start, end) of the words hit by windows, joined where they touch, and the items they come from."""
        spans: list[tuple[int, int]] = []
        items: set = set()
        if not self.least or len(ids) < self.least:
            return spans, items
        # words can only match in runs whose neighbours also stand side by side in some item
        known = ids >= 0
        if len(self.pairs) and len(ids) > 1:
            code = ids[:-1] * len(self.vocabulary) + ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            tied = known[:-1] & known[1:] & (self.pairs[at] == code)
        else:
            tied = np.zeros(max(len(ids) - 1, 0), bool)
        cut = np.flatnonzero(~tied) + 1
        starts, stops = np.concatenate(([0], cut)), np.concatenate((cut, [len(ids)]))
        keep = (stops - starts >= self.least) & known[starts]
        for a, b in zip(starts[keep].tolist(), stops[keep].tolist()):
            state = length = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                state, length = self._step(state, length, c)
                hit = 0
                for want, key in self.above[state]:
                    items.add(key)
                    hit = max(hit, want)
                for want, key in self.ends[state]:
                    if want <= length:
                        items.add(key)
                        hit = max(hit, want)
                if hit:
                    if spans and i + 1 - hit <= spans[-1][1]:
                        start = spans[-1][0]
                        while spans and i + 1 - hit <= spans[-1][1]:
                            start = min(start, spans.pop()[0], i + 1 - hit)
                        spans.append((start, i + 1))
                    else:
                        spans.append((i + 1 - hit, i + 1))
        return spans, items

    def number(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))


SPANS = "array<struct<start: bigint, end: bigint>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int) -> tuple[DataFrame, int]:
    """The items, numbered by block, and the number of blocks of about block_chars characters."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("words")).where("words IS NOT NULL").distinct()
    total = items.agg(F.coalesce(F.sum(F.length("words")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / block_chars))
    return items.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks))), blocks


def _one_block(numbered: DataFrame, block: int) -> list[tuple]:
    """The items of a block, of bounded size: the test set, a stated query set, is taken block by block."""
    rows = numbered.where(F.col("block") == block).orderBy("item", "words").collect()
    return [(r["item"], r["words"].encode()) for r in rows]


def _scanner(shared, window: int, every: bool):
    """A function over batches whose last column holds texts: the other columns, n_words, spans and items; without `every` only rows with hits."""

    def scan(batches):
        machine = ItemAutomaton(shared.value, window)  # built once a partition
        for batch in batches:
            n_words, spans, found = [], [], []
            for value in batch.column(batch.num_columns - 1).cast(pa.binary()):
                words = normal_words(value.as_py())
                hits, items = machine.windows(machine.number(words))
                n_words.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in hits])
                found.append(sorted(k for k in items if k is not None))
            more = [pa.array(n_words, pa.int64()), pa.array(spans, _SPAN_TYPE), pa.array(found, pa.list_(pa.string()))]
            out = pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], [*batch.schema.names[:-1], "n_words", "spans", "items"])
            yield out if every else out.filter(pa.array([bool(s) for s in spans], pa.bool_()))

    return scan


def _merged(spans: str):
    """Column: an array of spans, sorted, with those that touch joined."""
    empty = F.array().cast(SPANS)

    def add(done, s):
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= s["start"]), grown).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), empty, add)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = 4_000_000) -> DataFrame:
    """docs and the columns n_words, spans (array of {start, end}, in words) and items (sorted ids as strings) of its hits.

    Null texts have no words; items without words have no windows; items without an
    id hit words, but are not listed; repeated items count once an id. An item id with
    several texts counts as one item. Columns of docs with these names are replaced.
    Empty tables give no hits. A benchmark of several blocks takes one pass over the
    texts for each: one block at a time is brought to the driver, broadcast and made
    into one automaton a partition; the hits of a text are then put together by its digest.
    """
    numbered, blocks = item_blocks(benchmark, item_id, item_text, block_chars)
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    own, of = private(docs, "__text"), [F.col(f"`{c}`") for c in kept]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    found = f"n_words bigint, spans {SPANS}, items array<string>"
    first = spark.sparkContext.broadcast(_one_block(numbered, 0))
    scanned = docs.select(*of, F.col(text).alias(own)).mapInArrow(_scanner(first, window, True), f"{fields}, {found}" if kept else found)
    if blocks == 1:
        return scanned
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    parts = []
    for b in range(blocks):
        shared = first if b == 0 else spark.sparkContext.broadcast(_one_block(numbered, b))
        hits = docs.select(digest.alias("digest"), F.col(text).alias("text")).mapInArrow(_scanner(shared, window, False), f"digest string, {found}")
        parts.append(stage_table(hits.groupBy("digest").agg(F.first("spans").alias("spans"), F.first("items").alias("items")), f"block-{b}"))
        if b:
            shared.destroy()
    every = functools.reduce(DataFrame.unionByName, parts).groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    mark, spans, items = (private(docs, c) for c in ("__digest", "__spans", "__items"))
    joined = every.select(F.col("digest").alias(mark), _merged("spans").alias(spans), F.col("items").alias(items))
    counted = docs.withColumn(mark, digest).select(*of, mark, F.size(F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")).cast("bigint").alias("n_words"))
    out = counted.join(joined, mark, "left")
    return out.select(*of, "n_words", F.coalesce(spans, F.array().cast(SPANS)).alias("spans"), F.coalesce(items, F.array().cast("array<string>")).alias("items"))


def hit_words():
    """Column: the number of words inside spans."""
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, span_limit: int = 0, coverage_limit: float = 0.0, **columns) -> DataFrame:
    """The rows of docs that stay, with the columns of docs: those where no hit span is longer than
    span_limit words and no larger share of the words than coverage_limit is hit.

    With both limits 0, every document with a hit goes. Rows without words stay.
    """
    own = {c: f"__own_{c}" for c in ("n_words", "spans", "items") if c in docs.columns}
    found = contamination(docs.withColumnsRenamed(own), benchmark, window, **columns)
    longest = F.coalesce(F.array_max(F.transform("spans", lambda s: s["end"] - s["start"])), F.lit(0))
    stay = (longest <= span_limit) & (hit_words() <= F.col("n_words") * F.lit(float(coverage_limit)))
    return found.where(stay).select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])



def _without(text: bytes, spans: list[dict]) -> bytes:
    """A text without the words of some spans, and what stands between these."""
    places = [m.span() for m in NORMAL_WORD.finditer(text.lower())]
    out, at = [], 0
    for span in spans:
        out.append(text[at : places[span["start"]][0]])
        at = places[span["end"] - 1][1]
    return b"".join([*out, text[at:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, span_limit: int = 0, coverage_limit: float = 1.0, text: str = "text", **columns) -> DataFrame:
    """docs with every hit span of more than span_limit words cut out of its text, but for the rows of which a larger
    share of the words than coverage_limit is hit: these go.

    Other rows stay as they are. n_chars, if docs has it, follows where the text changes.
    """
    own = {c: private(docs, f"__own_{c}") for c in ("n_words", "spans", "items") if c in docs.columns}
    renamed = docs.withColumnsRenamed(own)
    found = contamination(renamed, benchmark, window, text=own.get(text, text), **columns).where(hit_words() <= F.col("n_words") * F.lit(float(coverage_limit)))
    cut = private(renamed, "__cut")
    found = found.withColumn(cut, F.filter("spans", lambda s: s["end"] - s["start"] > span_limit))
    kept = found.columns
    fields = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in kept)
    where, what = kept.index(own.get(text, text)), kept.index(cut)

    def trim(batches):
        for batch in batches:
            texts = batch.column(where)
            if any(len(s) for s in batch.column(what)):
                texts = pa.array([_without(t.as_py().encode(), s.as_py()).decode() if len(s) else t.as_py() for t, s in zip(texts, batch.column(what))], pa.string())
            columns = list(batch.columns)
            columns[where] = texts
            yield pa.RecordBatch.from_arrays(columns, kept)

    trimmed = found.mapInArrow(trim, fields)
    if "n_chars" in docs.columns:
        trimmed = trimmed.withColumn("n_chars", F.when(F.size(cut) > 0, F.char_length(F.col(own.get(text, text))).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return trimmed.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])
