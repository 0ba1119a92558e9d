"""Secret scans with a trigram inverted index.

Each rule is a regular expression with a Boolean trigram query (an AND of ORs of
ANDs) that every text with a match must satisfy. Documents are taken in segments;
a segment's index maps the trigrams of all queries to the documents that have them,
posting lists are intersected and united as the queries say, and the regular
expression verifies the candidates. A rule without mandatory trigrams scans all
documents of the segment. Segments are independent, so nothing is shuffled.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as _c
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import private


#: Strings a query may stand for are enumerated up to this many; beyond, the query is only made weaker.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    keep: Callable[[re.Match], bool] = lambda m: True
    flags: int = re.ASCII


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The base rules, in the order in which kinds are listed.
BASE = (
    Rule("assign", "(" + "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), _any_case("api") + "_?" + _any_case("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Public formats of further credentials. Schemes and token headers have a longest length, so that
#: a long run of their characters takes linear time.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosted_token", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,250}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_password", r"[a-z][a-z0-9+.-]{0,15}://[^\x09-\x0D\x20/:@]+:[^\x09-\x0D\x20/:@]+@"),
)
RULES = BASE + MORE

Query = frozenset  # of alternatives, each a frozenset of trigrams that must all be there; {frozenset()} is "always"
ALWAYS: Query = frozenset({frozenset()})


def _least(a: Query) -> Query:
    """a without alternatives that hold another one: these add nothing."""
    return frozenset(x for x in a if not any(y < x for y in a))


def _and(a: Query, b: Query) -> Query:
    both = _least(frozenset(x | y for x in a for y in b))
    return both if len(both) <= MOST_STRINGS else a


def _or(a: Query, b: Query) -> Query:
    return _least(a | b)


def _grams(text: str) -> frozenset:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _strings_query(strings: frozenset) -> Query:
    """One alternative for each string: all its trigrams; ALWAYS if some string is too short to have any."""
    return ALWAYS if any(len(s) < 3 for s in strings) else frozenset(_grams(s) for s in strings)


def _walk(parsed) -> tuple[frozenset | None, Query]:
    """All (lower-cased) strings that a piece of a pattern stands for, None if unbounded, and a query that its matches satisfy."""
    exact: frozenset | None = frozenset({""})
    query = ALWAYS

    def flush(run: frozenset | None) -> None:
        nonlocal query
        if run:
            query = _and(query, _strings_query(run))

    for op, value in parsed:
        strings: frozenset | None = None
        inner = ALWAYS
        if op is _c.LITERAL:
            strings = frozenset({chr(value).lower()})
        elif op is _c.IN:
            chars = {chr(v).lower() for o, v in value if o is _c.LITERAL}
            if all(o is _c.LITERAL for o, _ in value) and len(chars) <= 8:
                strings = frozenset(chars)
        elif op is _c.SUBPATTERN:
            strings, inner = _walk(value[3])
        elif op is _c.BRANCH:
            parts = [_walk(p) for p in value[1]]
            if all(s is not None for s, _ in parts):
                strings = frozenset().union(*(s for s, _ in parts))
            else:
                owns = [_and(q, _strings_query(s)) if s is not None else q for s, q in parts]
                inner = functools.reduce(_or, owns)
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
            low, high, body = value
            s, q = _walk(body)
            if s is not None and low == 0 and high == 1:
                strings = s | {""}
            elif s is not None and low == high and low <= 4:
                strings = frozenset({""})
                for _ in range(low):
                    strings = frozenset(x + y for x in strings for y in s)
            elif low:
                inner = _and(q, _strings_query(s)) if s is not None else q
        elif op is _c.AT:
            strings = frozenset({""})
        query = _and(query, inner)
        if strings is not None and exact is not None and len(exact) * len(strings) <= MOST_STRINGS:
            exact = frozenset(x + y for x in exact for y in strings)
            continue
        flush(exact)
        exact = strings
    if exact is not None and query == ALWAYS:
        return exact, query
    flush(exact)
    return None, query


def trigram_query(pattern: str) -> Query:
    """Alternatives of lower-case trigrams, one of which a text must hold entirely to match; ALWAYS if there is no such need.

    Trigrams with letters beyond ASCII are left out, as lower case is taken byte by byte.
    """
    strings, query = _walk(_parser.parse(pattern))
    if strings is not None:
        query = _and(query, _strings_query(strings))
    ascii_only = frozenset(frozenset(g for g in alternative if g.isascii()) for alternative in query)
    return ALWAYS if frozenset() in ascii_only else ascii_only


class SegmentScanner:
    """Builds the index of one segment at a time and finds the verified spans of all rules in it."""

    def __init__(self, rules=RULES):
        self.rules = [(r, re.compile(r.pattern, r.flags), trigram_query(r.pattern)) for r in rules]
        grams = sorted({g for _, _, q in self.rules for alternative in q for g in alternative})
        self.number = {g: k for k, g in enumerate(grams)}
        self.slot = np.full(1 << 24, -1, np.int16)
        for g, k in self.number.items():
            self.slot[int.from_bytes(g.encode(), "big")] = k

    def postings(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each trigram of the queries, the sorted numbers of the texts that have it in any case."""
        data = np.frombuffer(b"\xff".join(texts).lower(), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        found = []
        for at in range(0, max(len(data) - 2, 0), 1 << 21):
            part = data[at : at + (1 << 21) + 2].astype(np.int32)
            slots = self.slot[(part[:-2] << 16) | (part[1:-1] << 8) | part[2:]]
            where = np.flatnonzero(slots >= 0)
            owner = np.searchsorted(ends, where + at, side="right")
            found.append(np.unique(slots[where].astype(np.int64) * len(texts) + owner))
        keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        edges = np.searchsorted(keys, np.arange(len(self.number) + 1) * len(texts))
        return [keys[a:b] - k * len(texts) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]

    def candidates(self, query: Query, postings: list[np.ndarray], n: int) -> np.ndarray:
        if query == ALWAYS:
            return np.arange(n)
        lists = []
        for alternative in query:
            shortest, *others = sorted((postings[self.number[g]] for g in alternative), key=len)
            for other in others:
                shortest = np.intersect1d(shortest, other, assume_unique=True)
            lists.append(shortest)
        return np.unique(np.concatenate(lists))

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, rule number, end) in code points, sorted."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not texts:
            return out
        postings = self.postings(texts)
        for k, (rule, regex, query) in enumerate(self.rules):
            for i in self.candidates(query, postings, len(texts)).tolist():
                text = texts[i].decode()
                out[i] += [(m.start(), k, m.end()) for m in regex.finditer(text) if rule.keep(m)]
        for spans in out:
            spans.sort()
        return out


def find_secrets(docs: DataFrame, rules=RULES, text: str = "text", segment_bytes: int = 4_000_000) -> DataFrame:
    """docs and a column secrets: array of {kind, start, end}, in code points, by start and then the order of the rules.

    Null and empty texts have none. Matches of one rule do not overlap; those of
    different rules may. A column of docs named secrets is replaced. Every row,
    repeated ones too, comes back once; an empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c != "secrets"]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        scanner = SegmentScanner(rules)
        for batch in batches:
            found: list = []
            segment: list[bytes] = []
            size = 0
            for value in batch.column(len(kept)).cast(pa.binary()):
                segment.append(value.as_py() or b"")
                size += len(segment[-1])
                if size >= segment_bytes:
                    found += scanner.scan(segment)
                    segment, size = [], 0
            found += scanner.scan(segment)
            spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in row] for row in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(spans, span_type)], [*kept, "secrets"])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias(private(docs, "__text"))).mapInArrow(scan, f"{fields}, secrets array<struct<kind: string, start: bigint, end: bigint>>")


def _with_spans(docs: DataFrame, rules, text: str) -> tuple[DataFrame, list]:
    """docs with its spans, and docs' own columns (one that is named secrets is set aside meanwhile)."""
    own = {"secrets": private(docs, "__own_secrets")} if "secrets" in docs.columns else {}
    return find_secrets(docs.withColumnsRenamed(own), rules, text), [(own.get(c, c), c) for c in docs.columns]


def drop_secrets(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The rows of docs without any secret, with the columns of docs."""
    found, own = _with_spans(docs, rules, text)
    return found.where(F.size("secrets") == 0).select(*[F.col(f"`{a}`").alias(c) for a, c in own])


def redact_secrets(docs: DataFrame, rules=RULES, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every secret span replaced by `mask` (overlapping spans by one); n_chars, if docs has it, follows where the text changes."""
    found, own = _with_spans(docs, rules, text)
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at"))

    def cut(state, span):
        before = F.substring(F.col(f"`{text}`"), (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        piece = F.when(span["start"] >= state["at"], F.concat(before, F.lit(mask))).otherwise(F.lit(""))
        return F.when(span["end"] <= state["at"], state).otherwise(F.struct(F.concat(state["done"], piece).alias("done"), span["end"].alias("at")))

    done = private(found, "__cut")
    found = found.withColumn(done, F.aggregate("secrets", start, cut))
    whole = F.concat(F.col(f"{done}.done"), F.substring(F.col(f"`{text}`"), (F.col(f"{done}.at") + 1).cast("int"), F.length(F.col(f"`{text}`"))))
    found = found.withColumn(text, F.when(F.size("secrets") > 0, whole).otherwise(F.col(f"`{text}`")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(F.size("secrets") > 0, F.char_length(text).cast(kind)).otherwise(F.col("n_chars")))
    return found.select(*[F.col(f"`{a}`").alias(c) for a, c in own])
