"""Merkle trees by checkpoint and recompute against a plain tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from mathloom.llm import merkle
from tests.llm.test_operators import ODD, SCHEMA


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    fields = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(leaves, arity):
    """The root, and for each leaf the levels of (left, right) siblings."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for p, i in zip(paths, at):
            first = i // arity * arity
            p.append((level[first:i], level[i + 1 : first + arity]))
        at = [i // arity for i in at]
        level = [sha("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
    return level[0], paths


def tampered(row):
    if row["doc_id"] is None or row["text"] is None or zlib.crc32(str(row["doc_id"]).encode()) % 5:
        return row["text"]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"])


def brute(rows, arity):
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted(sources[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]))) for s in names]
    trees = [tree([leaf(r, r["text"]) for r in g], arity) for g in groups]
    root, tops = tree([t[0] for t in trees], arity)
    out = []
    for g, (subroot, paths), top in zip(groups, trees, tops):
        for r, path in zip(g, paths):
            folded = leaf(r, tampered(r))
            for left, right in path + top:
                folded = sha("".join([*left, folded, *right]))
            proof = [d for left, right in path + top for d in left + right]
            out.append((r["doc_id"], leaf(r, r["text"]), subroot, root, sha("".join(proof)), folded, folded == root, proof))
    return sorted(out, key=repr)


def found(docs, **more):
    claim = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    rows = merkle.prove(docs, claim_text=claim, siblings=True, **more)
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "siblings")
    return sorted((tuple(r[c] for c in names) for r in rows.collect()), key=repr)


# every: how many levels from one stored level to the next
@pytest.mark.parametrize("arity,every", [(16, 3), (16, 1), (2, 3), (3, 2)])
def test_matches_a_plain_tree(spark, arity, every):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute(docs.collect(), arity)
    assert found(docs, arity=arity, every=every) == want
    assert {r[6] for r in want} == {True, False}


def test_many_sources_and_sizes(spark):
    rows = []
    for s, n in enumerate([1, 2, 3, 4, 5, 8, 9, 16, 17, 27, 28, 64, 65] + [1] * 30):
        rows += [(len(rows) + i, f"Text {i}", None if i % 3 else "en", None if s == 2 else f"s{s}é"[: 1 + s % 5], i) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)
    for arity, every in ((2, 2), (3, 1), (16, 3)):
        assert found(docs, arity=arity, every=every) == brute(docs.collect(), arity)


def test_odd_tables(spark):
    odd = spark.createDataFrame(ODD, SCHEMA).withColumnsRenamed({"spans": "digest", "secrets": "tree", "families": "idx"})
    assert found(odd, arity=2, every=2) == brute(odd.collect(), 2)
    assert found(odd.limit(0)) == []
    assert found(odd.limit(1)) == brute(odd.limit(1).collect(), 16)
    same = spark.createDataFrame([(1, "x", "en", "s", 1)] * 40, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert found(same, arity=3, every=2) == brute(same.collect(), 3)


def test_a_proof_shows_any_change(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    changed = merkle.prove(docs, claim_text=F.concat("text", F.lit(" ")))
    assert changed.where("verified").count() == 0
    assert merkle.prove(docs).where("NOT verified").count() == 0


def test_few_levels_are_stored(spark):
    rows = spark.range(1000).selectExpr("0L AS tree", "id AS idx", "1000L AS n", "unhex(sha2(CAST(id AS STRING), 256)) AS digest")
    manifest = merkle.grow(rows, arity=2, every=4)
    assert [level.count() for level in manifest.levels] == [1000, 63, 4, 1] and manifest.roots.count() == 1
