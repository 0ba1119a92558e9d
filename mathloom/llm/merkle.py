"""Merkle manifest of a table: a tree of digests for each source and one over their roots, of which few levels are stored.

A leaf is the digest of a row. Of the trees only every third level is written; a
proof needs the levels between as well, so proof extraction goes from the top down,
subtree by subtree: the nodes of a stored level that have one stored ancestor, at most
arity ** every of them, meet in one task with what the ancestor's proof holds; the levels
between are computed again from them, their siblings are read off, and they are thrown away.

All trees of a level are worked on together, in subtrees of bounded size, so that one
source may hold any share of the rows. Places of rows in their source come from a range
partitioning and the counts of its parts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage_table

ARITY, EVERY = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def node(digests: list[bytes]) -> bytes:
    """The digest of a run: SHA-256 of the digests as hexadecimal text."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each `-` if null, else its number of bytes, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256))


def climb(digests: list[bytes], n: int, levels: int, arity: int) -> list[tuple[int, list[bytes]]]:
    """(nodes of the whole tree, those of this aligned subtree) for a level and up to `levels` above it; a level of one node is the last."""
    out = [(n, digests)]
    while n > 1 and len(out) <= levels:
        digests, n = [node(digests[i : i + arity]) for i in range(0, len(digests), arity)], -(-n // arity)
        out.append((n, digests))
    return out


def fold(leaf: bytes, siblings: list[bytes], places: list[tuple[int, int]], arity: int) -> bytes:
    """The root from a leaf, its proof and the (index, number of leaves) that it has in each tree on the way."""
    at = 0
    for index, n in places:
        while n > 1:
            first = index // arity * arity
            run, left = min(arity, n - first) - 1, index - first
            leaf = node([*siblings[at : at + left], leaf, *siblings[at + left : at + run]])
            at, index, n = at + run, index // arity, -(-n // arity)
    return leaf


@dataclass(frozen=True)
class Manifest:
    """levels[k](tree, idx, n, digest, ...): the stored levels, of trees that have more than one node below; roots(tree, digest)."""

    levels: list[DataFrame]
    roots: DataFrame
    arity: int
    every: int


def _runs(batches, *names: str):
    """(tree, block) and its rows, over batches in this order."""
    now, rows = None, []
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("tree", "block", *names)]
        for tree, block, *row in zip(*columns):
            if (tree, block) != now:
                if rows:
                    yield now, rows
                now, rows = (tree, block), []
            rows.append(row)
    if rows:
        yield now, rows


def _chunks(rows, schema: pa.Schema, most: int = 2048):
    kept = []
    for row in rows:
        kept.append(row)
        if len(kept) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), schema.types)], schema.names)
            kept = []
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), schema.types)], schema.names)


def grow(leaves: DataFrame, arity: int = ARITY, every: int = EVERY) -> Manifest:
    """leaves(tree, idx, n, digest, ...), written: their trees, of which every `every`-th level is stored."""
    schema = pa.schema([("tree", pa.int64()), ("idx", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])

    def up(batches):
        def found():
            for (tree, block), rows in _runs(batches, "n", "digest"):
                n, digests = climb([r[1] for r in rows], rows[0][0], every, arity)[-1]
                yield tree, block, n, digests[0]

        return _chunks(found(), schema)

    levels, roots = [leaves], []
    block = F.floor(F.col("idx") / F.lit(arity**every)).cast("bigint").alias("block")
    while True:
        level = levels[-1]
        roots.append(level.where("n = 1").select("tree", "digest"))
        below = level.where("n > 1").select("tree", block, "idx", "n", "digest")
        if below.isEmpty():
            break
        dealt = below.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")
        levels.append(stage_table(dealt.mapInArrow(up, "tree bigint, idx bigint, n bigint, digest binary"), "merkle-level"))
    every_root = roots[0]
    for r in roots[1:]:
        every_root = every_root.unionByName(r)
    return Manifest(levels, every_root, arity, every)


def _joined(nodes: DataFrame, above: DataFrame, span: int) -> DataFrame:
    """Nodes and, as the first row of their block, what is known of their stored ancestor: above(tree, block, known)."""
    own = nodes.withColumn("block", F.floor(F.col("idx") / F.lit(span)).cast("bigint")).withColumn("known", F.lit(None).cast("binary"))
    first = above.select(F.col("tree"), "block", F.lit(-1).cast("bigint").alias("idx"), "known")
    return own.unionByName(first, allowMissingColumns=True).repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")


def _subtree_proofs(rows, levels: int, arity: int):
    """(node's place in rows, siblings in the subtree, what is known above) for the nodes of one block: [idx, n, digest, known, ...]."""
    known, nodes = rows[0][3], rows[1:]
    steps = climb([r[2] for r in nodes], nodes[0][1], levels, arity) if nodes else []
    for at in range(len(nodes)):
        siblings, i = [], at
        for n, digests in steps[:-1]:
            first = i // arity * arity
            siblings += digests[first:i] + digests[i + 1 : first + arity]
            i //= arity
        yield at, siblings, known


def extract(manifest: Manifest, above: DataFrame, visit, schema: pa.Schema, extra: tuple[str, ...] = ()) -> DataFrame:
    """visit(tree, idx, n, digest, siblings, known, *extra) -> a row, for every leaf; above(tree, known) says what its root's proof holds.

    known is 32 bytes of the tree's root and then the siblings above a node.
    """
    arity, every = manifest.arity, manifest.every
    span = arity**every

    def down(batches):
        def found():
            for (tree, _), rows in _runs(batches, "idx", "n", "digest", "known"):
                for at, siblings, known in _subtree_proofs(rows, every, arity):
                    yield tree, rows[at + 1][0], known[:32] + b"".join(siblings) + known[32:]

        return _chunks(found(), pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("known", pa.binary())]), 256)

    def last(batches):
        def found():
            for (tree, _), rows in _runs(batches, "idx", "n", "digest", "known", *extra):
                for at, siblings, known in _subtree_proofs(rows, every, arity):
                    idx, n, digest, _, *own = rows[at + 1]
                    yield visit(tree, idx, n, digest, siblings, known, *own)

        return _chunks(found(), schema)

    # a tree that ends at a stored level takes what is above its root; others what their ancestor's level found
    tops = [level.where("n = 1").select("tree").join(above, "tree").select("tree", F.lit(0).cast("bigint").alias("block"), "known") for level in manifest.levels]
    found = tops[-1]
    for k in range(len(manifest.levels) - 1, 0, -1):
        joined = _joined(manifest.levels[k].select("tree", "idx", "n", "digest"), found, span)
        found = tops[k - 1].unionByName(stage_table(joined.mapInArrow(down, "tree bigint, block bigint, known binary"), "merkle-proofs"))
    leaves = manifest.levels[0].select("tree", "idx", "n", "digest", *extra)
    fields = ", ".join(f"`{f.name}` {_spark_type(f.type)}" for f in schema)
    return _joined(leaves, found, span).mapInArrow(last, fields)


def _spark_type(t: pa.DataType) -> str:
    return {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.string()): "array<string>"}[t]


def places(rows: DataFrame, group: str, *order: str) -> tuple[DataFrame, DataFrame]:
    """rows with `tree` (the place of their group among all groups), `idx` (their own in it) and `n` (its size); and groups(group, tree, n).

    Groups stand in ascending order, null first; rows in that of `order`, nulls first, then in any.
    """
    named = rows.withColumn("__any", F.monotonically_increasing_id())
    spread = stage_table(named, "merkle-rows").repartitionByRange(group, *order, "__any").sortWithinPartitions(group, *order, "__any")
    ordered = stage_table(spread.drop("__any").withColumn("__place", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__place", 33)), "merkle-rows")
    spans = stage_table(ordered.groupBy("__part", group).agg(F.min("__place").alias("__first"), F.count("*").alias("__n")), "merkle-spans")
    sizes = stage_table(spans.groupBy(group).agg(F.sum("__n").alias("n")), "merkle-groups")
    # no more rows of a group than there are parts
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    groups = _numbered(sizes, group)
    g = groups.select(F.col(group).alias("__g"), "tree", "n")
    known = starts.join(g, F.col(group).eqNullSafe(F.col("__g"))).select(F.col("__part").alias("__p"), "__g", "tree", "n", "__first", "__before")
    placed = ordered.join(known, (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")))
    idx = F.col("__place") - F.col("__first") + F.col("__before")
    own = [c for c in ordered.columns if not c.startswith("__")]
    return stage_table(placed.select(*own, "tree", idx.alias("idx"), "n"), "merkle-leaves"), groups


def _numbered(rows: DataFrame, by: str) -> DataFrame:
    """rows with `tree`, their place in the order of `by`, whose values differ."""
    ordered = stage_table(rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("__place", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__place", 33)), "merkle-groups")
    counts = ordered.groupBy("__part").agg(F.count("*").alias("__n"))
    # a row a part of the range partitioning
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = ordered.join(before.select("__part", "__before"), "__part")
    return stage_table(placed.withColumn("tree", F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__place", "__before"), "merkle-groups")


def prove(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", key: str = "doc_id", arity: int = ARITY, every: int = EVERY, claim_text: Column | None = None, text: str = "text", siblings: bool = False) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): the proof of every row, held against a claimed text.

    With `siblings` the proof itself comes along, as an array of digests from the leaf's level up.
    claim_text, a column of docs, is the text that somebody shows in place of the row's
    own (null: the row's own); the proof is folded from the leaf that it gives. Rows of a
    source stand in the order of their ids, those without an id first, then of their
    leaves, so that repeated rows, which have equal leaves, have equal trees in any order. A null in any
    field is a value of its own; an empty text is not null. An empty table gives an empty one,
    without a root. Columns that are not among the fields are not read.
    """
    own = [F.col(f"`{c}`") for c in fields]
    leaf = leaf_digest(own)
    claim = F.lit(None).cast("binary")
    if claim_text is not None:
        claim = F.when(claim_text.isNotNull(), leaf_digest([claim_text if c == text else F.col(f"`{c}`") for c in fields]))
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{group}`").alias("source"), leaf.alias("digest"), claim.alias("claim"))
    leaves, sources = places(rows, "source", "doc_id", "digest")
    forest = grow(leaves, arity, every)
    n_sources = sources.count()
    subroots = stage_table(forest.roots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("idx"), F.lit(n_sources).cast("bigint").alias("n"), "digest"), "merkle-subroots")
    over = grow(subroots, arity, every)
    found = over.roots.first()
    root = bytes(found["digest"]) if found else b""

    def of_source(tree, idx, n, digest, siblings, known):
        return idx, digest + b"".join(siblings) + known[32:]

    top = docs.sparkSession.createDataFrame([(0, bytearray(root))] if found else [], "tree bigint, known binary")
    above = stage_table(extract(over, top, of_source, pa.schema([("tree", pa.int64()), ("known", pa.binary())])), "merkle-above")

    kind = leaves.schema["doc_id"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    if id_type == pa.string() and kind != "string":
        raise TypeError(f"ids of type {kind} are not supported: cast {key} to bigint, int or string")

    def of_row(tree, idx, n, digest, below, known, doc_id, claim):
        subroot, rest = known[:32], known[32:]
        proof = below + [rest[i : i + 32] for i in range(0, len(rest), 32)]
        path = b"".join(proof).hex()
        folded = fold(claim or digest, proof, [(idx, n), (tree, n_sources)], arity)
        row = doc_id, digest.hex(), subroot.hex(), hashlib.sha256(path.encode()).hexdigest(), folded.hex()
        return (*row, [d.hex() for d in proof]) if siblings else row

    texts = [(c, pa.string()) for c in ("leaf", "subroot", "proof_sha256", "folded_root")]
    lists = [("siblings", pa.list_(pa.string()))] if siblings else []
    out = extract(forest, above, of_row, pa.schema([("doc_id", id_type), *texts, *lists]), ("doc_id", "claim"))
    return out.withColumn("root", F.lit(root.hex())).withColumn("verified", F.col("folded_root") == F.col("root"))
