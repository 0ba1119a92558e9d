"""Near-duplicates by shared word shingles: all pairs of texts of a Jaccard similarity of at least 0.8, SimHash links first.

Two texts are near if the sets of their five-word shingles are. SimHash fingerprints
of those sets, linked by the generalised pigeonhole index of simhash.py, propose most
pairs cheaply; but texts at 0.8 often differ in more bits than an index can bear, so
a second search finds every other pair. It puts all shingles in one order, rare ones
first: two near sets of sizes a and b share one of their first a // 5 + 1 and b // 5 + 1
shingles in that order. Rare means a low count of the shingle's slot in a table of
fixed size over all shingles of all texts; any order is right, a good one is fast.

Proposed pairs are compared by their sizes and by the parities of their shingles in
512 slots, which bound how much they differ, and what remains by the whole sets.

All who share a key first meet the least of them. Where that leaves several groups,
as among many edited copies of a text, each text has to meet every text of the other
groups: those pairs are never made as rows. A key's texts are dealt into tiles of bounded
size, in which sizes and parities are compared in compiled code, and only pairs that
pass leave the tile.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import FREQUENT, by_slots, connected_components, join_frequent
from .shared import private, stage_table
from .simhash import near_links
from .substrings import Words

SHINGLE = 5
#: Slots of the table of counts, as a power of two.
COUNT_BITS = 18
#: Bytes of the sketches that are compared in tiles.
BRIEF = 64
#: Texts of a key on one side of a tile, about.
TILE_ROWS = 4096
#: Pairs that a tile compares at once.
PAIRS_AT_ONCE = 20_000


def hashed_shingles(texts: list[bytes | None], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of all word runs of some texts (ASCII letters in lower case), in text order; a shorter text is one run, a blank one has none."""
    words = Words([(t or b"").lower() for t in texts])
    number = np.repeat(np.arange(len(texts)), words.sizes)
    owners, hashes = [], []
    first = words.ends - words.sizes
    for width in range(1, shingle + 1):
        if width < shingle:
            starts = first[words.sizes == width]
        else:
            starts = words.starts(shingle)
        if len(starts):
            owners.append(number[starts])
            hashes.append(words.rolling(width)[starts])
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(hashes)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


class ShingleSets:
    """The distinct shingles of some texts, each text's in one order: by the count of their slots, then by value."""

    def __init__(self, texts: list[bytes | None], counts: np.ndarray | None = None, shingle: int = SHINGLE):
        owner, hashes = hashed_shingles(texts, shingle)
        if counts is None:
            order = np.lexsort((hashes, owner))
        else:
            order = np.lexsort((hashes, counts[_slots(hashes)], owner))
        owner, hashes = owner[order], hashes[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
        self.owner, self.hashes = owner[new], hashes[new]
        self.sizes = np.bincount(self.owner, minlength=len(texts)).astype(np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes

    def prefixes(self) -> tuple[np.ndarray, np.ndarray]:
        """How many keys each text has, and the keys: its first size // 5 + 1 shingles; a blank text has the key 0."""
        lengths = self.sizes // 5 + 1
        rank = np.arange(len(self.owner)) - self.firsts[self.owner]
        keys = np.zeros(int(lengths.sum()), np.uint64)
        blank = np.repeat(self.sizes == 0, lengths)
        keys[~blank] = self.hashes[rank < lengths[self.owner]]
        return lengths, keys

    def sketches(self) -> list[bytes]:
        """The parities of how many shingles of a text fall into each of some slots, as bits: 512, or the power of two from the set's size on."""
        width = np.maximum(512, 1 << np.ceil(np.log2(np.maximum(self.sizes, 1))).astype(np.int64))
        ends = np.cumsum(width)
        cells = (ends - width)[self.owner] + (self.hashes & (width[self.owner] - 1).astype(np.uint64)).astype(np.int64)
        odd = (np.bincount(cells, minlength=int(width.sum())) & 1).astype(np.uint8)
        data = np.packbits(odd, bitorder="little").tobytes()
        return [data[(b - w) // 8 : b // 8] for b, w in zip(ends.tolist(), width.tolist())]

    def fingerprints(self) -> np.ndarray:
        """SimHash of each set as a signed long: a bit is set where over half the shingles have it."""
        out = np.zeros(len(self.sizes), np.int64)
        full = np.flatnonzero(self.sizes)
        if len(full):
            bits = np.unpackbits(self.hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            votes = np.add.reduceat(bits, self.firsts[full], axis=0, dtype=np.int32)
            packed = np.packbits(votes * 2 > self.sizes[full][:, None], axis=1)
            out[full] = packed.view(">u8").ravel().astype(np.uint64).view(np.int64)
        return out


def may_be_near(a_size: int, b_size: int, a: bytes, b: bytes) -> bool:
    """Whether two sets may be near by their sizes and sketches: they differ in at least as many elements as the sketches do in bits."""
    if 5 * min(a_size, b_size) < 4 * max(a_size, b_size):
        return False
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    wide, narrow = max(len(a), len(b)) * 8, min(len(a), len(b)) * 8
    if len(a) < len(b):
        x, y = y, x
    while wide > narrow:  # the halves of a sketch make that of half the width
        wide //= 2
        x = (x >> wide) ^ (x & ((1 << wide) - 1))
    return 9 * (x ^ y).bit_count() <= a_size + b_size


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is at least 0.8, in whole numbers; two empty sets are alike."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def _by_bytes(batch: pa.RecordBatch, most: int = 1_000_000):
    """(first row, texts) of pieces of a batch whose last column holds texts, of about `most` bytes each."""
    texts, size, at = [], 0, 0
    for k, value in enumerate(batch.column(batch.num_columns - 1).cast(pa.binary())):
        texts.append(value.as_py())
        size += len(texts[-1] or b"")
        if size >= most:
            yield at, texts
            texts, size, at = [], 0, k + 1
    if texts:
        yield at, texts


def shingle_counts(texts: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """How many shingles of all texts (their only column) fall into each slot: 2 ** COUNT_BITS numbers at any size."""

    def count(batches):
        table = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for _, piece in _by_bytes(batch):
                table += np.bincount(_slots(hashed_shingles(piece, shingle)[1]), minlength=len(table))
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(table[used])], ["slot", "n"])

    got = texts.mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << COUNT_BITS, np.int64)
    table[got["slot"].to_numpy()] = got["n"].to_numpy()
    return table


def shingle_rows(texts: DataFrame, counts: np.ndarray, shingle: int = SHINGLE) -> DataFrame:
    """texts(..., node, text) -> its columns but text, and size, sketch, fp and keys of each text's set."""
    kept = texts.columns[:-1]
    fields = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in kept)
    shared = texts.sparkSession.sparkContext.broadcast(np.minimum(counts, 2**31 - 1).astype(np.int32))  # of fixed size

    def known(batches):
        for batch in batches:
            for at, piece in _by_bytes(batch):
                sets = ShingleSets(piece, shared.value, shingle)
                lengths, keys = sets.prefixes()
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(keys.view(np.int64)))
                own = batch.slice(at, len(piece)).columns[: len(kept)]
                marks = [pa.array(sets.sizes), pa.array(sets.sketches(), pa.binary()), pa.array(sets.fingerprints())]
                yield pa.RecordBatch.from_arrays([*own, *marks, lists], [*kept, "size", "sketch", "fp", "keys"])

    return texts.mapInArrow(known, f"{fields}, size bigint, sketch binary, fp bigint, keys array<bigint>")


def _admitted(batches):
    for batch in batches:
        keep = [may_be_near(*row) for row in zip(*(batch.column(k).to_pylist() for k in range(2, 6)))]
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _compared(shingle: int):
    def compare(batches):
        last, own = None, None
        for batch in batches:
            us, vs = [], []
            for u, v, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())):
                if u != last:
                    last, own = u, ShingleSets([a.as_py()], None, shingle).hashes
                if near(own, ShingleSets([b.as_py()], None, shingle).hashes):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return compare


def near_pairs(pairs: DataFrame, sets: DataFrame, texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The pairs (u, v) of nodes whose texts are near: those that size and sketch admit are compared by their whole sets."""
    marks = sets.select("node", "size", "sketch")
    ordered = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    sized = ordered.join(marks.toDF("u", "a", "x"), "u").join(marks.toDF("v", "b", "y"), "v").where("5 * least(a, b) >= 4 * greatest(a, b)")
    likely = stage_table(sized.select("u", "v", "a", "b", "x", "y").mapInArrow(_admitted, "u bigint, v bigint"), "likely")
    wanted = likely.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    found = stage_table(by_slots(texts, "node", wanted, "left_semi").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "compared-texts")
    left, right = found.toDF("u", "a"), found.toDF("v", "b")
    return stage_table(likely.join(right, "v").join(left, "u").select("u", "v", "a", "b").mapInArrow(_compared(shingle), "u bigint, v bigint"), "near-pairs")


def simhash_pairs(sets: DataFrame, most: int) -> DataFrame:
    """(u, v): nodes of equal fingerprints with the least of them, and the least nodes of fingerprints within `most` bits."""
    prints = stage_table(sets.groupBy("fp").agg(F.min("node").alias("u")), "prints")
    alike = sets.select("fp", F.col("node").alias("v")).join(prints, "fp").where("u <> v").select("u", "v")
    links = near_links(prints.select("fp"), most)
    across = links.join(prints.select(F.col("fp").alias("u"), F.col("u").alias("a")), "u").join(prints.select(F.col("fp").alias("v"), F.col("u").alias("b")), "v")
    return alike.unionByName(across.select(F.col("a").alias("u"), F.col("b").alias("v")))


def shared_keys(keys: DataFrame, counts: np.ndarray) -> DataFrame:
    """keys(node, key) -> those rows whose key several nodes have, the number p of these, and the least of them.

    Keys in the slots that hold over one in FREQUENT of all shingles, fewer than
    FREQUENT slots, may be those of very many nodes and meet their counts by broadcast;
    all others are dealt by key once, for their counts and the join with these.
    """

    def often(rows: DataFrame) -> DataFrame:  # reads all columns of rows, so that both sides of the join are one shuffle
        return rows.groupBy("key").agg(F.count("*").alias("p"), F.min("node").alias("least")).where("p > 1")

    slots = np.flatnonzero(counts * FREQUENT > counts.sum()).tolist()
    heavy = F.shiftrightunsigned("key", 64 - COUNT_BITS).isin(slots) if slots else F.lit(False)
    light = keys.where(~heavy).select("node", "key").repartition("key")
    found = light.join(often(light), "key").select("node", "key", "p", "least")
    if not slots:
        return found
    hot = keys.where(heavy)
    known = often(hot).withColumn("weight", F.col("p"))
    return found.unionByName(join_frequent(hot, known, "key", "weight", int(counts.sum())).select("node", "key", "p", "least"))


def _briefs(batches):
    """node, size, sketch -> node, size, and the sketch folded to BRIEF bytes."""
    for batch in batches:
        folded = [np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, BRIEF), axis=0).tobytes() for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(folded, pa.binary())], ["node", "size", "brief"])


def _tile_pairs(tile: np.ndarray, side: np.ndarray, node: np.ndarray, root: np.ndarray, size: np.ndarray, brief: np.ndarray):
    """Pairs of nodes of different roots that sizes and briefs admit, from rows in the order of their tiles, some at a time.

    Rows of a tile with both sides meet the other side, those of a tile with one side each other.
    """
    first = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
    ends = np.r_[first[1:], len(tile)]
    rows = ends - first
    crossed = np.repeat(np.minimum.reduceat(side, first) != np.maximum.reduceat(side, first), rows)
    meets = np.repeat(ends, rows) - np.arange(len(tile)) - 1
    before = np.cumsum(meets) - meets
    at = 0
    while at < len(tile):
        upto = max(at + 1, int(np.searchsorted(before, before[at] + PAIRS_AT_ONCE)))
        n = meets[at:upto]
        i = np.repeat(np.arange(at, upto), n)
        j = np.arange(len(i)) - np.repeat(before[at:upto] - before[at], n) + i + 1
        at = upto
        may = (root[i] != root[j]) & (node[i] != node[j]) & (~crossed[i] | (side[i] != side[j]))
        i, j = i[may], j[may]
        may = 5 * np.minimum(size[i], size[j]) >= 4 * np.maximum(size[i], size[j])
        i, j = i[may], j[may]
        odd = np.bitwise_count(brief[i] ^ brief[j]).sum(axis=1, dtype=np.int64)
        may = 9 * odd <= size[i] + size[j]
        yield node[i[may]], node[j[may]]


def _tiles(batches):
    """Rows of key, tile, side, node, root, size, brief in the order of key and tile -> the pairs that each tile admits."""

    def admitted(table: pa.Table):
        key, part, side, node, root, size = (table.column(k).to_numpy() for k in range(6))
        tile = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        brief = np.frombuffer(b"".join(table.column(6).to_pylist()), np.uint64).reshape(len(node), -1)
        for u, v in _tile_pairs(tile, side, node, root, size, brief):
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    held: list[pa.RecordBatch] = []  # the rows of the tile that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        key, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if held and (key[0], part[0]) != (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()):
            yield from admitted(pa.Table.from_batches(held))
            held = []
        last = np.flatnonzero((key != key[-1]) | (part != part[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield from admitted(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from admitted(pa.Table.from_batches(held))


def pairs_in_tiles(members: DataFrame, sets: DataFrame, n_rows: int) -> DataFrame:
    """members(key, node, root), sets(node, size, sketch) -> the pairs (u, v) of a key's nodes of different roots that sizes and sketches admit.

    Of the most frequent root of a key no two rows are paired. Rows of other roots
    and those of the main one are dealt into blocks of about TILE_ROWS; each two
    blocks of others, and each block of others with each of the main root, make a
    tile, which one task holds. Pairs may come more than once and in either order.
    """
    sizes = members.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("mains"), F.sum("n").alias("p"), F.count("*").alias("roots"))
    mixed = mixed.where("roots > 1").select("key", "main", "mains", "p", F.col("p").alias("weight"))
    left = join_frequent(members, mixed, "key", "weight", n_rows)
    blocks = left.withColumn("k", F.ceil((F.col("p") - F.col("mains")) / TILE_ROWS).cast("int")).withColumn("l", F.ceil(F.col("mains") / TILE_ROWS).cast("int"))
    own = blocks.withColumn("other", F.col("root") != F.col("main")).withColumn("b", F.expr("CAST(pmod(xxhash64(node), IF(other, k, l)) AS INT)"))
    tiles = F.expr(f"""CASE
        WHEN p <= {int(TILE_ROWS)} THEN array(named_struct('tile', 0L, 'side', 0))
        WHEN other THEN concat(
            transform(sequence(0, k - 1), j -> named_struct('tile', CAST(least(b, j) AS BIGINT) * k + greatest(b, j), 'side', IF(j < b, 1, 0))),
            transform(sequence(0, l - 1), j -> named_struct('tile', CAST(k AS BIGINT) * k + CAST(b AS BIGINT) * l + j, 'side', 0)))
        ELSE transform(sequence(0, k - 1), j -> named_struct('tile', CAST(k AS BIGINT) * k + CAST(j AS BIGINT) * l + b, 'side', 1)) END""")
    briefs = sets.select("node", "size", "sketch").mapInArrow(_briefs, "node bigint, size bigint, brief binary")
    dealt = own.withColumn("tiles", tiles).select("key", "node", "root", "tiles").join(briefs, "node").select("key", F.explode("tiles").alias("at"), "node", "root", "size", "brief")
    ordered = dealt.select("key", "at.tile", "at.side", "node", "root", "size", "brief").repartition("key", "tile").sortWithinPartitions("key", "tile")
    return ordered.mapInArrow(_tiles, "u bigint, v bigint")


def near_components(sets: DataFrame, texts: DataFrame, counts: np.ndarray, most: int = 4, shingle: int = SHINGLE) -> DataFrame:
    """sets(node, size, sketch, fp, keys), texts(node, text) -> (node, root) for every node that is linked to another, root the smallest it reaches."""
    shared = stage_table(shared_keys(sets.select("node", F.explode("keys").alias("key")), counts), "shared-keys")
    stars = shared.where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    links = near_pairs(simhash_pairs(sets, most).unionByName(stars), sets, texts, shingle)
    roots = connected_components(links)
    several = shared.where("p > 2")  # of two nodes the pair has been compared
    placed = stage_table(several.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "placed-keys")
    more = near_pairs(pairs_in_tiles(placed, sets, placed.count()), sets, texts, shingle)
    return connected_components(links.unionByName(more))


def kept_rows(docs: DataFrame, most: int = 4, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """One row of docs of each group of near-duplicates: that with the smallest id (null ids come last, then the text decides).

    Rows are told apart by id and text together, so an id with several texts is
    several rows; equal rows count as one. Null and blank texts are alike; an empty
    table gives an empty one; columns of docs are kept as they are. Docs is read
    several times, so it should be a table.
    """
    words = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    node, own_id = F.xxhash64(words), F.col(f"`{doc_id}`")
    texts = docs.select(node.alias("node"), words.alias("text"))
    counts = shingle_counts(texts.select("text"), shingle)
    rows = stage_table(shingle_rows(docs.select(own_id.alias("id"), node.alias("node"), words.alias("text")), counts, shingle), "shingle-rows")
    each = stage_table(rows.groupBy("id", "node").agg(F.count("*").alias("n")), "each-row")
    copied = stage_table(each.groupBy("node").agg(F.sum("n").alias("n")).where("n > 1").select("node"), "copied")
    copies = rows.join(copied, "node", "left_semi").groupBy("node").agg(F.first(F.struct("size", "sketch", "fp", "keys")).alias("set"))
    sets = rows.join(copied, "node", "left_anti").select("node", "size", "sketch", "fp", "keys").unionByName(stage_table(copies.select("node", "set.*"), "copies"))
    roots = near_components(sets, texts, counts, most, shingle)
    placed = each.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = placed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("row")).select("row.id", "row.node")
    own = private(docs, "__row")
    mark = F.concat(F.coalesce(F.concat(F.col("id").cast("string"), F.lit("+")), F.lit("-")), F.col("node").cast("string")).alias(own)
    gone = each.select(mark).join(best.select(mark), own, "left_anti")
    again = stage_table(each.where("n > 1").select(mark).join(gone, own, "left_anti"), "repeated-rows")
    named = docs.withColumn(own, F.concat(F.coalesce(F.concat(own_id.cast("string"), F.lit("+")), F.lit("-")), node.cast("string")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    gone = stage_table(gone, "dropped-rows").unionByName(again)
    surely, perhaps = by_slots(named, own, gone, "left_anti"), by_slots(named, own, gone, "left_semi")
    kept = surely.unionByName(perhaps.join(gone, own, "left_anti")).select(*columns)
    if again.isEmpty():
        return kept
    return kept.unionByName(by_slots(named, own, again, "left_semi").join(again, own, "left_semi").dropDuplicates([own]).select(*columns))
