"""Exact duplicates by an index of cuckoo filters over the SHA-256 digests of live texts.

The digests are dealt into shards by their first bits. A shard keeps a cuckoo filter
(a 16-bit mark of each live digest in one of two buckets of four places) and, in
buckets of their own, the live digests with what is known of their texts: how many
rows have it and which row stays. A mark in neither bucket proves a digest new; a hit
is verified against the digests stored in its home bucket, so false hits cost a
comparison and never a row. Where no place can be freed, the filter is built anew with
twice the buckets from the stored digests. Digests leave the filter when their last row goes.

Every task first merges its own rows in a table of the same kind, so that a text which
a third of all rows have reaches its shard as one row a task.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import join_frequent
from .shared import stage_table

PLACES = 4
MOST_KICKS = 500
#: Live digests of a shard, about, and of a task's own table before it is sent on.
SHARD_DIGESTS = 50_000
#: Sign of the stored rows of a shard, of rows to add, and of rows that say what is left of a digest.
STORED, ADDED, LEFT = 0, 1, 2


class CuckooTable:
    """A cuckoo filter of digests with their entries [digest, id, row, n] in home buckets.

    Of the rows of one digest the entry names the one with the largest id (null is the
    smallest), and of those with that id the one with the smallest row number.
    """

    def __init__(self, buckets: int = 64):
        self.size = self.resizes = self.false_hits = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.places = array("H", bytes(2 * PLACES * buckets))
        self.content: dict[int, list[list]] = {}

    def _marks(self, digest: bytes) -> tuple[int, int]:
        return int.from_bytes(digest[8:10]) or 1, int.from_bytes(digest[10:16]) & self.mask

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & self.mask)

    def _at(self, bucket: int, mark: int) -> int:
        """A place of the bucket that holds this mark (0: that is free), or -1."""
        first = PLACES * bucket
        for at in range(first, first + PLACES):
            if self.places[at] == mark:
                return at
        return -1

    def may_hold(self, digest: bytes) -> bool:
        mark, home = self._marks(digest)
        return self._at(home, mark) >= 0 or self._at(self._other(home, mark), mark) >= 0

    def _place(self, mark: int, bucket: int) -> bool:
        for b in (bucket, self._other(bucket, mark)):
            if (at := self._at(b, 0)) >= 0:
                self.places[at] = mark
                return True
        for kick in range(MOST_KICKS):
            at = PLACES * bucket + (kick * 7 + mark) % PLACES
            mark, self.places[at] = self.places[at], mark
            bucket = self._other(bucket, mark)
            if (at := self._at(bucket, 0)) >= 0:
                self.places[at] = mark
                return True
        return False

    def _resize(self) -> None:
        """The filter anew from the stored digests, in twice the buckets or as many more as it takes."""
        entries, buckets = list(self.entries()), self.mask + 1
        placed = False
        while not placed:
            buckets *= 2
            self.resizes += 1
            self._clear(buckets)
            placed = all([self._keep(e) for e in entries])

    def _keep(self, entry: list) -> bool:
        mark, home = self._marks(entry[0])
        self.content.setdefault(home, []).append(entry)
        return self._place(mark, home)

    def find(self, digest: bytes) -> list | None:
        """The entry of a live digest: a hit of the filter, verified against the home bucket's digests."""
        if not self.may_hold(digest):
            return None
        for entry in self.content.get(self._marks(digest)[1], ()):
            if entry[0] == digest:
                return entry
        self.false_hits += 1
        return None

    def add(self, digest: bytes, key, row: int, n: int) -> None:
        entry = self.find(digest)
        if entry is None:
            self.size += 1
            if not self._keep([digest, key, row, n]):
                self._resize()
            return
        entry[3] += n
        old = entry[1]
        if key == old:
            entry[2] = min(entry[2], row)
        elif old is None or (key is not None and key > old):
            entry[1], entry[2] = key, row

    def put(self, digest: bytes, key, row: int, n: int) -> None:
        """What is left of a digest; with no row left it is no longer live."""
        self.remove(digest)
        if n:
            self.add(digest, key, row, n)

    def remove(self, digest: bytes) -> bool:
        entry = self.find(digest)
        if entry is None:
            return False
        mark, home = self._marks(digest)
        at = max(self._at(home, mark), self._at(self._other(home, mark), mark))
        self.places[at] = 0
        self.content[home].remove(entry)
        self.size -= 1
        return True

    def entries(self):
        for bucket in self.content.values():
            yield from bucket


@dataclass(frozen=True)
class TextIndex:
    """members(row, id, digest): all rows; live(shard, digest, keep_id, keep_row, n): a row a live text; filters(shard, places)."""

    members: DataFrame
    live: DataFrame
    filters: DataFrame
    shards: int


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256))


def _shard(shards: int) -> Column:
    """The number that the first 28 bits of a digest make, modulo a power of two."""
    return (F.conv(F.substring(F.hex("digest"), 1, 7), 16, 10).cast("int") % F.lit(shards)).alias("shard")


def _rows(batch: pa.RecordBatch, *names: str):
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def _batch(entries: list[list], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*entries)) or [[], [], [], []]
    arrays = [pa.array(c, t) for c, t in zip(columns, (pa.binary(), kind, pa.int64(), pa.int64()))]
    return pa.RecordBatch.from_arrays(arrays, ["digest", "id", "row", "n"])


def _merged_in_task(batches):
    table, kind = CuckooTable(), pa.int64()
    for batch in batches:
        kind = batch.schema.field("id").type
        for digest, key, row in _rows(batch, "digest", "id", "row"):
            table.add(digest, key, row, 1)
        if table.size >= SHARD_DIGESTS:
            yield _batch(list(table.entries()), kind)
            table = CuckooTable()
    yield _batch(list(table.entries()), kind)


def _shard_rows(shard: int, table: CuckooTable, kind: pa.DataType):
    entries = list(table.entries())
    for at in range(0, len(entries), 10_000):
        out = _batch(entries[at : at + 10_000], kind)
        n = out.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), *out.columns, pa.nulls(n, pa.binary())], ["shard", *out.schema.names, "places"])
    last = [[shard], [None], [None], [None], [None], [table.places.tobytes()]]
    types = (pa.int32(), pa.binary(), kind, pa.int64(), pa.int64(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(last, types)], ["shard", "digest", "id", "row", "n", "places"])


def _merged_in_shard(batches):
    """Rows of one shard after the other, those that are stored first; the table of a shard is all that is held."""
    now, table, kind = None, None, pa.int64()
    for batch in batches:
        kind = batch.schema.field("id").type
        for shard, sign, digest, key, row, n in _rows(batch, "shard", "sign", "digest", "id", "row", "n"):
            if shard != now:
                if table is not None:
                    yield from _shard_rows(now, table, kind)
                now, table = shard, CuckooTable()
            if sign == LEFT:
                table.put(digest, key, row, n)
            else:
                table.add(digest, key, row, n)
    if table is not None:
        yield from _shard_rows(now, table, kind)


def _applied(live: DataFrame | None, changes: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """live and filters after some changes(sign, digest, id, row, n)."""
    rows = changes.select(_shard(shards), "sign", "digest", "id", "row", "n")
    if live is not None:
        stored = live.select("shard", F.lit(STORED).alias("sign"), "digest", F.col("keep_id").alias("id"), F.col("keep_row").alias("row"), "n")
        rows = stored.unionByName(rows)
    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.repartition("shard").sortWithinPartitions("shard", "sign")
    out = stage_table(dealt.mapInArrow(_merged_in_shard, f"shard int, digest binary, id {kind}, row bigint, n bigint, places binary"), "text-index")
    kept = out.where("places IS NULL").select("shard", "digest", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), "n")
    return kept, out.where("places IS NOT NULL").select("shard", "places")


def _members(docs: DataFrame, text: str, doc_id: str, first_row: int) -> DataFrame:
    """Written once, so that the numbers of rows stand."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), _digest(text).alias("digest"))
    return stage_table(rows.withColumn("row", F.lit(first_row) + F.monotonically_increasing_id()), "text-rows")


def _additions(members: DataFrame) -> DataFrame:
    kind = members.schema["id"].dataType.simpleString()
    found = members.select("digest", "id", "row").mapInArrow(_merged_in_task, f"digest binary, id {kind}, row bigint, n bigint")
    return found.withColumn("sign", F.lit(ADDED))


def build(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shards: int | None = None) -> TextIndex:
    """An index of all rows of docs. Shards, a power of two, stay as many for the index's life."""
    members = _members(docs, text, doc_id, 0)
    if shards is None:
        partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        shards = 1 << (max(4 * partitions, members.count() // SHARD_DIGESTS, 1) - 1).bit_length()
    live, filters = _applied(None, _additions(members), shards)
    return TextIndex(members, live, filters, shards)


def insert(index: TextIndex, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> TextIndex:
    """The index with the rows of docs as well."""
    last = index.members.agg(F.coalesce(F.max("row"), F.lit(-1))).first()[0]
    more = _members(docs, text, doc_id, last + 1)
    live, filters = _applied(index.live, _additions(more), index.shards)
    return TextIndex(index.members.unionByName(more), live, filters, index.shards)


def delete(index: TextIndex, ids: DataFrame, doc_id: str = "doc_id") -> TextIndex:
    """The index without the rows of some ids; another row stays for a text whose row goes. Null and unknown ids delete nothing."""
    gone = ids.select(F.col(f"`{doc_id}`").alias("id")).where("id IS NOT NULL").distinct()
    members = stage_table(index.members.join(gone, "id", "left_anti"), "text-rows")
    touched = stage_table(index.members.join(gone, "id", "left_semi").select("digest").distinct(), "touched")
    rest = members.join(touched, "digest", "left_semi").groupBy("digest").agg(F.max(F.struct("id", (-F.col("row")).alias("row"))).alias("best"), F.count("*").alias("n"))
    left = touched.join(rest, "digest", "left").select(F.lit(LEFT).alias("sign"), "digest", "best.id", F.coalesce(-F.col("best.row"), F.lit(0)).alias("row"), F.coalesce("n", F.lit(0)).alias("n"))
    live, filters = _applied(index.live, left, index.shards)
    return TextIndex(members, live, filters, index.shards)


def _admitted(batches):
    """Digests whose mark the filter of their shard holds; a filter comes before the digests of its shard."""
    now, table = None, None
    for batch in batches:
        kept = []
        for shard, places, digest in _rows(batch, "shard", "places", "digest"):
            if places is not None:
                now, table = shard, CuckooTable(len(places) // (2 * PLACES))
                table.places = array("H", places)
            elif shard == now and table.may_hold(digest):
                kept.append(digest)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary())], ["digest"])


def probe(index: TextIndex, docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns keep_id and group_size of the live text that theirs equals; null where none does.

    Only digests that the filters admit are looked up in the stored content.
    """
    names = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], _digest(text).alias("digest"))
    counted = stage_table(rows.groupBy("digest").agg(F.count("*").alias("weight")), "probes")
    asked = counted.select(_shard(index.shards), F.lit(None).cast("binary").alias("places"), "digest")
    known = index.filters.select("shard", "places", F.lit(None).cast("binary").alias("digest"))
    stream = known.unionByName(asked).repartition("shard").sortWithinPartitions("shard", F.col("places").isNull())
    hits = stream.mapInArrow(_admitted, "digest binary")
    found = hits.join(index.live, "digest").select("digest", "keep_id", F.col("n").alias("group_size"))
    keyed = counted.join(found, "digest", "left")
    n_rows = counted.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    return join_frequent(rows, keyed, "digest", "weight", n_rows).select(*[F.col(n).alias(c) for c, n in names.items()], "keep_id", "group_size")


def duplicates(index: TextIndex) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) for every row of the index.

    Texts are equal when they are identical; null counts as empty. The row with the
    largest id stays; rows without an id stay only where no row of their text has
    one (keep_id is null then), and of several rows with the same id and text exactly
    one. An empty table gives an empty one; very long texts are read whole, by their
    digests; other columns are not read.
    """
    keyed = index.live.select("digest", "keep_id", "keep_row", F.col("n").alias("group_size"), F.col("n").alias("weight"))
    rows = join_frequent(index.members, keyed, "digest", "weight", index.members.count())
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")
