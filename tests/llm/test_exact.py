"""The cuckoo-filter index of texts against brute force, with insertions and deletions."""

import hashlib
import random

from mathloom.llm import cuckoo
from tests.llm.test_operators import LONG, ODD, SCHEMA, texts_of


def brute(rows):
    """{(id, text): [(keep_id, group_size, kept), ...]} of some (id, text)."""
    groups = {}
    for key, text in rows:
        groups.setdefault(text or "", []).append(key)
    out = {}
    for text, keys in groups.items():
        best = max((k for k in keys if k is not None), default=None)
        kept = [True] + [False] * (keys.count(best) - 1)
        for key in keys:
            out.setdefault((key, hashlib.sha256(text.encode()).hexdigest()), []).append((best, len(keys), kept.pop() if key == best else False))
    return {k: sorted(v) for k, v in out.items()}


def found(index):
    out = {}
    for r in cuckoo.duplicates(index).collect():
        out.setdefault((r["doc_id"], r["digest"].hex()), []).append((r["keep_id"], r["group_size"], r["kept"]))
    return {k: sorted(v) for k, v in out.items()}


def test_table_against_a_dict():
    rng, table, live = random.Random(1), cuckoo.CuckooTable(1), {}
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for step in range(20_000):
        digest = rng.choice(digests)
        if rng.random() < 0.6:
            key = rng.choice([None, *range(50)])
            table.add(digest, key, step, 1)
            old = live.get(digest)
            if old is None:
                live[digest] = [key, step, 1]
            else:
                old[2] += 1
                if key is not None and (old[0] is None or key > old[0]):
                    old[:2] = [key, step]
        else:
            assert table.remove(digest) == (live.pop(digest, None) is not None)
    assert {e[0]: e[1:] for e in table.entries()} == live and table.size == len(live)
    assert all(table.may_hold(d) for d in live) and table.resizes > 5
    assert sum(table.may_hold(d) for d in digests) <= len(live) + 10
    for d in digests:
        table.remove(d)
    assert table.size == 0 and not any(table.places)


def test_marks_that_all_collide():
    """More equal marks than two buckets have places: resized until the homes part them, none lost."""
    digests = [bytes(8) + b"\x00\x07" + i.to_bytes(6, "big") + bytes(16) for i in range(200)]
    table = cuckoo.CuckooTable(2)
    for i, d in enumerate(digests):
        table.add(d, i, i, 1)
    assert table.resizes and {e[0] for e in table.entries()} == set(digests)
    assert table.find(bytes(8) + b"\x00\x07" + (10**9).to_bytes(6, "big") + bytes(16)) is None


def test_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute(texts_of(docs))
    assert found(cuckoo.build(docs)) == want and any(v[0][1] > 1 for v in want.values())
    assert found(cuckoo.build(docs, shards=1)) == want


def test_insertions_and_deletions(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(60)]), rng.choice(["", "a", "b", "c", "d", None, LONG, *map(str, range(20))])) for _ in range(150)]

    def frame(part):
        return spark.createDataFrame(part, "doc_id bigint, text string")

    index = cuckoo.build(frame(rows[:50]), shards=4)
    for at in (50, 100):
        index = cuckoo.insert(index, frame(rows[at : at + 50]))
        assert found(index) == brute(rows[: at + 50])
    gone = set(range(0, 60, 2))
    index = cuckoo.delete(index, frame([(k, None) for k in sorted(gone)] + [(None, None), (999, None)]).select("doc_id"))
    rest = [(k, t) for k, t in rows if k not in gone]
    assert found(index) == brute(rest)
    index = cuckoo.insert(index, frame([(1000, "a"), (1001, "new")]))
    assert found(index) == brute([*rest, (1000, "a"), (1001, "new")])
    sizes = {}
    for k, t in [*rest, (1000, "a"), (1001, "new")]:
        sizes.setdefault(t or "", []).append(k)
    asked = spark.createDataFrame([("a", 1), ("absent", 2), (None, 3), ("new", 4), ("a", 1)], "text string, digest int")
    got = sorted((r["text"] or "", r["digest"], r["keep_id"], r["group_size"]) for r in cuckoo.probe(index, asked).collect())
    assert got == sorted([("a", 1, 1000, len(sizes["a"])), ("a", 1, 1000, len(sizes["a"])), ("absent", 2, None, None), ("", 3, max(k for k in sizes[""] if k is not None), len(sizes[""])), ("new", 4, 1001, 1)])
    everything = cuckoo.delete(index, index.members.select(index.members.id.alias("doc_id")))
    assert set(k for k, _ in found(everything)) <= {None}


def test_odd_tables(spark):
    odd = spark.createDataFrame(ODD, SCHEMA).withColumnRenamed("n_chars", "digest").withColumnRenamed("lang", "shard").withColumnRenamed("source", "row")
    assert found(cuckoo.build(odd)) == brute(texts_of(odd))
    empty = cuckoo.build(odd.limit(0))
    assert found(empty) == {} and found(cuckoo.insert(empty, odd)) == brute(texts_of(odd)) and cuckoo.probe(empty, odd).where("keep_id IS NOT NULL").count() == 0
    named = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x")], "doc_id string, text string")
    assert [(r["keep_id"], r["group_size"]) for r in cuckoo.duplicates(cuckoo.build(named)).collect()] == [("b", 3)] * 3


def test_one_text_in_every_row(spark):
    many = spark.range(20_000).selectExpr("id AS doc_id", "'the same' AS text").repartition(16)
    rows = cuckoo.duplicates(cuckoo.build(many, shards=8))
    assert rows.where("kept").collect()[0]["doc_id"] == 19_999 and rows.where("kept").count() == 1 and rows.where("group_size = 20000 AND keep_id = 19999").count() == 20_000
