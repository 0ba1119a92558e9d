"""Connected components of a link table by alternating large-star and small-star steps, and joins that bear frequent keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint, private, stage_table

#: A key with more than one in so many of all rows is frequent; there are fewer of these than this number, at any size.
FREQUENT = 1000
#: Rows of one key that a task takes, about, where pairs within keys are formed.
SHARE_ROWS = 4096
#: Slots of hashes that are broadcast in place of the values of a column, at most so many rows of a number at any size.
SLOTS = 1 << 21


def join_frequent(rows: DataFrame, keyed: DataFrame, key: str, weight: str, n_rows: int) -> DataFrame:
    """Inner join of rows with keyed (one row a key), without its column `weight`, the number of rows that a key has.

    Frequent keys, fewer than FREQUENT at any size, are broadcast, so that their rows
    stay where they are; the others meet by shuffle.
    """
    keyed = checkpoint(keyed)
    often = F.col(weight) * F.lit(FREQUENT) > F.lit(n_rows)
    hot = keyed.where(often).drop(weight)
    hot_keys = [r[0] for r in hot.select(key).collect()]  # fewer than FREQUENT
    if not hot_keys:
        return rows.join(keyed.drop(weight), key)
    frequent = F.col(key).isin(hot_keys)
    rest = rows.where(~frequent).join(keyed.where(~often).drop(weight), key)
    return rows.where(frequent).join(F.broadcast(hot), key).unionByName(rest)


def by_slots(rows: DataFrame, column: str, wanted: DataFrame, how: str) -> DataFrame:
    """Rows whose value of `column` may be in that column of wanted ("left_semi"), or is surely not ("left_anti"), told without a shuffle of rows.

    Values are put into SLOTS by a hash, and the slots that wanted uses are broadcast. Those
    that may match include some that do not, more of them the more slots are used: an exact join follows.
    """
    slot = private(rows, "__slot")
    place = F.pmod(F.xxhash64(column), F.lit(SLOTS)).cast("int").alias(slot)
    return rows.select("*", place).join(F.broadcast(wanted.select(place).distinct()), slot, how).drop(slot)


def pairs_across(members: DataFrame, test: str, n_rows: int) -> DataFrame:
    """members(key, node, root, own, p) -> (u, v): pairs of one key with different roots of which `test`, in u and v, holds.

    One of a pair must be `own` at the key (an indexed node; others are probes). p is
    the number of rows of the key. Of the most frequent root of a key no two rows are
    paired: each pair has a row of another root, and those meet all rows of the
    key, which are dealt into shares. Pairs may come more than once and in either order.
    """
    sizes = members.where("own").groupBy("key", "root").agg(F.count("*").alias("n"), F.max("p").alias("p"))
    main = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("p").alias("weight"))
    placed = stage_table(join_frequent(members, main, "key", "weight", n_rows).select("*", F.ceil(F.col("p") / SHARE_ROWS).cast("int").alias("shares")), "placed")

    def few(rows: DataFrame, node: str, root: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
        return rows.select("key", F.col("node").alias(node), F.col("root").alias(root), every)

    def many(rows: DataFrame, node: str, root: str) -> DataFrame:
        return rows.select("key", F.col("node").alias(node), F.col("root").alias(root), F.pmod(F.xxhash64("node"), F.col("shares")).cast("int").alias("share"))

    others, mains = placed.where("root <> main"), placed.where("root = main")
    both = few(others, "u", "ru").join(many(placed.where("own"), "v", "rv"), ["key", "share"])
    rest = many(mains, "u", "ru").join(few(others.where("own"), "v", "rv"), ["key", "share"])
    return both.unionByName(rest).where(f"ru <> rv AND {test}").select("u", "v")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each larger neighbour of u is tied to the smallest of u and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    return join_frequent(both.where("v > u"), least, "u", "n", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """u and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    tied = join_frequent(down, least, "u", "n", n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """links(u, v) -> (node, root): every node of a link and the smallest node that it can reach.

    Nodes may be of any type that can be ordered. Self links give a component of one
    node; nulls are ignored; an empty table gives an empty one. Each round is cut by
    a checkpoint in the shared folder, and only two numbers of a round, never links,
    come to the driver.
    """
    links = links.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL")
    alone = links.where("u = v").select(F.col("u").alias("node"))
    edges = checkpoint(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _digest(edges)
    while before[0]:
        stars = checkpoint(_large_star(edges, before[0]))
        edges = checkpoint(_small_star(stars, stars.count()))
        after = _digest(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    members = stars.union(edges.select(F.col("v"), F.col("v")))
    return members.union(alone.select("node", F.col("node").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
