"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source that holds n of N rows and shall make up the share w of the mix gets the
mean repetition rate w * budget / n. The number of copies of a row is the Poisson
quantile, at that rate, of a uniform number taken from a hash of its id (a sum of
such quantiles at high rates); copies are spread over the whole output by a second hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint, private, sort_key

#: Beyond this mean the copies are the sum of floor(rate / 8) Poisson numbers of mean 8 and one of the rest, each with a hash of its own.
MOST_RATE = 8.0
#: Terms of the Poisson sum; at a mean of 8 the chance of more is below 1e-15.
TERMS = 48
#: Up to so many sources, each a name and a number, are broadcast.
MOST_BROADCAST_SOURCES = 100_000
SALTS = 64


def poisson_quantile(uniform: Column, rate: Column) -> Column:
    """The least k with P(X <= k) > uniform, X Poisson with mean `rate` (at most MOST_RATE)."""
    start = F.struct(F.exp(-rate).alias("term"), F.exp(-rate).alias("below"), F.lit(0).alias("copies"))

    def add(state, k):
        term = state["term"] * rate / k
        more = (uniform >= state["below"]).cast("int")
        return F.struct(term.alias("term"), (state["below"] + term).alias("below"), (state["copies"] + more).alias("copies"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, add, lambda s: s["copies"])


def poisson_copies(rate: Column, doc_id: str, seed: str) -> Column:
    """A Poisson number of any mean, from hashes of the id; up to MOST_RATE it is the quantile of a single one."""
    whole = F.when(rate > MOST_RATE, F.floor(rate / MOST_RATE)).otherwise(F.lit(0)).cast("int")
    id_text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))

    def add(copies, k):
        bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), k.cast("string"), F.lit(":"), id_text)), 1, 13), 16, 10).cast("bigint")
        return copies + poisson_quantile(bits / F.lit(float(2**52)), F.lit(MOST_RATE))

    rest = poisson_quantile(sort_key(doc_id, seed) / F.lit(float(2**52)), rate - whole * F.lit(MOST_RATE))
    return F.when(whole == 0, rest).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(whole, F.lit(1))), rest, add))


def repetition_rates(docs: DataFrame, weights: DataFrame | None = None, budget_rows: float | None = None, source: str = "source") -> DataFrame:
    """(source, rows, rate): the mean number of copies of a row of each source.

    weights(source, weight): target shares, scaled to add up to 1 over the sources
    that docs has; without it all sources get the same share. budget_rows: expected
    rows of the mix, by default as many as docs has. A null source is a source of
    its own, written as an empty string in `weights`; sources that weights lacks get rate 0.
    """
    sizes = docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("source")).agg(F.count("*").alias("rows"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.lit(1.0))
    else:
        wanted = weights.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        weighed = sizes.join(wanted, "source", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    total = weighed.agg(F.sum("rows").alias("all_rows"), F.sum("weight").alias("all_weight"))
    budget = F.col("all_rows") if budget_rows is None else F.lit(float(budget_rows))
    rate = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * budget / F.col("rows")).otherwise(F.lit(0.0))
    return weighed.crossJoin(F.broadcast(total)).select("source", "rows", rate.alias("rate"))  # the total is one row


def _with_rates(rows: DataFrame, rates: DataFrame, name: str, doc_id: str, most_broadcast: int) -> DataFrame:
    """rows and the rate of their source `name`: few sources are broadcast, after they are counted; many are joined with salt, as one may hold most rows."""
    rates = checkpoint(rates)
    if rates.count() <= most_broadcast:
        return rows.join(F.broadcast(rates), name)
    salt = private(rows, "__salt")
    salted = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int")).join(salted, [name, salt])


def mix(docs: DataFrame, weights: DataFrame | None = None, budget_rows: float | None = None, seed: str = "mix", source: str = "source", doc_id: str = "doc_id", most_broadcast: int = MOST_BROADCAST_SOURCES) -> DataFrame:
    """The copies of docs' rows: columns of docs, copy_no (from 1), n_copies and shuffle_key, in the global order of shuffle_key.

    The same ids get the same copies at every run. Rows that repeat an id repeat its
    number of copies; null ids count as an empty id, null texts are carried along.
    An empty table gives an empty one; columns of docs named like the new ones are replaced.
    The order is that of partitions, each a range of the (uniform) key, and of the rows in each: no sample is needed for it.
    """
    name, rate, copy = (private(docs, c) for c in ("__source", "__rate", "__copy"))
    rates = repetition_rates(docs, weights, budget_rows, source).select(F.col("source").alias(name), F.col("rate").alias(rate))
    new = ("copy_no", "n_copies", "shuffle_key")
    own = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    counted = (
        _with_rates(docs.withColumn(name, F.coalesce(F.col(source), F.lit(""))), rates, name, doc_id, most_broadcast)
        .withColumn("n_copies", poisson_copies(F.col(rate), doc_id, seed).cast("int"))
        .where("n_copies > 0")
    )
    copies = counted.select(*own, "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy_no"))
    spread = copies.withColumn(copy, F.concat_ws("/", F.col(doc_id).cast("string"), F.col("copy_no").cast("string")))
    keyed = spread.withColumn("shuffle_key", sort_key(copy, seed + "/order")).drop(copy)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartitionById(parts, F.floor(F.col("shuffle_key") / F.lit(2.0**52) * parts).cast("int")).sortWithinPartitions("shuffle_key")
