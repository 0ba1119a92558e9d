"""Document fingerprints by winnowing, with DataFrame functions only.

Words are hashed, every `gram` consecutive words give a rolling hash of 31 bits, and
of each window of `window` consecutive grams the smallest is chosen, the rightmost
one at ties. Chosen grams keep their positions. Any passage of at least
window + gram - 1 words that two texts share is met by a common fingerprint entry.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM, WINDOW = 5, 8
#: The rolling hash of words h0 .. hk is h0 * BASE^k + .. + hk modulo PRIME; word hashes are taken modulo PRIME.
PRIME, BASE = 2**31 - 1, 1_220_703_125
#: An entry is its gram hash (31 bits) above 31 bits that fall as the position rises, so the least entry is the rightmost of the least hashes.
TOP = 2**31 - 1


def _word_hashes(text: Column) -> Column:
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME)))


def add_fingerprint(df: DataFrame, text: str, name: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """df and the column `name`: array of entries (see TOP) by position; null and blank texts get an empty one.

    A text of fewer than `gram` words has one gram, one of fewer than `window` grams one window.
    Arrays that later steps read more than once stand in columns of their own, so that they are computed once.
    """
    words, grams = f"__words_{name}", f"__grams_{name}"

    def roll(h: Column, w: Column) -> Column:
        return (h * F.lit(BASE) + w) % F.lit(PRIME)  # both factors are below 2^31

    def entry(hashed: Column, i: Column) -> Column:
        return F.shiftleft(hashed, 31).bitwiseOR(F.lit(TOP).cast("bigint") - i)

    def gram_at(i: Column) -> Column:
        hashed = F.get(F.col(words), i)
        for j in range(1, gram):
            hashed = roll(hashed, F.get(F.col(words), i + F.lit(j)))
        return entry(hashed, i)

    def least_from(i: Column) -> Column:
        return F.least(*[F.get(F.col(grams), i + F.lit(j)) for j in range(window)])

    empty = F.array().cast("array<bigint>")
    df = df.withColumn(words, _word_hashes(F.coalesce(F.col(text), F.lit(""))))
    short = F.array(entry(F.aggregate(words, F.lit(0).cast("bigint"), roll), F.lit(0)))
    whole = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - gram, F.lit(0))), gram_at)
    df = df.withColumn(grams, F.when(F.size(words) == 0, empty).when(F.size(words) < gram, short).otherwise(whole))
    chosen = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(grams) - window, F.lit(0))), least_from))
    return df.withColumn(name, F.when(F.size(grams) == 0, empty).otherwise(chosen)).drop(words, grams)


def entries(fingerprint: str) -> Column:
    """The fingerprint as an array of {hash, position}, positions in words from 0."""
    return F.transform(fingerprint, lambda c: F.struct(F.shiftright(c, 31).alias("hash"), (F.lit(TOP) - c.bitwiseAND(F.lit(TOP))).cast("int").alias("position")))


def as_text(fingerprint: str) -> Column:
    """hash:position of each entry, comma-joined; the hash in hexadecimal."""
    return F.array_join(F.transform(fingerprint, lambda c: F.concat(F.lower(F.hex(F.shiftright(c, 31))), F.lit(":"), (F.lit(TOP) - c.bitwiseAND(F.lit(TOP))).cast("string"))), ",")


def add_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df and the share of the hashes of two fingerprints that both have (Jaccard; 1.0 if both are empty)."""
    left, right = f"__a_{name}", f"__b_{name}"
    df = df.withColumn(left, F.array_distinct(F.transform(a, lambda c: F.shiftright(c, 31)))).withColumn(right, F.array_distinct(F.transform(b, lambda c: F.shiftright(c, 31))))
    common = f"__common_{name}"
    df = df.withColumn(common, F.size(F.array_intersect(left, right)))
    either = F.size(left) + F.size(right) - F.col(common)
    return df.withColumn(name, F.when(either == 0, F.lit(1.0)).otherwise(F.col(common) / either)).drop(left, right, common)


def with_next(rows: DataFrame, gram: int = GRAM, window: int = WINDOW, per_bucket: int = 2000, most_buckets: int = 65536, segments: int = 256) -> DataFrame:
    """rows(doc_id, text), their fingerprint fp, and next_text, next_fp of the next row in descending doc_id; after the last comes the first.

    Null ids come last; rows of the same id, or of none, follow each other by a hash of
    their text. The range of ids is cut at `segments` quantiles and each stretch into
    buckets of equal width (rows without an id by their hash); the first row of each bucket is
    also placed at the end of the bucket before it, so no order over all rows is needed.
    """
    cuts = F.array(*[F.lit(k / segments) for k in range(segments + 1)])
    stats = rows.agg(F.count("*").alias("n"), F.percentile_approx(F.col("doc_id").cast("double"), cuts, 20_000).alias("cuts")).first()
    buckets = min(most_buckets, max(segments, math.ceil(stats["n"] / per_bucket)))
    each, edges = math.ceil(buckets / segments), sorted(set(stats["cuts"] or [0.0]))
    bounds, own = F.array(*map(F.lit, edges)), F.col("doc_id").cast("double")
    number = F.greatest(F.size(F.filter(bounds, lambda b: b <= own)), F.lit(1))  # of the last edge that is not above the id
    low = F.get(bounds, number - 1)
    high = F.coalesce(F.get(bounds, number), low + 1)
    at = F.coalesce(F.width_bucket(own, low, high, F.lit(each)), F.lit(1))
    nowhere = F.width_bucket(F.col("tie").cast("double"), F.lit(-(2.0**63)), F.lit(2.0**63), F.lit(buckets)) - F.lit(buckets + 2)
    placed = rows.withColumn("tie", F.xxhash64("text")).withColumn("bucket", F.when(own.isNull(), nowhere).otherwise(number * (each + 2) + at).cast("bigint"))
    first_ids = placed.groupBy("bucket").agg(F.max(F.struct("doc_id", "tie")).alias("first")).select("bucket", "first.doc_id", "first.tie")
    before = Window.orderBy("bucket")  # over one row a bucket, some most_buckets at most
    linked = first_ids.withColumn("home", F.coalesce(F.lead("bucket").over(before), F.first_value("bucket").over(before)))
    heads = F.broadcast(linked.select(F.col("bucket").alias("hb"), F.col("doc_id").alias("hd"), F.col("tie").alias("ht"), "home"))  # at most most_buckets rows of numbers
    first_rows = placed.join(heads, (F.col("bucket") == F.col("hb")) & F.col("doc_id").eqNullSafe(F.col("hd")) & (F.col("tie") == F.col("ht"))).dropDuplicates(["hb"])
    guests = first_rows.select("doc_id", "text", F.col("home").alias("bucket"), "tie", F.lit(1).alias("guest"))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(stats["n"] / 16_000))
    every = add_fingerprint(placed.withColumn("guest", F.lit(0)).unionByName(guests), "text", "fp", gram, window).repartition(parts, "bucket")
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    return every.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fp", F.lead("fp").over(order)).where("guest = 0").select("doc_id", "text", "fp", "next_text", "next_fp")


def fingerprint_edits(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Per row of docs: doc_id, text, its fingerprint fp, an edited text with its fingerprint, and likenesses.

    The edited text has the last floor(n / 3) code points replaced by as many (or
    all) from the start of the next document in descending doc_id. Null texts count
    as empty; an only row follows itself; an empty table gives an empty one; other
    columns are not read. doc_id must be a number.
    """
    paired = with_next(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")), gram, window)
    cut = F.floor(F.char_length("text") / 3).cast("int")
    edited = paired.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.char_length("text") - cut), F.substring("next_text", F.lit(1), cut)))
    edited = add_fingerprint(edited, "edited", "edited_fp", gram, window)
    edited = add_likeness(edited, "fp", "edited_fp", "near_edited")
    return add_likeness(edited, "fp", "next_fp", "near_next")
