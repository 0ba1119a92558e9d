"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the cluster names; one in the warehouse, which is shared as well, only where none is set (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def checkpoint(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read back: compressed, and safe against lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def private(df: DataFrame, name: str) -> str:
    """A name for a column of an operator's own that df does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def sort_key(column: str, seed: str = "") -> Column:
    """52 uniform bits of the MD5 of a value and a seed; DuckDB can compute the same."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(column).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("bigint")


def held_out_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the fold a row belongs to (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def bounded_sample(df: DataFrame, key: str, most: int, seed: str) -> DataFrame:
    """About `most` rows of df, chosen by a hash of `key`, so that the same rows come at every run."""
    n = df.count()
    if n <= most:
        return df
    return df.where(sort_key(key, seed) < F.lit(int(2**52 * most / n)))
