"""The spread of the numbers of copies, at rates on both sides of the switch to sums."""

import pytest
from pyspark.sql import functions as F

from mathloom.llm import mixing


@pytest.mark.parametrize("rate", [1.5, 8.0, 10.0, 16.0, 200.5])
def test_copies_have_the_mean_and_variance_of_poisson(spark, rate):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    got = mixing.mix(rows, budget_rows=4000 * rate).where("copy_no = 1").agg(F.sum("n_copies").alias("n"), F.sum(F.col("n_copies") * F.col("n_copies")).alias("n2")).first()
    mean = got["n"] / 4000
    assert abs(mean - rate) < 5 * (rate / 4000) ** 0.5
    assert abs(got["n2"] / 4000 - mean**2 - rate) < 0.12 * rate
