"""Dense numbers and seeded orders."""

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import ranking
from tallyspark.sources import seeded


@pytest.mark.parametrize("n", [0, 1, 2, 5, 64, 65, 1000])
def test_the_network_is_a_permutation(n):
    orders = [[seeded.permuted(p, n, seed) for p in range(n)] for seed in (0, 1, 7)]
    assert all(sorted(o) == list(range(n)) for o in orders) and (n < 64 or len({tuple(o) for o in orders}) == 3)


def test_partitions_do_not_matter(spark):
    one, many, other = ([tuple(r) for r in seeded.index(spark, 500, seed, parts).orderBy("place").collect()] for seed, parts in ((3, 1), (3, 7), (4, 7)))
    assert one == many != other and sorted(k for _, k in other) == list(range(500)) and seeded.index(spark, 0, 3).count() == 0
    assert sum(abs(k - p) for p, k in one) > 500 * 100


def test_numbers_have_no_gaps(spark):
    rows = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("a"), F.lit("x").alias("number_of"))
    got = ranking.numbered(rows, ["a"]).select("a", "number", ranking.run_name(F.col("number")).alias("r")).collect()
    assert sorted((r["a"], r["number"]) for r in got) == [(i, i) for i in range(5000)] and {r["r"] for r in got} >= {"run_0000", "run_4999"}
    assert ranking.numbered(rows.limit(0), ["a"]).count() == 0
    assert sorted(r["number"] for r in ranking.numbered(rows.withColumn("a", F.lit(1)), ["a"]).collect()) == list(range(5000))
