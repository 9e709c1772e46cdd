"""The corpus in a seeded order, as a data source: ``spark.read.format("seeded_index")``.

A shuffle needs no sort where the order is a permutation that can be computed: the place of a row goes through a keyed Feistel network over the least power of four that holds all places, again and
again until it is one of them (cycle walking). Each partition computes its own places, so any number of partitions gives the same rows in the same order, and
another seed another order. The permutation is whole-number arithmetic that any SQL can repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the network: rounds, multiplier, and what tells rounds apart.
ROUNDS, MULTIPLIER, STEP = 4, 1_103_515_245, 12_345
SCHEMA = "place long, k long"


def half_bits(n: int) -> int:
    """Half the bits of the network's domain, which holds n places."""
    bits = 1
    while 1 << 2 * bits < n:
        bits += 1
    return bits


def network(x: int, bits: int, seed: int) -> int:
    """One pass: a permutation of the numbers of 2 * bits bits."""
    mask = (1 << bits) - 1
    left, right = x >> bits, x & mask
    for i in range(ROUNDS):
        mixed = ((right + seed) * MULTIPLIER + STEP * (i + 1)) % (1 << 31)
        left, right = right, left ^ (mixed >> 7 & mask)
    return left << bits | right


def permuted(place: int, n: int, seed: int) -> int:
    bits = half_bits(n)
    x = network(place, bits, seed)
    while x >= n:
        x = network(x, bits, seed)
    return x


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, n: int, seed: int, parts: int):
        self.n, self.seed, self.parts = n, seed, parts

    def partitions(self) -> list[InputPartition]:
        cuts = [self.n * i // self.parts for i in range(self.parts + 1)]
        return [_Range(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        for at in range(partition.first, partition.last, 10_000):
            places = range(at, min(at + 10_000, partition.last))
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array([permuted(p, self.n, self.seed) for p in places], pa.int64())], names=["place", "k"])


class SeededIndex(DataSource):
    """Options: rows, seed (0 by default, less than 2**20), partitions (8 by default)."""

    @classmethod
    def name(cls) -> str:
        return "seeded_index"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        n, seed, parts = (int(self.options.get(k, d)) for k, d in (("rows", "0"), ("seed", "0"), ("partitions", "8")))
        if n < 0 or n > 1 << 40 or not 0 <= seed < 1 << 20 or parts < 1:
            raise ValueError("rows, seed or partitions")
        return _Reader(n, seed, parts)


def index(spark: SparkSession, n: int, seed: int, partitions: int = 8) -> DataFrame:
    """place and k: which row stands where."""
    spark.dataSource.register(SeededIndex)
    return spark.read.format("seeded_index").options(rows=n, seed=seed, partitions=partitions).load()


def shuffled(rows: DataFrame, numbers: DataFrame, seed: int, partitions: int = 8) -> DataFrame:
    """rows with ``place``, where a seed puts them. numbers: the same rows with a dense ``number``."""
    return numbers.join(index(rows.sparkSession, numbers.count(), seed, partitions), F.col("number") == F.col("k")).drop("number", "k")
