"""What the corpus operators share: whole-text word rules, shared-folder tables, running totals."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, LF, VT, FF and CR. ``bytes.split()`` cuts UTF-8 text in the same places.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null; built-in functions only."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % n


#: Bytes of an Arrow batch, where the session leaves Spark's default: a worker and its JVM hold several copies of a batch at a time.
BATCH_BYTES, _BATCH_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
_DEFAULT_BATCH = 64 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches, so that batches of long texts fit next to each other; a session that has set a size keeps it."""
    if spark.conf.get(_BATCH_SETTING, None) in (f"{_DEFAULT_BATCH}b", "64m", "64MB"):
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def text_key(text: str = "text") -> Column:
    """Names a text by 128 bits; null counts as the empty text."""
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only for a local session that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if sc.applicationId not in _LOCAL:
            _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="tallyspark-")
        found = _LOCAL[sc.applicationId]
    return found.rstrip("/")


#: Paths of stored tables that are not dropped yet, by open block (the last is the innermost) and, first, those outside of any block.
_MADE: list[list[str]] = [[]]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyspark/{name}-{uuid.uuid4().hex}"
    _MADE[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Remove stored tables. What depends on them must have been written before."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()


@contextmanager
def scratch(spark: SparkSession):
    """A block whose stored tables go when it ends. What must outlive it is stored through the function that the block is given."""
    made: list[str] = []
    _MADE.append(made)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = stored(df, name)
        _MADE[-2].append(made.pop())
        return out

    try:
        yield keep
    finally:
        _MADE.remove(made)
        drop(spark, made)


def newest() -> list[str]:
    """The path of the table that was stored last outside of blocks that have ended."""
    return _MADE[-1][-1:]


def clear(spark: SparkSession) -> None:
    """Drop every table that is still stored: to be called once the results that read them have been written."""
    drop(spark, _MADE[0])


def running(df: DataFrame, order: list, name: str, **totals: Column) -> DataFrame:
    """df with, for each named value, the sum over all rows before it in a global order (0 for the first row).

    The rows are range-partitioned, so each task holds a contiguous stretch of the order of about equal size; stretches have their sums added up in a table of one row each,
    and a window adds up the rows inside of a stretch. Rows equal in ``order`` come in any order.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    placed = stored(placed.withColumns({f"_{k}": v for k, v in totals.items()}), name)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in totals])
    parts = parts.select(F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}_parts") for k in totals])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(F.broadcast(parts), F.col("_part") == F.col("_p"))
    joined = joined.withColumns({k: F.col(f"_{k}_parts") + F.coalesce(F.sum(f"_{k}").over(within), F.lit(0)) for k in totals})
    return joined.drop("_part", "_p", *[f"_{k}" for k in totals], *[f"_{k}_parts" for k in totals])


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which the worker hands memory back: Python workers serve task after task, and would keep what the largest one took."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def free_name(taken: list[str], wanted: str) -> str:
    """A column name that clashes with none of those taken, whatever the case."""
    low = {x.lower() for x in taken}
    while wanted.lower() in low:
        wanted = f"_{wanted}"
    return wanted
