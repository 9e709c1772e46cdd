"""Chat formatting with collapse of cumulative snapshots, with built-in functions only.

A logger that stores a conversation after every reply leaves prefixes of the final one. The hash of a prefix is the exclusive or of the hashes of its
(place, role, text), two of 64 bits, so it rolls along the turns as a running aggregate. A conversation whose whole hash is the hash of a proper prefix of any
other is dropped by an anti-join against the distinct proper prefixes; of equal conversations the one of least id stays. What remains is rendered, a conversation a row; ``segment_turns``, where
it is given, makes a row of so many turns each.

Scale: turns are range-partitioned by conversation and order, so a conversation that holds a large share of all rows, with turn numbers of any kind, spreads over many tasks; counts
and hashes of these cells are pre-aggregated and summed up before the turns inside a cell are. Exact repeats are taken together before anything is shuffled. Texts are shuffled twice, to meet their places and
their segments, and a segment is a bounded number of turns; only conversations of several segments are then put together, from one rendered text a segment.

Defined cases: turns are ordered by number (null last), then by role and text; an exact repeat of a turn counts once; a null role renders as "unknown", a null text as
empty; null conversation ids are one conversation; very long texts are one turn; empty tables give empty results. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stored

#: Turns rendered together.
SEGMENT_TURNS = 1024
#: Fixed values of the template.
BEFORE_ROLE, AFTER_ROLE, AFTER_TEXT = "<|", "|>\n", "<|end|>\n"


def _item() -> Column:
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    return F.md5(F.concat(part("role"), F.lit("\x1f"), part("text")).cast("binary"))


def _turn_key() -> Column:
    """Names a distinct turn of a conversation."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return F.md5(F.concat(part("conv_id"), F.lit("|"), part("turn"), F.lit("|"), _item()).cast("binary"))


def _same_cell() -> Column:
    return F.col("conv_id").eqNullSafe(F.col("_v")) & (F.col("cell") == F.col("_c"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, turn_key, place, p1, p2, n_turns: for each turn the hashes of the conversation up to it."""
    order = ["conv_id", F.col("turn").asc_nulls_last(), "item"]
    light = turns.select("conv_id", "turn", _item().alias("item"), _turn_key().alias("turn_key")).distinct()
    light = light.repartitionByRange(*order).withColumn("cell", F.spark_partition_id())
    light = stored(light, "chat-items")
    every = Window.partitionBy("conv_id")
    behind = every.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = light.groupBy("conv_id", "cell").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select(
        F.col("conv_id").alias("_v"), F.col("cell").alias("_c"), F.coalesce(F.sum("n").over(behind), F.lit(0)).alias("before"), F.sum("n").over(every).alias("n_turns")
    )
    within = Window.partitionBy("conv_id", "cell").orderBy(*order[1:])
    placed = light.join(sizes, _same_cell()).select(
        "conv_id", "cell", "item", "turn_key", "n_turns", (F.col("before") + F.row_number().over(within)).alias("place")
    )
    placed = placed.withColumn("x1", F.xxhash64("place", "item")).withColumn("x2", F.xxhash64(F.concat(F.lit("~"), "item"), "place"))
    placed = stored(placed, "chat-places")
    whole = placed.groupBy("conv_id", "cell").agg(F.bit_xor("x1").alias("c1"), F.bit_xor("x2").alias("c2")).select(
        F.col("conv_id").alias("_v"),
        F.col("cell").alias("_c"),
        F.coalesce(F.bit_xor("c1").over(behind), F.lit(0)).alias("b1"),
        F.coalesce(F.bit_xor("c2").over(behind), F.lit(0)).alias("b2"),
    )
    run = Window.partitionBy("conv_id", "cell").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = lambda b, x: F.col(b).bitwiseXOR(F.bit_xor(x).over(run))
    return placed.join(whole, _same_cell()).select("conv_id", "turn_key", "place", "n_turns", rolled("b1", "x1").alias("p1"), rolled("b2", "x2").alias("p2"))


def maximal(rolled: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that are no prefix of a longer one, one of each set of equals. rolled: rows of ``prefixes``."""
    proper = rolled.where("place < n_turns").select("place", "p1", "p2").distinct()
    whole = rolled.where("place = n_turns").groupBy("place", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    return whole.join(proper, ["place", "p1", "p2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def _segments(turns: DataFrame, rolled: DataFrame, chosen: DataFrame, segment_turns: int) -> DataFrame:
    """conv_id, segment (from 0), n_turns, rendered."""
    segment = F.floor((F.col("place") - 1) / segment_turns)
    kept = rolled.join(chosen.select(F.col("conv_id").alias("_v")), F.col("conv_id").eqNullSafe(F.col("_v")))
    kept = kept.select(F.col("turn_key").alias("k"), "conv_id", segment.alias("segment"), "place", "n_turns")
    texts = turns.select(_turn_key().alias("k"), "role", "text").groupBy("k").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    rows = texts.join(kept, "k").groupBy("conv_id", "segment", "n_turns").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("rows"))
    line = lambda x: F.concat(F.lit(BEFORE_ROLE), F.coalesce(x["role"], F.lit("unknown")), F.lit(AFTER_ROLE), F.coalesce(x["text"], F.lit("")), F.lit(AFTER_TEXT))
    return rows.select("conv_id", "segment", F.col("n_turns").cast("long").alias("n_turns"), F.array_join(F.transform("rows", line), "").alias("rendered"))


def render(turns: DataFrame, rolled: DataFrame, chosen: DataFrame, segment_turns: int | None = None) -> DataFrame:
    """conv_id, n_turns, rendered; with segment_turns also segment."""
    if segment_turns:
        return _segments(turns, rolled, chosen, segment_turns)
    several = F.col("n_turns") > SEGMENT_TURNS
    short = _segments(turns, rolled.where(~several), chosen.where(~several), SEGMENT_TURNS).drop("segment")
    parts = _segments(turns, rolled.where(several), chosen.where(several), SEGMENT_TURNS)
    whole = parts.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list(F.struct("segment", "rendered"))).alias("parts"))
    return short.unionByName(whole.select("conv_id", "n_turns", F.array_join(F.col("parts.rendered"), "").alias("rendered")))


def formatted(turns: DataFrame, segment_turns: int | None = None) -> DataFrame:
    """The maximal conversations, rendered."""
    with scratch(turns.sparkSession) as keep:
        rolled = keep(prefixes(turns), "chat-prefixes")
        chosen = keep(maximal(rolled), "chat-chosen")
    return render(turns, rolled, chosen, segment_turns)


def op8_chat_format(turns: DataFrame) -> DataFrame:
    return formatted(turns)


ORACLE = r"""
WITH items AS (
  SELECT DISTINCT conv_id, turn, role, text, md5(coalesce('=' || role, '-') || chr(31) || coalesce('=' || text, '-')) AS item FROM conversations
), lined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(item, '' ORDER BY turn NULLS LAST, item) AS chain FROM items GROUP BY conv_id
), firsts AS (SELECT chain, min(conv_id) AS conv_id, any_value(n_turns) AS n_turns FROM lined GROUP BY chain
), longest AS (
  SELECT * FROM firsts a WHERE NOT EXISTS (SELECT 1 FROM firsts b WHERE b.n_turns > a.n_turns AND starts_with(b.chain, a.chain))
), placed AS (
  SELECT i.*, l.n_turns, row_number() OVER (PARTITION BY i.conv_id ORDER BY turn NULLS LAST, item) AS place FROM items i JOIN longest l ON i.conv_id IS NOT DISTINCT FROM l.conv_id
)
SELECT conv_id, n_turns,
  string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY place) AS rendered
FROM placed GROUP BY 1, 2
"""
