"""Mixing sources to target weights by weighted fair queueing, with built-in functions only.

Each source queues its documents in shuffled order (MD5 of id and text), and starts over when it is through. A document's virtual finish time is the cumulative words of its source up to and
with it over the source's target. The documents of all sources (twice each, if a source may be taken twice) are range-sorted by finish time, and the queue is truncated where the words
served reach the total budget.

Scale: no source is collected. Running sums inside a source are sums over 4,096 key cells (pre-aggregated before the shuffle) plus a window
inside one cell; the order of the whole queue and the order of the sources are range-partitioned with running totals, so neither a source with a third of all rows nor millions of sources make
a large task. Texts are never shuffled: a document is taken by comparing its key with its source's cut.

Defined cases: null text has size 0; a null source is a source of its own, last in order; rows with equal id and text are interchangeable, each has its own place in the queue, and the right number
of them is taken, so ``queue`` and ``mix`` take the same words in every case; sources without words take nothing; empty tables give empty results. Extra columns are kept, one named ``copies`` is
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, n_words, running, scratch, stored

CELL_DIGITS = 3


def shuffle_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Places a document in its source's queue; null counts as empty."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.md5(F.concat(part(doc_id), F.lit("\x1f"), part(text)).cast("binary"))


def cycled_weights(place: Column, weights: tuple[float, ...]) -> Column:
    """The weight of the n-th source (from 0), weights repeating."""
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))


def with_targets(sources: DataFrame, weights: tuple[float, ...] | DataFrame, share: float, most: float) -> DataFrame:
    """source, source_size, target. Budget is share of all sizes, dealt by weight; no target is above most times its source's size, and the excess
    goes to the others by weight. In order of cap per weight the level of the last uncapped source solves this without iteration."""
    late = F.col("source").isNull()
    if isinstance(weights, DataFrame):
        weighed = sources.join(weights.select(F.col("source").alias("_s"), "weight"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        weighed = weighed.fillna(0.0, ["weight"])
    else:
        ranked = running(sources.withColumn("_late", late), ["_late", "source"], "mix-sources", place=F.lit(1)).drop("_late")
        weighed = ranked.withColumn("weight", cycled_weights(F.col("place"), weights)).drop("place")
    capped = weighed.where("weight > 0").withColumn("cap", F.col("source_size") * F.lit(float(most)))
    capped = capped.withColumns({"_full": F.col("cap") / F.col("weight"), "_late": late})
    used = stored(running(capped, ["_full", "_late", "source"], "mix-caps", before_cap=F.col("cap"), before_weight=F.col("weight")), "mix-capped")
    totals = used.agg(F.sum("weight").alias("weights"), F.sum("source_size").alias("size")).first()
    budget = float(totals["size"] or 0) * share
    level = (F.lit(budget) - F.col("before_cap")) / (F.lit(float(totals["weights"] or 0)) - F.col("before_weight"))
    top = used.agg(F.max(F.when(level * F.col("weight") <= F.col("cap"), level)).alias("level")).first()["level"]
    target = F.least(F.lit(top).cast("double") * F.col("weight"), F.col("cap"))
    return used.select("source", "source_size", target.alias("target"), F.lit(budget).alias("budget"))


def lined_up(docs: DataFrame, weights: tuple[float, ...] | DataFrame, share: float, most: float) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, budget, queue_key, served (words of its source up to and with it)."""
    keyed = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), shuffle_key().alias("queue_key"))
    keyed = stored(keyed.withColumn("cell", F.substring("queue_key", 1, CELL_DIGITS)), "mix-sizes")
    cells = keyed.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    behind = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = stored(cells.withColumn("cell_before", F.coalesce(F.sum("cell_size").over(behind), F.lit(0))), "mix-cells")
    targets = with_targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, share, most)
    targets = stored(targets.withColumnRenamed("source", "_t"), "mix-targets")
    cells = cells.join(targets, F.col("source").eqNullSafe(F.col("_t")), "left").drop("_t").fillna(0, ["target", "source_size"])
    cells = cells.withColumnsRenamed({"source": "_s", "cell": "_c"})
    joined = keyed.join(cells, F.col("source").eqNullSafe(F.col("_s")) & (F.col("cell") == F.col("_c")))
    within = Window.partitionBy("source", "cell").orderBy("queue_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", "budget", "queue_key", (F.col("cell_before") + F.sum("size").over(within)).alias("served")
    )


def finish_time(k: int | Column) -> Column:
    """Virtual finish time of a document in pass k over its source."""
    return F.try_divide(F.col("source_size") * k + F.col("served"), F.col("target"))


def _served_last(lined: DataFrame, passes: int) -> tuple | None:
    """Place in the queue (finish time, key) of the last document that the budget serves; None if none is, and the last of all if the budget outlasts the queue."""
    turns = lined.where("target > 0 and size > 0").select("size", "budget", "queue_key", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("k"), "served", "source_size", "target")
    turns = turns.select("size", "budget", finish_time(F.col("k")).alias("finish"), "queue_key")
    line = running(turns, ["finish", "queue_key"], "mix-queue", before=F.col("size"))
    return line.where(F.col("before") + F.col("size") <= F.col("budget")).agg(F.max(F.struct("finish", "queue_key")).alias("last")).first()["last"]


def _times_taken(passes: int, last: tuple | None) -> Column:
    if last is None:
        return F.lit(0)
    place = lambda k: F.struct(finish_time(k).alias("finish"), F.col("queue_key"))
    upto = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["queue_key"]).alias("queue_key"))
    taken = sum(F.when(place(k) <= upto, 1).otherwise(0) for k in range(passes))
    return F.when((F.col("target") > 0) & (F.col("size") > 0), taken).otherwise(0)


def queue(docs: DataFrame, weights: tuple[float, ...] | DataFrame = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, queue_key, served, copies (how often the mix takes it)."""
    with scratch(docs.sparkSession) as keep:
        lined = keep(lined_up(docs, weights, share, most), "mix-line")
        last = _served_last(lined, most)
    return lined.withColumn("copies", _times_taken(most, last))


def mix(docs: DataFrame, weights: tuple[float, ...] | DataFrame = (3, 1, 2), share: float = 1.5, most: int = 2, in_order: bool = False) -> DataFrame:
    """docs that the mix takes, each once, with ``copies`` (how often it is taken). ``in_order`` range-sorts them by virtual finish time."""
    with scratch(docs.sparkSession) as keep:
        taken = stored(queue(docs, weights, share, most).where("size > 0").select("source", "queue_key", "copies"), "mix-taken")
        # Copies only ever step down along a source's queue, at most once: a source's cut is (copies before, last key before, how many rows of that key, copies after).
        steps = taken.groupBy("source", "copies").agg(F.max("queue_key").alias("key"))
        edge = Window.partitionBy("source").orderBy(F.desc("copies"))
        cuts = steps.select("source", "copies", "key", F.lead("copies", 1).over(edge).alias("after"), F.row_number().over(edge).alias("n")).where("n = 1")
        cuts = cuts.select(F.col("source").alias("_src"), F.col("copies").alias("_hi"), F.coalesce("after", "copies").alias("_lo"), F.col("key").alias("_key"))
        at_cut = taken.join(cuts, F.col("source").eqNullSafe(F.col("_src")) & (F.col("queue_key") == F.col("_key")))
        higher = F.col("copies") == F.col("_hi")
        rows = at_cut.groupBy(F.col("source").alias("_of")).agg(F.count_if(higher).alias("_rows"), F.count_if(~higher).alias("_more"))
        cuts = keep(cuts.join(rows, F.col("_src").eqNullSafe(F.col("_of"))).drop("_of"), "mix-cuts")
    names = {c: free_name(docs.columns, c) for c in ("_src", "_hi", "_lo", "_key", "_rows", "_more", "_place")}
    split = cuts.where("_more > 0").limit(1).count() > 0
    cuts = cuts.withColumnsRenamed({c: n for c, n in names.items() if c != "_place"})
    src, hi, lo, key, rows, more, place = (F.col(n) for n in names.values())
    known = docs.drop("copies").join(cuts, F.col("source").eqNullSafe(src)).where(n_words(F.col("text")) > 0)
    mine = shuffle_key()
    kept = known.withColumn("copies", F.when(mine <= key, hi).otherwise(lo))
    if split:
        # Rows of the very key of a cut are equal rows; so many of them are before the cut.
        at_cut = (mine == key) & (more > 0)
        equal = known.where(at_cut).withColumn(names["_place"], F.row_number().over(Window.partitionBy(src).orderBy(F.lit(0))))
        equal = equal.withColumn("copies", F.when(place <= rows, hi).otherwise(lo)).drop(names["_place"])
        kept = kept.where(~at_cut).unionByName(equal)
    kept = kept.drop(*[n for c, n in names.items() if c != "_place"]).where("copies > 0")
    if in_order:
        kept = _in_order(docs, kept, weights, share, most)
    return kept


def _in_order(docs: DataFrame, kept: DataFrame, weights: tuple[float, ...] | DataFrame, share: float, most: int) -> DataFrame:
    """kept with ``virtual_finish`` (of the first pass), range-sorted by it."""
    times = lined_up(docs, weights, share, most).groupBy(F.col("source").alias("_s"), F.col("queue_key").alias("_k")).agg(F.min(finish_time(0)).alias("virtual_finish"))
    timed = kept.join(times, F.col("source").eqNullSafe(F.col("_s")) & (shuffle_key() == F.col("_k"))).drop("_s", "_k")
    return timed.repartitionByRange("virtual_finish", "doc_id").sortWithinPartitions("virtual_finish", "doc_id")


def op1_mixing(docs: DataFrame) -> DataFrame:
    return queue(docs, (3, 1, 2), 1.5, 2).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


ORACLE = r"""
WITH keyed AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(coalesce(doc_id::varchar, '') || chr(31) || coalesce(text, '')) AS k FROM documents
), per AS (SELECT source, sum(size)::double AS s, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM keyed GROUP BY source
), weighed AS (SELECT *, [3.0, 1.0, 2.0][(place - 1) % 3 + 1]::double AS w, 2.0 * s AS cap FROM per
), ordered AS (
  SELECT *, coalesce(sum(cap) OVER b, 0.0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER b, 0.0) AS open, sum(s) OVER () * 1.5 AS budget FROM weighed
  WINDOW b AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), leveled AS (
  SELECT *, max(CASE WHEN (budget - capped) / open * w <= cap THEN (budget - capped) / open END) OVER () AS level FROM ordered
), targets AS (SELECT source, s, budget, least(coalesce(level * w, cap), cap) AS target FROM leveled
), lined AS (
  SELECT d.*, t.s, t.target, t.budget, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS served
  FROM keyed d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), turns AS (
  SELECT size, budget, k, (s * e + served) / target AS finish FROM lined, (VALUES (0), (1)) v(e) WHERE target > 0 AND size > 0
), line AS (SELECT *, sum(size) OVER (ORDER BY finish, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM turns
), cut AS (SELECT max((finish, k)) AS last FROM line WHERE upto <= budget)
SELECT doc_id, size::bigint AS size, s::bigint AS source_size, target, (size * CASE WHEN target > 0 AND size > 0 AND last IS NOT NULL
  THEN ((served / target, k) <= last)::int + (((s + served) / target, k) <= last)::int ELSE 0 END)::bigint AS taken FROM lined, cut
"""
