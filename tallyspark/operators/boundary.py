"""The input boundary of an independent evaluation: what is evaluated must be what was locked.

Observations and the locked source sets of canonical states are compared as multisets, all trades at once: the references of both sides are counted together by lineage, and
the counts are summed up by lineage to reasons. Nothing of a trade is gathered. Where trades are gathered anyway, ``gate_of_trades`` compares the lists of each.

Defined cases: a state without observations and observations without a state are reasons of their own; a null watermark is; null parts of a reference are equal to null; repeated rows are a
reason; empty inputs give no rows. Output of another evaluator among the columns of the states raises before anything runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What identifies a source of an evaluation.
KEY = ("observation_id", "kind", "source_system", "source_version", "content_hash")
#: Columns that only an evaluator makes.
FORBIDDEN = ("reconciliation_run", "breaks", "break_ids", "result")


def rules() -> dict[str, Column]:
    """Columns of one lineage: has_state, watermark, n_observations, n_ids, foreign, late, unlocked, unseen, linkage_observation_id, linkage_seen."""
    c = F.col
    known = c("has_state") & (c("n_observations") > 0)
    return {
        "NO_OBSERVATIONS": c("n_observations") == 0,
        "NO_STATE": ~c("has_state"),
        "NO_WATERMARK": c("has_state") & c("watermark").isNull(),
        "OBSERVATION_REPEATS": c("n_observations") != c("n_ids"),
        "OUT_OF_SCOPE": known & (c("foreign") > 0),
        "ARRIVED_AFTER_WATERMARK": known & (c("late") > 0),
        "SOURCE_SET_DIFFERS": known & ((c("unlocked") > 0) | (c("unseen") > 0)),
        "LINKAGE_OUTSIDE_SET": c("linkage_observation_id").isNotNull() & ~F.coalesce(c("linkage_seen") > 0, F.lit(False)),
    }


def gate(observations: DataFrame, states: DataFrame, linkage: DataFrame | None = None, by: tuple[str, ...] = ("lineage_id",)) -> DataFrame:
    """lineage_id, reasons (empty: may be evaluated), one row a lineage.

    observations: lineage_id, tenant_id, portfolio_id, ingest_time and KEY; states: lineage_id, tenant_id, portfolio_id, source_watermark, source_version_set (structs with KEY); linkage: lineage_id,
    linkage_observation_id (may be null), once a lineage. ``by`` names a lineage in all three; where they are partitioned by these columns nothing is shuffled.
    """
    if found := [c for c in FORBIDDEN if c in states.columns]:
        raise ValueError(f"states hold output of an evaluator: {', '.join(found)}")
    by = list(by)
    head = states.select(*by, F.col("tenant_id").alias("_tenant"), F.col("portfolio_id").alias("_portfolio"), F.col("source_watermark").alias("watermark"))
    in_scope = F.col("tenant_id").eqNullSafe(F.col("_tenant")) & F.col("portfolio_id").eqNullSafe(F.col("_portfolio"))
    late = F.coalesce(F.col("ingest_time") > F.col("watermark"), F.lit(False))
    seen = observations.join(head, by, "left").select(*by, *KEY, F.lit(1).alias("n"), F.lit(0).alias("n_locked"), (~in_scope).cast("int").alias("foreign"), late.cast("int").alias("late"))
    locked = states.select(*by, F.explode("source_version_set").alias("r")).select(*by, *[F.col(f"r.{k}").alias(k) for k in KEY])
    locked = locked.select("*", F.lit(0).alias("n"), F.lit(1).alias("n_locked"), F.lit(0).alias("foreign"), F.lit(0).alias("late"))
    counts = ("n", "n_locked", "foreign", "late")
    met = seen.unionByName(locked).groupBy(*by, *KEY).agg(*[F.sum(c).alias(c) for c in counts])
    per = met.groupBy(*by).agg(
        F.sum("n").alias("n_observations"), F.countDistinct(F.when(F.col("n") > 0, F.col("observation_id"))).alias("n_ids"), F.sum("foreign").alias("foreign"), F.sum("late").alias("late"),
        F.count_if((F.col("n") > 0) & (F.col("n_locked") == 0)).alias("unlocked"), F.count_if((F.col("n") == 0) & (F.col("n_locked") > 0)).alias("unseen"),
    )
    rows = per.join(head.select(*by, "watermark", F.lit(True).alias("has_state")), by, "full_outer")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_observations", "n_ids", "foreign", "late", "unlocked", "unseen")}).withColumn("has_state", F.coalesce("has_state", F.lit(False)))
    if linkage is None:
        rows = rows.withColumns({"linkage_observation_id": F.lit(None).cast("string"), "linkage_seen": F.lit(None).cast("long")})
    else:
        met_by = linkage.select(*by, "linkage_observation_id").join(observations.select(*by, F.col("observation_id").alias("_id")), by, "left")
        linked = met_by.groupBy(*by, "linkage_observation_id").agg(F.count_if(F.col("_id") == F.col("linkage_observation_id")).alias("linkage_seen"))
        rows = rows.join(linked, by, "left")
    return rows.select("lineage_id", _reasons())


def _reasons() -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(code)) for code, broken in rules().items()])).alias("reasons")


def gate_of_trades(trades: DataFrame) -> DataFrame:
    """lineage_id, reasons as of ``gate``, of one row a lineage with all that is of it, so that nothing is met again.

    trades: lineage_id, observations (structs with tenant_id, portfolio_id, ingest_time and KEY), state (struct of tenant_id, portfolio_id, source_watermark, source_version_set; null for none),
    linkage_observation_id (may be null).
    """
    c, state = F.col, F.col("state")
    keys = lambda rows: F.transform(rows, lambda x: F.struct(*[x[k].alias(k) for k in KEY]))
    ids = F.transform("observations", lambda x: x["observation_id"])
    locked = F.coalesce(keys(state["source_version_set"]), F.array().cast(f"array<struct<{','.join(f'{k}:string' for k in KEY)}>>"))
    in_scope = lambda x: x["tenant_id"].eqNullSafe(state["tenant_id"]) & x["portfolio_id"].eqNullSafe(state["portfolio_id"])
    n = lambda holds: F.size(F.filter("observations", holds))
    rows = trades.select("lineage_id", "observations", "state", "linkage_observation_id", ids.alias("_ids"), keys("observations").alias("_seen"), locked.alias("_locked"))
    counted = rows.select(
        "lineage_id", "linkage_observation_id", state.isNotNull().alias("has_state"), state["source_watermark"].alias("watermark"), F.size("observations").alias("n_observations"),
        F.size(F.array_distinct(F.array_compact("_ids"))).alias("n_ids"), n(lambda x: ~in_scope(x)).alias("foreign"), n(lambda x: x["ingest_time"] > state["source_watermark"]).alias("late"),
        F.size(F.array_except("_seen", "_locked")).alias("unlocked"), F.size(F.array_except("_locked", "_seen")).alias("unseen"),
        F.size(F.filter("_ids", lambda i: i == c("linkage_observation_id"))).alias("linkage_seen"),
    )
    return counted.select("lineage_id", _reasons())
