"""Ingest: at-least-once deliveries against an append-only inbox.

A delivery's declared content hash is held against its content first: one that differs is CONTENT_HASH_MISMATCH and takes no part in what follows. Then its source identity decides: unseen is INSERTED,
seen with the same content is IDEMPOTENT_REPLAY, seen with other content is DUPLICATE_SOURCE_CONFLICT. The first
delivery stays authoritative, within a batch too. One window per identity decides a batch; the inbox side takes part as rows that came first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import sha256
from ..functions.documents import observation_content

IDENTITY = ("tenant_id", "portfolio_id", "source_system", "kind", "source_business_key", "source_version")


class SourceConflictError(ValueError):
    """A batch that must not conflict does."""


class ContentHashError(ValueError):
    """A delivery declares a hash that its content doesn't have."""


def classified(batch: DataFrame, inbox: DataFrame | None = None, identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    """batch with ``outcome`` and, for replays and conflicts, the authoritative ``first_observation_id`` and ``first_hash``.

    Where the batch has ``hash_valid`` (see ``verified``), rows of which it is not true are CONTENT_HASH_MISMATCH, and never the first of an identity.
    """
    sound = F.coalesce("hash_valid", F.lit(False)) if "hash_valid" in batch.columns else F.lit(True)
    rows = batch.withColumn("_stored", F.when(sound, 0).otherwise(1))
    if inbox is not None:
        keep = [*identity, "observation_id", "content_hash", "arrival"]
        seen = inbox.select(*keep, F.lit(-1).alias("_stored"))
        rows = rows.unionByName(seen, allowMissingColumns=True)
    # One frame and one step for both, so that one window serves them.
    w = Window.partitionBy(*identity).orderBy("_stored", "arrival", "observation_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"_n": F.row_number().over(w), "_first": F.first(F.struct("observation_id", "content_hash")).over(w)})
    same = F.col("content_hash") == F.col("_first.content_hash")
    outcome = F.when(F.col("_stored") == 1, "CONTENT_HASH_MISMATCH").when(F.col("_n") == 1, "INSERTED").when(same, "IDEMPOTENT_REPLAY").otherwise("DUPLICATE_SOURCE_CONFLICT")
    rows = rows.where("_stored >= 0").withColumn("outcome", outcome)
    later = (F.col("_n") > 1) & (F.col("_stored") == 0)
    rows = rows.withColumn("first_observation_id", F.when(later, F.col("_first.observation_id"))).withColumn("first_hash", F.when(later, F.col("_first.content_hash")))
    return rows.drop("_stored", "_n", "_first")


def split(outcomes: DataFrame, on_conflict: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """(rows to append to the inbox, rows to append to the quarantine); with on_conflict='raise' any conflict aborts before a write. Rows whose hash is wrong are in neither."""
    bare = [c for c in outcomes.columns if c not in ("outcome", "first_observation_id", "first_hash", "hash_valid")]
    conflicts = outcomes.where("outcome = 'DUPLICATE_SOURCE_CONFLICT'")
    if on_conflict == "raise" and conflicts.limit(1).count():
        raise SourceConflictError("a delivery contradicts stored content; nothing was written")
    return outcomes.where("outcome = 'INSERTED'").select(*bare), conflicts


def new_conflicts(conflicts: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Conflicts not in the quarantine yet; one row per observation id."""
    return conflicts.join(quarantined.select("observation_id"), "observation_id", "left_anti").dropDuplicates(["observation_id"])


def counters(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def verified(batch: DataFrame, text: Column) -> DataFrame:
    """batch with ``hash_valid``: whether the declared content hash is that of the content."""
    return batch.withColumn("hash_valid", F.col("content_hash") == sha256(text))


def corrections(bookings: DataFrame, field: str, value: Column, now: Column) -> DataFrame:
    """Re-delivery of the latest booking of each trade with a corrected field: next version and sequence, superseding the old row."""
    trade = ("tenant_id", "portfolio_id", "lineage_id")
    row = F.struct(*bookings.columns)
    last = bookings.where("kind = 'BOOKING'").groupBy(*trade).agg(F.max_by(row, F.struct(F.col("source_version").cast("decimal(19,0)"), "observation_id")).alias("r"))
    # The trade comes from the grouping, which keeps the partitioning.
    last = last.select(*trade, *[F.col(f"r.{c}").alias(c) for c in bookings.columns if c not in trade])
    version = (F.col("source_version").cast("decimal(19,0)") + 1).cast("string")
    kind = dict(bookings.dtypes)[field]
    fixed = last.withColumns(
        {
            field: value.cast(kind), "supersedes_observation_id": F.col("observation_id"), "source_version": version, "source_sequence": F.col("source_sequence") + 1,
            "observation_id": F.concat("observation_id", F.lit("_v"), version), "event_time": now, "ingest_time": now, "arrival": F.col("arrival") + 1,
            "kind_reference": F.concat("kind_reference", F.lit("_corrected")), "supersession_reason": F.lit("CORRECTION"),
        }
    )
    return fixed.withColumn("content_hash", sha256(observation_content())).select(*bookings.columns)
