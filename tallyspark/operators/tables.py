"""Append-only tables of the engine on Parquet, partitioned by scope and, where rows belong to one trade or source key, by a bucket of its hash.

There is no update or delete: the class offers ``append`` and ``read`` only. Uniqueness is kept by an anti-join before the append, against the buckets that the batch touches, not the whole
history: their numbers (at most ``BUCKETS``) are literals of the scan, so it lists those folders only.

With more than one writer, what must happen once is claimed first: a marker file is created if it is absent (never overwritten), and holds the name of who made it. A run
is claimed by its id before anything is evaluated, and shows up, with its breaks, only when its completion marker is there, which is written last; a booking version and
an envelope are claimed before their row is written; state versions are written by one writer at a time. The file system must create files exclusively, as HDFS does (a local one checks first).
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

#: table: unique key
TABLES: dict[str, tuple[str, ...]] = {
    "source_event_inbox": ("tenant_id", "portfolio_id", "source_system", "kind", "source_business_key", "source_version"),
    "source_event_conflicts": ("tenant_id", "portfolio_id", "observation_id"),
    "canonical_states": ("tenant_id", "portfolio_id", "trade_id", "canonical_state_version"),
    "reconciliation_runs": ("tenant_id", "portfolio_id", "run_id"),
    "trade_breaks": ("tenant_id", "portfolio_id", "break_id", "break_version"),
    "remediation_cases": ("case_id",),
    "remediation_approvals": ("case_id", "role"),
    "remediation_envelopes": ("case_id",),
    "remediation_executions": ("case_id", "attempt_id"),
    "remediation_evidence": ("case_id",),
    "legacy_booking_records": ("tenant_id", "portfolio_id", "trade_id", "record_version"),
}
SCOPE = ("tenant_id", "portfolio_id")
#: What a row's bucket is the hash of; each is decided by the table's key, so equal keys are in one bucket.
BUCKETED = {
    "source_event_inbox": "source_business_key", "source_event_conflicts": "observation_id", "canonical_states": "trade_id", "trade_breaks": "break_id", "legacy_booking_records": "trade_id",
}
BUCKETS = 256
#: Tables whose rows count only when their run is complete.
OF_RUNS = ("reconciliation_runs", "trade_breaks")


class UniquenessError(ValueError):
    """Rows that break a table's key in a strict append."""


class BusyError(RuntimeError):
    """Another writer is at it."""


class Store:
    """The tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        if name not in TABLES:
            raise KeyError(name)
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        try:
            self.spark.read.parquet(self.path(name))
        except AnalysisException:
            return False
        return True

    def ready(self, *names: str) -> bool:
        return all(map(self.exists, names or TABLES))

    def read(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        """The table; an empty frame of the given schema where nothing was ever appended. Of runs that are not complete nothing is shown."""
        if self.exists(name):
            rows = self._rows(name)
            return rows.join(self._completed(), "run_id", "left_semi") if name in OF_RUNS else rows
        if schema is None:
            raise LookupError(f"{name} has no rows yet")
        return self.spark.createDataFrame([], schema)

    def _rows(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """All rows that are written, or those of some buckets."""
        rows = self.spark.read.parquet(self.path(name))
        if buckets is not None and name in BUCKETED:
            rows = rows.where(F.col("bucket").isin(buckets))
        return rows.drop("bucket")

    @staticmethod
    def _bucket(name: str) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(BUCKETED[name], F.lit(""))), F.lit(BUCKETS)).cast("int")

    def _buckets(self, name: str, batch: DataFrame) -> list[int] | None:
        """The buckets that a batch touches, at most BUCKETS numbers."""
        return sorted(r[0] for r in batch.select(self._bucket(name)).distinct().collect()) if name in BUCKETED else None

    def touched(self, name: str, batch: DataFrame) -> DataFrame | None:
        """The stored rows in the buckets of a batch that has the table's key; None where nothing was appended yet."""
        return self._rows(name, self._buckets(name, batch)) if self.exists(name) else None

    def append(self, name: str, rows: DataFrame, strict: bool = False) -> None:
        """Append rows whose key is new; one row a key. With strict, a row whose key is stored raises and nothing is written."""
        key = list(TABLES[name])
        known = self.touched(name, rows)
        if known is not None:
            known = known.select(*key)
            if strict and rows.join(known, key, "left_semi").limit(1).count():
                raise UniquenessError(name)
            rows = rows.join(known, key, "left_anti")
        self._add(name, rows.dropDuplicates(key))

    def _add(self, name: str, rows: DataFrame) -> None:
        """Append rows that are known to be new. Each bucket is written by one task."""
        by = [c for c in SCOPE if c in rows.columns]
        if name in BUCKETED:
            by.append("bucket")
            rows = rows.withColumn("bucket", self._bucket(name)).repartition(*by)
        rows.write.mode("append").partitionBy(*by).parquet(self.path(name))

    def ingest(self, batch: DataFrame, on_conflict: str = "quarantine", on_mismatch: str = "raise") -> DataFrame:
        """Verify content hashes, classify a batch, append what is new, quarantine what conflicts; returns the outcome counters. Of the inbox only the buckets and identities of the batch are read.

        A batch that has ``hash_valid`` (documents) is taken at its word; else the hash of each row's content is computed. A wrong hash fails the batch before anything is written, or, with
        on_mismatch='reject', its row is counted and left out."""
        from ..functions.documents import observation_content
        from .ingest import IDENTITY, ContentHashError, classified, counters, new_conflicts, split, verified

        if "hash_valid" not in batch.columns:
            batch = verified(batch, observation_content())
        if on_mismatch == "raise" and batch.where("hash_valid is not true").limit(1).count():
            raise ContentHashError("a delivery declares a hash that its content does not have; nothing was written")
        batch = batch.persist()
        inbox = self._seen("source_event_inbox", batch, IDENTITY)
        outcomes = classified(batch, inbox).persist()
        try:
            new, conflicts = split(outcomes, on_conflict)
            conflicts = conflicts.drop("hash_valid")
            counted = self.spark.createDataFrame(counters(outcomes).collect(), "outcome string, n long")
            self._add("source_event_inbox", new)
            former = self._seen("source_event_conflicts", conflicts, TABLES["source_event_conflicts"])
            self._add("source_event_conflicts", new_conflicts(conflicts, former) if former is not None else conflicts.dropDuplicates(["observation_id"]))
        finally:
            outcomes.unpersist()
            batch.unpersist()
        return counted

    def _seen(self, name: str, batch: DataFrame, key: tuple[str, ...], broadcast_rows: int = 100_000) -> DataFrame | None:
        """Rows of a table whose key is in the batch; None where nothing was appended yet."""
        known = self.touched(name, batch)
        if known is None:
            return None
        keys = batch.select(*key).distinct()
        if keys.count() <= broadcast_rows:
            keys = F.broadcast(keys)
        return known.join(keys, list(key), "left_semi")

    def observations(self) -> DataFrame:
        """All that the sources sent and nothing supersedes: the inbox, then the quarantine."""
        from . import reconcile as R

        inbox = self.read("source_event_inbox")
        conflicts = self.read("source_event_conflicts") if self.exists("source_event_conflicts") else inbox.limit(0)
        return R.without_superseded(R.unite(inbox, conflicts.select(*inbox.columns)))

    def append_states(self, states: DataFrame) -> None:
        """Append the states that differ from the stored latest of their trade, each as its next version. One writer at a time."""
        from .reconcile import versioned

        with self.exclusive("canonical_states"):
            new = versioned(states, self.touched("canonical_states", states))
            self._add("canonical_states", new.dropDuplicates(list(TABLES["canonical_states"])))

    def run(self, run_id: str, config=None, completed_at=None) -> DataFrame:
        """Reconcile all that is stored and persist states, breaks, run rows and, last, the completion marker; returns the run rows. A run id that is taken, by whomever, raises before anything is written."""
        from . import reconcile as R
        from .reporting import run_ledger

        mine = uuid.uuid4().hex
        if self.claim("run", run_id, holder=mine) != mine:
            raise UniquenessError(f"run {run_id} is there already")
        rows = R.trade_rows(self.observations(), config).persist()
        try:
            broken = R.breaks(R.facts(rows, config), run_id)
            self.append_states(R.canonical_states(rows))
            self.append("trade_breaks", broken)
            ledger = run_ledger(rows, broken, run_id, completed_at)
            self.append("reconciliation_runs", ledger, strict=True)
            self.claim("completed-run", run_id, holder=run_id)
        finally:
            rows.unpersist()
        return self.read("reconciliation_runs").where(F.col("run_id") == run_id)

    def _completed(self) -> DataFrame:
        """run_id of each run with a completion marker."""
        try:
            return self.spark.read.text(f"{self.root}/_claims/completed-run").select(F.col("value").alias("run_id"))
        except AnalysisException:
            return self.spark.createDataFrame([], "run_id string")

    def _marker(self, kind: str, key: tuple) -> tuple:
        name = hashlib.sha256("\x1f".join(map(str, key)).encode()).hexdigest()
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_claims/{kind}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def claim(self, kind: str, *key: object, holder: str, patience_s: float = 5.0) -> str:
        """Who holds a claim: ``holder``, if nobody did before, or whoever came first. Asking again is safe."""
        path, files = self._marker(kind, key)
        try:
            out = files.create(path, False)
        except Py4JJavaError as error:
            if "exist" not in str(error.java_exception).lower():
                raise
            return self._holder(path, files, patience_s)
        out.write(bytearray(holder.encode()))
        out.close()
        return holder

    def _holder(self, path, files, patience_s: float) -> str:
        """What a marker holds; its maker may be just about to write it."""
        until = time.monotonic() + patience_s
        while not files.getFileStatus(path).getLen():
            if time.monotonic() > until:
                raise BusyError(f"{path} was created and not written")
            time.sleep(0.05)
        # One name of some dozen characters.
        return self.spark.read.text(path.toString()).first()["value"]

    @contextmanager
    def exclusive(self, what: str, patience_s: float = 60.0) -> Iterator[None]:
        """One writer at a time. A writer that died leaves its marker; ``release`` takes it away."""
        mine, until = uuid.uuid4().hex, time.monotonic() + patience_s
        while self.claim("writer", what, holder=mine) != mine:
            if time.monotonic() > until:
                raise BusyError(f"{what} is being written")
            time.sleep(0.2)
        try:
            yield
        finally:
            self.release(what)

    def release(self, what: str) -> None:
        path, files = self._marker("writer", (what,))
        files.delete(path, False)
