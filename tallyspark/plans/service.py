"""The engine's workflows over its append-only tables: what a service or dashboard calls. Reads return DataFrames; nothing is collected but single cases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest, remediation, reporting
from ..functions.columns import opaque_id
from ..functions.reference_data import Config
from ..operators import reconcile as R
from ..operators.tables import Store, UniquenessError


APPROVAL = "case_id string, role string, approver_identity string, decision string, approved_recommendation_hash string"


class NotEligible(ValueError):
    """A break or case that the step does not apply to."""


class NotFound(LookupError):
    """Nothing of that id is in the scope."""


class Engine:
    """One tenant's view: every read is scoped to the tenant and its portfolios."""

    def __init__(
        self, spark: SparkSession, root: str, tenant_id: str, portfolio_ids: list[str], secret: bytes, config: Config | None = None, runbooks: DataFrame | None = None, provider: Callable | None = None
    ):
        """runbooks: rows of ``files.runbook_sections``, searched for each case; provider: see ``remediation.recommend``."""
        self.spark, self.store, self.secret, self.config = spark, Store(spark, root), secret, config
        self.tenant_id, self.portfolio_ids, self.runbooks, self.provider = tenant_id, portfolio_ids, runbooks, provider

    def _read(self, name: str) -> DataFrame:
        return reporting.scoped(self.store.read(name), self.tenant_id, self.portfolio_ids)

    def load(self, deliveries: DataFrame, on_conflict: str = "quarantine") -> DataFrame:
        foreign = deliveries.where((F.col("tenant_id") != self.tenant_id) | ~F.col("portfolio_id").isin(self.portfolio_ids))
        if foreign.limit(1).count():
            raise ValueError("deliveries outside the scope")
        return self.store.ingest(deliveries, on_conflict)

    def run(self, run_id: str, completed_at: Column | None = None) -> DataFrame:
        return self.store.run(run_id, self.config, completed_at)

    def summary(self) -> DataFrame:
        """One row: totals of the latest run; no rows before the first."""
        return reporting.totals(reporting.of_latest_run(self._read("reconciliation_runs"), self._read("reconciliation_runs")))

    def summary_tables(self) -> dict[str, DataFrame]:
        """What a dashboard shows beside the totals: breaks of the latest run by family, trades by product, observations by portfolio."""
        return {
            "breaks_by_family": reporting.by_family(reporting.of_latest_run(self._read("trade_breaks"), self._read("reconciliation_runs"))),
            "trades_by_product": reporting.trades_by_product(self._read("canonical_states")),
            "observations": self._read("source_event_inbox").groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("n")),
        }

    def runs(self, limit: int = 20) -> DataFrame:
        return reporting.recent_runs(self._read("reconciliation_runs"), limit)

    def breaks(self, limit: int = 500, run_id: str | None = None, search: str | None = None, **wanted: str | None) -> DataFrame:
        """Breaks of the latest run, or of a named one; filters by family, product_type, state, and by a part of the trade's or break's id."""
        rows = self._read("trade_breaks")
        rows = rows.where(F.col("run_id") == run_id) if run_id else reporting.of_latest_run(rows, self._read("reconciliation_runs"))
        if search:
            rows = rows.where(reporting.search(F.col("trade_id"), search) | reporting.search(F.col("break_id"), search))
        return reporting.break_list(rows, limit, **wanted)

    def break_detail(self, break_id: str) -> DataFrame:
        """The highest version of a break."""
        return self._found(reporting.latest(self._read("trade_breaks").where(F.col("break_id") == break_id), ["break_id"], "break_version"), break_id)

    def trade_detail(self, trade_id: str) -> DataFrame:
        """The latest state of a trade with its breaks of the latest run."""
        rows = reporting.of_latest_run(self._read("trade_breaks"), self._read("reconciliation_runs"))
        return self._found(reporting.trade_detail(self._read("canonical_states"), rows, trade_id), trade_id)

    @staticmethod
    def _found(rows: DataFrame, name: str) -> DataFrame:
        if not rows.limit(1).count():
            raise NotFound(name)
        return rows

    def observations(self, trade: DataFrame | None = None) -> DataFrame:
        """Stored observations that nothing supersedes; of some trades only where a frame of them is given."""
        rows = reporting.scoped(self.store.observations(), self.tenant_id, self.portfolio_ids)
        return rows.join(trade.select(*R.TRADE).distinct(), list(R.TRADE), "left_semi") if trade is not None else rows

    def observation_list(self) -> DataFrame:
        """All stored observations of the scope by trade, sequence and id."""
        return self._read("source_event_inbox").orderBy("lineage_id", "source_sequence", "observation_id")

    def open_case(self, break_id: str) -> DataFrame:
        """Triage, recommendation and policy for one break; the case is stored and its booking record seeded."""
        found = self.break_detail(break_id).select("*", F.explode("comparisons").alias("c")).select(*R.TRADE, "trade_id", "break_id", "family", "c.*")
        triaged = remediation.triage(found, self.observations(found))
        facts = triaged.first()
        if facts is None or not self._read("canonical_states").where(F.col("trade_id") == facts["trade_id"]).limit(1).count():
            raise NotEligible(break_id)
        case = remediation.policy(self._recommended(triaged, facts.asDict())).withColumn("case_id", opaque_id("case_", "break_id")).withColumn("recommendation_hash", remediation.recommendation_hash())
        case = case.select(
            "case_id", *R.TRADE, "trade_id", "break_id", "field_path", F.col("expected_value").alias("approved_value"), F.col("observed_value").alias("expected_old_value"), "policy_outcome", "policy_reason",
            "citations", "prompt", "recommendation_hash",
        )
        self.store.append("remediation_cases", case)
        seed = case.select("tenant_id", "portfolio_id", "trade_id", F.lit(1).alias("record_version"), F.col("expected_old_value").alias("value"), F.lit(None).cast("string").alias("applied_key"))
        self.store.append("legacy_booking_records", seed)
        return self.case(case.first()["case_id"])

    def _recommended(self, triaged: DataFrame, facts: dict) -> DataFrame:
        """The provider's answer for one case. It is asked with the runbook sections that fit the case, and what it cites must be in the runbooks."""
        found = remediation.candidates(self.runbooks, facts) if self.runbooks is not None else []
        rows = F.array(*[F.struct(*[F.lit(x[k]).alias(k) for k in ("citation", "content", "title")]) for x in found]).cast("array<struct<citation:string,content:string,title:string>>")
        asked = triaged.withColumn("prompt", remediation.provider_prompt(rows))
        answered = remediation.recommend(asked, self.provider)
        return answered if self.runbooks is None else remediation.with_known_citations(answered, self.runbooks)

    def case(self, case_id: str) -> DataFrame:
        return self._read("remediation_cases").where(F.col("case_id") == case_id)

    def approve(self, case_id: str, role: str, identity: str, recommendation_hash: str | None = None) -> None:
        """One approval per role, bound to the recommendation that was shown (its hash; the stored one by default); the same person may not hold both."""
        row = self.case(case_id).select("policy_outcome", "recommendation_hash").first()
        if row is None or row[0] != "ELIGIBLE_FOR_APPROVAL" or role not in ("MAKER", "CHECKER"):
            raise NotEligible(case_id)
        if recommendation_hash is not None and recommendation_hash != row[1]:
            raise NotEligible("the approval is of another recommendation")
        if self.store.exists("remediation_approvals"):
            mine = self.store.read("remediation_approvals").where((F.col("case_id") == case_id) & (F.col("approver_identity") == identity) & (F.col("role") != role))
            if mine.limit(1).count():
                raise NotEligible("maker and checker must differ")
        if self.store.claim("approval", case_id, role, holder=identity) != identity:
            raise UniquenessError(f"{role} of {case_id} is decided")
        self.store.append("remediation_approvals", self.spark.createDataFrame([(case_id, role, identity, "APPROVED", row[1])], APPROVAL), strict=True)

    def execute(self, case_id: str, attempt_id: str, now: Column, attempt_context: str = "NORMAL") -> DataFrame:
        """One attempt: envelope once, checks, apply once. A success re-delivers the booking, evaluates the trade again and freezes the evidence."""
        case = self.case(case_id)
        issued = remediation.envelopes(case, now, self.secret)
        # Issued once: whoever claims the case's envelope writes it. One that is claimed and not written (its writer died) is written by the next.
        self.store.claim("envelope", case_id, holder=attempt_id)
        self.store.append("remediation_envelopes", issued)
        envelope = remediation.verified_envelopes(self.store.read("remediation_envelopes").where(F.col("case_id") == case_id).select(*issued.columns), now, self.secret)
        approvals = self.store.read("remediation_approvals") if self.store.exists("remediation_approvals") else self.spark.createDataFrame([], APPROVAL)
        bound = approvals.join(case.select("case_id", F.col("recommendation_hash").alias("approved_recommendation_hash")), ["case_id", "approved_recommendation_hash"], "left_semi")
        state = remediation.approvals(bound)
        record = reporting.latest(self._read("legacy_booking_records"), ["tenant_id", "portfolio_id", "trade_id"], "record_version")
        record = record.select("tenant_id", "portfolio_id", "trade_id", F.col("value").alias("current_value"), "applied_key", "record_version")
        attempt = envelope.join(state.select("case_id", "approval"), "case_id", "left").fillna("MISSING", ["approval"]).join(record, ["tenant_id", "portfolio_id", "trade_id"], "left")
        done = remediation.execute(attempt.withColumn("attempt_context", F.lit(attempt_context)).withColumn("attempt_id", F.lit(attempt_id)))
        done = self._claimed(done)
        self.store.append("remediation_executions", done.select("case_id", "attempt_id", "tenant_id", "portfolio_id", "trade_id", "outcome", "side_effect", "approved_value", "idempotency_key"), strict=True)
        stored = self.store.read("remediation_executions").where((F.col("case_id") == case_id) & (F.col("attempt_id") == attempt_id))
        if stored.where("side_effect").limit(1).count():
            self.store.append("legacy_booking_records", remediation.applied(self._read("legacy_booking_records"), stored))
            self._redeliver(case, now)
            self.rerun_trade(case_id)
            self._freeze(case_id)
        return stored

    def _claimed(self, done: DataFrame) -> DataFrame:
        """The outcome of one attempt once the booking's next version is claimed. Who comes second reads again: the same action has been applied, or another value is there."""
        row = done.where("side_effect").select("tenant_id", "portfolio_id", "trade_id", "record_version", "idempotency_key", "attempt_id").first()
        if row is None:
            return done
        holder = self.store.claim("booking", *row[:3], row["record_version"] + 1, holder=f"{row['idempotency_key']} {row['attempt_id']}")
        key, _, attempt = holder.partition(" ")
        if attempt == row["attempt_id"]:
            return done
        applied = self.store.read("legacy_booking_records").where((F.col("trade_id") == row["trade_id"]) & (F.col("record_version") == row["record_version"] + 1))
        if key == row["idempotency_key"] and not applied.limit(1).count():
            return done  # its claimer died before it wrote the version: the same action goes on
        lost = "DUPLICATE_NOOP" if key == row["idempotency_key"] else "REJECTED_VALUE_MISMATCH"
        return done.withColumn("outcome", F.lit(lost)).withColumn("side_effect", F.lit(False))

    def _redeliver(self, case: DataFrame, now: Column) -> None:
        row = case.first()
        bookings = self._read("source_event_inbox").join(case.select(*R.TRADE), list(R.TRADE), "left_semi")
        fixed = ingest.corrections(bookings.where("kind = 'BOOKING'"), row["field_path"].removeprefix("/payload/"), F.lit(row["approved_value"]), now)
        self.store.ingest(fixed.select(*bookings.columns))

    def trade_observations(self, trade_id: str) -> DataFrame:
        """Observations of the lineages that name a trade as business key or in the payload."""
        rows = reporting.scoped(self.store.observations(), self.tenant_id, self.portfolio_ids)
        return rows.where((F.col("source_business_key") == trade_id) | (F.col("source_trade_id") == trade_id))

    def rerun_trade(self, case_id: str) -> DataFrame:
        """Facts of the case's trade over all that is stored now. A state that has changed is stored as the trade's next version."""
        rows = R.trade_rows(self.observations(self.case(case_id)), self.config)
        self.store.append_states(R.canonical_states(rows))
        return R.facts(rows, self.config)

    def verification(self, case_id: str, run_id: str) -> DataFrame:
        """The run envelope of the case's trade, evaluated again: result, breaks, hash. Like the batch's envelopes, and no entry of the run history."""
        return R.run_envelopes(R.trade_rows(self.observations(self.case(case_id)), self.config), run_id, self.config)

    def _freeze(self, case_id: str) -> None:
        frozen = remediation.frozen_evidence(self.evidence_view(case_id))
        self.store.append("remediation_evidence", frozen)

    def evidence_view(self, case_id: str) -> DataFrame:
        mine = lambda name: self.store.read(name).where(F.col("case_id") == case_id)
        none = self.spark.createDataFrame([], "case_id string, evidence_hash string")
        evidence = mine("remediation_evidence") if self.store.exists("remediation_evidence") else none
        return remediation.case_view(self.case(case_id), mine("remediation_approvals"), mine("remediation_envelopes"), mine("remediation_executions"), evidence)

