"""Remediation: triage of breaks, policy, approvals, signed envelopes, idempotent execution, runbook search."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import canonical_json, lookup, sha256
from ..functions.reference_data import IDENTITY_POLICY
from .lineage import checkpointed

# Fixed values of the policy.
CONFIDENCE_THRESHOLD = 0.7
ACTION = "CORRECT_LEGACY_BOOKING_FIELD"
ALLOWED_FIELDS = ("/payload/base_amount",)
SUPPORTING_SECTIONS = {
    "CORRECT_LEGACY_BOOKING_FIELD": ("RB-001#1", "RB-001#2", "RB-001#3", "RB-002#1", "RB-002#7"),
    "MANUAL_INVESTIGATION": ("RB-001#5", "RB-002#4"),
}
PREFERRED_SECTIONS = ("RB-001#3", "RB-002#1")
ENVELOPE_SECONDS = 900
#: Tables that a closure keeps apart.
MOST_PARTS = 16


def triage(facts: DataFrame, observations: DataFrame) -> DataFrame:
    """Eligible breaks: economic facts on the base amount with both sources; with the systems behind them."""
    systems = observations.select("tenant_id", "portfolio_id", "lineage_id", "observation_id", "source_system")
    name = lambda c: systems.withColumnsRenamed({"observation_id": f"{c}_observation_id", "source_system": f"{c}_source_system"})
    keys = ["tenant_id", "portfolio_id", "lineage_id"]
    wanted = facts.where("family = 'ECONOMIC_VALUE_MISMATCH' and field_path = '/payload/base_amount' and expected_observation_id is not null and observed_observation_id is not null")
    return wanted.join(name("expected"), [*keys, "expected_observation_id"]).join(name("observed"), [*keys, "observed_observation_id"])


def triage_of_trades(facts: DataFrame) -> DataFrame:
    """``triage`` of facts that have the observations of their trade with them (``obs``, as of ``reconcile.gathered``), which then need not be met again."""
    wanted = facts.where("family = 'ECONOMIC_VALUE_MISMATCH' and field_path = '/payload/base_amount'")
    system = lambda side: F.try_element_at(F.filter("obs", lambda x: x["observation_id"] == F.col(f"{side}_observation_id")), F.lit(1))["source_system"]
    seen = lambda side: F.exists("obs", lambda x: x["observation_id"] == F.col(f"{side}_observation_id"))
    return wanted.where(seen("expected") & seen("observed")).withColumns({f"{side}_source_system": system(side) for side in ("expected", "observed")})


PROMPT_FACTS = ("expected_source_system", "expected_value", "family", "field_path", "observed_source_system", "observed_value", "trade_id")


def provider_prompt(candidates: Column) -> Column:
    """What a provider is asked: the facts of a triaged case, and the runbook sections it may cite (array of structs of citation, title, content), as canonical JSON."""
    return canonical_json(F.struct(candidates.alias("candidate_citations"), F.struct(*PROMPT_FACTS).alias("facts")), keep_nulls=True)


def candidate_query(case: dict) -> str:
    """What runbooks are searched for."""
    words = (case["family"], case["field_path"], "economic value mismatch", case["expected_source_system"], case["observed_source_system"], "correction authoritative source booking")
    return " ".join(words)


def candidates(sections: DataFrame, case: dict, top_k: int = 5) -> list[dict]:
    """The sections that share most words with a case: citation, title, content; at most top_k rows."""
    found = keyword_search(sections, candidate_query(case), top_k, F.concat_ws(" ", "title", "content"), ["document_id", "section_number"])
    return [{"citation": f"{r['document_id']}#{r['section_number']}", "title": r["title"], "content": r["content"]} for r in found.collect()]


RECOMMENDED = ("abstain_reason", "citations", "confidence", "proposed_fields", "recommended_action")


def recommendation_hash() -> Column:
    """What an approval is bound to: all that a recommendation says, and the break it is for."""
    entries = F.array_sort(F.map_entries("proposed_fields")).alias("proposed_fields")
    fields = [entries if c == "proposed_fields" else F.col(c) for c in sorted((*RECOMMENDED, "break_id"))]
    return sha256(canonical_json(F.struct(*fields), keep_nulls=True))


def recommend(cases: DataFrame, provider: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Recommendations of a provider: a function of triaged cases that adds what ``rule_based`` adds, which is the one taken without another."""
    return (provider or rule_based)(cases)


def rule_based(cases: DataFrame) -> DataFrame:
    """A correction where booking deviates from execution, else it abstains."""
    fit = (F.col("expected_source_system") == "FIX_EXECUTION") & (F.col("observed_source_system") == "MOCK_LEGACY_BOOKING")
    return cases.select(
        "*",
        F.when(fit, 0.93).otherwise(0.2).alias("confidence"),
        F.when(fit, ACTION).alias("recommended_action"),
        F.when(fit, F.create_map("field_path", "expected_value")).otherwise(F.create_map().cast("map<string,string>")).alias("proposed_fields"),
        F.when(fit, F.array(*map(F.lit, PREFERRED_SECTIONS))).otherwise(F.array().cast("array<string>")).alias("citations"),
        F.when(~fit, "unsupported_break_pattern").alias("abstain_reason"),
    )


def with_known_citations(recommended: DataFrame, sections: DataFrame) -> DataFrame:
    """Citations (document#section) that the runbook index holds; others go, so that the policy sees them as missing. sections: document_id, section_number of the packaged runbooks, some dozen rows."""
    rows = sections.select(F.concat("document_id", F.lit("#"), F.col("section_number").cast("string"))).distinct().limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("the runbook index has more sections than fit a literal")
    known = F.array(*[F.lit(r[0]) for r in rows]).cast("array<string>")
    return recommended.withColumn("citations", F.array_intersect("citations", known))


def policy(recommended: DataFrame) -> DataFrame:
    """The policy ladder: the first rule that applies decides. Columns: confidence, recommended_action, abstain_reason, citations, proposed_fields, field_path,
    expected_value."""
    c = F.col
    keys, values = F.map_keys("proposed_fields"), F.map_values("proposed_fields")
    field, value = F.try_element_at(keys, F.lit(1)), F.try_element_at(values, F.lit(1))
    supported = F.arrays_overlap("citations", F.array(*map(F.lit, SUPPORTING_SECTIONS[ACTION])))
    ladder = (
        ("MANUAL_INVESTIGATION", "confidence_below_threshold", c("confidence") < CONFIDENCE_THRESHOLD),
        ("MANUAL_INVESTIGATION", None, c("recommended_action").isNull()),
        ("REJECTED", "action_outside_allow_list", c("recommended_action") != ACTION),
        ("REJECTED", "missing_citation", F.size("citations") == 0),
        ("REJECTED", "citation_does_not_support_action", ~supported),
        ("REJECTED", "proposed_fields_must_be_exactly_one", F.size(keys) != 1),
        ("REJECTED", "field_outside_allow_list", ~field.isin(*ALLOWED_FIELDS)),
        ("REJECTED", "field_does_not_match_break", field != c("field_path")),
        ("REJECTED", "proposed_value_does_not_match_authoritative_source", value != c("expected_value")),
    )
    outcome = reason = None
    for result, why, when in ladder:
        text = F.coalesce("abstain_reason", F.lit("ai_abstained")) if why is None else F.lit(why)
        outcome = F.when(when, result) if outcome is None else outcome.when(when, result)
        reason = F.when(when, text) if reason is None else reason.when(when, text)
    eligible = F.lit("economic_field_correction_eligible")
    return recommended.select("*", outcome.otherwise("ELIGIBLE_FOR_APPROVAL").alias("policy_outcome"), reason.otherwise(eligible).alias("policy_reason"))


def approvals(rows: DataFrame) -> DataFrame:
    """Approvals of each case: one each of maker and checker, by different people. rows: case_id, role, approver_identity, decision."""
    yes = rows.where("decision = 'APPROVED'")
    by = yes.groupBy("case_id").agg(
        F.min(F.when(F.col("role") == "MAKER", F.col("approver_identity"))).alias("maker"), F.min(F.when(F.col("role") == "CHECKER", F.col("approver_identity"))).alias("checker")
    )
    missing = F.col("maker").isNull() | F.col("checker").isNull()
    return by.withColumn("approval", F.when(missing, "MISSING").when(F.col("maker") == F.col("checker"), "SAME_IDENTITY").otherwise("COMPLETE"))


def hmac_sha256(text: Column, secret: bytes) -> Column:
    """Hex HMAC-SHA256; Spark has no built-in, so Arrow batches."""

    @F.arrow_udf("string")
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if x is None else hmac.new(secret, x.encode(), hashlib.sha256).hexdigest() for x in batch.to_pylist()], pa.string())

    return sign(text)


ENVELOPE = ("case_id", "tenant_id", "portfolio_id", "trade_id", "field_path", "expected_old_value", "approved_value", "idempotency_key", "issued_at", "expires_at")


def envelope_hash() -> Column:
    """Hash of the canonical JSON of an envelope: named fields in order, nulls kept, so that no two envelopes have one text."""
    return sha256(canonical_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(ENVELOPE)]), keep_nulls=True))


def envelopes(cases: DataFrame, issued_at: Column, secret: bytes, more: tuple[str, ...] = ()) -> DataFrame:
    """Signed envelopes of eligible cases (case_id, scope, trade_id, field_path, expected_old_value, approved_value), valid for 15 minutes. ``more`` are columns of the case that stay beside them."""
    meaning = canonical_json(F.struct("approved_value", "case_id", "field_path", "trade_id"), keep_nulls=True)
    key = F.concat(F.lit("idem:"), F.sha2(meaning, 256))
    made = cases.withColumn("idempotency_key", key).withColumn("issued_at", issued_at).withColumn("expires_at", issued_at + F.make_dt_interval(secs=F.lit(ENVELOPE_SECONDS)))
    made = made.select(*ENVELOPE, *more).withColumn("envelope_hash", envelope_hash())
    return made.withColumn("signature", hmac_sha256(F.col("envelope_hash"), secret))


def verified_envelopes(rows: DataFrame, now: Column, secret: bytes) -> DataFrame:
    """rows with ``envelope_status``: TAMPERED before EXPIRED (at the end itself too) before VALID."""
    sound = (F.col("envelope_hash") == envelope_hash()) & (F.col("signature") == hmac_sha256(F.col("envelope_hash"), secret))
    return rows.withColumn("envelope_status", F.when(~F.coalesce(sound, F.lit(False)), "TAMPERED").when(now >= F.col("expires_at"), "EXPIRED").otherwise("VALID"))


def execute(attempts: DataFrame) -> DataFrame:
    """Outcome of each attempt. Columns: envelope_status, approval, field_path, current_value (null: no record), applied_key, idempotency_key, expected_old_value, attempt_context."""
    c = F.col
    replay = c("applied_key").eqNullSafe(c("idempotency_key")) & c("current_value").isNotNull()
    outcome = (
        F.when(c("envelope_status") == "TAMPERED", "REJECTED_TAMPERED")
        .when(c("envelope_status") == "EXPIRED", "REJECTED_EXPIRED")
        .when(c("approval") == "MISSING", "REJECTED_APPROVALS_MISSING")
        .when(c("approval") == "SAME_IDENTITY", "REJECTED_SAME_IDENTITY")
        .when(~c("field_path").isin(*ALLOWED_FIELDS), "REJECTED_FIELD_NOT_ALLOWED")
        .when(replay, F.when(c("attempt_context") == "TIMEOUT_RECOVERY_ATTEMPT", "TIMEOUT_RECOVERED").otherwise("DUPLICATE_NOOP"))
        .when(c("current_value").isNull() | (c("current_value") != c("expected_old_value")), "REJECTED_VALUE_MISMATCH")
        .otherwise("SUCCESS")
    )
    return attempts.withColumn("outcome", outcome).withColumn("side_effect", outcome == "SUCCESS")


def seeded(records: DataFrame | None, seeds: DataFrame) -> DataFrame:
    """records and the seeds of trades that have none: a record that is there stays as it is."""
    return seeds if records is None else records.unionByName(seeds.join(records, ["tenant_id", "portfolio_id", "trade_id"], "left_anti"))


def applied(records: DataFrame, executed: DataFrame) -> DataFrame:
    """New versions of the records that succeeded; the latest version is the record. records: scope, trade_id, record_version, value, applied_key."""
    keys = ["tenant_id", "portfolio_id", "trade_id"]
    w = Window.partitionBy(*keys).orderBy(F.desc("record_version"))
    last = records.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*keys, "record_version")
    done = executed.where("side_effect").select(*keys, F.col("approved_value").alias("value"), F.col("idempotency_key").alias("applied_key"))
    return last.join(done, keys).select(*keys, (F.col("record_version") + 1).alias("record_version"), "value", "applied_key")


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))


def keyword_search(sections: DataFrame, query: str, top_k: int, text: Column, order: list[str]) -> DataFrame:
    """The sections sharing most words with the query; sections that share none are never returned."""
    wanted = F.array(*[F.lit(w) for w in sorted({w for w in _words(query)})])
    return sections.withColumn("overlap", F.size(F.array_intersect(tokens(text), wanted))).where("overlap > 0").orderBy(F.desc("overlap"), *order).limit(top_k)


def _words(query: str) -> list[str]:
    import re

    return re.findall("[a-z0-9]+", query.lower())


def case_view(cases: DataFrame, approval_rows: DataFrame, envelope_rows: DataFrame, executions: DataFrame, evidence: DataFrame) -> DataFrame:
    """A case with its nested children; children are gathered before the join."""
    def gathered(rows: DataFrame, *fields: str, name: str) -> DataFrame:
        return rows.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))

    return (
        cases.join(gathered(approval_rows, "role", "approver_identity", "decision", name="approvals"), "case_id", "left")
        .join(envelope_rows.select("case_id", F.struct("idempotency_key", "envelope_hash").alias("envelope")), "case_id", "left")
        .join(gathered(executions, "attempt_id", "outcome", name="executions"), "case_id", "left")
        .join(evidence.select("case_id", F.col("evidence_hash")), "case_id", "left")
    )


def frozen_evidence(views: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Hashed snapshots of case views, once a case: a stored one stays."""
    made = views.select("case_id", F.sha2(F.to_json(F.struct(*sorted(views.columns)), {"ignoreNullFields": "false"}), 256).alias("evidence_hash"))
    return made if stored is None else made.join(stored.select("case_id"), "case_id", "left_anti")


def reachable(edges: DataFrame, starts: DataFrame, most_steps: int = 1000) -> DataFrame:
    """(start, node) of the transitive closure over edges(source, target). Only pairs that are new go on, so
    diamonds and cycles add nothing. Raises where ``most_steps`` do not reach the end, rather than returning what is there. Each step checkpoints its new pairs only; what many steps have found is put together
    now and then, so that plans stay short."""
    edges = checkpointed(edges.select("source", "target").distinct())
    new = checkpointed(starts.select(F.col("node").alias("start"), "node").distinct())
    parts = [new]
    for _ in range(most_steps):
        onward = new.join(edges, new["node"] == edges["source"]).select("start", F.col("target").alias("node")).distinct()
        found = reduce(DataFrame.unionByName, parts)
        new = checkpointed(onward.join(found, ["start", "node"], "left_anti"))
        if not new.limit(1).count():
            return found
        parts = [*parts, new] if len(parts) < MOST_PARTS else [checkpointed(found), new]
    raise RuntimeError(f"the closure was not complete after {most_steps} steps")


def identity_outcome() -> Column:
    """The identity policy as a ladder over condition flags, by precedence."""
    c = F.col
    return (
        F.when(~c("schema_supported"), "REJECT_UNSUPPORTED_SCHEMA_VERSION")
        .when(~c("scope_match"), "REJECT_CROSS_PORTFOLIO_LINKAGE")
        .when(c("same_delivery") & c("same_hash"), "IDEMPOTENT_REPLAY")
        .when(c("same_delivery") & ~c("same_hash"), "DUPLICATE_SOURCE_CONFLICT")
        .when(c("same_source") & (c("version_relation") == "GREATER"), "NEW_SOURCE_VERSION")
        .when(c("same_source") & (c("version_relation") == "LOWER"), "LATE_SOURCE_VERSION_RECORDED")
        .when(c("candidates") != 1, "LINKAGE_REVIEW_REQUIRED")
        .otherwise("NEW_OBSERVATION")
    )


def storage_effect(outcome: Column) -> Column:
    return lookup(outcome, dict(IDENTITY_POLICY))
