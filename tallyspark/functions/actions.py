"""Contract of recommendations, action instructions and evidence items: parsing, hashes, and predicates in the form of ``validation``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import lookup, sha256
from .reference_data import SYSTEMS
from .validation import bad_format

# Words of the contract.
ACTIONS = ("CORRECT_LEGACY_BOOKING_FIELD", "MANUAL_INVESTIGATION")
PRIORITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
RISK_TIERS = ("LOW", "MEDIUM", "HIGH")
ROLES = ("MAKER", "CHECKER")
TARGET_FIELD = "/payload/confirmation_reference"
RECOMMENDATION = (
    "abstain_reason string, citations array<struct<document_id:string,section:string>>, confidence double, predicted_root_cause string, priority string, "
    "proposed_fields map<string,string>, recommended_action string, required_approvals array<string>, risk_tier string"
)
RECOMMENDATION_FIELDS = (
    "abstain_reason", "citations", "confidence", "predicted_root_cause", "priority", "proposed_fields", "recommended_action", "required_approvals", "risk_tier",
)
#: Columns that the semantic key of an action binds, in the alphabetical order of its JSON.
IDEMPOTENT = (
    "action_type", "content_hash", "exact_approved_new_value", "normalised_expected_old_value", "portfolio_id", "target_booking_version", "tenant_id", "trade_id",
)


def _outside(value: Column, words: tuple[str, ...]) -> Column:
    return ~F.coalesce(value.isin(*words), F.lit(False))


def _not(holds: Column) -> Column:
    """Broken unless it surely holds: a missing value of a required field breaks its rule."""
    return ~F.coalesce(holds, F.lit(False))


def parsed_recommendations(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """rows with the fields of a provider's answer and ``reasons``; an answer with a reason must not reach the policy. Null and broken text is NOT_JSON only."""
    c = F.col
    schema = f"{RECOMMENDATION}, _broken string"
    read = rows.withColumn("_r", F.from_json(raw, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})).withColumn("_keys", F.json_object_keys(raw))
    flat = read.withColumns({name: c(f"_r.{name}") for name in RECOMMENDATION_FIELDS})
    broken = c("_r").isNull() | c("_r._broken").isNotNull() | c("_keys").isNull()
    rules = recommendation_rules() | {"UNKNOWN_FIELD": F.size(F.array_except("_keys", F.array(*map(F.lit, RECOMMENDATION_FIELDS)))) > 0}
    codes = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(code)) for code, bad in rules.items()]))
    return flat.withColumn("reasons", F.when(broken, F.array(F.lit("NOT_JSON"))).otherwise(codes)).drop("_r", "_keys")


def recommendation_rules() -> dict[str, Column]:
    """Columns of RECOMMENDATION. An action and a reason to abstain exclude each other; one of them is there."""
    c = F.col
    cause = F.length(F.coalesce(F.trim("predicted_root_cause"), F.lit("")))
    abstains = F.coalesce(F.length(F.trim("abstain_reason")) > 0, F.lit(False))
    acts = c("recommended_action").isNotNull()
    return {
        "ROOT_CAUSE_LENGTH": ~cause.between(1, 2000),
        "CONFIDENCE_RANGE": ~F.coalesce(c("confidence").between(0.0, 1.0), F.lit(False)),
        "PRIORITY": _outside(c("priority"), PRIORITIES),
        "RISK_TIER": _outside(c("risk_tier"), RISK_TIERS),
        "ACTION": acts & _outside(c("recommended_action"), ACTIONS),
        "APPROVAL_ROLE": F.coalesce(F.exists("required_approvals", lambda x: _outside(x, ROLES)), F.lit(False)),
        "CITATION": F.coalesce(F.exists("citations", lambda x: x["document_id"].isNull() | x["section"].isNull()), F.lit(False)),
        "NEITHER_ACTION_NOR_REASON": ~acts & ~abstains,
        "ACTION_AND_REASON": acts & abstains,
        "CORRECTION_WITHOUT_FIELD": c("recommended_action").eqNullSafe(F.lit(ACTIONS[0])) & (F.coalesce(F.size("proposed_fields"), F.lit(0)) < 1),
    }


def recommendation_hash() -> Column:
    """What an approval is bound to: hash of all fields of the recommendation, keys in order, nulls kept, maps as sorted entries."""
    fields = [F.array_sort(F.map_entries(name)).alias(name) if name == "proposed_fields" else F.col(name) for name in RECOMMENDATION_FIELDS]
    return sha256(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


def ordered_sources(sources: str) -> Column:
    """Source references of an action (tenant_id, portfolio_id, case_id, trade_id, observation_id, source_version, content_hash, kind, source_system) in the
    order in which they are hashed; the set has no order of its own."""
    order = ("tenant_id", "portfolio_id", "case_id", "trade_id", "observation_id", "source_version", "content_hash", "kind", "source_system")
    return F.array_sort(F.transform(sources, lambda x: F.struct(*[F.coalesce(x[f].cast("string"), F.lit("")).alias(f) for f in order])))


def idempotency_key() -> Column:
    """At most one effect for one meaning: the same correction of the same booking version has the same key."""
    return F.concat(F.lit("idem:"), F.sha2(F.to_json(F.struct(*IDEMPOTENT), {"ignoreNullFields": "false"}), 256))


def action_rules() -> dict[str, Column]:
    """Columns of one action draft: IDEMPOTENT, case_id, target_field_path, control_type, lease_expires_at, issued_at, not_before, expires_at, sources (array as in
    ``ordered_sources``), maker_reference, checker_reference, signer_key_id, signature_algorithm, signature, draft (its hashed text), idempotency_key."""
    c = F.col
    scope = ("tenant_id", "portfolio_id", "case_id", "trade_id")
    foreign = lambda x: ~(F.struct(*[x[f].alias(f) for f in scope]).eqNullSafe(F.struct(*[c(f).alias(f) for f in scope])))
    ids = F.transform("sources", lambda x: x["observation_id"])
    lease = c("lease_expires_at")
    signed = [c(x).isNotNull() for x in ("signer_key_id", "signature_algorithm", "signature")]
    number = sum((x.cast("int") for x in signed), F.lit(0))
    return {
        "TARGET_FIELD": _not(c("target_field_path") == TARGET_FIELD),
        "BOOKING_VERSION": _not(c("target_booking_version") >= 1),
        "NEW_VALUE_LENGTH": _not(F.length("exact_approved_new_value").between(1, 128)),
        "VALUE_UNCHANGED": c("normalised_expected_old_value") == c("exact_approved_new_value"),
        "STARTS_BEFORE_ISSUE": _not(c("not_before") >= c("issued_at")),
        "ENDS_BEFORE_START": _not(c("expires_at") > c("not_before")),
        "CONTROL_LEASE": (c("control_type") == "CAS") & lease.isNotNull() | (c("control_type") == "LEASE") & lease.isNull(),
        "LEASE_WINDOW": lease.isNotNull() & ((lease <= c("not_before")) | (lease > c("expires_at"))),
        "NO_SOURCES": _not(F.size("sources") >= 1),
        "SOURCE_REPEATS": F.size(ids) != F.size(F.array_distinct(ids)),
        "SOURCE_SCOPE": F.exists("sources", foreign),
        "SOURCE_SYSTEM": F.exists("sources", lambda x: ~x["source_system"].eqNullSafe(lookup(x["kind"], SYSTEMS))),
        "SAME_DECISION": _not(c("maker_reference") != c("checker_reference")),
        "SIGNATURE_INCOMPLETE": number.isin(1, 2),
        "CONTENT_HASH": ~c("content_hash").eqNullSafe(sha256(c("draft"))),
        "IDEMPOTENCY_KEY": ~c("idempotency_key").eqNullSafe(idempotency_key()),
    }


def evidence_rules() -> dict[str, Column]:
    """Columns of one evidence item: evidence_id, evidence_version, supersedes_evidence_id, derivative_of_evidence_id, redaction_status, evidence_kind, scope and
    source_scope (structs of tenant_id, portfolio_id, case_id, trade_id; the latter may be null), source_kind, source_system, source_version, source_hash, content_hash, captured_at,
    created_at."""
    c = F.col
    derived = c("redaction_status") == "REDACTED_DERIVATIVE"
    known = [c(x).isNotNull() for x in ("source_scope", "source_kind", "source_system")]
    number = sum((x.cast("int") for x in known), F.lit(0))
    hashed = c("evidence_kind") == "SOURCE_OBSERVATION_HASH"
    return {
        "CREATED_BEFORE_CAPTURE": _not(c("created_at") >= c("captured_at")),
        "FIRST_SUPERSEDES": (c("evidence_version") == 1) & c("supersedes_evidence_id").isNotNull(),
        "REVISION_WITHOUT_FORMER": (c("evidence_version") > 1) & c("supersedes_evidence_id").isNull(),
        "SUPERSEDES_ITSELF": c("supersedes_evidence_id") == c("evidence_id"),
        "DERIVATIVE_WITHOUT_ORIGIN": derived & c("derivative_of_evidence_id").isNull(),
        "DERIVES_FROM_ITSELF": derived & (c("derivative_of_evidence_id") == c("evidence_id")),
        "ORIGIN_OF_NO_DERIVATIVE": ~derived & c("derivative_of_evidence_id").isNotNull(),
        "CONTENT_HASH": c("content_hash").isNull() | bad_format(c("content_hash"), "sha256"),
        "SOURCE_INCOMPLETE": number.isin(1, 2),
        "SOURCE_SYSTEM": c("source_kind").isNotNull() & ~c("source_system").eqNullSafe(lookup(c("source_kind"), SYSTEMS)),
        "HASH_WITHOUT_SOURCE": hashed & ((number < 3) | c("source_version").isNull() | c("source_hash").isNull()),
        "SOURCE_SCOPE": c("source_scope").isNotNull() & ~c("source_scope").eqNullSafe(c("scope")),
    }
