"""Closed reference data of trade reconciliation: kinds, policies, families, transitions.

Fixed values throughout: they define the results.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("EXECUTION", "TRADE_CAPTURE", "CONFIRMATION", "BOOKING")
SYSTEMS = {"EXECUTION": "FIX_EXECUTION", "TRADE_CAPTURE": "FIX_TRADE_CAPTURE", "CONFIRMATION": "FPML_CONFIRMATION", "BOOKING": "MOCK_LEGACY_BOOKING"}
REQUIRED_KINDS = ("EXECUTION", "CONFIRMATION", "BOOKING")

#: The two orders in which sources are asked for a field, and the sources trusted for it.
EXECUTION_FIRST = ("FIX_EXECUTION", "FIX_TRADE_CAPTURE", "FPML_CONFIRMATION", "MOCK_LEGACY_BOOKING")
CONFIRMATION_FIRST = ("FPML_CONFIRMATION", "MOCK_LEGACY_BOOKING", "FIX_TRADE_CAPTURE", "FIX_EXECUTION")
EXECUTION_TRUSTED = ("FIX_EXECUTION", "FIX_TRADE_CAPTURE")
CONFIRMATION_TRUSTED = ("FPML_CONFIRMATION",)
EXECUTION_FIELDS = (
    "product_type", "quoted_rate", "settlement_rule_version", "base_currency", "terms_currency", "side", "base_amount", "terms_amount", "trade_date", "value_date",
    "counterparty_id", "book_id",
)
CONFIRMATION_FIELDS = ("lifecycle_status",)

#: family: (condition code, severity)
FAMILIES = {
    "MISSING_REQUIRED_SOURCE": ("MISSING_SOURCE_AFTER_WATERMARK", "HIGH"),
    "AMBIGUOUS_OR_UNMATCHED_LINKAGE": ("LINKAGE_CANDIDATE_SCOPE_INVARIANT", "HIGH"),
    "DUPLICATE_SOURCE_CONFLICT": ("DUPLICATE_SOURCE_IDENTITY_CONTENT", "HIGH"),
    "CURRENCY_PAIR_OR_SIDE_MISMATCH": ("EXACT_CURRENCY_PAIR_SIDE", "CRITICAL"),
    "ECONOMIC_VALUE_MISMATCH": ("DECIMAL_OUTSIDE_TOLERANCE", "CRITICAL"),
    "TRADE_OR_VALUE_DATE_MISMATCH": ("EXACT_TRADE_VALUE_DATE", "HIGH"),
    "LIFECYCLE_STATUS_MISMATCH": ("ALLOWED_LIFECYCLE_RELATION", "HIGH"),
    "POST_ACTION_VERIFICATION_FAILURE": ("POST_ACTION_READBACK_RECONCILIATION", "CRITICAL"),
}
MISSING_SEVERITY = {"EXECUTION": "HIGH", "CONFIRMATION": "MEDIUM", "BOOKING": "HIGH"}
SEVERITY_RANK = {"CRITICAL": 1, "HIGH": 2, "MEDIUM": 3}
DEADLINE_RANK = {"OVERDUE": 1, "DUE": 2, "NO_CONFIGURED_DEADLINE": 3}
SEVERITY_ORDER = ("CRITICAL", "HIGH", "MEDIUM")
DEADLINE_ORDER = ("OVERDUE", "DUE", "NO_CONFIGURED_DEADLINE")
#: (outcome, storage effect) by precedence.
IDENTITY_POLICY = (
    ("REJECT_UNSUPPORTED_SCHEMA_VERSION", "REJECT"), ("REJECT_CROSS_PORTFOLIO_LINKAGE", "REJECT"), ("IDEMPOTENT_REPLAY", "APPEND_DUPLICATE_EVIDENCE"),
    ("DUPLICATE_SOURCE_CONFLICT", "APPEND_CONFLICT_EVIDENCE"), ("NEW_SOURCE_VERSION", "APPEND_AND_SUPERSEDE_ACTIVE_VERSION"),
    ("LATE_SOURCE_VERSION_RECORDED", "APPEND_LATE_NON_ACTIVE_VERSION"), ("LINKAGE_REVIEW_REQUIRED", "APPEND"), ("NEW_OBSERVATION", "APPEND"),
)
NON_ACTION_FAMILIES = ("MISSING_REQUIRED_SOURCE", "POST_ACTION_VERIFICATION_FAILURE")

#: Roles of the evidence of each family's comparisons.
EVIDENCE_ROLES = {
    "MISSING_REQUIRED_SOURCE": ("INGESTION_WATERMARK", "EXPECTED_SOURCE"),
    "AMBIGUOUS_OR_UNMATCHED_LINKAGE": ("CANDIDATE_LINK", "LINKAGE_DECISION"),
    "DUPLICATE_SOURCE_CONFLICT": ("SOURCE_PAYLOAD_PAIR", "SOURCE_METADATA"),
    "CURRENCY_PAIR_OR_SIDE_MISMATCH": ("FIELD_COMPARISON", "NORMALISATION_RULE"),
    "ECONOMIC_VALUE_MISMATCH": ("DECIMAL_COMPARISON", "NORMALISATION_RULE"),
    "TRADE_OR_VALUE_DATE_MISMATCH": ("DATE_COMPARISON", "NORMALISATION_RULE"),
    "LIFECYCLE_STATUS_MISMATCH": ("LIFECYCLE_RELATION", "NORMALISATION_RULE"),
    "POST_ACTION_VERIFICATION_FAILURE": ("ACTION_INSTRUCTION", "PRE_ACTION_READ", "POST_ACTION_READ", "CHANGED_FIELD_DIFF"),
}
#: (path, value type) of the comparisons that a family may hold.
COMPARISONS = {
    "MISSING_REQUIRED_SOURCE": (("/source/execution_observation", "ABSENCE"), ("/source/confirmation_observation", "ABSENCE"), ("/source/booking_observation", "ABSENCE")),
    "AMBIGUOUS_OR_UNMATCHED_LINKAGE": (("/linkage/trade_id", "COUNT"),),
    "DUPLICATE_SOURCE_CONFLICT": (
        ("/source/source_business_key", "SOURCE_IDENTITY"), ("/source/source_version", "SOURCE_VERSION"), ("/source/content_hash", "CONTENT_HASH"),
    ),
    "CURRENCY_PAIR_OR_SIDE_MISMATCH": (("/payload/base_currency", "CURRENCY"), ("/payload/terms_currency", "CURRENCY"), ("/payload/side", "SIDE")),
    "ECONOMIC_VALUE_MISMATCH": (("/payload/base_amount", "DECIMAL"), ("/payload/terms_amount", "DECIMAL"), ("/payload/quoted_rate", "DECIMAL")),
    "TRADE_OR_VALUE_DATE_MISMATCH": (("/payload/trade_date", "DATE"), ("/payload/value_date", "DATE")),
    "LIFECYCLE_STATUS_MISMATCH": (("/payload/lifecycle_status", "LIFECYCLE_STATUS"),),
    "POST_ACTION_VERIFICATION_FAILURE": (
        ("/payload/book_id", "IDENTIFIER"), ("/payload/lifecycle_status", "LIFECYCLE_STATUS"), ("/payload/booking_version", "SOURCE_VERSION"), ("/payload/record_fingerprint", "CONTENT_HASH"),
    ),
}
RESOLUTION_TYPES = {f: ("RECONCILIATION_PASS", "OWNER_APPROVED_NON_ACTION") if f in NON_ACTION_FAMILIES else ("RECONCILIATION_PASS",) for f in FAMILIES}
MATERIALITY_ORDER = ("MATERIAL", "UNASSESSED", "NON_MATERIAL")
TIE_BREAKERS = ("MATERIALITY_BAND", "SEVERITY", "LIFECYCLE_DEADLINE", "CASE_AGE")

TRANSITIONS = (
    (None, "OPEN", "DETECTED"),
    ("OPEN", "UNDER_INVESTIGATION", "BEGIN_INVESTIGATION"),
    ("OPEN", "ESCALATED", "ESCALATE"),
    ("UNDER_INVESTIGATION", "RESOLUTION_PROPOSED", "PROPOSE_RESOLUTION"),
    ("UNDER_INVESTIGATION", "ESCALATED", "ESCALATE"),
    ("RESOLUTION_PROPOSED", "ACTION_PENDING", "ACTION_AUTHORISATION_PENDING"),
    ("RESOLUTION_PROPOSED", "NO_ACTION_DISPOSITION_PENDING", "NO_ACTION_DISPOSITION_PENDING"),
    ("RESOLUTION_PROPOSED", "ESCALATED", "ESCALATE"),
    ("ACTION_PENDING", "VERIFYING", "BEGIN_VERIFICATION"),
    ("ACTION_PENDING", "ESCALATED", "ESCALATE"),
    ("NO_ACTION_DISPOSITION_PENDING", "VERIFYING", "BEGIN_VERIFICATION"),
    ("NO_ACTION_DISPOSITION_PENDING", "ESCALATED", "ESCALATE"),
    ("VERIFYING", "RESOLVED", "RESOLUTION_VERIFIED"),
    ("VERIFYING", "ESCALATED", "ESCALATE"),
)
STATES = ("OPEN", "UNDER_INVESTIGATION", "RESOLUTION_PROPOSED", "ACTION_PENDING", "NO_ACTION_DISPOSITION_PENDING", "VERIFYING", "RESOLVED", "ESCALATED")

#: What a mutated trade of the synthetic corpus has: (family, variant, kind, effect, late)
VARIANTS = (
    ("MISSING", 0, "EXECUTION", "DROP", False), ("MISSING", 1, "EXECUTION", "DROP", True), ("MISSING", 2, "CONFIRMATION", "DROP", False),
    ("MISSING", 3, "CONFIRMATION", "DROP", True), ("MISSING", 4, "BOOKING", "DROP", False), ("MISSING", 5, "BOOKING", "DROP", True),
    ("LINKAGE", 0, "EXECUTION", "UNMATCHED", False), ("LINKAGE", 1, "TRADE_CAPTURE", "UNMATCHED", False), ("LINKAGE", 2, "CONFIRMATION", "UNMATCHED", False),
    ("LINKAGE", 3, "EXECUTION", "AMBIGUOUS", False), ("LINKAGE", 4, "TRADE_CAPTURE", "AMBIGUOUS", False), ("LINKAGE", 5, "CONFIRMATION", "AMBIGUOUS", False),
    ("DUPLICATE", 0, "EXECUTION", "DUPLICATE", False), ("DUPLICATE", 1, "TRADE_CAPTURE", "DUPLICATE", False), ("DUPLICATE", 2, "CONFIRMATION", "DUPLICATE", False),
    ("DUPLICATE", 3, "BOOKING", "DUPLICATE", False), ("DUPLICATE", 4, "EXECUTION", "DUPLICATE", True), ("DUPLICATE", 5, "BOOKING", "DUPLICATE", True),
    ("CURRENCY", 0, "EXECUTION", "BASE_GBP", False), ("CURRENCY", 1, "TRADE_CAPTURE", "TERMS_CHF", False), ("CURRENCY", 2, "CONFIRMATION", "SIDE", False),
    ("CURRENCY", 3, "BOOKING", "BASE_GBP", False), ("CURRENCY", 4, "EXECUTION", "TERMS_CHF", False), ("CURRENCY", 5, "TRADE_CAPTURE", "SIDE", False),
    ("ECONOMIC", 0, "EXECUTION", "BASE_AMOUNT", False), ("ECONOMIC", 1, "TRADE_CAPTURE", "TERMS_AMOUNT", False), ("ECONOMIC", 2, "CONFIRMATION", "RATE", False),
    ("ECONOMIC", 3, "BOOKING", "BASE_AMOUNT", False), ("ECONOMIC", 4, "EXECUTION", "TERMS_AMOUNT", False), ("ECONOMIC", 5, "TRADE_CAPTURE", "RATE", False),
    ("DATE", 0, "EXECUTION", "TRADE_DATE", False), ("DATE", 1, "TRADE_CAPTURE", "VALUE_DATE", False), ("DATE", 2, "CONFIRMATION", "TRADE_DATE", False),
    ("DATE", 3, "BOOKING", "VALUE_DATE", False), ("DATE", 4, "EXECUTION", "VALUE_DATE", False), ("DATE", 5, "BOOKING", "TRADE_DATE", True),
    ("LIFECYCLE", 0, "EXECUTION", "AMENDED", False), ("LIFECYCLE", 1, "TRADE_CAPTURE", "AMENDED", False), ("LIFECYCLE", 2, "CONFIRMATION", "AMENDED", False),
    ("LIFECYCLE", 3, "EXECUTION", "CANCELLED", False), ("LIFECYCLE", 4, "TRADE_CAPTURE", "CANCELLED", False), ("LIFECYCLE", 5, "CONFIRMATION", "CANCELLED", False),
    ("POST_ACTION", 0, "BOOKING", "BOOK_ID", False), ("POST_ACTION", 1, "BOOKING", "CANCELLED", False), ("POST_ACTION", 2, "BOOKING", "BOOK_ID", False),
    ("POST_ACTION", 3, "BOOKING", "CANCELLED", False), ("POST_ACTION", 4, "BOOKING", "BOOK_ID", False), ("POST_ACTION", 5, "BOOKING", "CANCELLED", True),
)
FAMILY_ORDER = ("MISSING", "LINKAGE", "DUPLICATE", "CURRENCY", "ECONOMIC", "DATE", "LIFECYCLE", "POST_ACTION")


TOLERANCE_MODES = ("NONE", "ABSOLUTE_DECIMAL", "RELATIVE_DECIMAL")


@dataclass(frozen=True)
class Config:
    """Arrival windows (seconds), decimal tolerances (mode, value) and expected statuses. The defaults are the fixture configuration."""

    windows: dict[tuple[str, str], int] = field(default_factory=lambda: {(p, k): 0 for p in ("FX_SPOT", "FX_FORWARD") for k in REQUIRED_KINDS})
    tolerances: dict[tuple[str, str], tuple[str, str]] = field(
        default_factory=lambda: {
            (p, f): ("ABSOLUTE_DECIMAL", v) for p in ("FX_SPOT", "FX_FORWARD") for f, v in (("base_amount", "0.01"), ("terms_amount", "0.01"), ("quoted_rate", "0.0001"))
        }
    )
    statuses: dict[str, str] = field(default_factory=lambda: {"EXECUTION": "NEW", "TRADE_CAPTURE": "CAPTURED", "CONFIRMATION": "CONFIRMED", "BOOKING": "BOOKED"})
    effective_from: str = "2026-01-01 00:00:00"
    effective_to: str | None = None
    config_id: str = "config_fixture"
    version: str = "1.0.0"
    status: str = "FIXTURE_ONLY"
    owner_reference: str | None = None

    def problems(self) -> list[str]:
        """Reasons why the configuration is incomplete or malformed; empty if it is sound."""
        out = []
        products = ("FX_SPOT", "FX_FORWARD")
        if set(self.windows) != {(p, k) for p in products for k in REQUIRED_KINDS}:
            out.append("ARRIVAL_WINDOWS_INCOMPLETE")
        if any(v < 0 for v in self.windows.values()):
            out.append("ARRIVAL_WINDOW_NEGATIVE")
        if set(self.tolerances) != {(p, f) for p in products for f in ("base_amount", "terms_amount", "quoted_rate")}:
            out.append("TOLERANCES_INCOMPLETE")
        if any(m not in TOLERANCE_MODES or (m == "NONE") != (v is None) for m, v in self.tolerances.values()):
            out.append("TOLERANCE_SHAPE")
        if set(self.statuses) != set(KINDS):
            out.append("LIFECYCLE_RULES_INCOMPLETE")
        if self.status == "OWNER_APPROVED" and not self.owner_reference:
            out.append("OWNER_REFERENCE_MISSING")
        if self.effective_to is not None and self.effective_to <= self.effective_from:
            out.append("EFFECTIVE_INTERVAL_EMPTY")
        return out

    def effective(self, at: Column) -> Column:
        """Whether a time is in the effective interval, which holds its beginning and not its end."""
        inside = at >= F.lit(self.effective_from).cast("timestamp")
        return inside if self.effective_to is None else inside & (at < F.lit(self.effective_to).cast("timestamp"))

    def content_hash(self) -> str:
        """Hash of the canonical JSON of all rules."""
        document = {
            "config_id": self.config_id, "effective_from": self.effective_from, "effective_to": self.effective_to, "owner_reference": self.owner_reference, "status": self.status,
            "statuses": self.statuses, "tolerances": [[*key, *rule] for key, rule in sorted(self.tolerances.items())], "version": self.version,
            "windows": [[*key, seconds] for key, seconds in sorted(self.windows.items())],
        }
        return "sha256:" + hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
