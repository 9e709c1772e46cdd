"""Contract predicates: each rule is a reason code and a column that is true where the rule is broken. Rows are never lost: a frame is split into valid rows and
rejected rows with all their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import lookup
from .reference_data import FAMILIES, NON_ACTION_FAMILIES, REQUIRED_KINDS, SYSTEMS, TRANSITIONS

# Formats of the contract.
PATTERNS = {
    "identifier": r"^[a-z][a-z0-9_-]{2,127}$",
    "tenant": r"^tenant_[a-z0-9][a-z0-9_-]{1,63}$",
    "portfolio": r"^portfolio_[a-z0-9][a-z0-9_-]{1,63}$",
    "correlation": r"^corr_[a-z0-9][a-z0-9_-]{1,127}$",
    "sha256": r"^sha256:[0-9a-f]{64}$",
    "semantic_version": r"^[0-9]+\.[0-9]+\.[0-9]+$",
    "source_version": r"^[1-9][0-9]{0,18}$",
    "currency": r"^[A-Z]{3}$",
    "decimal": r"^(0|[1-9][0-9]*)(\.[0-9]+)?$",
    "aware_timestamp": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "side": r"^(BUY_BASE|SELL_BASE)$",
    "count": r"^(0|[1-9][0-9]*)$",
}
CONFIRMATION_STATUS = {"PENDING": "CAPTURED", "AFFIRMED": "CONFIRMED", "REJECTED": "CANCELLED", "AMENDED": "AMENDED", "CANCELLED": "CANCELLED"}
EXECUTION_TRIPLES = (("NEW", "EXECUTED", "NEW"), ("AMEND", "AMENDED", "AMENDED"), ("CANCEL", "CANCELLED", "CANCELLED"))
CAPTURE_TRIPLES = (("NEW", "CAPTURED", "CAPTURED"), ("AMEND", "AMENDED", "AMENDED"), ("CANCEL", "CANCELLED", "CANCELLED"))
LINKAGE_REASONS = {
    "ACCEPTED": "EXACT_DETERMINISTIC_KEY",
    "REJECTED": "HUMAN_REJECTED",
    "UNMATCHED": "NO_ELIGIBLE_CANDIDATE",
    "AMBIGUOUS": "MULTIPLE_ELIGIBLE_CANDIDATES",
    "CROSS_SCOPE_REJECTED": "TENANT_OR_PORTFOLIO_SCOPE_MISMATCH",
}


def bad_format(value: Column, name: str) -> Column:
    """Present but not of the format. (`$` alone would admit a final line break.)"""
    return value.isNotNull() & ~value.rlike(PATTERNS[name].removesuffix("$") + r"\z")


def fraction_digits(value: Column) -> Column:
    return F.when(value.contains("."), F.length(F.substring_index(value, ".", -1))).otherwise(0)


def scale_mismatch(amount: str) -> Column:
    return F.coalesce(fraction_digits(F.col(f"{amount}_value")) != F.col(f"{amount}_scale"), F.lit(False))


def settlement_window(product: Column, trade: Column, value: Column) -> Column:
    """Broken where value is before trade, a forward settles on its trade date, or a spot later than four days after it."""
    days = F.datediff(value, trade)
    return (days < 0) | (product == "FX_FORWARD") & (days <= 0) | (product == "FX_SPOT") & (days > 4)


def _not_in(columns: tuple[str, ...], triples: tuple[tuple[str, ...], ...]) -> Column:
    ok = F.lit(False)
    for triple in triples:
        one = F.lit(True)
        for c, v in zip(columns, triple, strict=True):
            one = one & F.col(c).eqNullSafe(F.lit(v))
        ok = ok | one
    return ~ok


def observation_rules() -> dict[str, Column]:
    """Rules of a source observation. Columns: envelope, flat payload, kind_type, kind_status, kind_time."""
    c = F.col
    return {
        "UNSUPPORTED_SCHEMA_VERSION": ~c("schema_version").eqNullSafe(F.lit("1.0.0")),
        "IDENTIFIER_FORMAT": bad_format(c("observation_id"), "identifier") | c("observation_id").isNull(),
        "SCOPE_FORMAT": bad_format(c("tenant_id"), "tenant") | bad_format(c("portfolio_id"), "portfolio"),
        "SOURCE_VERSION_FORMAT": bad_format(c("source_version"), "source_version"),
        "CONTENT_HASH_FORMAT": bad_format(c("content_hash"), "sha256"),
        "CURRENCY_FORMAT": bad_format(c("base_currency"), "currency") | bad_format(c("terms_currency"), "currency"),
        "DECIMAL_FORMAT": bad_format(c("base_amount_value"), "decimal") | bad_format(c("terms_amount_value"), "decimal") | bad_format(c("rate_value"), "decimal"),
        "DECIMAL_SCALE": scale_mismatch("base_amount") | scale_mismatch("terms_amount") | scale_mismatch("rate"),
        "CURRENCY_PAIR": (c("base_currency") == c("terms_currency")) | (c("base_amount_currency") != c("base_currency")) | (c("terms_amount_currency") != c("terms_currency")),
        "SETTLEMENT_WINDOW": settlement_window(c("product_type"), c("trade_date"), c("value_date")),
        "EVENT_AFTER_INGEST": c("event_time") > c("ingest_time"),
        "PAYLOAD_TIME_AFTER_INGEST": c("kind_time") > c("ingest_time"),
        "ENTITY_VERSION": c("entity_version") != 1,
        "SUPERSESSION_PAIR": c("supersedes_observation_id").isNull() != c("supersession_reason").isNull(),
        "KIND_SYSTEM": ~c("source_system").eqNullSafe(lookup(c("kind"), SYSTEMS)),
        "EXECUTION_STATUS": (c("kind") == "EXECUTION") & _not_in(("kind_type", "kind_status", "lifecycle_status"), EXECUTION_TRIPLES),
        "CAPTURE_STATUS": (c("kind") == "TRADE_CAPTURE") & _not_in(("kind_type", "kind_status", "lifecycle_status"), CAPTURE_TRIPLES),
        "CONFIRMATION_STATUS": (c("kind") == "CONFIRMATION") & ~c("lifecycle_status").eqNullSafe(lookup(c("kind_status"), CONFIRMATION_STATUS)),
        "BOOKING_STATUS": (c("kind") == "BOOKING") & ~c("kind_status").eqNullSafe(c("lifecycle_status")),
    }


def linkage_rules() -> dict[str, Column]:
    """Rules of a linkage decision. Columns: tenant_id, portfolio_id, decision, reason_code, chosen_trade_id, candidates array<struct<trade_id, tenant_id, portfolio_id>>."""
    c = F.col
    foreign = F.exists("candidates", lambda x: (x["tenant_id"] != c("tenant_id")) | (x["portfolio_id"] != c("portfolio_id")))
    n, decision = F.size("candidates"), c("decision")
    sole = F.try_element_at(c("candidates"), F.lit(1))["trade_id"]
    return {
        "DECISION_REASON": ~c("reason_code").eqNullSafe(lookup(decision, LINKAGE_REASONS)),
        "CROSS_SCOPE_WITHOUT_CANDIDATE": (decision == "CROSS_SCOPE_REJECTED") & ~foreign,
        "FOREIGN_CANDIDATE": (decision != "CROSS_SCOPE_REJECTED") & foreign,
        "ACCEPTED_SHAPE": (decision == "ACCEPTED") & ((n != 1) | ~c("chosen_trade_id").eqNullSafe(sole)),
        "UNMATCHED_WITH_CANDIDATE": (decision == "UNMATCHED") & (n > 0),
        "AMBIGUOUS_TOO_FEW": (decision == "AMBIGUOUS") & (n < 2),
        "CHOSEN_WITHOUT_ACCEPTANCE": (decision != "ACCEPTED") & c("chosen_trade_id").isNotNull(),
    }


def _value_format(column: str) -> Column:
    value, kind = F.col(column), F.col("value_type")
    by = {"DECIMAL": "decimal", "DATE": "date", "CURRENCY": "currency", "SIDE": "side", "COUNT": "count", "SOURCE_VERSION": "source_version", "CONTENT_HASH": "sha256"}
    out = F.lit(False)
    for k, p in by.items():
        out = out | (kind == k) & bad_format(value, p)
    return out


def fact_rules() -> dict[str, Column]:
    """Rules of a break comparison with its break's family, severity and operands (columns as break facts have them)."""
    c = F.col
    family = c("family")
    missing = family == "MISSING_REQUIRED_SOURCE"
    severity = F.when(missing, F.when(c("field_path").contains("confirmation"), "MEDIUM").otherwise("HIGH")).otherwise(lookup(family, {f: s for f, (_, s) in FAMILIES.items()}))
    allowed = {f"/source/{k.lower()}_observation": k for k in REQUIRED_KINDS}
    distinct = family.isin("CURRENCY_PAIR_OR_SIDE_MISMATCH", "DUPLICATE_SOURCE_CONFLICT", "ECONOMIC_VALUE_MISMATCH", "TRADE_OR_VALUE_DATE_MISMATCH", "LIFECYCLE_STATUS_MISMATCH")
    return {
        "CONDITION_CODE": ~c("condition_code").eqNullSafe(lookup(family, {f: x for f, (x, _) in FAMILIES.items()})),
        "SEVERITY": ~c("severity").eqNullSafe(severity),
        "EQUAL_OPERANDS": c("expected_value").eqNullSafe(c("observed_value")),
        "VALUE_FORMAT": _value_format("expected_value") | _value_format("observed_value"),
        "MISSING_PATH": missing & ~c("field_path").isin(*allowed),
        "EXPECTED_SOURCE": missing != c("expected_observation_id").isNull(),
        "OBSERVED_SOURCE": c("observed_observation_id").isNull(),
        "SAME_SOURCE": distinct & (c("expected_observation_id") == c("observed_observation_id")),
    }


def transition_rules() -> dict[str, Column]:
    """Columns from_state (null at detection), to_state, reason_code."""
    ok = F.lit(False)
    for a, b, r in TRANSITIONS:
        ok = ok | F.col("from_state").eqNullSafe(F.lit(a)) & (F.col("to_state") == b) & (F.col("reason_code") == r)
    return {"ILLEGAL_TRANSITION": ~F.coalesce(ok, F.lit(False))}


def resolution_rules() -> dict[str, Column]:
    """Columns family, resolution_type, reconciliation_run_id, has_proof, disposition_id, approver_type, evidence_ids, evidence_roles."""
    c = F.col
    passed, unacted = c("resolution_type") == "RECONCILIATION_PASS", c("resolution_type") == "OWNER_APPROVED_NON_ACTION"
    repeats = lambda x: F.size(x) != F.size(F.array_distinct(x))
    return {
        "EVIDENCE_REPEATS": repeats(c("evidence_ids")) | repeats(c("evidence_roles")) | (F.size("evidence_ids") < 1),
        "PASS_WITHOUT_RUN": passed & c("reconciliation_run_id").isNull(),
        "PASS_WITHOUT_PROOF": passed & ~c("has_proof"),
        "PASS_WITH_DISPOSITION": passed & (c("disposition_id").isNotNull() | c("approver_type").isNotNull()),
        "PASS_WITHOUT_RESULT": passed & ~F.array_contains("evidence_roles", "RECONCILIATION_RESULT"),
        "NON_ACTION_FAMILY": unacted & ~c("family").isin(*NON_ACTION_FAMILIES),
        "NON_ACTION_APPROVER": unacted & (c("disposition_id").isNull() | ~c("approver_type").eqNullSafe(F.lit("HUMAN"))),
        "NON_ACTION_WITH_PASS": unacted & (c("reconciliation_run_id").isNotNull() | c("has_proof")),
        "NON_ACTION_EVIDENCE": unacted & ~F.array_contains("evidence_roles", "DISPOSITION_APPROVAL"),
    }


def with_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with ``reasons``: codes of the broken rules, in the order of the rules."""
    return df.withColumn("reasons", F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in rules.items()])))


def reason_text(rules: dict[str, Column]) -> Column:
    """The codes of the broken rules, joined by commas. Compiled, which the arrays of ``with_reasons`` are not."""
    return F.concat_ws(",", *[F.when(broken, F.lit(code)) for code, broken in rules.items()])


def reason_counts(df: DataFrame, rules: dict[str, Column], *by: str) -> DataFrame:
    """by, reason, n: how many rows break each rule. Rows are counted as they are, none is multiplied by its reasons."""
    counted = df.groupBy(*by).agg(*[F.count_if(broken).alias(code) for code, broken in rules.items()])
    each = F.explode(F.array(*[F.struct(F.lit(code).alias("reason"), F.col(code).alias("n")) for code in rules])).alias("r")
    return counted.select(*by, each).select(*by, "r.*").where("n > 0")


def split(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with reasons)."""
    marked = with_reasons(df, rules)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def proof_agrees(values: Column, value_type: Column, mode: Column, tolerance: Column) -> Column:
    """Whether all values of a reconciliation proof agree with the first one, within tolerance for decimals."""
    first = F.try_element_at(values, F.lit(1))
    number = lambda x: x.try_cast("decimal(28,10)")
    gap = lambda x: F.abs(number(x) - number(first))
    near = F.forall(
        values,
        lambda x: F.coalesce(
            F.when(mode == "ABSOLUTE_DECIMAL", gap(x) <= tolerance.try_cast("decimal(28,10)"))
            .when(mode == "RELATIVE_DECIMAL", gap(x) <= F.abs(number(first)) * tolerance.try_cast("decimal(9,8)"))
            .otherwise(gap(x) == 0),
            F.lit(False),
        ),
    )
    return (F.size(values) > 0) & F.when(value_type == "DECIMAL", near).otherwise(F.forall(values, lambda x: x == first))
