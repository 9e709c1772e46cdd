"""Contract predicates of what the engine itself makes: provenance, evaluation contexts, breaks, runs, selections, policies. In the form of ``validation``: a reason code, and a column that is
true where the rule is broken."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import lookup, sha256
from .reference_data import (
    COMPARISONS,
    CONFIRMATION_FIELDS,
    DEADLINE_ORDER,
    DEADLINE_RANK,
    EVIDENCE_ROLES,
    EXECUTION_FIELDS,
    FAMILIES,
    IDENTITY_POLICY,
    MATERIALITY_ORDER,
    REQUIRED_KINDS,
    RESOLUTION_TYPES,
    SEVERITY_ORDER,
    SEVERITY_RANK,
    SYSTEMS,
    TIE_BREAKERS,
    TOLERANCE_MODES,
    TRANSITIONS,
)
from .validation import proof_agrees, settlement_window

#: Families whose breaks stand between two sources.
DISTINCT_SOURCES = ("CURRENCY_PAIR_OR_SIDE_MISMATCH", "DUPLICATE_SOURCE_CONFLICT", "ECONOMIC_VALUE_MISMATCH", "TRADE_OR_VALUE_DATE_MISMATCH", "LIFECYCLE_STATUS_MISMATCH")
FIELD_PATHS = tuple(f"/payload/{f}" for f in (*EXECUTION_FIELDS, *CONFIRMATION_FIELDS))
#: All paths that a source-of-truth policy rules on.
POLICY_PATHS = (*FIELD_PATHS, "/payload/confirmation_status", "/payload/booking_status", "/linkage/trade_id")


def repeats(values: Column) -> Column:
    return F.size(values) != F.size(F.array_distinct(values))


def differ(a: Column, b: Column) -> Column:
    """Whether two arrays are different sets."""
    return (F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0)


def provenance_rules() -> dict[str, Column]:
    """Columns of one provenance entry: field_name, field_path, observation_id, kind, source_system, source_version, ingest_time, source_tenant_id, source_portfolio_id, and of its state: tenant_id,
    portfolio_id, watermark, source_version_set (structs of observation_id, kind, source_system, source_version)."""
    c = F.col
    source = F.try_element_at(F.filter("source_version_set", lambda x: x["observation_id"] == c("observation_id")), F.lit(1))
    same = lambda f: source[f].eqNullSafe(c(f))
    ids = F.transform("source_version_set", lambda x: x["observation_id"])
    return {
        "FIELD_PATH": c("field_path") != F.concat(F.lit("/payload/"), "field_name"),
        "PROVENANCE_SYSTEM": ~c("source_system").eqNullSafe(lookup(c("kind"), SYSTEMS)),
        "PROVENANCE_SCOPE": (c("source_tenant_id") != c("tenant_id")) | (c("source_portfolio_id") != c("portfolio_id")),
        "SOURCE_SET_REPEATS": repeats(ids),
        "SOURCE_NOT_IN_SET": source.isNull(),
        "SOURCE_DIFFERS_FROM_SET": source.isNotNull() & ~(same("kind") & same("source_system") & same("source_version")),
        "INGESTED_AFTER_WATERMARK": c("ingest_time") > c("watermark"),
    }


def context_rules() -> dict[str, Column]:
    """What is evaluated must be what was assembled. Columns of a trade row (obs, trade_id, decision, watermark), with evaluated_at, product_type, settlement_rule_version and
    source_version_set (structs of observation_id, kind, source_system, source_version, content_hash), and linkage_observation_id (may be null)."""
    c, key = F.col, ("observation_id", "kind", "source_system", "source_version", "content_hash")
    keys = lambda rows: F.transform(rows, lambda x: F.struct(*[x[f].alias(f) for f in key]))
    ids = F.transform("obs", lambda x: x["observation_id"])
    accepted = c("decision") == "ACCEPTED"
    return {
        "NO_SOURCES": F.size("obs") < 1,
        "EVALUATED_BEFORE_WATERMARK": c("evaluated_at") < c("watermark"),
        "OBSERVATION_REPEATS": repeats(ids),
        "SOURCE_SET_DIFFERS": differ(keys("obs"), keys("source_version_set")),
        "ARRIVED_AFTER_WATERMARK": F.exists("obs", lambda x: x["ingest_time"] > c("watermark")),
        "FOREIGN_TRADE": accepted & F.exists("obs", lambda x: x["source_trade_id"] != c("trade_id")),
        "PRODUCT_DIFFERS": F.exists("obs", lambda x: x["product_type"] != c("product_type")),
        "SETTLEMENT_RULE_DIFFERS": F.exists("obs", lambda x: x["settlement_rule_version"] != c("settlement_rule_version")),
        "LINKAGE_OUTSIDE_SET": c("linkage_observation_id").isNotNull() & ~F.array_contains(ids, c("linkage_observation_id")),
    }


def selection_rules() -> dict[str, Column]:
    """A caller's selection of a field against the one the policy makes. Columns selected and required (structs of observation_id, source_version, content_hash), known_hashes (all hashes seen for
    the selected id)."""
    return {
        "NOT_SELECTED": F.col("selected").isNull(),
        "SELECTION_DIFFERS": F.col("selected").isNotNull() & ~F.col("selected").eqNullSafe(F.col("required")),
        "IDENTITY_INCONSISTENT": F.size(F.array_distinct("known_hashes")) > 1,
    }


def post_action_rules() -> dict[str, Column]:
    """Columns pre and post (structs of kind, tenant_id, portfolio_id, source_business_key; post may be null), readback_available, changed (structs of field_path, expected_value, observed_value)."""
    pre, post = F.col("pre"), F.col("post")
    scope = lambda x: F.struct(*[x[f].alias(f) for f in ("tenant_id", "portfolio_id", "source_business_key")])
    return {
        "PRE_ACTION_KIND": ~pre["kind"].eqNullSafe(F.lit("BOOKING")),
        "POST_ACTION_KIND": post.isNotNull() & ~post["kind"].eqNullSafe(F.lit("BOOKING")),
        "POST_ACTION_SCOPE": post.isNotNull() & ~scope(pre).eqNullSafe(scope(post)),
        "READBACK_WITHOUT_POST": F.col("readback_available") & post.isNull(),
        "CHANGED_REPEATS": repeats(F.col("changed")),
        "CHANGED_EQUAL": F.exists("changed", lambda x: x["expected_value"].eqNullSafe(x["observed_value"])),
    }


def run_rules(content_hash: Column) -> dict[str, Column]:
    """Columns of a run envelope, with facts_of_breaks (comparisons of its breaks together); content_hash: what the envelope's hash has to be."""
    c = F.col
    return {
        "EVALUATED_BEFORE_WATERMARK": c("evaluated_at") < c("source_watermark"),
        "BREAK_IDS_REPEAT": repeats(c("break_ids")),
        "RESULT": (c("result") == "PASS") != (F.size("break_ids") == 0),
        "FACT_COUNT": c("n_facts") != c("facts_of_breaks"),
        "CONTENT_HASH": ~c("content_hash").eqNullSafe(content_hash),
    }


def break_rules() -> dict[str, Column]:
    """Invariants of a whole break. Columns of ``reconcile.breaks``, with trade_date, value_date, roles (of its evidence), available_kinds, previous_state, transition_reason,
    supersedes_break_id, resolution_type (null if none), expected_by, watermark."""
    c = F.col
    family = c("family")
    paths = F.transform("comparisons", lambda x: x["field_path"])
    pairs = F.transform("comparisons", lambda x: F.concat(x["field_path"], F.lit("="), x["value_type"]))
    array = lambda values: F.array(*map(F.lit, values))
    per_family = lambda table: _by_family(family, {f: array(v) for f, v in table.items()})
    key = c("priority_key")
    rank = F.struct(F.lit(2), lookup(c("severity"), SEVERITY_RANK), lookup(c("deadline_status"), DEADLINE_RANK), F.lit(0))
    moved = F.lit(False)
    for a, b, r in TRANSITIONS:
        moved = moved | c("previous_state").eqNullSafe(F.lit(a)) & (c("state") == b) & (c("transition_reason") == r)
    missing = family == "MISSING_REQUIRED_SOURCE"
    return {
        "CONDITION_CODE": ~c("condition_code").eqNullSafe(lookup(family, {f: x for f, (x, _) in FAMILIES.items()})),
        "SETTLEMENT_WINDOW": settlement_window(c("product_type"), c("trade_date"), c("value_date")),
        "COMPARISON_PATHS_REPEAT": repeats(paths) | (F.size(paths) < 1),
        "COMPARISON_PATH": F.size(F.array_except(pairs, per_family({f: [f"{p}={t}" for p, t in x] for f, x in COMPARISONS.items()}))) > 0,
        "SOURCE_IDS_REPEAT": repeats(c("source_ids")),
        "EVIDENCE_ROLES": F.size(F.array_except(per_family(EVIDENCE_ROLES), c("roles"))) > 0,
        "AVAILABLE_SOURCE_MISSING": missing & F.array_contains("available_kinds", c("group_key")),
        "EXPECTED_TOO_EARLY": missing & (c("expected_by") < c("watermark")),
        "EXPECTATION_KIND": missing & ~c("group_key").isin(*REQUIRED_KINDS),
        "ORDERING_KEY": ~F.to_json(F.array(*[key[f] for f in ("materiality", "severity", "deadline", "age")])).eqNullSafe(F.to_json(F.array(*[rank[f"col{i}"] for i in range(1, 5)]))),
        "ILLEGAL_TRANSITION": ~F.coalesce(moved, F.lit(False)),
        "FIRST_VERSION_SUPERSEDES": (c("break_version") == 1) & c("supersedes_break_id").isNotNull(),
        "REOPENED_WITHOUT_FORMER": (c("break_version") > 1) & c("supersedes_break_id").isNull(),
        "REOPENED_WITH_SAME_ID": (c("break_version") > 1) & (c("supersedes_break_id") == c("break_id")),
        "RESOLUTION_TYPE": c("resolution_type").isNotNull() & ~F.array_contains(per_family(RESOLUTION_TYPES), c("resolution_type")),
    }


def _by_family(family: Column, table: dict[str, Column]) -> Column:
    out = None
    for f, value in table.items():
        out = F.when(family == f, value) if out is None else out.when(family == f, value)
    return out


def comparison_rules() -> dict[str, Column]:
    """Columns value_type, tolerance_mode, tolerance_value, expected_observation_id, expected_source_version, observed_observation_id, observed_source_version."""
    c = F.col
    half = lambda side: c(f"{side}_observation_id").isNull() != c(f"{side}_source_version").isNull()
    return {
        "TOLERANCE_MODE": ~F.coalesce(c("tolerance_mode").isin(*TOLERANCE_MODES), F.lit(False)),
        "TOLERANCE_VALUE": (c("tolerance_mode") == "NONE") != c("tolerance_value").isNull(),
        "TOLERANCE_OF_NO_DECIMAL": (c("tolerance_mode") != "NONE") & (c("value_type") != "DECIMAL"),
        "SOURCE_INCOMPLETE": half("expected") | half("observed"),
    }


def policy_rules() -> dict[str, Column]:
    """Rules of one field of a source-of-truth policy. Columns field_path, trusted_sources, source_precedence."""
    return {
        "PRECEDENCE_REPEATS": repeats(F.col("source_precedence")),
        "TRUSTED_WITHOUT_PRECEDENCE": F.size(F.array_except("trusted_sources", "source_precedence")) > 0,
        "UNKNOWN_PATH": ~F.col("field_path").isin(*POLICY_PATHS),
    }


def policy_set_rules() -> dict[str, Column]:
    """Rules of a whole policy: columns paths (of all its fields, as a list), document (its canonical JSON), pinned_hash."""
    return {
        "PATHS_REPEAT": repeats(F.col("paths")),
        "PATHS_INCOMPLETE": differ(F.col("paths"), F.array(*map(F.lit, POLICY_PATHS))),
        "POLICY_HASH": ~F.col("pinned_hash").eqNullSafe(sha256(F.col("document"))),
    }


def priority_policy_problems(materiality: list[str], severity: list[str], deadline: list[str], tie_breakers: list[str]) -> list[str]:
    """Reasons why a priority policy is not the approved one."""
    wanted = {"MATERIALITY_ORDER": (materiality, MATERIALITY_ORDER), "SEVERITY_ORDER": (severity, SEVERITY_ORDER), "DEADLINE_ORDER": (deadline, DEADLINE_ORDER), "TIE_BREAKERS": (tie_breakers, TIE_BREAKERS)}
    return [name for name, (have, want) in wanted.items() if tuple(have) != want]


def identity_policy_problems(rows: list[tuple[int, str, str]]) -> list[str]:
    """Reasons why an identity policy, rows of (precedence, outcome, storage effect), is not the approved table."""
    out = []
    if [r[0] for r in rows] != list(range(1, len(IDENTITY_POLICY) + 1)):
        out.append("PRECEDENCE")
    if [tuple(r[1:]) for r in rows] != list(IDENTITY_POLICY):
        out.append("OUTCOMES")
    return out


def proof_rules() -> dict[str, Column]:
    """What a resolution by a passed reconciliation must prove of its break. Columns of the break: run_id, family, condition_code, sources (structs of observation_id, source_version), comparisons (structs of
    field_path, value_type, expected_observation_id, observed_observation_id, tolerance_mode, tolerance_value); and proof (struct of run_id, family, condition_code, sources, comparisons: structs of
    field_path, value_type, values: structs of observation_id, source_version, value)."""
    c, proof = F.col, F.col("proof")
    proved = lambda x: F.try_element_at(F.filter(proof["comparisons"], lambda p: p["field_path"] == x["field_path"]), F.lit(1))
    ids = lambda rows: F.transform(rows, lambda v: v["observation_id"])
    operands = lambda x: F.array_compact(F.array(x["expected_observation_id"], x["observed_observation_id"]))
    version = lambda v: F.try_element_at(F.filter("sources", lambda s: s["observation_id"] == v["observation_id"]), F.lit(1))["source_version"]
    covered = lambda holds: F.exists("comparisons", lambda x: proved(x).isNotNull() & holds(x, proved(x)))
    agrees = lambda x, p: proof_agrees(F.transform(p["values"], lambda v: v["value"]), x["value_type"], x["tolerance_mode"], x["tolerance_value"])
    known = lambda rows: F.transform(rows, lambda s: F.struct(s["observation_id"].alias("observation_id"), s["source_version"].alias("source_version")))
    paths = lambda rows: F.transform(rows, lambda x: x["field_path"])
    return {
        "NO_PROOF": proof.isNull(),
        "PROOF_RUN": proof["run_id"] != c("run_id"),
        "PROOF_BREAK": (proof["family"] != c("family")) | (proof["condition_code"] != c("condition_code")),
        "PROOF_SOURCES_DIFFER": differ(known("sources"), known(proof["sources"])),
        "PROOF_PATHS_DIFFER": differ(paths("comparisons"), paths(proof["comparisons"])),
        "PROOF_VALUE_TYPE": covered(lambda x, p: p["value_type"] != x["value_type"]),
        "PROOF_SOURCE_UNKNOWN": covered(lambda x, p: F.size(F.array_except(ids(p["values"]), ids(F.col("sources")))) > 0),
        "PROOF_VERSION": covered(lambda x, p: F.exists(p["values"], lambda v: v["source_version"] != version(v))),
        "PROOF_OPERANDS_MISSING": covered(lambda x, p: F.size(F.array_except(operands(x), ids(p["values"]))) > 0),
        "PROOF_ONE_SOURCE": c("family").isin(*DISTINCT_SOURCES) & covered(lambda x, p: F.size(F.array_distinct(ids(p["values"]))) < 2),
        "PROOF_DISAGREES": covered(lambda x, p: ~F.coalesce(agrees(x, p), F.lit(False))),
    }


def run_break_rules() -> dict[str, Column]:
    """A run against the breaks that name it. Columns: run_id, tenant_id, portfolio_id, trade_id, break_ids (in the run's order) and breaks (structs of break_id, run_id, tenant_id, portfolio_id, trade_id,
    in the order they are stored)."""
    c = F.col
    scope = ("tenant_id", "portfolio_id", "trade_id")
    return {
        "BREAK_ORDER": ~F.transform("breaks", lambda b: b["break_id"]).eqNullSafe(c("break_ids")),
        "BREAK_RUN": F.exists("breaks", lambda b: ~b["run_id"].eqNullSafe(c("run_id"))),
        "BREAK_SCOPE": F.exists("breaks", lambda b: ~F.struct(*[b[f].alias(f) for f in scope]).eqNullSafe(F.struct(*[c(f).alias(f) for f in scope]))),
    }


def break_reference_rules() -> dict[str, Column]:
    """What a break points at must be among its sources. Columns: tenant_id, portfolio_id, sources (structs as of ``reconcile.source_reference``), comparisons (structs of field_path, expected_observation_id,
    expected_source_version, observed_observation_id, observed_source_version), evidence (structs of evidence_id, source_observation_id)."""
    c = F.col
    ids = F.transform("sources", lambda x: x["source_observation_id"])
    version = lambda i: F.try_element_at(F.filter("sources", lambda x: x["source_observation_id"] == i), F.lit(1))["source_version"]
    sides = ("expected", "observed")
    unknown = lambda i: i.isNotNull() & ~F.array_contains(ids, F.coalesce(i, F.lit("")))
    moved = lambda x, side: F.array_contains(ids, F.coalesce(x[f"{side}_observation_id"], F.lit(""))) & ~version(x[f"{side}_observation_id"]).eqNullSafe(x[f"{side}_source_version"])
    any_side = lambda holds: F.exists("comparisons", lambda x: holds(x, sides[0]) | holds(x, sides[1]))
    return {
        "SOURCE_REPEATS": repeats(ids),
        "SOURCE_SCOPE": F.exists("sources", lambda x: ~(x["source_tenant_id"].eqNullSafe(c("tenant_id")) & x["source_portfolio_id"].eqNullSafe(c("portfolio_id")))),
        "OPERAND_UNKNOWN": any_side(lambda x, side: unknown(x[f"{side}_observation_id"])),
        "OPERAND_VERSION": any_side(moved),
        "EVIDENCE_REPEATS": repeats(F.transform("evidence", lambda e: e["evidence_id"])),
        "EVIDENCE_SOURCE_UNKNOWN": F.exists("evidence", lambda e: ~F.coalesce(F.array_contains(ids, e["source_observation_id"]), F.lit(False))),
    }
