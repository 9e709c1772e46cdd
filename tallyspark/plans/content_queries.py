"""Contract rules over what the engine makes and what the events hold: every column that a rule reads comes from a table, and the defects are those of the corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import actions, contract
from ..functions import validation as V
from ..functions.columns import canonical_json, lookup, sha256, tolerance_of
from ..functions.reference_data import CONFIRMATION_FIELDS, CONFIRMATION_TRUSTED, EXECUTION_FIELDS, EXECUTION_TRUSTED, KINDS
from ..operators import reconcile as R
from ..operators import remediation, reporting
from ..sources import corpus
from .contract_queries import by_reason
from .oracles import over

#: What an event does to a user's case of a day.
STATE_OF = {"signup": "OPEN", "view": "UNDER_INVESTIGATION", "click": "RESOLUTION_PROPOSED", "purchase": "ACTION_PENDING", "error": "ESCALATED"}
REASON_OF = {"signup": "DETECTED", "view": "BEGIN_INVESTIGATION", "click": "PROPOSE_RESOLUTION", "purchase": "ACTION_AUTHORISATION_PENDING", "error": "ESCALATE"}
ROLE_OF = {"signup": "MAKER", "purchase": "CHECKER"}


def _days(events: DataFrame) -> DataFrame:
    return events.withColumn("day", F.to_date("ts"))


def _in_order():
    """The events of a user's day, one after the other."""
    return Window.partitionBy("user_id", "day").orderBy("ts", "event_id")


def transition_violations(events: DataFrame) -> DataFrame:
    """Each event moves the case of its user's day on from where the former event left it."""
    state = lookup(F.col("event_type"), STATE_OF)
    tried = _days(events).select(F.lag(state).over(_in_order()).alias("from_state"), state.alias("to_state"), lookup(F.col("event_type"), REASON_OF).alias("reason_code"))
    _, rejected = V.split(tried, V.transition_rules())
    return rejected.groupBy("from_state", "to_state", "reason_code").agg(F.count(F.lit(1)).alias("n"))


def identity_policy(events: DataFrame) -> DataFrame:
    """Each event against the former one of its user's day."""
    former = lambda c: F.lag(c).over(_in_order())
    rows = _days(events).select("*", *[former(c).alias(f"former_{c}") for c in ("props", "value", "event_type")])
    same = lambda c: F.coalesce(F.col(c) == F.col(f"former_{c}"), F.lit(False))
    alike = F.count(F.lit(1)).over(Window.partitionBy("user_id", "day", "event_type"))
    flags = rows.select(
        (F.col("event_type") != "error").alias("schema_supported"), (F.col("value") >= 0.5).alias("scope_match"), same("props").alias("same_delivery"), same("value").alias("same_hash"),
        same("event_type").alias("same_source"), F.when(F.col("value") > F.col("former_value"), "GREATER").when(F.col("value") < F.col("former_value"), "LOWER").otherwise("EQUAL").alias("version_relation"),
        alike.alias("candidates"),
    )
    return flags.groupBy(remediation.identity_outcome().alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def _approvals(events: DataFrame) -> DataFrame:
    """user_id, day, approval: who signs up makes, who purchases checks, under the name in the properties; values from 10 on approve."""
    rows = _days(events)
    given = rows.where(F.col("event_type").isin(*ROLE_OF)).select(
        F.concat_ws("/", "user_id", "day").alias("case_id"), lookup(F.col("event_type"), ROLE_OF).alias("role"), F.col("props").alias("approver_identity"),
        F.when(F.col("value") >= 10, "APPROVED").otherwise("REJECTED").alias("decision"),
    )
    cases = rows.select("user_id", "day").distinct().withColumn("case_id", F.concat_ws("/", "user_id", "day"))
    return cases.join(remediation.approvals(given), "case_id", "left").select("user_id", "day", F.coalesce("approval", F.lit("MISSING")).alias("approval"))


def approvals_status(events: DataFrame) -> DataFrame:
    return _approvals(events).groupBy("approval").agg(F.count(F.lit(1)).alias("n"))


def applied_corrections(events: DataFrame) -> DataFrame:
    """A record for each user from the first event, seeded twice, and a new version where the last purchase has another value."""
    scope = [F.lit(corpus.TENANT).alias("tenant_id"), F.lit(corpus.PORTFOLIOS[0]).alias("portfolio_id"), F.col("user_id").cast("string").alias("trade_id")]
    place = F.struct("ts", "event_id")
    seeds = events.groupBy("user_id").agg(F.min_by("value", place).alias("v")).select(*scope, F.lit(1).alias("record_version"), F.col("v").cast("string").alias("value"), F.lit(None).cast("string").alias("applied_key"))
    records = remediation.seeded(remediation.seeded(None, seeds), seeds.withColumn("value", F.lit("0")))
    last = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max_by(F.struct("value", "event_id"), place).alias("p"))
    done = last.select(*scope, F.col("p.value").cast("string").alias("approved_value"), F.concat(F.lit("idem:"), F.col("p.event_id").cast("string")).alias("idempotency_key"))
    now = records.select("trade_id", F.col("value").alias("_value"))
    done = done.join(now, "trade_id").withColumn("side_effect", F.col("approved_value") != F.col("_value"))
    every = records.unionByName(remediation.applied(records, done))
    return reporting.latest(every, ["tenant_id", "portfolio_id", "trade_id"], "record_version").select("trade_id", "record_version", "value", "applied_key")


def _cases(trades: DataFrame) -> DataFrame:
    """Eligible cases, with what stands around them, from one evaluation of the trades: a fact keeps the observations of its trade."""
    around = {c: F.col(f"by_execution.{c}") for c in ("book_id", "counterparty_id", "side")}
    # Remediation is of economic breaks only.
    facts = R.facts(trades.withColumns(around), corpus.CONFIG, families=("ECONOMIC_VALUE_MISMATCH",), more=("obs", *around))
    found = remediation.policy(remediation.recommend(remediation.triage_of_trades(facts))).where("policy_outcome = 'ELIGIBLE_FOR_APPROVAL'")
    return found.select(
        *R.TRADE, "trade_id", F.concat(F.lit("case_"), "trade_id").alias("case_id"), "field_path", F.col("observed_value").alias("expected_old_value"), F.col("expected_value").alias("approved_value"),
        "watermark", "product_type", *around,
    )


def _envelopes(cases: DataFrame) -> DataFrame:
    """Envelopes issued at the watermark, as they are read half a minute later for each number of the counterparty. Three books keep them badly: one writes amounts without trailing zeros, one joins both
    amounts, one loses the trade."""
    made = remediation.envelopes(cases, F.col("watermark"), b"secret", ("book_id", "counterparty_id", "watermark", "product_type", "side"))
    book = F.col("book_id")
    kept = made.withColumns(
        {
            "approved_value": F.when(book == "book_1", F.regexp_replace("approved_value", "0$", "")).when(book == "book_2", "").otherwise(F.col("approved_value")),
            "expected_old_value": F.when(book == "book_2", F.concat_ws("|", "expected_old_value", "approved_value")).otherwise(F.col("expected_old_value")),
            "trade_id": F.when(book != "book_3", F.col("trade_id")),
        }
    )
    later = F.substring_index("counterparty_id", "_", -1).cast("int") * 30
    return remediation.verified_envelopes(kept, F.col("watermark") + F.make_dt_interval(secs=later), b"secret")


def envelope_statuses(trades: DataFrame) -> DataFrame:
    return _envelopes(_cases(trades)).groupBy("envelope_status").agg(F.count(F.lit(1)).alias("n"))


def executor_outcomes(trades: DataFrame, events: DataFrame) -> DataFrame:
    """One attempt for each envelope. Approvals are those of the user of the counterparty's number on the last day; spot bookings have been corrected by the same action before."""
    latest = _approvals(events).groupBy("user_id").agg(F.max_by("approval", "day").alias("approval"))
    rows = _envelopes(_cases(trades)).withColumn("user_id", F.substring_index("counterparty_id", "_", -1).cast("long")).join(latest, "user_id", "left")
    spot = F.col("product_type") == "FX_SPOT"
    attempts = rows.select(
        "envelope_status", F.coalesce("approval", F.lit("MISSING")).alias("approval"), "field_path", F.when(spot, F.col("approved_value")).otherwise(F.col("expected_old_value")).alias("current_value"),
        F.when(spot, F.col("idempotency_key")).alias("applied_key"), "idempotency_key", "expected_old_value",
        F.when(F.col("side") == "SELL_BASE", "TIMEOUT_RECOVERY_ATTEMPT").otherwise("NORMAL").alias("attempt_context"),
    )
    return remediation.execute(attempts).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if("side_effect").alias("side_effects"))


def comparison_violations(facts: DataFrame, corrections: DataFrame) -> DataFrame:
    """The engine's comparisons after the corrections: those that name a superseded source have lost its version."""
    # Met by trade, which is how both are partitioned, and once for both sides.
    gone = corrections.groupBy(*R.TRADE).agg(F.collect_set("supersedes_observation_id").alias("_gone"))
    rows = facts.join(gone, list(R.TRADE), "left")
    for side in ("expected", "observed"):
        lost = F.coalesce(F.array_contains("_gone", F.col(f"{side}_observation_id")), F.lit(False))
        rows = rows.withColumn(f"{side}_source_version", F.when(~lost, F.col(f"{side}.source_version")))
    rules = {f: tolerance_of(corpus.CONFIG, F.col("product_type"), f) for f in ("base_amount", "terms_amount", "quoted_rate")}
    pick = lambda i, none: F.coalesce(*[F.when(F.col("field_path") == f"/payload/{f}", r[i]) for f, r in rules.items()], none)
    rows = rows.withColumns({"tolerance_mode": pick(0, F.lit("NONE")), "tolerance_value": pick(1, F.lit(None).cast("string"))})
    return by_reason(rows, contract.comparison_rules() | V.fact_rules())


def policy_violations(trades: DataFrame) -> DataFrame:
    """The order in which a trade's sources stand, as a policy of each of its fields: sources that are there twice, and trusted ones that are not."""
    rows = [(f, EXECUTION_TRUSTED) for f in EXECUTION_FIELDS] + [(f, CONFIRMATION_TRUSTED) for f in CONFIRMATION_FIELDS]
    each = F.explode(F.array(*[F.struct(F.lit(f"/payload/{f}").alias("field_path"), F.array(*map(F.lit, t)).alias("trusted_sources")) for f, t in rows])).alias("r")
    given = trades.select(F.transform("obs", lambda x: x["source_system"]).alias("source_precedence"), each).select("source_precedence", "r.*")
    return by_reason(given, contract.policy_rules())


def policy_set_violations(trades: DataFrame) -> DataFrame:
    """The fields that a trade's sources rule on, as a whole policy, pinned to all four kinds of sources."""
    kinds = F.transform("obs", lambda x: x["kind"])
    of = lambda kind, path: F.transform(F.filter(kinds, lambda k: k == kind), lambda _: F.lit(path))
    paths = F.concat(F.array(*map(F.lit, (*contract.FIELD_PATHS, "/linkage/trade_id"))), of("CONFIRMATION", "/payload/confirmation_status"), of("BOOKING", "/payload/booking_status"))
    text = lambda a: canonical_json(F.struct(F.array_sort(F.array_distinct(a)).alias("kinds")))
    rows = trades.select(paths.alias("paths"), text(kinds).alias("document"), sha256(text(F.array(*map(F.lit, KINDS)))).alias("pinned_hash"))
    return by_reason(rows, contract.policy_set_rules())


def post_action_violations(trades: DataFrame) -> DataFrame:
    """The first booking of a trade against its last one, as before and after an action; what differs from the execution has changed."""
    booked = F.filter("obs", lambda x: x["kind"] == "BOOKING")
    record = lambda x: F.when(x.isNotNull(), F.struct(x["kind"].alias("kind"), F.col("tenant_id"), F.col("portfolio_id"), x["source_business_key"].alias("source_business_key")))
    last = F.try_element_at(booked, F.lit(-1))
    fields = [f for _, f, _ in R.COMPARED]
    change = lambda f: F.struct(F.lit(f"/payload/{f}").alias("field_path"), F.col(f"by_execution.{f}").cast("string").alias("expected_value"), last[f].cast("string").alias("observed_value"))
    changed = F.filter(F.array(*[change(f) for f in fields]), lambda c: c["expected_value"] != c["observed_value"])
    rows = trades.select(
        record(F.coalesce(F.try_element_at(booked, F.lit(1)), F.get("obs", F.lit(0)))).alias("pre"), record(last).alias("post"), F.lit(True).alias("readback_available"), changed.alias("changed")
    )
    return by_reason(rows, contract.post_action_rules())


def evidence_violations(facts: DataFrame, observed: DataFrame, corrections: DataFrame, run_id: str) -> DataFrame:
    """The evidence of all breaks as items that are written three minutes after their source came in, against the sources that are left after the corrections."""
    # All are met by trade, which is how they are partitioned.
    gone = corrections.select(*R.TRADE, F.col("supersedes_observation_id").alias("observation_id"))
    left = observed.join(gone, [*R.TRADE, "observation_id"], "left_anti")
    source = left.select(
        *R.TRADE, F.col("observation_id").alias("source_observation_id"), F.col("kind").alias("source_kind"), "source_system", "source_version", F.col("content_hash").alias("source_hash"),
        F.col("source_trade_id").alias("_trade"), (F.col("ingest_time") + F.expr("INTERVAL 3 MINUTES")).alias("created_at"),
    )
    items = R.evidence(facts, run_id, corpus.CONFIG, ("watermark",)).withColumnRenamed("watermark", "captured_at").join(source, [*R.TRADE, "source_observation_id"], "left")
    scope = lambda trade: F.struct("tenant_id", "portfolio_id", F.col("lineage_id").alias("case_id"), trade.alias("trade_id"))
    none = F.lit(None).cast("string")
    rows = items.withColumns(
        {
            "evidence_version": F.lit(1), "supersedes_evidence_id": none, "derivative_of_evidence_id": none, "redaction_status": F.lit("NOT_REQUIRED"), "evidence_kind": F.lit("SOURCE_OBSERVATION_HASH"),
            "scope": scope(F.col("trade_id")), "source_scope": F.when(F.col("source_kind").isNotNull(), scope(F.col("_trade"))), "created_at": F.coalesce("created_at", "captured_at"),
        }
    )
    return by_reason(rows, actions.evidence_rules())


def recommendation_reasons(observed: DataFrame, facts: DataFrame) -> DataFrame:
    """The provider's answers as it writes them, parsed fail-closed. It gives the break's severity as risk tier of forwards, which is another scale."""
    given = remediation.recommend(remediation.triage(facts, observed))
    cited = F.transform("citations", lambda x: F.struct(F.substring_index(x, "#", 1).alias("document_id"), F.substring_index(x, "#", -1).alias("section")))
    raw = F.struct(
        "abstain_reason", cited.alias("citations"), "confidence", F.col("condition_code").alias("predicted_root_cause"), F.col("severity").alias("priority"), "proposed_fields", "recommended_action",
        F.array(*map(F.lit, actions.ROLES)).alias("required_approvals"), F.when(F.col("product_type") == "FX_SPOT", "HIGH").otherwise(F.col("severity")).alias("risk_tier"),
    )
    found = actions.parsed_recommendations(given.select(F.to_json(raw, {"ignoreNullFields": "false"}).alias("raw")))
    return found.select(F.array_join("reasons", ",").alias("reasons"), "recommended_action").groupBy("reasons", "recommended_action").agg(F.count(F.lit(1)).alias("n"))


def action_violations(outcomes: DataFrame) -> DataFrame:
    """Drafts that would put the reference of a conflicting delivery back to that of the first one. The contract allows that for confirmations only."""
    first = outcomes.where("outcome = 'INSERTED'").select(
        F.col("observation_id").alias("first_observation_id"), F.col("kind_reference").alias("first_reference"), F.col("ingest_time").alias("issued_at"), F.col("source_system").alias("first_system"),
    )
    conflicts = outcomes.where("outcome = 'DUPLICATE_SOURCE_CONFLICT'").join(first, "first_observation_id")
    case = F.concat(F.lit("case_"), "observation_id")
    source = lambda oid, system: F.struct(
        F.col("tenant_id"), F.col("portfolio_id"), case.alias("case_id"), F.col("source_trade_id").alias("trade_id"), F.col(oid).alias("observation_id"), F.col("kind"), F.col(system).alias("source_system")
    )
    none = F.lit(None).cast("string")
    rows = conflicts.select(
        F.lit("CORRECT").alias("action_type"), "tenant_id", "portfolio_id", case.alias("case_id"), F.col("source_trade_id").alias("trade_id"), F.concat(F.lit("/payload/"), F.lower("kind"), F.lit("_reference")).alias("target_field_path"),
        F.col("source_version").cast("int").alias("target_booking_version"), F.col("kind_reference").alias("normalised_expected_old_value"), F.col("first_reference").alias("exact_approved_new_value"), "issued_at",
        F.col("ingest_time").alias("not_before"), (F.col("ingest_time") + F.expr("INTERVAL 3 HOURS")).alias("expires_at"), F.lit("CAS").alias("control_type"), F.lit(None).cast("timestamp").alias("lease_expires_at"),
        F.array(source("first_observation_id", "first_system"), source("observation_id", "source_system")).alias("sources"), F.col("counterparty_id").alias("maker_reference"),
        F.col("book_id").alias("checker_reference"), none.alias("signer_key_id"), none.alias("signature_algorithm"), none.alias("signature"), F.concat_ws(">", "kind_reference", "first_reference").alias("draft"),
    )
    rows = rows.withColumn("content_hash", sha256(F.col("draft"))).withColumn("idempotency_key", actions.idempotency_key())
    marked = V.with_reasons(rows, actions.action_rules())
    return marked.groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n"), F.min("idempotency_key").alias("least_key"))


def source_references(trades: DataFrame) -> DataFrame:
    """The sources of each trade as a break refers to them."""
    return trades.select("lineage_id", F.explode(F.transform("obs", lambda x: R.source_reference(x, F.col("tenant_id"), F.col("portfolio_id")))).alias("r")).select("lineage_id", "r.*")


def named(
    observed: Callable, outcomes: Callable, facts: Callable, trades: Callable, corrections: Callable, table: Callable, run_id: str
) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    events = lambda s, d: table(s, d, "events")
    # Remediation is of economic breaks only.
    economic = lambda s, d: R.reconcile(observed(s, d), corpus.CONFIG, families=("ECONOMIC_VALUE_MISMATCH",))
    return {
        "transition_violations": lambda s, d: transition_violations(events(s, d)),
        "identity_policy": lambda s, d: identity_policy(events(s, d)),
        "approvals_status": lambda s, d: approvals_status(events(s, d)),
        "applied_corrections": lambda s, d: applied_corrections(events(s, d)),
        "envelope_statuses": lambda s, d: envelope_statuses(trades(s, d)),
        "executor_outcomes": lambda s, d: executor_outcomes(trades(s, d), events(s, d)),
        "comparison_violations": lambda s, d: comparison_violations(facts(s, d), corrections(s, d)),
        "policy_violations": lambda s, d: policy_violations(trades(s, d)),
        "policy_set_violations": lambda s, d: policy_set_violations(trades(s, d)),
        "post_action_violations": lambda s, d: post_action_violations(trades(s, d)),
        "evidence_violations": lambda s, d: evidence_violations(facts(s, d), observed(s, d), corrections(s, d), run_id),
        "recommendation_reasons": lambda s, d: recommendation_reasons(observed(s, d), economic(s, d)),
        "action_violations": lambda s, d: action_violations(outcomes(s, d)),
        "source_references": lambda s, d: source_references(trades(s, d)),
    }


_DAYS = "days AS (SELECT *, ts::date AS day FROM events)"
_APPROVED = f"""{_DAYS}, given AS (
  SELECT user_id, day, min(CASE WHEN event_type = 'signup' THEN props END) AS maker, min(CASE WHEN event_type = 'purchase' THEN props END) AS checker
  FROM days WHERE event_type IN ('signup', 'purchase') AND value >= 10 GROUP BY 1, 2
), approved AS (
  SELECT user_id, day, CASE WHEN maker IS NULL OR checker IS NULL THEN 'MISSING' WHEN maker = checker THEN 'SAME_IDENTITY' ELSE 'COMPLETE' END AS approval
  FROM (SELECT DISTINCT user_id, day FROM days) LEFT JOIN given USING (user_id, day)
)"""
_ELIGIBLE = """cases AS (
  SELECT f.lineage_id, f.trade_id, f.portfolio_id, f.expected_value, f.observed_value, f.product_type, w.book_id, w.side, split_part(w.counterparty_id, '_', 2)::int AS party
  FROM all_facts f JOIN win w USING (lineage_id) WHERE f.field_path = '/payload/base_amount' AND f.expected_observation_id LIKE 'obs_execution%' AND f.observed_observation_id LIKE 'obs_booking%'
), envelopes AS (
  SELECT *, CASE WHEN book_id IN ('book_2', 'book_3') OR book_id = 'book_1' AND expected_value LIKE '%0' THEN 'TAMPERED' WHEN party * 30 >= 900 THEN 'EXPIRED' ELSE 'VALID' END AS envelope_status FROM cases
)"""
_GONE = "gone AS (SELECT observation_id FROM seen WHERE kind = 'BOOKING' AND target = 'BOOKING' AND effect = 'BASE_AMOUNT')"
_KINDS = """kinds_of AS (SELECT lineage_id, count(*) FILTER (kind = 'EXECUTION') AS e, count(*) FILTER (kind = 'TRADE_CAPTURE') AS t, count(*) FILTER (kind = 'CONFIRMATION') AS c,
  count(*) FILTER (kind = 'BOOKING') AS b FROM seen GROUP BY 1)"""

ORACLES: dict[str, str] = {
    "transition_violations": f"""
        WITH {_DAYS}, named(t, state, reason) AS (VALUES ('signup', 'OPEN', 'DETECTED'), ('view', 'UNDER_INVESTIGATION', 'BEGIN_INVESTIGATION'), ('click', 'RESOLUTION_PROPOSED', 'PROPOSE_RESOLUTION'),
          ('purchase', 'ACTION_PENDING', 'ACTION_AUTHORISATION_PENDING'), ('error', 'ESCALATED', 'ESCALATE')),
        legal(f, t) AS (VALUES (NULL, 'OPEN'), ('OPEN', 'UNDER_INVESTIGATION'), ('OPEN', 'ESCALATED'), ('UNDER_INVESTIGATION', 'RESOLUTION_PROPOSED'), ('UNDER_INVESTIGATION', 'ESCALATED'),
          ('RESOLUTION_PROPOSED', 'ACTION_PENDING'), ('RESOLUTION_PROPOSED', 'ESCALATED'), ('ACTION_PENDING', 'ESCALATED')),
        moves AS (SELECT lag(state) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS f, state, reason FROM days JOIN named ON event_type = t)
        SELECT f AS from_state, state AS to_state, reason AS reason_code, count(*) AS n FROM moves m WHERE NOT EXISTS (SELECT 1 FROM legal l WHERE l.f IS NOT DISTINCT FROM m.f AND l.t = m.state) GROUP BY 1, 2, 3""",
    "identity_policy": f"""
        WITH {_DAYS}, r AS (SELECT *, lag(props) OVER w AS p, lag(value) OVER w AS v, lag(event_type) OVER w AS t, count(*) OVER (PARTITION BY user_id, day, event_type) AS n FROM days
          WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id))
        SELECT CASE WHEN event_type = 'error' THEN 'REJECT_UNSUPPORTED_SCHEMA_VERSION' WHEN value < 0.5 THEN 'REJECT_CROSS_PORTFOLIO_LINKAGE' WHEN props = p AND value = v THEN 'IDEMPOTENT_REPLAY'
          WHEN props = p THEN 'DUPLICATE_SOURCE_CONFLICT' WHEN event_type = t AND value > v THEN 'NEW_SOURCE_VERSION' WHEN event_type = t AND value < v THEN 'LATE_SOURCE_VERSION_RECORDED'
          WHEN n <> 1 THEN 'LINKAGE_REVIEW_REQUIRED' ELSE 'NEW_OBSERVATION' END AS outcome, count(*) AS n FROM r GROUP BY 1""",
    "approvals_status": f"WITH {_APPROVED} SELECT approval, count(*) AS n FROM approved GROUP BY 1",
    "applied_corrections": """
        WITH f AS (SELECT user_id, arg_min(value, (ts, event_id)) AS v FROM events GROUP BY 1), p AS (SELECT user_id, arg_max(value, (ts, event_id)) AS v, arg_max(event_id, (ts, event_id)) AS e
          FROM events WHERE event_type = 'purchase' GROUP BY 1)
        SELECT f.user_id::varchar AS trade_id, CASE WHEN p.v <> f.v THEN 2 ELSE 1 END AS record_version, CASE WHEN p.v <> f.v THEN p.v ELSE f.v END::varchar AS value,
          CASE WHEN p.v <> f.v THEN 'idem:' || p.e END AS applied_key FROM f LEFT JOIN p USING (user_id)""",
    "envelope_statuses": over(f", {_ELIGIBLE} SELECT envelope_status, count(*) AS n FROM envelopes GROUP BY 1"),
    "executor_outcomes": over(
        f""", {_ELIGIBLE}, {_APPROVED}, last_days AS (SELECT user_id, arg_max(approval, day) AS approval FROM approved GROUP BY 1),
        attempts AS (SELECT e.*, coalesce(approval, 'MISSING') AS approval FROM envelopes e LEFT JOIN last_days ON user_id = party),
        ended AS (SELECT CASE WHEN envelope_status <> 'VALID' THEN 'REJECTED_' || envelope_status WHEN approval = 'MISSING' THEN 'REJECTED_APPROVALS_MISSING' WHEN approval = 'SAME_IDENTITY' THEN 'REJECTED_SAME_IDENTITY'
          WHEN product_type = 'FX_SPOT' THEN CASE WHEN side = 'SELL_BASE' THEN 'TIMEOUT_RECOVERED' ELSE 'DUPLICATE_NOOP' END ELSE 'SUCCESS' END AS outcome FROM attempts)
        SELECT outcome, count(*) AS n, count(*) FILTER (outcome = 'SUCCESS') AS side_effects FROM ended GROUP BY 1"""
    ),
    "comparison_violations": over(
        f""", {_GONE} SELECT CASE WHEN expected_observation_id IN (SELECT observation_id FROM gone) OR observed_observation_id IN (SELECT observation_id FROM gone) THEN 'SOURCE_INCOMPLETE' ELSE '' END AS reasons,
        count(*) AS n FROM all_facts GROUP BY 1"""
    ),
    "policy_violations": over(
        f""", {_KINDS}, sides(n, conf) AS (VALUES (12, false), (1, true))
        SELECT concat_ws(',', CASE WHEN greatest(e, t, c, b) > 1 THEN 'PRECEDENCE_REPEATS' END, CASE WHEN conf AND c = 0 OR NOT conf AND (e = 0 OR t = 0) THEN 'TRUSTED_WITHOUT_PRECEDENCE' END) AS reasons,
          sum(n)::bigint AS n FROM kinds_of, sides GROUP BY 1"""
    ),
    "policy_set_violations": over(
        f""", {_KINDS} SELECT concat_ws(',', CASE WHEN greatest(c, b) > 1 THEN 'PATHS_REPEAT' END, CASE WHEN least(c, b) = 0 THEN 'PATHS_INCOMPLETE' END, CASE WHEN least(e, t, c, b) = 0 THEN 'POLICY_HASH' END) AS reasons,
        count(*) AS n FROM kinds_of GROUP BY 1"""
    ),
    "post_action_violations": over(f", {_KINDS} SELECT CASE WHEN b = 0 THEN 'PRE_ACTION_KIND,READBACK_WITHOUT_POST' ELSE '' END AS reasons, count(*) AS n FROM kinds_of GROUP BY 1"),
    "evidence_violations": over(
        f""", {_GONE}, items AS (SELECT f.lineage_id, f.trade_id, f.watermark, CASE WHEN r.n = 0 AND f.expected_observation_id IS NOT NULL THEN f.expected_observation_id ELSE f.observed_observation_id END AS src
          FROM all_facts f, (VALUES (0), (1)) r(n)),
        met_items AS (SELECT i.*, s.ingest_epoch, s.source_trade_id, i.src IN (SELECT observation_id FROM gone) AS lost FROM items i JOIN seen s ON s.lineage_id = i.lineage_id AND s.observation_id = i.src)
        SELECT concat_ws(',', CASE WHEN NOT lost AND ingest_epoch + 180 < watermark THEN 'CREATED_BEFORE_CAPTURE' END, CASE WHEN lost THEN 'HASH_WITHOUT_SOURCE' END,
          CASE WHEN NOT lost AND source_trade_id <> trade_id THEN 'SOURCE_SCOPE' END) AS reasons, count(*) AS n FROM met_items GROUP BY 1"""
    ),
    "recommendation_reasons": over(
        """SELECT CASE WHEN product_type = 'FX_SPOT' THEN '' ELSE 'RISK_TIER' END AS reasons,
          CASE WHEN expected_observation_id LIKE 'obs_execution%' AND observed_observation_id LIKE 'obs_booking%' THEN 'CORRECT_LEGACY_BOOKING_FIELD' END AS recommended_action, count(*) AS n
        FROM all_facts WHERE field_path = '/payload/base_amount' GROUP BY 1, 2"""
    ),
    "action_violations": over(
        """, drafts AS (SELECT c.*, f.kind_reference AS first_reference, 'sha256:' || sha256(c.kind_reference || '>' || f.kind_reference) AS draft_hash
          FROM decided c JOIN decided f ON f.observation_id = c.first_id WHERE c.outcome = 'DUPLICATE_SOURCE_CONFLICT'),
        keyed_drafts AS (SELECT kind, 'idem:' || sha256('{"action_type":"CORRECT","content_hash":"' || draft_hash || '","exact_approved_new_value":"' || first_reference || '","normalised_expected_old_value":"' || kind_reference
          || '","portfolio_id":"' || portfolio_id || '","target_booking_version":' || source_version || ',"tenant_id":"' || tenant_id || '","trade_id":"' || source_trade_id || '"}') AS idem FROM drafts)
        SELECT CASE WHEN kind = 'CONFIRMATION' THEN '' ELSE 'TARGET_FIELD' END AS reasons, count(*) AS n, min(idem) AS least_key FROM keyed_drafts GROUP BY 1"""
    ),
    "source_references": over(
        """SELECT lineage_id, observation_id AS source_observation_id, kind AS observation_kind, source_system, source_business_key, tenant_id AS source_tenant_id, portfolio_id AS source_portfolio_id,
        source_version, content_hash FROM seen"""
    ),
}
