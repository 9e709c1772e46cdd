"""Rows made by hand, most of them spoilt in one way, for every rule of the contracts, and in SQL which reasons they must get. The tables give numbers of rows only."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import actions, contract
from tallyspark.functions import validation as V
from tallyspark.functions.reference_data import STATES, TRANSITIONS
from tallyspark.operators import remediation, reporting
from tallyspark.plans.contract_oracles import listed
from tallyspark.plans.contract_queries import by_reason, spoilt
from tallyspark.plans.registry import table


def _pick(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def transition_violations(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    reasons = tuple(dict.fromkeys(r for _, _, r in TRANSITIONS))
    order = ("DETECTED", "BEGIN_INVESTIGATION", "PROPOSE_RESOLUTION", "ACTION_AUTHORISATION_PENDING", "NO_ACTION_DISPOSITION_PENDING", "BEGIN_VERIFICATION", "RESOLUTION_VERIFIED", "ESCALATE")
    assert set(reasons) == set(order)
    tried = table(spark, d, "events").select(
        F.when(e % 9 < 8, _pick(STATES, F.least(e % 9, F.lit(7)))).alias("from_state"), _pick(STATES, F.floor(e / 9) % 8).alias("to_state"), _pick(order, F.floor(e / 72) % 8).alias("reason_code")
    )
    _, rejected = V.split(tried, V.transition_rules())
    return rejected.groupBy("from_state", "to_state", "reason_code").agg(F.count(F.lit(1)).alias("n"))


def recommendation_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Provider answers, most of them spoilt in one way, parsed fail-closed."""
    k = F.col("event_id") % 12
    either = lambda at, bad, good: F.when(k == at, bad).otherwise(good)
    raw = F.concat(
        F.lit('{"predicted_root_cause":"'), either(1, "", "late booking"), F.lit('","confidence":'), F.when(k == 2, "1.5").when(k == 3, '"high"').otherwise("0.9"), F.lit(',"priority":"'), either(4, "URGENT", "HIGH"),
        F.lit('","risk_tier":"LOW","required_approvals":["MAKER","'), either(5, "OWNER", "CHECKER"), F.lit('"],"recommended_action":'), F.when(k == 6, "null").when(k == 7, '"DELETE"').otherwise('"CORRECT_LEGACY_BOOKING_FIELD"'),
        F.lit(',"abstain_reason":'), either(8, '"unsure"', "null"), F.lit(',"proposed_fields":{'), either(9, "", '"field_path":"1.00"'), F.lit('},"citations":[{"document_id":"RB-001","section":"3"}]'), either(10, ',"note":1', ""),
        either(11, "", "}"),
    )
    found = actions.parsed_recommendations(table(spark, d, "events").select(raw.alias("raw")))
    return found.select(F.array_join("reasons", ",").alias("reasons"), "recommended_action").groupBy("reasons", "recommended_action").agg(F.count(F.lit(1)).alias("n"))


def action_violations(spark: SparkSession, d: str) -> DataFrame:
    """Action drafts of orders, most of them spoilt in one way, through the contract."""
    k, c = F.col("o_orderkey") % 17, F.col("o_custkey")
    at = lambda hour: F.lit(f"2026-03-02 {hour:02d}:00:00").cast("timestamp")
    text = lambda prefix: F.concat(F.lit(prefix), F.col("o_orderkey"))
    source = lambda kind, portfolio, oid, system: F.struct(
        F.lit("tenant_a").alias("tenant_id"), portfolio.alias("portfolio_id"), text("case_").alias("case_id"), text("trade_").alias("trade_id"), oid.alias("observation_id"), F.lit(kind).alias("kind"), system.alias("source_system")
    )
    home, mine = F.lit("portfolio_a"), text("exec_")
    pair = F.array(
        source("EXECUTION", home, mine, F.lit("FIX_EXECUTION")),
        source("BOOKING", F.when(k == 11, "portfolio_b").otherwise(home), F.when(k == 10, mine).otherwise(text("book_")), F.when(k == 12, "FIX_EXECUTION").otherwise("MOCK_LEGACY_BOOKING")),
    )
    rows = table(spark, d, "orders").select(
        F.lit("CORRECT").alias("action_type"), F.lit("tenant_a").alias("tenant_id"), home.alias("portfolio_id"), text("case_").alias("case_id"), text("trade_").alias("trade_id"),
        F.when(k == 1, "/payload/side").otherwise(actions.TARGET_FIELD).alias("target_field_path"), F.when(k == 2, 0).otherwise(1).alias("target_booking_version"),
        F.when(c % 7 > 0, F.when(k == 3, "new").otherwise("old")).alias("normalised_expected_old_value"), F.when(k == 16, "").otherwise("new").alias("exact_approved_new_value"),
        at(9).alias("issued_at"), F.when(k == 4, at(8)).otherwise(at(9)).alias("not_before"), F.when(k == 5, at(9)).otherwise(at(12)).alias("expires_at"),
        F.when(k.isin(7, 8), "LEASE").otherwise("CAS").alias("control_type"), F.when(k == 6, at(10)).when(k == 8, at(13)).alias("lease_expires_at"),
        F.when(k == 9, F.filter(pair, lambda x: F.lit(False))).otherwise(pair).alias("sources"), F.lit("decision_1").alias("maker_reference"), F.when(k == 13, "decision_1").otherwise("decision_2").alias("checker_reference"),
        F.when(c % 5 < 2, "key_1").alias("signer_key_id"), F.when(c % 5 == 1, "ED25519").alias("signature_algorithm"), F.when(c % 5 == 1, "c2ln").alias("signature"), text("draft ").alias("draft"), k.alias("k"),
    )
    rows = rows.withColumn("content_hash", actions.sha256(F.when(F.col("k") == 14, "other").otherwise(F.col("draft"))))
    rows = rows.withColumn("idempotency_key", F.when(F.col("k") == 15, "idem:0").otherwise(actions.idempotency_key()))
    marked = V.with_reasons(rows, actions.action_rules())
    return marked.groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n"), F.min("idempotency_key").alias("least_key"))


def evidence_violations(spark: SparkSession, d: str) -> DataFrame:
    """Evidence items of events, most of them spoilt in one way, through the contract."""
    k = F.col("event_id") % 12
    scope = lambda portfolio: F.struct(F.lit("tenant_a").alias("tenant_id"), portfolio.alias("portfolio_id"), F.lit("case_1").alias("case_id"), F.lit("trade_1").alias("trade_id"))
    at = lambda hour: F.lit(f"2026-03-02 {hour:02d}:00:00").cast("timestamp")
    rows = table(spark, d, "events").select(
        F.lit("ev_1").alias("evidence_id"), F.when(k.isin(2, 3), 2).otherwise(1).alias("evidence_version"), F.when(k == 1, "ev_0").when(k == 3, "ev_1").alias("supersedes_evidence_id"),
        F.when(k == 5, "ev_1").when(k == 6, "ev_0").alias("derivative_of_evidence_id"), F.when(k.isin(4, 5), "REDACTED_DERIVATIVE").otherwise("NOT_REQUIRED").alias("redaction_status"),
        F.when(k == 7, F.lit("sha256:x")).otherwise(actions.sha256(F.lit("a"))).alias("content_hash"), F.lit("SOURCE_OBSERVATION_HASH").alias("evidence_kind"), scope(F.lit("portfolio_a")).alias("scope"),
        F.when(k != 8, scope(F.when(k == 9, "portfolio_b").otherwise("portfolio_a"))).alias("source_scope"), F.lit("BOOKING").alias("source_kind"),
        F.when(k == 10, "FIX_EXECUTION").otherwise("MOCK_LEGACY_BOOKING").alias("source_system"), F.lit("1").alias("source_version"), actions.sha256(F.lit("b")).alias("source_hash"),
        at(9).alias("captured_at"), F.when(k == 11, at(8)).otherwise(at(9)).alias("created_at"),
    )
    marked = V.with_reasons(rows, actions.evidence_rules())
    return marked.groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


def executor_outcomes(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("event_id") % 10
    value, other = F.lit("100.00"), F.lit("90.00")
    attempts = table(spark, d, "events").select(
        F.when(m == 0, "TAMPERED").when(m == 1, "EXPIRED").otherwise("VALID").alias("envelope_status"), F.when(m == 2, "MISSING").when(m == 3, "SAME_IDENTITY").otherwise("COMPLETE").alias("approval"),
        F.when(m == 4, "/payload/side").otherwise("/payload/base_amount").alias("field_path"), F.when(m == 7, None).when(m == 8, other).otherwise(value).alias("current_value"),
        F.when(m.isin(5, 6), "idem:1").alias("applied_key"), F.lit("idem:1").alias("idempotency_key"), value.alias("expected_old_value"),
        F.when(m == 6, "TIMEOUT_RECOVERY_ATTEMPT").otherwise("NORMAL").alias("attempt_context"),
    )
    return remediation.execute(attempts).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if("side_effect").alias("side_effects"))


def identity_policy(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    bit = lambda n: F.floor(e / n) % 2 == 1
    flags = table(spark, d, "events").select(
        bit(1).alias("schema_supported"), bit(2).alias("scope_match"), bit(4).alias("same_delivery"), bit(8).alias("same_hash"), bit(16).alias("same_source"),
        _pick(("GREATER", "LOWER", "EQUAL"), F.floor(e / 32) % 3).alias("version_relation"), (F.floor(e / 96) % 3).alias("candidates"),
    )
    return flags.groupBy(remediation.identity_outcome().alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def approvals_status(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").select("user_id").distinct()
    u = F.col("user_id") % 4
    rows = users.select(
        F.col("user_id").cast("string").alias("case_id"),
        F.explode(F.filter(F.array(F.struct(F.lit("MAKER").alias("role"), F.lit("ann").alias("approver_identity")), F.struct(F.lit("CHECKER").alias("role"), F.when(u == 1, "ann").otherwise("bo").alias("approver_identity"))),
                           lambda x: (u != 2) | (x["role"] == "MAKER"))).alias("a"),
        F.when(u == 3, "REJECTED").otherwise("APPROVED").alias("decision"),
    ).select("case_id", "a.*", "decision")
    found = remediation.approvals(rows)
    every = users.select(F.col("user_id").cast("string").alias("case_id")).join(found, "case_id", "left")
    return every.groupBy(F.coalesce("approval", F.lit("MISSING")).alias("approval")).agg(F.count(F.lit(1)).alias("n"))


def post_action_violations(events: DataFrame) -> DataFrame:
    k = F.col("event_id") % 8
    record = lambda kind, portfolio: F.struct(kind.alias("kind"), F.lit("tenant_a").alias("tenant_id"), portfolio.alias("portfolio_id"), F.lit("trade_1").alias("source_business_key"))
    change = lambda a, b: F.struct(F.lit("/payload/book_id").alias("field_path"), F.lit(a).alias("expected_value"), F.lit(b).alias("observed_value"))
    home = F.lit("portfolio_a")
    post = record(F.when(k == 2, "EXECUTION").otherwise("BOOKING"), F.when(k == 3, "portfolio_b").otherwise(home))
    rows = events.select(
        record(F.when(k == 1, "EXECUTION").otherwise("BOOKING"), home).alias("pre"), F.when(~k.isin(4, 7), post).alias("post"), (k != 7).alias("readback_available"),
        F.when(k == 5, F.array(change("a", "b"), change("a", "b"))).when(k == 6, F.array(change("a", "a"))).otherwise(F.array(change("a", "b"))).alias("changed"),
    )
    return by_reason(rows, contract.post_action_rules())


def comparison_violations(events: DataFrame) -> DataFrame:
    k = F.col("event_id") % 6
    rows = events.select(
        F.when(k == 3, "DATE").otherwise("DECIMAL").alias("value_type"), F.when(k == 1, "ABOUT").otherwise("ABSOLUTE_DECIMAL").alias("tolerance_mode"), F.when(k != 2, "0.01").alias("tolerance_value"),
        F.lit("obs_1").alias("expected_observation_id"), F.when(k != 4, "1").alias("expected_source_version"), F.when(k != 5, "obs_2").alias("observed_observation_id"), F.lit("1").alias("observed_source_version"),
    )
    return by_reason(rows, contract.comparison_rules())


def policy_violations(events: DataFrame) -> DataFrame:
    k = F.col("event_id") % 4
    systems = F.array(*map(F.lit, ("FIX_EXECUTION", "FPML_CONFIRMATION")))
    path = F.element_at(F.array(*map(F.lit, contract.POLICY_PATHS)), (F.col("event_id") % len(contract.POLICY_PATHS) + 1).cast("int"))
    rows = events.select(
        spoilt(k, 1, F.lit("/payload/unknown"), path).alias("field_path"), spoilt(k, 2, F.array(F.lit("OTHER")), systems).alias("trusted_sources"),
        spoilt(k, 3, F.concat(systems, systems), systems).alias("source_precedence"),
    )
    return by_reason(rows, contract.policy_rules())


def policy_set_violations(events: DataFrame) -> DataFrame:
    k, all_paths = F.col("event_id") % 4, F.array(*map(F.lit, contract.POLICY_PATHS))
    document = F.concat(F.lit('{"policy_version":"'), (F.col("event_id") % 3).cast("string"), F.lit('.0.0"}'))
    rows = events.select(
        F.when(k == 1, F.concat(all_paths, F.slice(all_paths, 1, 1))).when(k == 2, F.slice(all_paths, 2, 100)).otherwise(all_paths).alias("paths"), document.alias("document"),
        spoilt(k, 3, F.lit("sha256:0"), F.concat(F.lit("sha256:"), F.sha2(document, 256))).alias("pinned_hash"),
    )
    return by_reason(rows, contract.policy_set_rules())


def applied_corrections(events: DataFrame) -> DataFrame:
    """Records of users, some of which an execution corrects: one new version for each success, none for others; seeding again adds nothing."""
    users = events.select(F.col("user_id").cast("string").alias("trade_id")).distinct()
    scope = [F.lit("tenant_a").alias("tenant_id"), F.lit("portfolio_a").alias("portfolio_id")]
    records = users.select(*scope, "trade_id", F.lit(1).alias("record_version"), F.lit("90").alias("value"), F.lit(None).cast("string").alias("applied_key"))
    done = users.select(*scope, "trade_id", (F.col("trade_id").cast("long") % 4 == 0).alias("side_effect"), F.lit("100").alias("approved_value"), F.concat(F.lit("idem:"), "trade_id").alias("idempotency_key"))
    every = records.unionByName(remediation.applied(records, done))
    last = reporting.latest(every, ["tenant_id", "portfolio_id", "trade_id"], "record_version")
    return last.select("trade_id", "record_version", "value", "applied_key")


def envelope_statuses(events: DataFrame) -> DataFrame:
    """Signed envelopes of users, some changed or late."""
    k = F.col("user_id") % 5
    users = events.select("user_id").distinct()
    text = lambda prefix: F.concat(F.lit(prefix), F.col("user_id").cast("string"))
    cases = users.select(
        text("case_").alias("case_id"), F.lit("tenant_a").alias("tenant_id"), F.lit("portfolio_a").alias("portfolio_id"), text("trade_").alias("trade_id"), F.lit("/payload/base_amount").alias("field_path"),
        F.lit("90").alias("expected_old_value"), F.lit("100").alias("approved_value"), "user_id",
    )
    at, secret = F.lit("2026-01-01 10:00:00").cast("timestamp"), b"secret"
    made = remediation.envelopes(cases.drop("user_id"), at, secret).join(cases.select("case_id", "user_id"), "case_id")
    made = made.withColumns({"approved_value": spoilt(k, 1, F.lit("999"), "approved_value"), "signature": spoilt(k, 2, F.lit("00"), "signature")})
    now = at + F.when(k == 3, F.make_dt_interval(secs=F.lit(900))).when(k == 4, F.make_dt_interval(secs=F.lit(899))).otherwise(F.make_dt_interval(secs=F.lit(0)))
    return remediation.verified_envelopes(made, now, secret).groupBy("envelope_status").agg(F.count(F.lit(1)).alias("n"))


EVENTS = {f.__name__: f for f in (post_action_violations, comparison_violations, policy_violations, policy_set_violations, applied_corrections, envelope_statuses)}
TABLES = {f.__name__: f for f in (transition_violations, recommendation_reasons, action_violations, evidence_violations, executor_outcomes, identity_policy, approvals_status)}

EXPECTED = {
    "transition_violations": """
        WITH states(s) AS (VALUES ('OPEN'), ('UNDER_INVESTIGATION'), ('RESOLUTION_PROPOSED'), ('ACTION_PENDING'), ('NO_ACTION_DISPOSITION_PENDING'), ('VERIFYING'), ('RESOLVED'), ('ESCALATED')),
        names(r) AS (VALUES ('DETECTED'), ('BEGIN_INVESTIGATION'), ('PROPOSE_RESOLUTION'), ('ACTION_AUTHORISATION_PENDING'), ('NO_ACTION_DISPOSITION_PENDING'), ('BEGIN_VERIFICATION'), ('RESOLUTION_VERIFIED'), ('ESCALATE')),
        numbered AS (SELECT event_id, event_id % 9 AS a, (event_id // 9) % 8 AS b, (event_id // 72) % 8 AS c FROM events),
        tried AS (SELECT event_id, CASE WHEN a < 8 THEN (SELECT list(s ORDER BY list_position(['OPEN','UNDER_INVESTIGATION','RESOLUTION_PROPOSED','ACTION_PENDING','NO_ACTION_DISPOSITION_PENDING','VERIFYING','RESOLVED','ESCALATED'], s)) FROM states)[a + 1] END AS f,
          ['OPEN','UNDER_INVESTIGATION','RESOLUTION_PROPOSED','ACTION_PENDING','NO_ACTION_DISPOSITION_PENDING','VERIFYING','RESOLVED','ESCALATED'][b + 1] AS t,
          ['DETECTED','BEGIN_INVESTIGATION','PROPOSE_RESOLUTION','ACTION_AUTHORISATION_PENDING','NO_ACTION_DISPOSITION_PENDING','BEGIN_VERIFICATION','RESOLUTION_VERIFIED','ESCALATE'][c + 1] AS r FROM numbered),
        legal(f, t, r) AS (VALUES (NULL, 'OPEN', 'DETECTED'), ('OPEN', 'UNDER_INVESTIGATION', 'BEGIN_INVESTIGATION'), ('OPEN', 'ESCALATED', 'ESCALATE'), ('UNDER_INVESTIGATION', 'RESOLUTION_PROPOSED', 'PROPOSE_RESOLUTION'),
          ('UNDER_INVESTIGATION', 'ESCALATED', 'ESCALATE'), ('RESOLUTION_PROPOSED', 'ACTION_PENDING', 'ACTION_AUTHORISATION_PENDING'), ('RESOLUTION_PROPOSED', 'NO_ACTION_DISPOSITION_PENDING', 'NO_ACTION_DISPOSITION_PENDING'),
          ('RESOLUTION_PROPOSED', 'ESCALATED', 'ESCALATE'), ('ACTION_PENDING', 'VERIFYING', 'BEGIN_VERIFICATION'), ('ACTION_PENDING', 'ESCALATED', 'ESCALATE'),
          ('NO_ACTION_DISPOSITION_PENDING', 'VERIFYING', 'BEGIN_VERIFICATION'), ('NO_ACTION_DISPOSITION_PENDING', 'ESCALATED', 'ESCALATE'), ('VERIFYING', 'RESOLVED', 'RESOLUTION_VERIFIED'), ('VERIFYING', 'ESCALATED', 'ESCALATE'))
        SELECT f AS from_state, t AS to_state, r AS reason_code, count(*) AS n FROM tried x WHERE NOT EXISTS (SELECT 1 FROM legal l WHERE l.f IS NOT DISTINCT FROM x.f AND l.t = x.t AND l.r = x.r) GROUP BY 1, 2, 3""",
    "recommendation_reasons": """
        WITH e AS (SELECT event_id % 12 AS k FROM events), texts AS (SELECT '{"predicted_root_cause":"' || CASE k WHEN 1 THEN '' ELSE 'late booking' END || '","confidence":' || CASE k WHEN 2 THEN '1.5' WHEN 3 THEN '"high"' ELSE '0.9' END
          || ',"priority":"' || CASE k WHEN 4 THEN 'URGENT' ELSE 'HIGH' END || '","risk_tier":"LOW","required_approvals":["MAKER","' || CASE k WHEN 5 THEN 'OWNER' ELSE 'CHECKER' END || '"],"recommended_action":'
          || CASE k WHEN 6 THEN 'null' WHEN 7 THEN '"DELETE"' ELSE '"CORRECT_LEGACY_BOOKING_FIELD"' END || ',"abstain_reason":' || CASE k WHEN 8 THEN '"unsure"' ELSE 'null' END || ',"proposed_fields":{'
          || CASE k WHEN 9 THEN '' ELSE '"field_path":"1.00"' END || '},"citations":[{"document_id":"RB-001","section":"3"}]' || CASE k WHEN 10 THEN ',"note":1' ELSE '' END || CASE k WHEN 11 THEN '' ELSE '}' END AS raw FROM e),
        docs AS (SELECT raw, CASE WHEN json_valid(raw) THEN raw::json END AS j FROM texts),
        fields AS (SELECT j, j->>'recommended_action' AS a, j->>'abstain_reason' AS w, try_cast(j->>'confidence' AS double) AS c, json_type(j->'confidence') IN ('DOUBLE', 'UBIGINT', 'BIGINT') AS numeric_c FROM docs)
        SELECT CASE WHEN j IS NULL OR NOT numeric_c THEN 'NOT_JSON' ELSE concat_ws(',',
          CASE WHEN length(j->>'predicted_root_cause') NOT BETWEEN 1 AND 2000 THEN 'ROOT_CAUSE_LENGTH' END, CASE WHEN c NOT BETWEEN 0 AND 1 THEN 'CONFIDENCE_RANGE' END,
          CASE WHEN j->>'priority' NOT IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL') THEN 'PRIORITY' END, CASE WHEN a NOT IN ('CORRECT_LEGACY_BOOKING_FIELD', 'MANUAL_INVESTIGATION') THEN 'ACTION' END,
          CASE WHEN NOT list_has_all(['MAKER', 'CHECKER'], (j->>'$.required_approvals[*]')) THEN 'APPROVAL_ROLE' END, CASE WHEN a IS NULL AND w IS NULL THEN 'NEITHER_ACTION_NOR_REASON' END,
          CASE WHEN a IS NOT NULL AND w IS NOT NULL THEN 'ACTION_AND_REASON' END, CASE WHEN a = 'CORRECT_LEGACY_BOOKING_FIELD' AND len(json_keys(j->'proposed_fields')) = 0 THEN 'CORRECTION_WITHOUT_FIELD' END,
          CASE WHEN list_contains(json_keys(j), 'note') THEN 'UNKNOWN_FIELD' END) END AS reasons,
          CASE WHEN j IS NOT NULL THEN a END AS recommended_action, count(*) AS n FROM fields GROUP BY 1, 2""",
    "action_violations": """
        WITH o AS (SELECT o_orderkey AS id, o_orderkey % 17 AS k, CASE WHEN o_custkey % 7 > 0 THEN CASE WHEN o_orderkey % 17 = 3 THEN 'new' ELSE 'old' END END AS old_value, CASE WHEN o_orderkey % 17 = 16 THEN '' ELSE 'new' END AS new_value,
          o_custkey % 5 AS s, CASE WHEN o_orderkey % 17 = 2 THEN 0 ELSE 1 END AS v FROM orders),
        h AS (SELECT *, 'sha256:' || sha256(CASE WHEN k = 14 THEN 'other' ELSE 'draft ' || id END) AS hash FROM o),
        i AS (SELECT *, CASE WHEN k = 15 THEN 'idem:0' ELSE 'idem:' || sha256('{"action_type":"CORRECT","content_hash":"' || hash || '","exact_approved_new_value":"' || new_value || '","normalised_expected_old_value":' || coalesce('"' || old_value || '"', 'null')
          || ',"portfolio_id":"portfolio_a","target_booking_version":' || v || ',"tenant_id":"tenant_a","trade_id":"trade_' || id || '"}') END AS idem FROM h)
        SELECT concat_ws(',', CASE k WHEN 1 THEN 'TARGET_FIELD' WHEN 2 THEN 'BOOKING_VERSION' WHEN 16 THEN 'NEW_VALUE_LENGTH' END, CASE WHEN old_value = new_value THEN 'VALUE_UNCHANGED' END,
          CASE k WHEN 4 THEN 'STARTS_BEFORE_ISSUE' WHEN 5 THEN 'ENDS_BEFORE_START' WHEN 6 THEN 'CONTROL_LEASE' WHEN 7 THEN 'CONTROL_LEASE' WHEN 8 THEN 'LEASE_WINDOW' WHEN 9 THEN 'NO_SOURCES' WHEN 10 THEN 'SOURCE_REPEATS' WHEN 11 THEN 'SOURCE_SCOPE'
            WHEN 12 THEN 'SOURCE_SYSTEM' WHEN 13 THEN 'SAME_DECISION' END, CASE WHEN s = 0 THEN 'SIGNATURE_INCOMPLETE' END, CASE k WHEN 14 THEN 'CONTENT_HASH' WHEN 15 THEN 'IDEMPOTENCY_KEY' END) AS reasons,
          count(*) AS n, min(idem) AS least_key FROM i GROUP BY 1""",
    "evidence_violations": """
        SELECT coalesce(['FIRST_SUPERSEDES', 'REVISION_WITHOUT_FORMER', 'SUPERSEDES_ITSELF', 'DERIVATIVE_WITHOUT_ORIGIN', 'DERIVES_FROM_ITSELF', 'ORIGIN_OF_NO_DERIVATIVE', 'CONTENT_HASH', 'SOURCE_INCOMPLETE,HASH_WITHOUT_SOURCE',
          'SOURCE_SCOPE', 'SOURCE_SYSTEM', 'CREATED_BEFORE_CAPTURE'][event_id % 12], '') AS reasons, count(*) AS n FROM events GROUP BY 1""",
    "executor_outcomes": """
        WITH a AS (SELECT event_id, event_id % 10 AS m FROM events)
        SELECT CASE m WHEN 0 THEN 'REJECTED_TAMPERED' WHEN 1 THEN 'REJECTED_EXPIRED' WHEN 2 THEN 'REJECTED_APPROVALS_MISSING' WHEN 3 THEN 'REJECTED_SAME_IDENTITY' WHEN 4 THEN 'REJECTED_FIELD_NOT_ALLOWED'
          WHEN 5 THEN 'DUPLICATE_NOOP' WHEN 6 THEN 'TIMEOUT_RECOVERED' WHEN 7 THEN 'REJECTED_VALUE_MISMATCH' WHEN 8 THEN 'REJECTED_VALUE_MISMATCH' ELSE 'SUCCESS' END AS outcome, count(*) AS n,
          count(*) FILTER (m = 9) AS side_effects FROM a GROUP BY 1""",
    "identity_policy": """
        WITH a AS (SELECT event_id % 2 = 1 AS s, (event_id // 2) % 2 = 1 AS scope, (event_id // 4) % 2 = 1 AS d, (event_id // 8) % 2 = 1 AS h, (event_id // 16) % 2 = 1 AS src, (event_id // 32) % 3 AS rel, (event_id // 96) % 3 AS n FROM events)
        SELECT CASE WHEN NOT s THEN 'REJECT_UNSUPPORTED_SCHEMA_VERSION' WHEN NOT scope THEN 'REJECT_CROSS_PORTFOLIO_LINKAGE' WHEN d AND h THEN 'IDEMPOTENT_REPLAY' WHEN d THEN 'DUPLICATE_SOURCE_CONFLICT'
          WHEN src AND rel = 0 THEN 'NEW_SOURCE_VERSION' WHEN src AND rel = 1 THEN 'LATE_SOURCE_VERSION_RECORDED' WHEN n <> 1 THEN 'LINKAGE_REVIEW_REQUIRED' ELSE 'NEW_OBSERVATION' END AS outcome, count(*) AS n FROM a GROUP BY 1""",
    "approvals_status": """
        WITH c AS (SELECT DISTINCT user_id FROM events) SELECT CASE user_id % 4 WHEN 0 THEN 'COMPLETE' WHEN 1 THEN 'SAME_IDENTITY' ELSE 'MISSING' END AS approval, count(*) AS n FROM c GROUP BY 1""",
    "post_action_violations": listed(
        "events", "event_id", ["", "PRE_ACTION_KIND", "POST_ACTION_KIND", "POST_ACTION_SCOPE", "READBACK_WITHOUT_POST", "CHANGED_REPEATS", "CHANGED_EQUAL", ""]
    ),
    "comparison_violations": listed("events", "event_id", ["", "TOLERANCE_MODE", "TOLERANCE_VALUE", "TOLERANCE_OF_NO_DECIMAL", "SOURCE_INCOMPLETE", "SOURCE_INCOMPLETE"]),
    "policy_violations": listed("events", "event_id", ["", "UNKNOWN_PATH", "TRUSTED_WITHOUT_PRECEDENCE", "PRECEDENCE_REPEATS"]),
    "policy_set_violations": listed("events", "event_id", ["", "PATHS_REPEAT", "PATHS_INCOMPLETE", "POLICY_HASH"]),
    "applied_corrections": """
        WITH u AS (SELECT DISTINCT user_id FROM events) SELECT user_id::varchar AS trade_id, CASE WHEN user_id % 4 = 0 THEN 2 ELSE 1 END AS record_version,
          CASE WHEN user_id % 4 = 0 THEN '100' ELSE '90' END AS value, CASE WHEN user_id % 4 = 0 THEN 'idem:' || user_id END AS applied_key FROM u""",
    "envelope_statuses": """
        WITH u AS (SELECT DISTINCT user_id FROM events) SELECT CASE WHEN user_id % 5 IN (1, 2) THEN 'TAMPERED' WHEN user_id % 5 = 3 THEN 'EXPIRED' ELSE 'VALID' END AS envelope_status, count(*) AS n
        FROM u GROUP BY 1""",
}
