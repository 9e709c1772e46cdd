"""DuckDB SQL for the contract queries, written on its own from the rules: which reasons each kind of spoilt row must get."""

from __future__ import annotations

from .oracles import over

LEDGER = """
ledger AS (
  SELECT t.portfolio_id, count(*) AS trades_evaluated, coalesce(sum(n), 0)::bigint AS break_count FROM trade t
  LEFT JOIN (SELECT lineage_id, count(*) AS n FROM broken GROUP BY 1) b USING (lineage_id) GROUP BY 1
), runs AS (SELECT 'run_' || v.n AS run_id, portfolio_id, trades_evaluated, break_count, 1700000000 + v.n AS completed_at FROM ledger, (VALUES (1), (2), (3)) v(n))
"""


def listed(source: str, key: str, reasons: list[str], times: int = 1) -> str:
    """Rows of a table by the reasons that their number, modulo the length of the list, stands for."""
    words = ", ".join(f"'{r}'" for r in reasons)
    return f"SELECT [{words}][({key} % {len(reasons)})::int + 1] AS reasons, (count(*) * {times})::bigint AS n FROM {source} GROUP BY 1"


ORACLES: dict[str, str] = {
    "provenance_violations": listed(
        "orders", "o_orderkey",
        ["", "FIELD_PATH", "PROVENANCE_SYSTEM,SOURCE_DIFFERS_FROM_SET", "PROVENANCE_SCOPE", "SOURCE_SET_REPEATS", "SOURCE_NOT_IN_SET", "SOURCE_DIFFERS_FROM_SET", "INGESTED_AFTER_WATERMARK", ""],
        13,
    ),
    "context_violations": listed(
        "orders", "o_orderkey",
        ["", "EVALUATED_BEFORE_WATERMARK", "OBSERVATION_REPEATS", "SOURCE_SET_DIFFERS", "ARRIVED_AFTER_WATERMARK", "FOREIGN_TRADE", "PRODUCT_DIFFERS", "SETTLEMENT_RULE_DIFFERS", "LINKAGE_OUTSIDE_SET", ""],
    ),
    "selection_violations": listed("orders", "o_orderkey", ["", "NOT_SELECTED", "SELECTION_DIFFERS", "IDENTITY_INCONSISTENT", ""]),
    "run_violations": over(
        """, r AS (SELECT substr(lineage_id, 9)::bigint % 7 AS k, lineage_id IN (SELECT lineage_id FROM broken) AS bad FROM trade)
        SELECT CASE k WHEN 1 THEN 'EVALUATED_BEFORE_WATERMARK,CONTENT_HASH' WHEN 2 THEN CASE WHEN bad THEN 'BREAK_IDS_REPEAT,CONTENT_HASH' ELSE '' END WHEN 3 THEN 'RESULT,CONTENT_HASH'
          WHEN 4 THEN 'FACT_COUNT' WHEN 5 THEN 'CONTENT_HASH' ELSE '' END AS reasons, count(*) AS n FROM r GROUP BY 1"""
    ),
    "break_violations": over(
        """, b AS (SELECT substr(lineage_id, 9)::bigint % 14 AS k, family = 'MISSING_REQUIRED_SOURCE' AS missing FROM broken)
        SELECT CASE k WHEN 0 THEN CASE WHEN missing THEN '' ELSE 'RESOLUTION_TYPE' END WHEN 7 THEN CASE WHEN missing THEN 'AVAILABLE_SOURCE_MISSING' ELSE '' END
          WHEN 8 THEN CASE WHEN missing THEN 'EXPECTED_TOO_EARLY' ELSE '' END
          ELSE ['CONDITION_CODE', 'SETTLEMENT_WINDOW', 'COMPARISON_PATHS_REPEAT', 'COMPARISON_PATH', 'SOURCE_IDS_REPEAT', 'EVIDENCE_ROLES', '', '', 'ORDERING_KEY', 'ILLEGAL_TRANSITION',
            'FIRST_VERSION_SUPERSEDES', 'REOPENED_WITHOUT_FORMER', 'REOPENED_WITH_SAME_ID'][k] END AS reasons, count(*) AS n FROM b GROUP BY 1"""
    ),
    "document_violations": over(", d AS (SELECT k FROM obs) " + listed("d", "k", ["", "DECIMAL_FORMAT", "DECIMAL_TOO_LONG", "DATE_FORMAT", "TIME_WITHOUT_OFFSET", "UNKNOWN_FIELD", "NOT_JSON"])),
    "linkage_violations": over(
        """, l AS (SELECT substr(lineage_id, 9)::bigint % 6 AS k, decision, n_candidates FROM decisions)
        SELECT CASE k WHEN 1 THEN CASE WHEN decision = 'UNMATCHED' THEN '' ELSE 'FOREIGN_CANDIDATE' END WHEN 2 THEN 'DECISION_REASON'
          WHEN 3 THEN CASE WHEN decision = 'ACCEPTED' THEN 'ACCEPTED_SHAPE' ELSE 'CHOSEN_WITHOUT_ACCEPTANCE' END
          WHEN 4 THEN CASE decision WHEN 'ACCEPTED' THEN 'ACCEPTED_SHAPE' WHEN 'AMBIGUOUS' THEN 'AMBIGUOUS_TOO_FEW' ELSE '' END ELSE '' END AS reasons, count(*) AS n FROM l GROUP BY 1"""
    ),
    "resolution_violations": over(
        """, f AS (SELECT substr(lineage_id, 9)::bigint % 6 AS k, family = 'MISSING_REQUIRED_SOURCE' AS missing, field_path = '/payload/quoted_rate' AS near FROM all_facts)
        SELECT CASE k WHEN 1 THEN CASE WHEN near THEN '' ELSE 'PASS_WITHOUT_PROOF' END WHEN 2 THEN 'PASS_WITHOUT_RUN' WHEN 3 THEN CASE WHEN missing THEN '' ELSE 'NON_ACTION_FAMILY' END
          WHEN 4 THEN CASE WHEN missing THEN 'NON_ACTION_APPROVER' ELSE 'NON_ACTION_FAMILY,NON_ACTION_APPROVER' END ELSE '' END AS reasons, count(*) AS n FROM f GROUP BY 1"""
    ),
    "recent_runs": over(f", {LEDGER} SELECT run_id, portfolio_id, break_count, completed_at::bigint AS completed_at FROM runs ORDER BY completed_at DESC, run_id DESC, portfolio_id LIMIT 4"),
    "latest_run": over(f", {LEDGER} SELECT run_id, portfolio_id, break_count FROM runs WHERE run_id = 'run_2'"),
    "runs_of_id": over(f", {LEDGER} SELECT run_id, portfolio_id, trades_evaluated FROM runs WHERE run_id = 'run_1'"),
    "break_latest_version": over(
        """SELECT break_id AS root, CASE WHEN substr(lineage_id, 9)::bigint % 3 > 0 THEN 2 ELSE 1 END AS break_version, CASE WHEN substr(lineage_id, 9)::bigint % 3 > 0 THEN break_id END AS supersedes_break_id
        FROM broken"""
    ),
    "trade_details": over(
        """, per AS (SELECT trade_id, count(*)::int AS n, string_agg(family, ',' ORDER BY family, break_id) AS families FROM broken GROUP BY 1)
        SELECT t.trade_id, w.product_type, c.lifecycle_status, coalesce(n, 0)::int AS n_breaks, coalesce(families, '') AS families
        FROM trade t JOIN win w USING (lineage_id) JOIN winc c USING (lineage_id) LEFT JOIN per ON per.trade_id = t.trade_id"""
    ),
    "breaks_search": over("SELECT trade_id, family FROM broken WHERE trade_id LIKE 'trade_00000001%'"),
    "facts_in_scope": over("SELECT trade_id, family, field_path FROM all_facts WHERE portfolio_id = 'portfolio_london'"),
    "families_present": over(
        """, f AS (SELECT DISTINCT family FROM all_facts) SELECT family, list_position(['MISSING_REQUIRED_SOURCE', 'AMBIGUOUS_OR_UNMATCHED_LINKAGE', 'DUPLICATE_SOURCE_CONFLICT',
          'CURRENCY_PAIR_OR_SIDE_MISMATCH', 'ECONOMIC_VALUE_MISMATCH', 'TRADE_OR_VALUE_DATE_MISMATCH', 'LIFECYCLE_STATUS_MISMATCH', 'POST_ACTION_VERIFICATION_FAILURE'], family) AS place FROM f"""
    ),
    "corpus_manifest": over(
        "SELECT 'tenant_demo' AS tenant_id, count(DISTINCT lineage_id) AS n_trades, count(*) AS n_deliveries, count(DISTINCT content_hash) AS n_contents, 'sha256:' || sha256(concat_ws('|', "
        + ", ".join(f"sum(('0x' || substr(content_hash, {8 + 8 * i}, 8))::bigint)::varchar" for i in range(8))
        + ")) AS content_hash FROM obs"
    ),
}
