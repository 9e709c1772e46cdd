"""DuckDB SQL for the engine's queries, written on its own from the rules, not from the DataFrame code."""

from __future__ import annotations

OBS = """
base AS (
  SELECT o_orderkey AS k, o_orderkey // 2 AS half, (o_orderkey // 2) % 72 AS slot, o_orderkey % 2 = 0 AS spot, lpad(o_orderkey::varchar, 10, '0') AS pk,
    o_totalprice::decimal(18,2) AS amount, o_orderdate::date AS td, o_custkey FROM orders
), tr AS (
  SELECT k, pk, spot, td, amount, ['portfolio_london', 'portfolio_sydney'][(half + k // 144) % 2 + 1] AS portfolio_id,
    CASE WHEN spot THEN ((10800 + k % 100)::decimal(12,0) * 0.0001::decimal(5,4))::decimal(12,4) ELSE ((153000 + k % 1000)::decimal(12,0) * 0.001::decimal(4,3))::decimal(12,4) END AS rate,
    CASE WHEN (k // 4) % 2 = 0 THEN 'BUY_BASE' ELSE 'SELL_BASE' END AS side, 'counterparty_' || (o_custkey % 50) AS cp, 'book_' || (k % 7) AS book,
    CASE WHEN slot >= 24 THEN (slot - 24) // 6 END AS fam, CASE WHEN slot >= 24 THEN (slot - 24) % 6 END AS var FROM base
), defect AS (
  SELECT *, ((units // 10000 + CASE WHEN units % 10000 > 5000 OR units % 10000 = 5000 AND units // 10000 % 2 = 1 THEN 1 ELSE 0 END)::decimal(20,0) * 0.01::decimal(3,2))::decimal(18,2) AS terms,
    CASE WHEN fam = 0 THEN ['EXECUTION', 'EXECUTION', 'CONFIRMATION', 'CONFIRMATION', 'BOOKING', 'BOOKING'][var + 1]
      WHEN fam = 1 THEN ['EXECUTION', 'TRADE_CAPTURE', 'CONFIRMATION', 'EXECUTION', 'TRADE_CAPTURE', 'CONFIRMATION'][var + 1]
      WHEN fam = 2 THEN ['EXECUTION', 'TRADE_CAPTURE', 'CONFIRMATION', 'BOOKING', 'EXECUTION', 'BOOKING'][var + 1]
      WHEN fam IN (3, 4) THEN ['EXECUTION', 'TRADE_CAPTURE', 'CONFIRMATION', 'BOOKING', 'EXECUTION', 'TRADE_CAPTURE'][var + 1]
      WHEN fam = 5 THEN ['EXECUTION', 'TRADE_CAPTURE', 'CONFIRMATION', 'BOOKING', 'EXECUTION', 'BOOKING'][var + 1]
      WHEN fam = 6 THEN ['EXECUTION', 'TRADE_CAPTURE', 'CONFIRMATION', 'EXECUTION', 'TRADE_CAPTURE', 'CONFIRMATION'][var + 1]
      WHEN fam = 7 THEN 'BOOKING' ELSE '' END AS target,
    CASE WHEN fam = 0 THEN 'DROP' WHEN fam = 1 THEN CASE WHEN var < 3 THEN 'UNMATCHED' ELSE 'AMBIGUOUS' END WHEN fam = 2 THEN 'DUPLICATE'
      WHEN fam = 3 THEN ['BASE_GBP', 'TERMS_CHF', 'SIDE', 'BASE_GBP', 'TERMS_CHF', 'SIDE'][var + 1]
      WHEN fam = 4 THEN ['BASE_AMOUNT', 'TERMS_AMOUNT', 'RATE', 'BASE_AMOUNT', 'TERMS_AMOUNT', 'RATE'][var + 1]
      WHEN fam = 5 THEN ['TRADE_DATE', 'VALUE_DATE', 'TRADE_DATE', 'VALUE_DATE', 'VALUE_DATE', 'TRADE_DATE'][var + 1]
      WHEN fam = 6 THEN CASE WHEN var < 3 THEN 'AMENDED' ELSE 'CANCELLED' END
      WHEN fam = 7 THEN CASE WHEN var % 2 = 0 THEN 'BOOK_ID' ELSE 'CANCELLED' END ELSE '' END AS effect,
    coalesce(fam = 0 AND var IN (1, 3, 5) OR fam = 2 AND var > 3 OR fam IN (5, 7) AND var = 5, false) AS late
  FROM (SELECT *, (amount * 100)::bigint * (rate * 10000)::bigint AS units FROM tr)
), kinds(kind, system, seq, minutes, rnk, expected_status) AS (VALUES
  ('EXECUTION', 'FIX_EXECUTION', 1, 0, 1, 'NEW'), ('TRADE_CAPTURE', 'FIX_TRADE_CAPTURE', 2, 1, 2, 'CAPTURED'),
  ('CONFIRMATION', 'FPML_CONFIRMATION', 4, 3, 3, 'CONFIRMED'), ('BOOKING', 'MOCK_LEGACY_BOOKING', 3, 2, 4, 'BOOKED')
), del AS (
  SELECT d.*, x.*, c.copy, x.kind = d.target AS hit FROM defect d, kinds x, (VALUES (0), (1)) c(copy)
  WHERE CASE WHEN c.copy = 1 THEN x.kind = d.target AND d.effect IN ('DUPLICATE', 'AMBIGUOUS') ELSE NOT (x.kind = d.target AND d.effect = 'DROP') END
), plain AS (
  SELECT 'tenant_demo' AS tenant_id, portfolio_id, 'lineage_' || pk AS lineage_id, 'obs_' || lower(kind) || '_' || pk || CASE WHEN copy = 1 THEN '_x' ELSE '' END AS observation_id,
    kind, system AS source_system, CASE WHEN hit AND effect = 'UNMATCHED' THEN 'trade_x' ELSE 'trade_' END || pk AS source_business_key,
    CASE WHEN hit AND (effect = 'UNMATCHED' OR effect = 'AMBIGUOUS' AND copy = 1) THEN 'trade_x' ELSE 'trade_' END || pk AS source_trade_id,
    CASE WHEN hit AND effect = 'AMBIGUOUS' AND copy = 1 THEN '2' ELSE '1' END AS source_version, seq AS source_sequence, rnk, expected_status,
    CASE WHEN spot THEN 'FX_SPOT' ELSE 'FX_FORWARD' END AS product_type,
    CASE WHEN hit AND effect = 'BASE_GBP' THEN 'GBP' WHEN spot THEN 'EUR' ELSE 'USD' END AS base_currency,
    CASE WHEN hit AND effect = 'TERMS_CHF' THEN 'CHF' WHEN spot THEN 'USD' ELSE 'JPY' END AS terms_currency,
    CASE WHEN hit AND effect = 'SIDE' THEN CASE side WHEN 'BUY_BASE' THEN 'SELL_BASE' ELSE 'BUY_BASE' END ELSE side END AS side,
    (amount + CASE WHEN hit AND effect = 'BASE_AMOUNT' THEN 1000 ELSE 0 END)::decimal(18,2) AS base_amount,
    (terms + CASE WHEN hit AND effect = 'TERMS_AMOUNT' THEN 1 ELSE 0 END)::decimal(18,2) AS terms_amount,
    (rate + CASE WHEN hit AND effect = 'RATE' THEN 0.01::decimal(3,2) ELSE 0::decimal(3,2) END)::decimal(12,4) AS quoted_rate,
    (td + CASE WHEN hit AND effect = 'TRADE_DATE' THEN 1 ELSE 0 END)::date AS trade_date,
    (td + CASE WHEN spot THEN 2 ELSE 90 END + CASE WHEN hit AND effect = 'VALUE_DATE' THEN 1 ELSE 0 END)::date AS value_date,
    cp AS counterparty_id, book || CASE WHEN hit AND effect = 'BOOK_ID' THEN '_moved' ELSE '' END AS book_id,
    CASE WHEN hit AND effect IN ('AMENDED', 'CANCELLED') THEN effect ELSE expected_status END AS lifecycle_status,
    lower(kind) || '_ref_' || k || CASE WHEN copy = 1 AND effect = 'DUPLICATE' THEN '_changed' ELSE '' END AS kind_reference,
    datediff('day', date '1970-01-01', td) * 86400 + 32405 + minutes * 60 + CASE WHEN hit AND late THEN 300 ELSE 0 END AS ingest_epoch,
    datediff('day', date '1970-01-01', td) * 86400 + 32400 + minutes * 60 AS event_epoch, k * 16 + seq * 2 + copy AS arrival, k, effect, target, late
  FROM del
), obs AS MATERIALIZED (
  SELECT *, 'sha256:' || sha256(to_json({base_amount: base_amount::varchar, base_currency: base_currency, book_id: book_id, counterparty_id: counterparty_id, kind: kind, kind_reference: kind_reference,
    lifecycle_status: lifecycle_status, product_type: product_type, quoted_rate: quoted_rate::varchar, side: side, source_business_key: source_business_key, source_trade_id: source_trade_id,
    source_version: source_version, terms_amount: terms_amount::varchar, terms_currency: terms_currency, trade_date: trade_date::varchar, value_date: value_date::varchar})::varchar) AS content_hash
  FROM plain
), outcomes AS (
  SELECT *, row_number() OVER same AS nth, first_value(content_hash) OVER same AS first_hash, first_value(observation_id) OVER same AS first_id FROM obs
  WINDOW same AS (PARTITION BY tenant_id, portfolio_id, source_system, kind, source_business_key, source_version ORDER BY arrival, observation_id)
), decided AS MATERIALIZED (
  SELECT *, CASE WHEN nth = 1 THEN 'INSERTED' WHEN content_hash = first_hash THEN 'IDEMPOTENT_REPLAY' ELSE 'DUPLICATE_SOURCE_CONFLICT' END AS outcome FROM outcomes
), met AS MATERIALIZED (
  SELECT *, (outcome <> 'INSERTED')::int AS src_ord,
    row_number() OVER (PARTITION BY lineage_id ORDER BY rnk, source_sequence, observation_id, source_version, content_hash) AS ordinal
  FROM decided WHERE outcome <> 'IDEMPOTENT_REPLAY'
), keyed AS (
  SELECT lineage_id, source_business_key, count(*) AS n, min(src_ord * 1000000 + source_sequence) AS first_seen, min(observation_id) AS first_id FROM met GROUP BY 1, 2
), modes AS MATERIALIZED (
  SELECT lineage_id, source_business_key AS trade_id FROM (SELECT *, row_number() OVER (PARTITION BY lineage_id ORDER BY n DESC, first_seen, first_id) AS r FROM keyed) WHERE r = 1
), seen AS MATERIALIZED (
  SELECT s.*, row_number() OVER (PARTITION BY s.lineage_id ORDER BY s.source_business_key <> m.trade_id AND s.source_trade_id <> m.trade_id,
      list_position(['FIX_EXECUTION', 'FIX_TRADE_CAPTURE', 'FPML_CONFIRMATION', 'MOCK_LEGACY_BOOKING'], source_system), source_version::bigint DESC, observation_id, content_hash) AS exec_place,
    row_number() OVER (PARTITION BY s.lineage_id ORDER BY s.source_business_key <> m.trade_id AND s.source_trade_id <> m.trade_id,
      list_position(['FPML_CONFIRMATION', 'MOCK_LEGACY_BOOKING', 'FIX_TRADE_CAPTURE', 'FIX_EXECUTION'], source_system), source_version::bigint DESC, observation_id, content_hash) AS conf_place
  FROM met s JOIN modes m USING (lineage_id)
), trade AS MATERIALIZED (
  SELECT s.lineage_id, s.tenant_id, s.portfolio_id, m.trade_id, count(*) AS n_obs, max(ingest_epoch) AS watermark, count(DISTINCT source_trade_id) AS n_payload,
    bool_or(source_business_key <> m.trade_id) AS foreign_key, list(DISTINCT kind) AS kind_list, list(DISTINCT source_trade_id ORDER BY source_trade_id) AS payload_list, list(observation_id ORDER BY ordinal) AS ids
  FROM seen s JOIN modes m USING (lineage_id) GROUP BY 1, 2, 3, 4
), first_obs AS MATERIALIZED (SELECT lineage_id, observation_id AS first_id FROM seen WHERE ordinal = 1
), win AS MATERIALIZED (SELECT * FROM seen WHERE exec_place = 1
), winc AS MATERIALIZED (SELECT * FROM seen WHERE conf_place = 1
), source_sets AS (
  SELECT lineage_id, list({content_hash: content_hash, kind: kind, observation_id: observation_id, source_business_key: source_business_key, source_system: source_system,
    source_version: source_version} ORDER BY kind, source_system, source_business_key, source_version::bigint, observation_id, content_hash) AS items FROM seen GROUP BY 1
), decisions AS (
  SELECT *, CASE WHEN n_obs > 4 AND n_payload > 1 THEN 'AMBIGUOUS' WHEN foreign_key THEN 'UNMATCHED' ELSE 'ACCEPTED' END AS decision,
    CASE WHEN n_obs > 4 AND n_payload > 1 THEN n_payload WHEN foreign_key THEN 0 ELSE 1 END AS n_candidates FROM trade
), off AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lineage_id, field ORDER BY ordinal) AS place FROM (
    SELECT s.lineage_id, s.ordinal, s.observation_id, w.observation_id AS win_id, f.field, f.value_type, f.family,
      CASE f.field WHEN 'base_currency' THEN s.base_currency WHEN 'terms_currency' THEN s.terms_currency WHEN 'side' THEN s.side WHEN 'base_amount' THEN s.base_amount::varchar
        WHEN 'terms_amount' THEN s.terms_amount::varchar WHEN 'quoted_rate' THEN s.quoted_rate::varchar WHEN 'trade_date' THEN s.trade_date::varchar ELSE s.value_date::varchar END AS own,
      CASE f.field WHEN 'base_currency' THEN w.base_currency WHEN 'terms_currency' THEN w.terms_currency WHEN 'side' THEN w.side WHEN 'base_amount' THEN w.base_amount::varchar
        WHEN 'terms_amount' THEN w.terms_amount::varchar WHEN 'quoted_rate' THEN w.quoted_rate::varchar WHEN 'trade_date' THEN w.trade_date::varchar ELSE w.value_date::varchar END AS theirs,
      CASE f.field WHEN 'base_amount' THEN abs(s.base_amount - w.base_amount) > 0.01 WHEN 'terms_amount' THEN abs(s.terms_amount - w.terms_amount) > 0.01
        WHEN 'quoted_rate' THEN abs(s.quoted_rate - w.quoted_rate) > 0.0001 END AS beyond
    FROM seen s JOIN win w USING (lineage_id), (VALUES ('base_currency', 'CURRENCY', 'CURRENCY_PAIR_OR_SIDE_MISMATCH'), ('terms_currency', 'CURRENCY', 'CURRENCY_PAIR_OR_SIDE_MISMATCH'),
      ('side', 'SIDE', 'CURRENCY_PAIR_OR_SIDE_MISMATCH'), ('base_amount', 'DECIMAL', 'ECONOMIC_VALUE_MISMATCH'), ('terms_amount', 'DECIMAL', 'ECONOMIC_VALUE_MISMATCH'),
      ('quoted_rate', 'DECIMAL', 'ECONOMIC_VALUE_MISMATCH'), ('trade_date', 'DATE', 'TRADE_OR_VALUE_DATE_MISMATCH'), ('value_date', 'DATE', 'TRADE_OR_VALUE_DATE_MISMATCH')) f(field, value_type, family)
    WHERE s.observation_id <> w.observation_id
  ) WHERE coalesce(beyond, own <> theirs)
), bad AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lineage_id ORDER BY ordinal) AS r FROM seen WHERE lifecycle_status <> expected_status) WHERE r = 1
), settled AS (SELECT lineage_id FROM seen GROUP BY 1 HAVING count(DISTINCT lifecycle_status) = 1 AND min(lifecycle_status) IN ('AMENDED', 'CANCELLED')
), mate AS (
  SELECT * FROM (
    SELECT o.lineage_id, o.observation_id, o.lifecycle_status, o.expected_status, row_number() OVER (PARTITION BY o.lineage_id ORDER BY
      CASE WHEN o.lifecycle_status = o.expected_status THEN 0 WHEN o.lifecycle_status <> b.lifecycle_status THEN 1 ELSE 2 END, o.ordinal) AS r
    FROM seen o JOIN bad b USING (lineage_id) WHERE o.observation_id <> b.observation_id) WHERE r = 1
), dup AS (
  SELECT lineage_id, kind, source_business_key, source_version, min(ordinal) AS o1, nth_value_2 AS o2 FROM (
    SELECT *, (list_sort(list(ordinal) OVER same))[2] AS nth_value_2, count(*) OVER same AS n_same FROM seen
    WINDOW same AS (PARTITION BY lineage_id, kind, source_business_key, source_version)
  ) WHERE n_same > 1 GROUP BY ALL HAVING count(DISTINCT content_hash) > 1
), facts AS MATERIALIZED (
  SELECT t.lineage_id, 'MISSING_REQUIRED_SOURCE' AS family, r.kind AS group_key, '/source/' || lower(r.kind) || '_observation' AS field_path, 'ABSENCE' AS value_type, 'present' AS expected_value,
    'absent_after_watermark' AS observed_value, NULL AS expected_observation_id, f.first_id AS observed_observation_id, r.severity, 'DUE' AS deadline_status
  FROM trade t JOIN first_obs f USING (lineage_id), (VALUES ('EXECUTION', 'HIGH'), ('CONFIRMATION', 'MEDIUM'), ('BOOKING', 'HIGH')) r(kind, severity) WHERE NOT list_contains(t.kind_list, r.kind)
  UNION ALL SELECT d.lineage_id, 'AMBIGUOUS_OR_UNMATCHED_LINKAGE', '', '/linkage/trade_id', 'COUNT', '1', CASE WHEN n_candidates = 1 THEN '0' ELSE n_candidates::varchar END, f.first_id, f.first_id, 'HIGH',
    'NO_CONFIGURED_DEADLINE' FROM decisions d JOIN first_obs f USING (lineage_id) WHERE decision <> 'ACCEPTED'
  UNION ALL SELECT lineage_id, family, '', '/payload/' || field, value_type, theirs, own, win_id, observation_id,
    CASE WHEN family = 'TRADE_OR_VALUE_DATE_MISMATCH' THEN 'HIGH' ELSE 'CRITICAL' END, 'NO_CONFIGURED_DEADLINE' FROM off WHERE place = 1
  UNION ALL SELECT b.lineage_id, 'LIFECYCLE_STATUS_MISMATCH', '', '/payload/lifecycle_status', 'LIFECYCLE_STATUS',
    CASE WHEN m.lifecycle_status = b.lifecycle_status THEN m.expected_status ELSE m.lifecycle_status END, b.lifecycle_status, m.observation_id, b.observation_id, 'HIGH', 'NO_CONFIGURED_DEADLINE'
    FROM bad b JOIN mate m USING (lineage_id) WHERE b.lineage_id NOT IN (SELECT lineage_id FROM settled)
  UNION ALL SELECT d.lineage_id, 'DUPLICATE_SOURCE_CONFLICT', d.kind || '/' || d.source_business_key || '/' || d.source_version, '/source/content_hash', 'CONTENT_HASH', a.content_hash, b.content_hash,
    a.observation_id, b.observation_id, 'HIGH', 'NO_CONFIGURED_DEADLINE' FROM dup d JOIN seen a ON a.lineage_id = d.lineage_id AND a.ordinal = d.o1 JOIN seen b ON b.lineage_id = d.lineage_id AND b.ordinal = d.o2
), all_facts AS MATERIALIZED (
  SELECT t.tenant_id, t.portfolio_id, t.trade_id, w.product_type, f.*, t.watermark, e.source_version AS expected_source_version, e.content_hash AS expected_hash,
    o.source_version AS observed_source_version, o.content_hash AS observed_hash,
    CASE f.family WHEN 'MISSING_REQUIRED_SOURCE' THEN 'MISSING_SOURCE_AFTER_WATERMARK' WHEN 'AMBIGUOUS_OR_UNMATCHED_LINKAGE' THEN 'LINKAGE_CANDIDATE_SCOPE_INVARIANT'
      WHEN 'DUPLICATE_SOURCE_CONFLICT' THEN 'DUPLICATE_SOURCE_IDENTITY_CONTENT' WHEN 'CURRENCY_PAIR_OR_SIDE_MISMATCH' THEN 'EXACT_CURRENCY_PAIR_SIDE'
      WHEN 'ECONOMIC_VALUE_MISMATCH' THEN 'DECIMAL_OUTSIDE_TOLERANCE' WHEN 'TRADE_OR_VALUE_DATE_MISMATCH' THEN 'EXACT_TRADE_VALUE_DATE' ELSE 'ALLOWED_LIFECYCLE_RELATION' END AS condition_code,
    CASE WHEN f.family = 'DUPLICATE_SOURCE_CONFLICT' THEN [f.expected_observation_id, f.observed_observation_id] ELSE t.ids END AS source_ids
  FROM facts f JOIN trade t USING (lineage_id) JOIN win w USING (lineage_id) LEFT JOIN seen e ON e.lineage_id = f.lineage_id AND e.observation_id = f.expected_observation_id
    JOIN seen o ON o.lineage_id = f.lineage_id AND o.observation_id = f.observed_observation_id
), grouped AS MATERIALIZED (
  SELECT tenant_id, portfolio_id, lineage_id, trade_id, product_type, family, group_key, condition_code, any_value(severity) AS severity, any_value(deadline_status) AS deadline_status,
    any_value(watermark) AS watermark, any_value(source_ids) AS source_ids, count(*) AS n_comparisons, list({expected_observation_id: expected_observation_id,
      expected_source_version: expected_source_version, expected_value: expected_value, field_path: field_path, observed_observation_id: observed_observation_id,
      observed_source_version: observed_source_version, observed_value: observed_value, value_type: value_type} ORDER BY field_path) AS comparisons
  FROM all_facts GROUP BY 1, 2, 3, 4, 5, 6, 7, 8
), broken AS (
  SELECT *, 'break_' || lower(family) || '_' || left(sha256('{"comparisons":' || to_json(comparisons)::varchar || ',"family":"' || family || '","run_id":"run_demo","source_ids":'
    || to_json(source_ids)::varchar || '}'), 40) AS break_id FROM grouped
)
"""


#: The fixture configuration as canonical JSON.
CONFIG_TEXT = (
    '{"config_id":"config_fixture","effective_from":"1970-01-01 00:00:00","effective_to":null,"owner_reference":null,"status":"FIXTURE_ONLY",'
    '"statuses":{"BOOKING":"BOOKED","CONFIRMATION":"CONFIRMED","EXECUTION":"NEW","TRADE_CAPTURE":"CAPTURED"},'
    '"tolerances":[["FX_FORWARD","base_amount","ABSOLUTE_DECIMAL","0.01"],["FX_FORWARD","quoted_rate","ABSOLUTE_DECIMAL","0.0001"],'
    '["FX_FORWARD","terms_amount","ABSOLUTE_DECIMAL","0.01"],["FX_SPOT","base_amount","ABSOLUTE_DECIMAL","0.01"],["FX_SPOT","quoted_rate","ABSOLUTE_DECIMAL","0.0001"],'
    '["FX_SPOT","terms_amount","ABSOLUTE_DECIMAL","0.01"]],"version":"1.0.0",'
    '"windows":[["FX_FORWARD","BOOKING",0],["FX_FORWARD","CONFIRMATION",0],["FX_FORWARD","EXECUTION",0],["FX_SPOT","BOOKING",0],["FX_SPOT","CONFIRMATION",0],["FX_SPOT","EXECUTION",0]]}'
)


def over(tail: str) -> str:
    return f"WITH {OBS} {tail}"


FACT_COLUMNS = (
    "portfolio_id, trade_id, product_type, family, group_key, field_path, value_type, expected_value, observed_value, expected_observation_id, observed_observation_id, severity, deadline_status, condition_code"
)


def of_family(name: str) -> str:
    return over(f"SELECT {FACT_COLUMNS} FROM all_facts WHERE family = '{name}'")


EXECUTION_COLUMNS = "product_type, quoted_rate, settlement_rule_version, base_currency, terms_currency, side, base_amount, terms_amount, trade_date, value_date, counterparty_id, book_id"

ORACLES: dict[str, str] = {
    "break_facts_all": over(f"SELECT {FACT_COLUMNS} FROM all_facts"),
    "missing_required_source": of_family("MISSING_REQUIRED_SOURCE"),
    "linkage_breaks": of_family("AMBIGUOUS_OR_UNMATCHED_LINKAGE"),
    "duplicate_source_conflict": of_family("DUPLICATE_SOURCE_CONFLICT"),
    "currency_side_breaks": of_family("CURRENCY_PAIR_OR_SIDE_MISMATCH"),
    "economic_breaks": of_family("ECONOMIC_VALUE_MISMATCH"),
    "date_breaks": of_family("TRADE_OR_VALUE_DATE_MISMATCH"),
    "lifecycle_breaks": of_family("LIFECYCLE_STATUS_MISMATCH"),
    "missing_source_after_window": over(
        """SELECT trade_id, field_path, severity, a.offset_s::int AS offset_s, CASE WHEN a.offset_s > 60 THEN 'OVERDUE' ELSE 'DUE' END AS deadline_status
        FROM all_facts, (VALUES (59), (60), (61)) a(offset_s) WHERE family = 'MISSING_REQUIRED_SOURCE' AND a.offset_s >= 60"""
    ),
    "canonical_state": over(
        """SELECT t.portfolio_id, t.trade_id, t.watermark::bigint AS source_watermark, w.product_type, w.quoted_rate::varchar AS quoted_rate, '1.0.0' AS settlement_rule_version, w.base_currency, w.terms_currency,
        w.side, w.base_amount::varchar AS base_amount, w.terms_amount::varchar AS terms_amount, w.trade_date::varchar AS trade_date, w.value_date::varchar AS value_date, w.counterparty_id, w.book_id, c.lifecycle_status,
        'sha256:' || sha256('{"source_version_set":' || to_json(x.items)::varchar || ',"state":' || to_json({base_amount: w.base_amount::varchar, base_currency: w.base_currency, book_id: w.book_id,
          counterparty_id: w.counterparty_id, lifecycle_status: c.lifecycle_status, product_type: w.product_type, quoted_rate: w.quoted_rate::varchar, settlement_rule_version: '1.0.0', side: w.side,
          terms_amount: w.terms_amount::varchar, terms_currency: w.terms_currency, trade_date: w.trade_date::varchar, value_date: w.value_date::varchar})::varchar || '}') AS state_hash
        FROM trade t JOIN win w USING (lineage_id) JOIN winc c USING (lineage_id) JOIN source_sets x USING (lineage_id)"""
    ),
    "field_provenance_long": over(
        """, fields(name, by_conf) AS (VALUES ('product_type', false), ('quoted_rate', false), ('settlement_rule_version', false), ('base_currency', false), ('terms_currency', false), ('side', false),
          ('base_amount', false), ('terms_amount', false), ('trade_date', false), ('value_date', false), ('counterparty_id', false), ('book_id', false), ('lifecycle_status', true))
        SELECT t.trade_id, '/payload/' || f.name AS field_path, x.observation_id, x.source_system, x.source_version,
          CASE WHEN f.by_conf AND x.source_system = 'FPML_CONFIRMATION' OR NOT f.by_conf AND x.source_system IN ('FIX_EXECUTION', 'FIX_TRADE_CAPTURE') THEN 'SELECTED' ELSE 'SECONDARY_SUPPORTING' END AS conflict_status
        FROM fields f, seen x JOIN trade t USING (lineage_id) WHERE CASE WHEN f.by_conf THEN x.conf_place ELSE x.exec_place END = 1"""
    ),
    "policy_winner": over("SELECT w.lineage_id, w.observation_id AS execution_first, c.observation_id AS confirmation_first FROM win w JOIN winc c USING (lineage_id)"),
    "engine_ordinal": over("SELECT lineage_id, observation_id, ordinal::int AS ordinal FROM seen"),
    "trade_id_mode": over("SELECT lineage_id, trade_id FROM modes"),
    "source_watermark": over("SELECT lineage_id, watermark::bigint AS watermark, n_obs AS n_observations FROM trade"),
    "source_version_set": over(
        """SELECT lineage_id, count(*) AS n_sources, string_agg(observation_id, ',' ORDER BY kind, source_system, source_business_key, source_version::bigint, observation_id, content_hash) AS sources
        FROM seen GROUP BY 1"""
    ),
    "linkage_decision": over(
        """SELECT trade_id, decision, CASE decision WHEN 'AMBIGUOUS' THEN 'MULTIPLE_ELIGIBLE_CANDIDATES' WHEN 'UNMATCHED' THEN 'NO_ELIGIBLE_CANDIDATE' ELSE 'EXACT_DETERMINISTIC_KEY' END AS reason_code,
        n_candidates::int AS n_candidates, CASE WHEN decision = 'ACCEPTED' THEN trade_id END AS chosen_trade_id FROM decisions"""
    ),
    "canonical_version_after_correction": over(
        """, wrong AS (SELECT lineage_id FROM seen WHERE kind = 'BOOKING' AND target = 'BOOKING' AND effect = 'BASE_AMOUNT')
        SELECT t.trade_id, v.n::varchar AS canonical_state_version FROM trade t, (VALUES (1), (2)) v(n) WHERE v.n = 1 OR t.lineage_id IN (SELECT lineage_id FROM wrong)"""
    ),
    "config_effective_interval": over(
        """SELECT family, count(*) AS n FROM all_facts WHERE watermark >= epoch(timestamp '1995-01-01') AND watermark < epoch(timestamp '1997-01-01') GROUP BY 1"""
    ),
    "run_envelopes": over(
        """, per AS (SELECT lineage_id, list(break_id ORDER BY family, break_id) AS found_ids, sum(n_comparisons)::int AS n FROM broken GROUP BY 1
        ), named AS (SELECT t.*, coalesce(found_ids, []::varchar[]) AS break_ids, coalesce(n, 0)::int AS n_facts, CASE WHEN n > 0 THEN 'BREAKS_DETECTED' ELSE 'PASS' END AS result,
          strftime(make_timestamp(watermark * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS at_time FROM trade t LEFT JOIN per USING (lineage_id))
        SELECT trade_id, result, len(break_ids)::int AS n_breaks, n_facts, 'sha256:' || sha256(to_json({break_ids: break_ids, config_hash: 'sha256:' || sha256('{CONFIG_TEXT}'),
          config_id: 'config_fixture', config_version: '1.0.0', evaluated_at: at_time, lineage_id: lineage_id, n_facts: n_facts, portfolio_id: portfolio_id, result: result, run_id: 'run_demo',
          run_version: 1, source_watermark: at_time, tenant_id: tenant_id, trade_id: trade_id})::varchar) AS content_hash FROM named""".replace("{CONFIG_TEXT}", CONFIG_TEXT)
    ),
    "ingest_outcomes": over("SELECT portfolio_id, outcome, count(*) AS n FROM decided GROUP BY 1, 2"),
    "ingest_quarantine": over("SELECT observation_id, content_hash, first_id AS first_observation_id, first_hash FROM decided WHERE outcome = 'DUPLICATE_SOURCE_CONFLICT'"),
    "content_hash_verify": over("SELECT kind, (k % 97 <> 5) AS hash_valid, count(*) AS n FROM obs GROUP BY 1, 2"),
    "supersession_filter": over(
        """, wrong AS (SELECT * FROM seen WHERE kind = 'BOOKING' AND target = 'BOOKING' AND effect = 'BASE_AMOUNT')
        SELECT lineage_id, observation_id, base_amount::varchar AS base_amount, source_version FROM seen WHERE observation_id NOT IN (SELECT observation_id FROM wrong)
        UNION ALL SELECT lineage_id, observation_id || '_v2', (base_amount - 1000)::decimal(18,2)::varchar, '2' FROM wrong"""
    ),
    "rerun_after_correction": over(
        """SELECT trade_id, family, count(*) AS n_facts FROM all_facts WHERE lineage_id IN (SELECT lineage_id FROM obs WHERE effect = 'BASE_AMOUNT')
        AND lineage_id NOT IN (SELECT lineage_id FROM seen WHERE kind = 'BOOKING' AND target = 'BOOKING' AND effect = 'BASE_AMOUNT') GROUP BY 1, 2"""
    ),
    "run_ledger_by_portfolio": over(
        """SELECT t.portfolio_id, 'run_demo' AS run_id, count(*) AS trades_evaluated, sum(n_obs)::bigint AS observations_ingested, count(*) FILTER (n IS NULL) AS clean_trades,
        count(*) FILTER (n IS NOT NULL) AS broken_trades, coalesce(sum(n), 0)::bigint AS break_count FROM trade t LEFT JOIN (SELECT lineage_id, count(*) AS n FROM broken GROUP BY 1) b USING (lineage_id) GROUP BY 1"""
    ),
    "summary_rollup": over(
        """SELECT count(*) AS trades_evaluated, sum(n_obs)::bigint AS observations_ingested, count(*) FILTER (n IS NULL) AS clean_trades, count(*) FILTER (n IS NOT NULL) AS broken_trades,
        coalesce(sum(n), 0)::bigint AS break_count FROM trade t LEFT JOIN (SELECT lineage_id, count(*) AS n FROM broken GROUP BY 1) b USING (lineage_id)"""
    ),
    "breaks_by_family": over("SELECT family, count(*) AS n_breaks FROM broken GROUP BY 1"),
    "trades_by_product": over("SELECT w.product_type, count(DISTINCT t.trade_id) AS n_trades FROM trade t JOIN win w USING (lineage_id) GROUP BY 1"),
    "break_records": over("SELECT break_id, portfolio_id, trade_id, family, group_key, severity, n_comparisons::int AS n_comparisons FROM broken"),
    "break_list_topn": over("SELECT break_id, family, severity, watermark::bigint AS detected_at FROM broken WHERE product_type = 'FX_SPOT' ORDER BY watermark DESC, break_id LIMIT 500"),
    "priority_queue": over(
        """SELECT break_id, severity, deadline_status FROM broken ORDER BY CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END,
        CASE deadline_status WHEN 'OVERDUE' THEN 1 WHEN 'DUE' THEN 2 ELSE 3 END, break_id LIMIT 200"""
    ),
    "latest_canonical_version": over(
        """SELECT portfolio_id, t.trade_id, CASE WHEN substr(t.trade_id, 16)::int % 3 = 0 THEN '10' ELSE '9' END AS canonical_state_version FROM trade t"""
    ),
    "trade_break_counts": over("SELECT t.trade_id, count(b.break_id) AS n_breaks, coalesce(string_agg(b.family, ',' ORDER BY b.family, b.break_id), '') AS families FROM trade t LEFT JOIN broken b USING (lineage_id) GROUP BY 1"),
    "evidence_records": over(
        """, roles(family, role, place) AS (VALUES ('MISSING_REQUIRED_SOURCE', 'INGESTION_WATERMARK', 0), ('MISSING_REQUIRED_SOURCE', 'EXPECTED_SOURCE', 1),
          ('AMBIGUOUS_OR_UNMATCHED_LINKAGE', 'CANDIDATE_LINK', 0), ('AMBIGUOUS_OR_UNMATCHED_LINKAGE', 'LINKAGE_DECISION', 1), ('DUPLICATE_SOURCE_CONFLICT', 'SOURCE_PAYLOAD_PAIR', 0),
          ('DUPLICATE_SOURCE_CONFLICT', 'SOURCE_METADATA', 1), ('CURRENCY_PAIR_OR_SIDE_MISMATCH', 'FIELD_COMPARISON', 0), ('CURRENCY_PAIR_OR_SIDE_MISMATCH', 'NORMALISATION_RULE', 1),
          ('ECONOMIC_VALUE_MISMATCH', 'DECIMAL_COMPARISON', 0), ('ECONOMIC_VALUE_MISMATCH', 'NORMALISATION_RULE', 1), ('TRADE_OR_VALUE_DATE_MISMATCH', 'DATE_COMPARISON', 0),
          ('TRADE_OR_VALUE_DATE_MISMATCH', 'NORMALISATION_RULE', 1), ('LIFECYCLE_STATUS_MISMATCH', 'LIFECYCLE_RELATION', 0), ('LIFECYCLE_STATUS_MISMATCH', 'NORMALISATION_RULE', 1)
        ), sourced AS (SELECT f.*, r.role, r.place, r.place = 0 AND expected_observation_id IS NOT NULL AS by_expected FROM all_facts f JOIN roles r USING (family)
        ), named AS (SELECT *, CASE WHEN by_expected THEN expected_observation_id ELSE observed_observation_id END AS src FROM sourced
        ), hashed AS (SELECT *, sha256(to_json({captured_at: strftime(make_timestamp(watermark * 1000000), '%Y-%m-%dT%H:%M:%S+00:00'), config_hash: 'sha256:' || sha256('{CONFIG_TEXT}'),
          field_path: field_path, role: role, run_id: 'run_demo', salt: concat_ws(':', group_key, place, expected_value, observed_value),
          source_content_hash: CASE WHEN by_expected THEN expected_hash ELSE observed_hash END, source_observation_id: src,
          source_version: CASE WHEN by_expected THEN expected_source_version ELSE observed_source_version END})::varchar) AS digest FROM named)
        SELECT trade_id, family, field_path, role, src AS source_observation_id, 'evidence_' || lower(role) || '_' || left(digest, 24) AS evidence_id, 'sha256:' || digest AS content_hash FROM hashed""".replace("{CONFIG_TEXT}", CONFIG_TEXT)
    ),
    "post_action_breaks": over(
        """, pairs AS (SELECT m.trade_id, s.observation_id, s.book_id, s.lifecycle_status, s.effect, s.k FROM seen s JOIN modes m USING (lineage_id) WHERE s.kind = 'BOOKING' AND s.src_ord = 0)
        SELECT trade_id, '/payload/book_id' AS field_path, 'IDENTIFIER' AS value_type, replace(book_id, '_moved', '') AS expected_value, book_id AS observed_value FROM pairs WHERE effect = 'BOOK_ID' AND k % 11 <> 0
        UNION ALL SELECT trade_id, '/payload/lifecycle_status', 'LIFECYCLE_STATUS', 'BOOKED', lifecycle_status FROM pairs WHERE lifecycle_status <> 'BOOKED' AND k % 11 <> 0
        UNION ALL SELECT trade_id, '/payload/book_id', 'IDENTIFIER', replace(book_id, '_moved', ''), 'readback_unavailable' FROM pairs WHERE k % 11 = 0 OR (k % 13 = 0 AND k % 11 <> 0 AND effect <> 'BOOK_ID' AND lifecycle_status = 'BOOKED')"""
    ),
    "coverage_matrix": over(
        """, t AS (SELECT CASE WHEN spot THEN 'FX_SPOT' ELSE 'FX_FORWARD' END AS product_type, CASE WHEN fam IS NULL THEN 'CLEAN' ELSE 'BROKEN' END AS population,
          ['MISSING', 'LINKAGE', 'DUPLICATE', 'CURRENCY', 'ECONOMIC', 'DATE', 'LIFECYCLE', 'POST_ACTION'][fam + 1] AS family, portfolio_id FROM tr)
        SELECT product_type, population, family, portfolio_id, count(*) AS n, grouping(product_type, population, family, portfolio_id)::bigint AS set_id FROM t
        GROUP BY GROUPING SETS ((product_type, population), (product_type, family), (product_type, portfolio_id), (product_type), ())"""
    ),
    "contract_violations": over(
        """, dirty AS (SELECT *, (k % 12)::int AS d FROM obs), reasons AS (
          SELECT kind, d, CASE d WHEN 1 THEN 'UNSUPPORTED_SCHEMA_VERSION' WHEN 2 THEN 'DECIMAL_SCALE' WHEN 3 THEN 'CURRENCY_PAIR' WHEN 4 THEN 'SETTLEMENT_WINDOW' WHEN 5 THEN 'EVENT_AFTER_INGEST'
            WHEN 6 THEN 'PAYLOAD_TIME_AFTER_INGEST' WHEN 7 THEN 'ENTITY_VERSION' WHEN 8 THEN 'SUPERSESSION_PAIR' WHEN 9 THEN 'KIND_SYSTEM' WHEN 10 THEN 'SOURCE_VERSION_FORMAT' END AS reason FROM dirty)
        SELECT kind, reason, count(*) AS n FROM reasons WHERE reason IS NOT NULL GROUP BY 1, 2"""
    ),
    "policy_ladder": over(
        """, c AS (SELECT f.trade_id, f.expected_value, o.k, split_part(observed_observation_id, '_', 2) AS okind, split_part(expected_observation_id, '_', 2) AS ekind FROM all_facts f
          JOIN (SELECT DISTINCT lineage_id, k FROM obs) o USING (lineage_id) WHERE family = 'ECONOMIC_VALUE_MISMATCH' AND field_path = '/payload/base_amount'),
        r AS (SELECT *, ekind = 'execution' AND okind = 'booking' AS fit FROM c)
        SELECT trade_id, CASE WHEN NOT fit OR k % 5 = 1 THEN 'MANUAL_INVESTIGATION' WHEN k % 5 IN (2, 3) THEN 'REJECTED' ELSE 'ELIGIBLE_FOR_APPROVAL' END AS policy_outcome,
          CASE WHEN NOT fit OR k % 5 = 1 THEN 'confidence_below_threshold' WHEN k % 5 = 2 THEN 'missing_citation' WHEN k % 5 = 3 THEN 'proposed_value_does_not_match_authoritative_source'
            ELSE 'economic_field_correction_eligible' END AS policy_reason FROM r"""
    ),
    "keyword_search_topk": """
        WITH q AS (SELECT ['the', 'of', 'with', 'license', 'version', 'that', 'onea'] AS w), scored AS (
          SELECT doc_id, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), w)) AS overlap FROM documents, q)
        SELECT doc_id, overlap::int AS overlap FROM scored WHERE overlap > 0 ORDER BY overlap DESC, doc_id LIMIT 20""",
    "provenance_graph_edges": over(
        """, edges AS (SELECT observation_id AS source, lineage_id AS target, 'OBSERVATION_OF' AS edge FROM seen
          UNION ALL SELECT observation_id, 'state_' || lineage_id, 'SELECTED_FOR' FROM win UNION ALL SELECT lineage_id, 'state_' || lineage_id, 'ASSEMBLED_INTO' FROM trade)
        SELECT edge, count(*) AS n, count(DISTINCT source) AS n_sources, count(DISTINCT target) AS n_targets FROM edges GROUP BY 1"""
    ),
    "reachability": """
        WITH RECURSIVE edges AS (SELECT DISTINCT p_partkey AS source, p_partkey // 2 AS target FROM part WHERE p_partkey > 0), walk(start, node) AS (
          SELECT p_partkey, p_partkey FROM part UNION SELECT w.start, e.target FROM walk w JOIN edges e ON w.node = e.source)
        SELECT start, node FROM walk""",
    "orders_lineitem_missing": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "lineitem_duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "order_amount_tolerance": """
        WITH l AS (SELECT l_orderkey, sum(round(l_extendedprice::decimal(18,2) * (1 - l_discount::decimal(4,2)), 2)::decimal(18,2)) AS total FROM lineitem GROUP BY 1)
        SELECT o_orderkey, o_totalprice::decimal(18,2)::varchar AS order_amount, total::decimal(38,2)::varchar AS line_amount FROM orders JOIN l ON o_orderkey = l_orderkey WHERE abs(o_totalprice::decimal(18,2) - total) > 1000""",
    "events_ingest_outcomes": """
        WITH d AS (SELECT user_id, event_type, event_id, md5(coalesce(props, '')) AS h, date_trunc('hour', ts) AS slot FROM events),
        o AS (SELECT *, row_number() OVER w AS nth, first_value(h) OVER w AS first_h FROM d WINDOW w AS (PARTITION BY user_id, event_type, slot ORDER BY event_id))
        SELECT event_type, CASE WHEN nth = 1 THEN 'INSERTED' WHEN h = first_h THEN 'IDEMPOTENT_REPLAY' ELSE 'DUPLICATE_SOURCE_CONFLICT' END AS outcome, count(*) AS n FROM o GROUP BY 1, 2""",
    "legacy_readback": over(
        """SELECT trade_id, substr(m.trade_id, 7)::bigint % 3 + 1 AS record_version, 'value_' || (substr(m.trade_id, 7)::bigint % 3 + 1) AS value FROM modes m"""
    ),
}
