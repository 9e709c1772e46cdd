"""All queries of the reconciliation engine, by name: thin plans over the operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import validation as V
from ..functions.documents import observation_content
from ..operators import ingest, remediation, reporting
from ..operators import reconcile as R
from ..sources import corpus
from . import content_queries, contract_oracles, contract_queries, document_queries, evaluation_queries
from .oracles import ORACLES as _ORACLES

RUN, CONFIG = "run_demo", corpus.CONFIG
FACT_COLUMNS = (
    "portfolio_id", "trade_id", "product_type", "family", "group_key", "field_path", "value_type", "expected_value", "observed_value", "expected_observation_id", "observed_observation_id", "severity",
    "deadline_status", "condition_code",
)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def epoch(c: Column) -> Column:
    return F.unix_timestamp(c)


def outcomes(spark: SparkSession, d: str, only: DataFrame | None = None) -> DataFrame:
    return ingest.classified(corpus.load(spark, d, only), None, corpus.IDENTITY)


def observed(spark: SparkSession, d: str, only: DataFrame | None = None) -> DataFrame:
    """What a run reads: authoritative and conflicting rows. Told apart by outcome in one pass, which is the union of both tables. ``only`` names trades (portfolio_id, lineage_id) outside of which nothing is
    made: an identity lies in one lineage, so what is left is the same."""
    rows = outcomes(spark, d, only).where("outcome <> 'IDEMPOTENT_REPLAY'")
    return rows.withColumn("src_ord", (F.col("outcome") != "INSERTED").cast("int")).drop("outcome", "first_observation_id", "first_hash")


def trades(spark: SparkSession, d: str) -> DataFrame:
    return R.trade_rows(observed(spark, d), CONFIG)


def all_facts(spark: SparkSession, d: str) -> DataFrame:
    return R.reconcile(observed(spark, d), CONFIG)


def break_rows(spark: SparkSession, d: str) -> DataFrame:
    return R.breaks(all_facts(spark, d), RUN)


def of_family(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: R.reconcile(observed(spark, d), CONFIG, families=(name,)).select(*FACT_COLUMNS)


def missing_source_after_window(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 60 s, evaluated 59, 60 and 61 s after the watermark."""
    config = replace(CONFIG, windows=dict.fromkeys(CONFIG.windows, 60))
    rows = R.trade_rows(observed(spark, d), config)
    rows = rows.withColumn("offset_s", F.explode(F.array(F.lit(59), F.lit(60), F.lit(61))))
    at = F.col("watermark") + F.make_dt_interval(secs=F.col("offset_s"))
    found = R.facts(rows.withColumn("lineage_id", F.concat_ws("@", "lineage_id", "offset_s")), config, at, families=("MISSING_REQUIRED_SOURCE",))
    return found.select("trade_id", "field_path", "severity", F.substring_index("lineage_id", "@", -1).cast("int").alias("offset_s"), "deadline_status")


def canonical_state(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string").alias(c)
    return R.canonical_states(trades(spark, d)).select(
        "portfolio_id", "trade_id", epoch(F.col("source_watermark")).alias("source_watermark"), "product_type", text("quoted_rate"), "settlement_rule_version", "base_currency", "terms_currency", "side",
        text("base_amount"), text("terms_amount"), text("trade_date"), text("value_date"), "counterparty_id", "book_id", "lifecycle_status", "state_hash",
    )


def source_version_set(spark: SparkSession, d: str) -> DataFrame:
    sets = trades(spark, d).select("lineage_id", R.source_set().alias("sources"))
    return sets.select("lineage_id", F.size("sources").cast("long").alias("n_sources"), F.array_join(F.transform("sources", lambda x: x["observation_id"]), ",").alias("sources"))


def linkage_decision(spark: SparkSession, d: str) -> DataFrame:
    return trades(spark, d).select("trade_id", "decision", "reason_code", F.size("candidates").alias("n_candidates"), "chosen_trade_id")


def content_hash_verify(spark: SparkSession, d: str) -> DataFrame:
    """A few deliveries are forged; verification finds exactly those."""
    rows = corpus.load(spark, d)
    forged = F.substring_index("lineage_id", "_", -1).cast("long") % 97 == 5
    rows = rows.withColumn("content_hash", F.when(forged, F.concat(F.lit("sha256:"), F.sha2(F.lit("forged"), 256))).otherwise(F.col("content_hash")))
    return ingest.verified(rows, observation_content()).groupBy("kind", "hash_valid").agg(F.count(F.lit(1)).alias("n"))


def corrected_bookings(spark: SparkSession, d: str) -> DataFrame:
    """Corrected re-deliveries of the bookings whose amount was 1,000 too high."""
    wrong = corpus.truth(corpus.dealt_orders(spark, d)).where("effect = 'BASE_AMOUNT' and target = 'BOOKING'")
    affected = observed(spark, d, wrong.select("portfolio_id", "lineage_id"))
    return ingest.corrections(affected, "base_amount", F.col("base_amount") - 1000, F.col("ingest_time"))


def with_corrections(spark: SparkSession, d: str) -> DataFrame:
    """All observations, and the corrections."""
    return observed(spark, d).unionByName(corrected_bookings(spark, d))


def corrected_trades(spark: SparkSession, d: str) -> DataFrame:
    """The trades as they are gathered before and after the corrections."""
    return R.corrected(R.gathered(observed(spark, d)), corrected_bookings(spark, d))


def trades_after_correction(spark: SparkSession, d: str) -> DataFrame:
    """The trades as a run after the corrections sees them."""
    rows = corrected_trades(spark, d).select(*R.TRADE, F.coalesce("obs_after", "obs").alias("obs"))
    return R.evaluated(rows, CONFIG)


def supersession_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = R.without_superseded(with_corrections(spark, d))
    return rows.select("lineage_id", "observation_id", F.col("base_amount").cast("string").alias("base_amount"), "source_version")


def rerun_after_correction(spark: SparkSession, d: str) -> DataFrame:
    """The trades with a wrong base amount anywhere, evaluated again."""
    again = corpus.truth(table(spark, d, "orders")).where("effect = 'BASE_AMOUNT'").select("lineage_id")
    facts = R.reconcile(R.without_superseded(with_corrections(spark, d)).join(again, "lineage_id", "left_semi"), CONFIG)
    return facts.groupBy("trade_id", "family").agg(F.count(F.lit(1)).alias("n_facts"))


def canonical_version_after_correction(spark: SparkSession, d: str) -> DataFrame:
    """States of a first run, and of a run after the corrections: what has changed is the next version of its trade."""
    first = R.canonical_states(trades(spark, d))
    later = R.canonical_states(R.trade_rows(R.without_superseded(with_corrections(spark, d)), CONFIG))
    return first.unionByName(R.versioned(later, first)).select("trade_id", "canonical_state_version")


def config_effective_interval(spark: SparkSession, d: str) -> DataFrame:
    """A configuration of two years evaluates the trades of these years only."""
    config = replace(CONFIG, effective_from="1995-01-01 00:00:00", effective_to="1997-01-01 00:00:00")
    return R.reconcile(observed(spark, d), config, outside="skip").groupBy("family").agg(F.count(F.lit(1)).alias("n"))


def run_envelopes(spark: SparkSession, d: str) -> DataFrame:
    return R.run_envelopes(trades(spark, d), RUN, CONFIG).select("trade_id", "result", F.size("break_ids").alias("n_breaks"), "n_facts", "content_hash")


def run_ledger(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d).drop("tenant_id", "status", "completed_at")


def summary_rollup(spark: SparkSession, d: str) -> DataFrame:
    return reporting.totals(_ledger(spark, d)).drop("run_id", "completed_at")


def latest_canonical_version(spark: SparkSession, d: str) -> DataFrame:
    """Versions compare as numbers: 10 is after 9."""
    states = R.canonical_states(trades(spark, d))
    more = states.withColumn("canonical_state_version", F.explode(F.array(F.lit("9"), F.lit("10"), F.lit("1"))))
    more = more.where("canonical_state_version <> '10' or cast(substring(trade_id, 16) as int) % 3 = 0")
    return reporting.latest(more, ["tenant_id", "portfolio_id", "trade_id"], "canonical_state_version").select("portfolio_id", "trade_id", "canonical_state_version")


def trade_break_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = trades(spark, d)
    per = R.breaks(R.facts(rows, CONFIG), RUN).groupBy("lineage_id").agg(F.count(F.lit(1)).alias("n_breaks"), F.sort_array(F.collect_list(F.struct("family", "break_id"))).alias("b"))
    families = F.coalesce(F.array_join(F.transform("b", lambda x: x["family"]), ","), F.lit(""))
    return rows.join(per, "lineage_id", "left").select("trade_id", F.coalesce("n_breaks", F.lit(0)).alias("n_breaks"), families.alias("families"))


def post_action_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Each booking read back after an action: as it should be before, as the corpus has it after; some reads fail, some breaks remain."""
    rows = R.numbered(trades(spark, d)).where("kind = 'BOOKING' and src_ord = 0")
    k = F.substring_index("lineage_id", "_", -1).cast("long")
    fields = lambda book, status: F.struct(book.alias("book_id"), status.alias("lifecycle_status"), F.lit("1").alias("booking_version"), F.lit("same").alias("record_fingerprint"), "observation_id")
    pre = fields(F.regexp_replace("book_id", "_moved$", ""), F.lit("BOOKED"))
    pairs = rows.select(
        *R.TRADE, "trade_id", pre.alias("pre"), F.when(k % 11 != 0, fields(F.col("book_id"), F.col("lifecycle_status"))).alias("post"),
        F.array().cast("array<struct<field_path:string,expected_value:string,observed_value:string>>").alias("changed"), (k % 11 != 0).alias("readback_available"), (k % 13 == 0).alias("original_break_remaining"),
    )
    return R.post_action_facts(pairs).select("trade_id", "field_path", "value_type", "expected_value", "observed_value")


def contract_rows(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries in contract columns, every twelfth kind of order key spoilt in its own way."""
    rows = corpus.load(spark, d)
    k = F.substring_index("lineage_id", "_", -1).cast("long") % 12
    c = F.col
    status = F.when(c("kind") == "EXECUTION", F.when(c("lifecycle_status") == "NEW", "EXECUTED").otherwise(c("lifecycle_status"))).when(
        c("kind") == "CONFIRMATION", F.when(c("lifecycle_status") == "CONFIRMED", "AFFIRMED").otherwise(c("lifecycle_status"))
    ).otherwise(c("lifecycle_status"))
    kind_type = F.when(c("lifecycle_status") == "AMENDED", "AMEND").when(c("lifecycle_status") == "CANCELLED", "CANCEL").otherwise("NEW")
    later = c("ingest_time") + F.expr("INTERVAL 1 SECOND")
    return rows.select(
        F.when(k == 1, "2.0.0").otherwise("1.0.0").alias("schema_version"), "observation_id", "tenant_id", "portfolio_id", "kind", F.when(k == 9, "OTHER").otherwise(c("source_system")).alias("source_system"),
        F.when(k == 10, "0").otherwise(c("source_version")).alias("source_version"), "content_hash", "product_type", "base_currency", "terms_currency", "side",
        F.when(k == 3, "XXX").otherwise(c("base_currency")).alias("base_amount_currency"), c("terms_currency").alias("terms_amount_currency"), c("base_amount").cast("string").alias("base_amount_value"),
        F.when(k == 2, 3).otherwise(2).alias("base_amount_scale"), c("terms_amount").cast("string").alias("terms_amount_value"), F.lit(2).alias("terms_amount_scale"),
        c("quoted_rate").cast("string").alias("rate_value"), F.lit(4).alias("rate_scale"), "trade_date", F.when(k == 4, F.date_sub("trade_date", 1)).otherwise(c("value_date")).alias("value_date"),
        F.when(k == 5, later).otherwise(c("event_time")).alias("event_time"), "ingest_time", F.when(k == 6, later).otherwise(c("event_time")).alias("kind_time"),
        F.when(k == 7, 2).otherwise(1).alias("entity_version"), F.when(k == 8, "obs_old").alias("supersedes_observation_id"), F.lit(None).cast("string").alias("supersession_reason"),
        kind_type.alias("kind_type"), status.alias("kind_status"), "lifecycle_status",
    )


def contract_violations(spark: SparkSession, d: str) -> DataFrame:
    return V.reason_counts(contract_rows(spark, d), V.observation_rules(), "kind")


def policy_ladder(spark: SparkSession, d: str) -> DataFrame:
    """The provider's recommendations, some of them spoilt, through the policy."""
    rows = observed(spark, d)
    cases = remediation.recommend(remediation.triage(R.reconcile(rows, CONFIG), rows))
    k = F.substring_index("lineage_id", "_", -1).cast("long") % 5
    cases = cases.withColumns(
        {
            "confidence": F.when(k == 1, 0.5).otherwise(F.col("confidence")),
            "citations": F.when(k == 2, F.array().cast("array<string>")).otherwise(F.col("citations")),
            "proposed_fields": F.when((k == 3) & F.col("recommended_action").isNotNull(), F.create_map("field_path", F.lit("0.00"))).otherwise(F.col("proposed_fields")),
        }
    )
    return remediation.policy(cases).select("trade_id", "policy_outcome", "policy_reason")


def keyword_search_topk(spark: SparkSession, d: str) -> DataFrame:
    found = remediation.keyword_search(table(spark, d, "documents"), "The license, of version: with that ONEA", 20, F.col("text"), ["doc_id"])
    return found.select("doc_id", "overlap")


def provenance_graph(spark: SparkSession, d: str) -> DataFrame:
    """A trade has all its edges, so the trades are made once."""
    state = F.concat(F.lit("state_"), "lineage_id")
    edge = lambda source, target, name: F.struct(source.alias("source"), target.alias("target"), F.lit(name).alias("edge"))
    observations = F.transform("obs", lambda x: edge(x["observation_id"], F.col("lineage_id"), "OBSERVATION_OF"))
    rest = F.array(edge(F.col("by_execution.observation_id"), state, "SELECTED_FOR"), edge(F.col("lineage_id"), state, "ASSEMBLED_INTO"))
    edges = trades(spark, d).select(F.concat(observations, rest).alias("e")).select(F.explode_outer("e").alias("e")).select("e.*")
    return edges.groupBy("edge").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("n_sources"), F.countDistinct("target").alias("n_targets"))


def reachability(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    edges = part.where("p_partkey > 0").select(F.col("p_partkey").alias("source"), F.floor(F.col("p_partkey") / 2).alias("target")).distinct()
    return remediation.reachable(edges, part.select(F.col("p_partkey").alias("node")))


def orders_lineitem_missing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


def lineitem_duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("n_parts")).where("n > 1")


def order_amount_tolerance(spark: SparkSession, d: str) -> DataFrame:
    net = F.round(F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)")), 2).cast("decimal(18,2)")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(net).alias("total"))
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    joined = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).where(F.abs(amount - F.col("total")) > 1000)
    return joined.select("o_orderkey", amount.cast("string").alias("order_amount"), F.col("total").cast("decimal(38,2)").cast("string").alias("line_amount"))


def event_deliveries(events: DataFrame) -> DataFrame:
    """Events as deliveries: user, type and hour identify, the properties are the content."""
    return events.select(
        "user_id", "event_type", F.date_trunc("hour", "ts").alias("slot"), F.col("event_id").cast("string").alias("observation_id"), F.col("event_id").alias("arrival"),
        F.md5(F.coalesce("props", F.lit("")).cast("binary")).alias("content_hash"),
    )


EVENT_IDENTITY = ("user_id", "event_type", "slot")


def events_ingest_outcomes(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.classified(event_deliveries(table(spark, d, "events")), None, EVENT_IDENTITY)
    return rows.groupBy("event_type", "outcome").agg(F.count(F.lit(1)).alias("n"))


def legacy_readback(spark: SparkSession, d: str) -> DataFrame:
    """Records are versions in an append-only table; a read returns the last."""
    ids = trades(spark, d).select("tenant_id", "portfolio_id", "trade_id")
    last = F.substring("trade_id", 7, 10).cast("long") % 3 + 1
    versions = ids.withColumn("record_version", F.explode(F.sequence(F.lit(1).cast("long"), last))).withColumn("value", F.concat(F.lit("value_"), F.col("record_version").cast("string")))
    return reporting.latest(versions, ["tenant_id", "portfolio_id", "trade_id"], "record_version").select("trade_id", "record_version", "value")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "break_facts_all": lambda s, d: all_facts(s, d).select(*FACT_COLUMNS),
    "missing_required_source": of_family("MISSING_REQUIRED_SOURCE"),
    "linkage_breaks": of_family("AMBIGUOUS_OR_UNMATCHED_LINKAGE"),
    "duplicate_source_conflict": of_family("DUPLICATE_SOURCE_CONFLICT"),
    "currency_side_breaks": of_family("CURRENCY_PAIR_OR_SIDE_MISMATCH"),
    "economic_breaks": of_family("ECONOMIC_VALUE_MISMATCH"),
    "date_breaks": of_family("TRADE_OR_VALUE_DATE_MISMATCH"),
    "lifecycle_breaks": of_family("LIFECYCLE_STATUS_MISMATCH"),
    "missing_source_after_window": missing_source_after_window,
    "canonical_state": canonical_state,
    "field_provenance_long": lambda s, d: R.provenance(trades(s, d)).drop(*R.TRADE, "kind", "ingest_time"),
    "policy_winner": lambda s, d: trades(s, d).select("lineage_id", F.col("by_execution.observation_id").alias("execution_first"), F.col("by_confirmation.observation_id").alias("confirmation_first")),
    "engine_ordinal": lambda s, d: R.numbered(trades(s, d)).select("lineage_id", "observation_id", "ordinal"),
    "trade_id_mode": lambda s, d: trades(s, d).select("lineage_id", "trade_id"),
    "source_watermark": lambda s, d: trades(s, d).select("lineage_id", epoch(F.col("watermark")).alias("watermark"), "n_observations"),
    "source_version_set": source_version_set,
    "linkage_decision": linkage_decision,
    "ingest_outcomes": lambda s, d: outcomes(s, d).groupBy("portfolio_id", "outcome").agg(F.count(F.lit(1)).alias("n")),
    "ingest_quarantine": lambda s, d: ingest.split(outcomes(s, d))[1].select("observation_id", "content_hash", "first_observation_id", "first_hash"),
    "content_hash_verify": content_hash_verify,
    "supersession_filter": supersession_filter,
    "rerun_after_correction": rerun_after_correction,
    "canonical_version_after_correction": canonical_version_after_correction,
    "config_effective_interval": config_effective_interval,
    "run_envelopes": run_envelopes,
    "run_ledger_by_portfolio": run_ledger,
    "summary_rollup": summary_rollup,
    "breaks_by_family": lambda s, d: reporting.by_family(break_rows(s, d), RUN),
    "trades_by_product": lambda s, d: reporting.trades_by_product(R.canonical_states(trades(s, d))),
    "break_records": lambda s, d: break_rows(s, d).select("break_id", "portfolio_id", "trade_id", "family", "group_key", "severity", F.size("comparisons").alias("n_comparisons")),
    "break_list_topn": lambda s, d: reporting.break_list(break_rows(s, d), 500, product_type="FX_SPOT", family=None).select("break_id", "family", "severity", epoch(F.col("detected_at")).alias("detected_at")),
    "priority_queue": lambda s, d: reporting.priority_queue(break_rows(s, d), 200).select("break_id", "severity", "deadline_status"),
    "latest_canonical_version": latest_canonical_version,
    "trade_break_counts": trade_break_counts,
    "evidence_records": lambda s, d: R.evidence(all_facts(s, d), RUN, CONFIG).drop(*R.TRADE, "group_key"),
    "post_action_breaks": post_action_breaks,
    "coverage_matrix": lambda s, d: reporting.coverage(corpus.truth(table(s, d, "orders"))),
    "contract_violations": contract_violations,
    "policy_ladder": policy_ladder,
    "keyword_search_topk": keyword_search_topk,
    "provenance_graph_edges": provenance_graph,
    "reachability": reachability,
    "orders_lineitem_missing": orders_lineitem_missing,
    "lineitem_duplicate_keys": lineitem_duplicate_keys,
    "order_amount_tolerance": order_amount_tolerance,
    "events_ingest_outcomes": events_ingest_outcomes,
    "legacy_readback": legacy_readback,
}


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    found = R.breaks(R.facts(trades(spark, d), CONFIG, clean=True, more=("n_observations",)), RUN, ("n_observations",))
    return reporting.ledger_of_breaks(found, RUN)


QUERIES |= contract_queries.named(trades, break_rows, all_facts, _ledger, table, RUN) | document_queries.QUERIES
QUERIES |= content_queries.named(observed, outcomes, all_facts, trades, corrected_bookings, table, RUN)
QUERIES |= evaluation_queries.named(observed, corrected_bookings, all_facts, trades, corrected_trades, table, RUN)
ORACLES: dict[str, str] = {name: sql for name, sql in (_ORACLES | contract_oracles.ORACLES | document_queries.ORACLES | evaluation_queries.ORACLES | content_queries.ORACLES).items() if name in QUERIES}
