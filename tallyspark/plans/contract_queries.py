"""Queries of the engine's contract rules and reports: good rows, most of them spoilt in one way, through the rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contract
from ..functions import validation as V
from ..functions.columns import position
from ..functions.reference_data import EVIDENCE_ROLES, FAMILIES
from ..operators import reconcile as R
from ..operators import reporting
from ..operators.lineage import checkpointed
from ..sources import corpus, files


def key_of(lineage: str = "lineage_id") -> Column:
    """The order key of a trade."""
    return F.substring_index(lineage, "_", -1).cast("long")


def spoilt(k: Column, n: int, bad: Column, good: Column | str) -> Column:
    return F.when(k == n, bad).otherwise(F.col(good) if isinstance(good, str) else good)


def by_reason(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows by all their reasons; the clean ones have none."""
    return rows.groupBy(V.reason_text(rules).alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


def provenance_violations(trades: DataFrame) -> DataFrame:
    k = key_of() % 9
    rows = R.provenance(trades.withColumn("source_version_set", R.source_set()), "watermark", "source_version_set")
    rows = rows.select(
        "tenant_id", "portfolio_id", "watermark", F.substring_index("field_path", "/", -1).alias("field_name"), spoilt(k, 1, F.lit("/payload/x"), "field_path").alias("field_path"), "kind",
        spoilt(k, 2, F.lit("OTHER"), "source_system").alias("source_system"), F.col("tenant_id").alias("source_tenant_id"),
        spoilt(k, 3, F.lit("portfolio_other"), "portfolio_id").alias("source_portfolio_id"),
        spoilt(k, 4, F.concat("source_version_set", "source_version_set"), "source_version_set").alias("source_version_set"),
        spoilt(k, 5, F.lit("obs_none"), "observation_id").alias("observation_id"), spoilt(k, 6, F.lit("99"), "source_version").alias("source_version"),
        spoilt(k, 7, F.col("ingest_time") + F.expr("INTERVAL 1 DAY"), "ingest_time").alias("ingest_time"),
    )
    return by_reason(rows, contract.provenance_rules())


def context_violations(trades: DataFrame) -> DataFrame:
    k, c = key_of() % 10, F.col
    locked = R.source_set()
    rows = trades.withColumn("locked", locked).select(
        spoilt(k, 5, F.lit("trade_other"), "trade_id").alias("trade_id"), spoilt(k, 5, F.lit("ACCEPTED"), "decision").alias("decision"),
        spoilt(k, 2, F.concat("obs", F.slice("obs", 1, 1)), "obs").alias("obs"), spoilt(k, 4, c("watermark") - F.expr("INTERVAL 1 DAY"), "watermark").alias("watermark"),
        spoilt(k, 1, c("watermark") - F.expr("INTERVAL 1 SECOND"), "watermark").alias("evaluated_at"), spoilt(k, 6, F.lit("FX_SWAP"), c("by_execution.product_type")).alias("product_type"),
        spoilt(k, 7, F.lit("2.0.0"), c("by_execution.settlement_rule_version")).alias("settlement_rule_version"),
        spoilt(k, 3, F.slice("locked", 2, 100), "locked").alias("source_version_set"), spoilt(k, 8, F.lit("obs_none"), c("first_observation.observation_id")).alias("linkage_observation_id"),
    )
    return by_reason(rows, contract.context_rules())


def selection_violations(trades: DataFrame) -> DataFrame:
    k, w = key_of() % 5, R.reference(F.col("by_execution"))
    other = w.withField("content_hash", F.lit("sha256:0"))
    hashes = F.array(F.col("by_execution.content_hash"))
    rows = trades.select(
        spoilt(k, 1, F.lit(None), F.when(k == 2, other).otherwise(w)).alias("selected"), w.alias("required"), spoilt(k, 3, F.concat(hashes, F.array(F.lit("sha256:1"))), hashes).alias("known_hashes")
    )
    return by_reason(rows, contract.selection_rules())


def run_violations(trades: DataFrame, run_id: str) -> DataFrame:
    k, c = key_of() % 7, F.col
    rows = R.run_envelopes(trades, run_id, corpus.CONFIG).withColumn("facts_of_breaks", spoilt(k, 4, c("n_facts") + 1, "n_facts")).withColumns(
        {
            "evaluated_at": spoilt(k, 1, c("evaluated_at") - F.expr("INTERVAL 1 SECOND"), "evaluated_at"), "break_ids": spoilt(k, 2, F.concat("break_ids", "break_ids"), "break_ids"),
            "result": spoilt(k, 3, F.when(c("result") == "PASS", "BREAKS_DETECTED").otherwise("PASS"), "result"), "content_hash": spoilt(k, 5, F.lit("sha256:0"), "content_hash"),
        }
    )
    return by_reason(rows, contract.run_rules(R.envelope_hash()))


def break_violations(breaks: DataFrame) -> DataFrame:
    k, c = key_of() % 14, F.col
    trade_date = F.lit("2026-03-02").cast("date")
    rows = breaks.withColumns(
        {
            "trade_date": trade_date, "value_date": spoilt(k, 2, F.date_sub(trade_date, 1), F.date_add(trade_date, F.when(c("product_type") == "FX_SPOT", 2).otherwise(90))),
            "roles": spoilt(k, 6, F.array().cast("array<string>"), R.lookup_array(c("family"), EVIDENCE_ROLES)), "watermark": c("detected_at"),
            "expected_by": spoilt(k, 8, c("detected_at") - F.expr("INTERVAL 1 SECOND"), "detected_at"), "available_kinds": spoilt(k, 7, F.array("group_key"), F.array().cast("array<string>")),
            "previous_state": F.lit(None).cast("string"), "transition_reason": F.lit("DETECTED"), "state": spoilt(k, 10, F.lit("RESOLVED"), "state"),
            "supersedes_break_id": F.when(k == 11, "break_0").when(k == 13, c("break_id")), "break_version": F.when(k.isin(12, 13), 2).otherwise(1),
            "resolution_type": F.when(k == 0, "OWNER_APPROVED_NON_ACTION"), "condition_code": spoilt(k, 1, F.lit("X"), "condition_code"),
            "comparisons": F.when(k == 3, F.concat("comparisons", "comparisons")).when(k == 4, F.transform("comparisons", lambda x: x.withField("value_type", F.lit("OTHER")))).otherwise(c("comparisons")),
            "source_ids": spoilt(k, 5, F.concat("source_ids", "source_ids"), "source_ids"), "priority_key": spoilt(k, 9, c("priority_key").withField("age", F.lit(1)), "priority_key"),
        }
    )
    return by_reason(rows, contract.break_rules())


def document_violations(deliveries: DataFrame) -> DataFrame:
    """Deliveries as JSON documents, parsed again."""
    k = key_of() % 7
    amount = lambda c, bad: F.struct(F.lit("EUR").alias("currency"), bad(F.col(c).cast("string")).alias("value"), F.lit(2).alias("scale"))
    same = lambda x: x
    time = lambda c, good: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss" + ("'Z'" if good else ""))
    payload = F.struct(
        amount("base_amount", lambda x: F.when(k == 1, F.concat(F.lit("0"), x)).when(k == 2, F.concat(x, F.lit("000000001"))).otherwise(x)).alias("base_amount"), amount("terms_amount", same).alias("terms_amount"),
        spoilt(k, 3, F.lit("2026-3-2"), F.col("trade_date").cast("string")).alias("trade_date"), F.col("value_date").cast("string").alias("value_date"),
    )
    document = F.to_json(F.struct("observation_id", F.when(k == 4, time("event_time", False)).otherwise(time("event_time", True)).alias("event_time"), time("ingest_time", True).alias("ingest_time"), payload.alias("payload")))
    document = F.when(k == 5, F.concat(F.lit('{"surprise":1,'), F.substring(document, 2, 100_000))).when(k == 6, F.substring(document, 1, 30)).otherwise(document)
    return by_reason(files.parsed_documents(deliveries.select(document.alias("document"))), files.document_rules())


def linkage_violations(trades: DataFrame) -> DataFrame:
    k = key_of() % 6
    candidates = F.transform("candidates", lambda x: F.struct(x.alias("trade_id"), F.col("tenant_id").alias("tenant_id"), spoilt(k, 1, F.lit("portfolio_other"), "portfolio_id").alias("portfolio_id")))
    rows = trades.select(
        "tenant_id", "portfolio_id", "decision", spoilt(k, 2, F.lit("HUMAN_REJECTED"), "reason_code").alias("reason_code"), spoilt(k, 3, F.lit("trade_other"), "chosen_trade_id").alias("chosen_trade_id"),
        spoilt(k, 4, F.slice(candidates, 1, 0), candidates).alias("candidates"),
    )
    return by_reason(rows, V.linkage_rules())


def resolution_violations(facts: DataFrame) -> DataFrame:
    """Resolutions of breaks: a pass must be proved by values that agree within tolerance."""
    k = key_of() % 6
    values = F.array("expected_value", F.when(k == 1, F.col("observed_value")).otherwise(F.col("expected_value")))
    proved = V.proof_agrees(values, F.col("value_type"), F.lit("ABSOLUTE_DECIMAL"), F.lit("0.01"))
    unacted = k.isin(3, 4)
    rows = facts.select(
        "family", F.when(unacted, "OWNER_APPROVED_NON_ACTION").otherwise("RECONCILIATION_PASS").alias("resolution_type"), F.when(~unacted & (k != 2), "run_demo").alias("reconciliation_run_id"),
        (proved & ~unacted).alias("has_proof"), F.when(unacted, "disposition_1").alias("disposition_id"), F.when(k == 3, "HUMAN").when(k == 4, "SERVICE").alias("approver_type"),
        F.array(F.lit("evidence_1")).alias("evidence_ids"), F.when(unacted, F.array(F.lit("DISPOSITION_APPROVAL"))).otherwise(F.array(F.lit("RECONCILIATION_RESULT"))).alias("evidence_roles"),
    )
    return by_reason(rows, V.resolution_rules())


def run_rows(ledger: DataFrame) -> DataFrame:
    """Three runs of the ledger, one of which did not complete."""
    n = F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("n")
    rows = ledger.drop("run_id", "completed_at", "status").select("*", n)
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n"))
    return rows.select(F.concat(F.lit("run_"), "n").alias("run_id"), F.when(F.col("n") == 3, "FAILED").otherwise("COMPLETED").alias("status"), at.alias("completed_at"), *ledger.drop("run_id", "completed_at", "status").columns)


def latest_run(runs: DataFrame) -> DataFrame:
    """The rows of the latest run. A ledger is a row a portfolio; it is kept, so that finding the run and reading it evaluate the trades once."""
    kept = checkpointed(runs)
    return reporting.of_latest_run(kept, kept)


def break_versions(breaks: DataFrame) -> DataFrame:
    """The breaks of two thirds of all trades, found again after they were resolved."""
    return breaks.withColumn("supersedes_break_id", F.lit(None).cast("string")).unionByName(R.reopened(breaks.where(key_of() % 3 > 0), "run_next"))


def trade_details(trades: DataFrame, breaks: DataFrame) -> DataFrame:
    """Every trade's state with its breaks, as the view of one trade shows it."""
    per = breaks.groupBy("trade_id").agg(F.sort_array(F.collect_list(F.struct("family", "break_id"))).alias("b"))
    rows = reporting.latest(R.canonical_states(trades), ["tenant_id", "portfolio_id", "trade_id"], "canonical_state_version").join(per, "trade_id", "left")
    return rows.select("trade_id", "product_type", "lifecycle_status", F.coalesce(F.size("b"), F.lit(0)).alias("n_breaks"), F.coalesce(F.array_join(F.transform("b", lambda x: x["family"]), ","), F.lit("")).alias("families"))


def named(trades: Callable, breaks: Callable, facts: Callable, ledger: Callable, table: Callable, run_id: str) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries, over the registry's frames."""
    epoch = lambda c: F.unix_timestamp(c).alias(c)
    return {
        "provenance_violations": lambda s, d: provenance_violations(trades(s, d)),
        "context_violations": lambda s, d: context_violations(trades(s, d)),
        "selection_violations": lambda s, d: selection_violations(trades(s, d)),
        "run_violations": lambda s, d: run_violations(trades(s, d), run_id),
        "break_violations": lambda s, d: break_violations(breaks(s, d)),
        "document_violations": lambda s, d: document_violations(corpus.load(s, d)),
        "linkage_violations": lambda s, d: linkage_violations(trades(s, d)),
        "resolution_violations": lambda s, d: resolution_violations(facts(s, d)),
        "recent_runs": lambda s, d: reporting.recent_runs(run_rows(ledger(s, d)), 4).select("run_id", "portfolio_id", "break_count", epoch("completed_at")),
        "latest_run": lambda s, d: latest_run(run_rows(ledger(s, d))).select("run_id", "portfolio_id", "break_count"),
        "runs_of_id": lambda s, d: reporting.runs_by_id(run_rows(ledger(s, d)), "run_1").select("run_id", "portfolio_id", "trades_evaluated"),
        "break_latest_version": lambda s, d: reporting.latest(
            break_versions(breaks(s, d)).withColumn("root", F.coalesce("supersedes_break_id", "break_id")), ["root"], "break_version"
        ).select("root", "break_version", "supersedes_break_id"),
        "trade_details": lambda s, d: trade_details(trades(s, d), breaks(s, d)),
        "breaks_search": lambda s, d: breaks(s, d).where(reporting.search(F.col("trade_id"), "TRADE_00000001")).select("trade_id", "family"),
        "facts_in_scope": lambda s, d: R.in_taxonomy_order(reporting.scoped(facts(s, d), corpus.TENANT, [corpus.PORTFOLIOS[0]])).select("trade_id", "family", "field_path"),
            "families_present": lambda s, d: facts(s, d).select("family", position(F.col("family"), tuple(FAMILIES)).alias("place")).distinct().orderBy("place"),
        "corpus_manifest": lambda s, d: corpus.manifest(table(s, d, "orders")),
    }
