"""The evaluator over whole blocks of the synthetic corpus and at its boundaries."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import validation as V
from tallyspark.functions.columns import canonical_json, within_tolerance
from tallyspark.functions.documents import observation_content
from tallyspark.functions.reference_data import Config
from tallyspark.operators import ingest, remediation, reporting
from tallyspark.operators import reconcile as R
from tallyspark.operators.tables import Store, UniquenessError
from tallyspark.sources import corpus


@pytest.fixture(scope="module")
def orders(spark):
    rows = spark.range(144).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 9).alias("o_custkey"), (F.col("id") * 10.25 + 1000).alias("o_totalprice"), F.lit("2026-03-02").cast("timestamp_ntz").alias("o_orderdate")
    )
    return rows.persist()


@pytest.fixture(scope="module")
def seen(orders):
    rows = ingest.classified(corpus.deliveries(orders)).where("outcome <> 'IDEMPOTENT_REPLAY'")
    return rows.withColumn("src_ord", (F.col("outcome") != "INSERTED").cast("int")).drop("outcome", "first_observation_id", "first_hash").persist()


@pytest.fixture(scope="module")
def facts(seen):
    return R.reconcile(seen).persist()


def counted(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r["count"] for r in df.groupBy(*keys).count().collect()}


def test_a_block_of_144_trades(orders, seen, facts):
    assert counted(ingest.classified(corpus.deliveries(orders)), "outcome") == {"INSERTED": 570, "DUPLICATE_SOURCE_CONFLICT": 12}
    breaks = R.breaks(facts, "run_1")
    assert counted(breaks, "family") == {
        "MISSING_REQUIRED_SOURCE": 12, "AMBIGUOUS_OR_UNMATCHED_LINKAGE": 12, "DUPLICATE_SOURCE_CONFLICT": 12, "CURRENCY_PAIR_OR_SIDE_MISMATCH": 12, "ECONOMIC_VALUE_MISMATCH": 12,
        "TRADE_OR_VALUE_DATE_MISMATCH": 12, "LIFECYCLE_STATUS_MISMATCH": 18,
    }
    rows = R.trade_rows(seen)
    ledger = reporting.run_ledger(rows, breaks, "run_1").collect()
    assert sum(r["trades_evaluated"] for r in ledger) == 144 and sum(r["clean_trades"] for r in ledger) == 54 and sum(r["break_count"] for r in ledger) == 90
    assert all(r["trades_evaluated"] == 72 for r in ledger) and sum(r["observations_ingested"] for r in ledger) == 582
    assert breaks.select("break_id").distinct().count() == 90


def test_order_and_partitioning_do_not_matter(seen, facts):
    mine = sorted(map(str, facts.drop("watermark").collect()))
    again = R.reconcile(seen.orderBy(F.desc("observation_id")).repartition(7)).drop("watermark")
    assert sorted(map(str, again.collect())) == mine


def test_one_exchange_and_no_sort_merge_join(spark, seen, tmp_path):
    seen.write.parquet(str(tmp_path / "seen"))
    plan = R.reconcile(spark.read.parquet(str(tmp_path / "seen")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan and "Python" not in plan


def test_the_truth_stays_apart(seen):
    assert not {"family", "variant", "effect", "target", "late", "population"} & set(seen.columns)


def test_outlier_in_the_winner_is_reported_by_the_first_other(facts):
    rows = facts.where("field_path = '/payload/base_amount'").collect()
    outliers = [r for r in rows if r["expected_observation_id"].startswith("obs_execution") and r["observed_observation_id"].startswith("obs_trade_capture")]
    assert outliers and all(float(r["expected_value"]) - float(r["observed_value"]) == 1000 for r in outliers)


def one_trade(seen, change=lambda df: df):
    return change(seen.where("lineage_id = 'lineage_0000000000'"))


@pytest.mark.parametrize(("by", "n"), [("0.01", 0), ("0.0100000001", 1), ("0.02", 1)])
def test_amount_tolerance_is_inclusive(seen, by, n):
    rows = one_trade(seen, lambda d: d.withColumn("base_amount", F.when(F.col("kind") == "BOOKING", F.col("base_amount").cast("decimal(28,10)") + F.lit(by).cast("decimal(28,10)")).otherwise(F.col("base_amount")).cast("decimal(28,10)")))
    assert R.reconcile(rows).where("field_path = '/payload/base_amount'").count() == n


@pytest.mark.parametrize(("seconds", "expected"), [(59, None), (60, "DUE"), (61, "OVERDUE")])
def test_arrival_window(seen, seconds, expected):
    rows = one_trade(seen, lambda d: d.where("kind <> 'CONFIRMATION'"))
    config = Config(windows=dict.fromkeys(Config().windows, 60))
    got = R.reconcile(rows, config, F.col("watermark") + F.make_dt_interval(secs=F.lit(seconds))).where("family = 'MISSING_REQUIRED_SOURCE'").collect()
    assert [r["deadline_status"] for r in got] == ([expected] if expected else []) and all(r["severity"] == "MEDIUM" for r in got)


def test_mixed_terminal_statuses_break_once_and_equal_ones_do_not(seen):
    status = lambda rule: one_trade(seen, lambda d: d.withColumn("lifecycle_status", rule))
    mixed = R.reconcile(status(F.when(F.col("kind") == "BOOKING", "CANCELLED").otherwise("AMENDED"))).collect()
    assert [(r["family"], {r["expected_value"], r["observed_value"]}) for r in mixed] == [("LIFECYCLE_STATUS_MISMATCH", {"AMENDED", "CANCELLED"})]
    assert R.reconcile(status(F.lit("CANCELLED"))).count() == 0


def test_relative_tolerance(spark):
    row = spark.range(1).select(
        within_tolerance(F.lit("100").cast("decimal(28,10)"), F.lit("101").cast("decimal(28,10)"), F.lit("RELATIVE_DECIMAL"), F.lit("0.01")).alias("a"),
        within_tolerance(F.lit("100").cast("decimal(28,10)"), F.lit("101.0000000001").cast("decimal(28,10)"), F.lit("RELATIVE_DECIMAL"), F.lit("0.01")).alias("b"),
        within_tolerance(F.lit("1").cast("decimal(28,10)"), F.lit("1").cast("decimal(28,10)"), F.lit("NONE"), F.lit(None).cast("string")).alias("c"),
    ).first()
    assert (row["a"], row["b"], row["c"]) == (True, False, True)


def test_config_is_effective_in_its_interval(seen):
    rows = one_trade(seen, lambda d: d.where("kind <> 'BOOKING'"))
    at = rows.agg(F.max("ingest_time").cast("string")).first()[0]
    assert R.reconcile(rows, Config(effective_from=at)).count() == 1
    ended = Config(effective_to=at)
    assert R.reconcile(rows, ended, outside="skip").count() == 0
    with pytest.raises(Exception, match="not effective"):
        R.reconcile(rows, ended).collect()


def test_unknown_tolerance_mode_fails(spark):
    one = F.lit("1").cast("decimal(28,10)")
    with pytest.raises(Exception, match="unknown tolerance mode"):
        spark.range(1).select(within_tolerance(one, one, F.concat(F.lit("ABSOLUTE"), F.col("id").cast("string")), F.lit("0.01"))).collect()


def test_winners_name_the_trade(seen):
    """The execution of order 84 (slot 42 // 6: LINKAGE 0, unmatched) is foreign in both keys, so no field is taken from it."""
    rows = seen.where("source_business_key like 'trade_x%' and kind = 'EXECUTION'").select("lineage_id")
    state = R.trade_rows(seen.join(rows, "lineage_id", "left_semi")).select("by_execution.source_system", "trade_id").collect()
    assert state and all(r["source_system"] == "FIX_TRADE_CAPTURE" and r["trade_id"].startswith("trade_0") for r in state)


def test_hashes_tell_where_a_null_is(spark, seen):
    rows = one_trade(seen)
    a = R.canonical_states(R.trade_rows(rows.withColumn("book_id", F.lit(None).cast("string")).withColumn("counterparty_id", F.lit("x"))))
    b = R.canonical_states(R.trade_rows(rows.withColumn("counterparty_id", F.lit(None).cast("string")).withColumn("book_id", F.lit("x"))))
    assert a.first()["state_hash"] != b.first()["state_hash"]


def test_changed_states_get_the_next_version(spark, orders, tmp_path):
    store = Store(spark, str(tmp_path / "tables"))
    store.ingest(corpus.deliveries(orders))
    store.run("run_1")
    store.run("run_2")
    assert store.read("canonical_states").count() == 144
    bookings = store.read("source_event_inbox").where("kind = 'BOOKING' and lineage_id = 'lineage_0000000000'")
    fixed = ingest.corrections(bookings, "book_id", F.lit("book_fixed"), F.lit("2026-04-01 00:00:00").cast("timestamp"))
    store.ingest(fixed.select(*bookings.columns))
    store.run("run_3")
    found = store.read("canonical_states").where("lineage_id = 'lineage_0000000000'").select("canonical_state_version", "source_watermark").collect()
    assert {r["canonical_state_version"] for r in found} == {"1", "2"} and store.read("canonical_states").count() == 145
    before = store.read("trade_breaks").count()
    with pytest.raises(UniquenessError):
        store.run("run_3")
    assert store.read("trade_breaks").count() == before


def test_closure_of_long_chains_diamonds_and_cycles(spark):
    chain = [(i, i + 1) for i in range(150)]
    diamonds = [(1000 + 3 * i, 1000 + 3 * i + d) for i in range(20) for d in (1, 2)] + [(1000 + 3 * i + d, 1003 + 3 * i) for i in range(20) for d in (1, 2)]
    edges = spark.createDataFrame([*chain, *diamonds, (2000, 2001), (2001, 2000)], "source long, target long").coalesce(1)
    starts = spark.createDataFrame([(0,), (1000,), (2000,)], "node long")
    got = remediation.reachable(edges, starts).groupBy("start").count().collect()
    assert {r["start"]: r["count"] for r in got} == {0: 151, 1000: 61, 2000: 2}
    with pytest.raises(RuntimeError, match="complete"):
        remediation.reachable(edges, starts, most_steps=3)


def test_policies_are_the_approved_ones():
    from tallyspark.functions import contract
    from tallyspark.functions.reference_data import DEADLINE_ORDER, IDENTITY_POLICY, MATERIALITY_ORDER, SEVERITY_ORDER, TIE_BREAKERS

    assert contract.priority_policy_problems(list(MATERIALITY_ORDER), list(SEVERITY_ORDER), list(DEADLINE_ORDER), list(TIE_BREAKERS)) == []
    assert contract.priority_policy_problems(list(MATERIALITY_ORDER), ["HIGH"], [], list(TIE_BREAKERS)) == ["SEVERITY_ORDER", "DEADLINE_ORDER"]
    rows = [(i, *r) for i, r in enumerate(IDENTITY_POLICY, 1)]
    assert contract.identity_policy_problems(rows) == [] and contract.identity_policy_problems(rows[::-1]) == ["PRECEDENCE", "OUTCOMES"]


def test_the_sql_twin_imports_nothing_of_the_engine():
    """The DuckDB texts are a second implementation; and nothing outside of the corpus operators imports them."""
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "tallyspark"
    names = {
        f.relative_to(root).as_posix(): {n.module or "" for n in ast.walk(ast.parse(f.read_text())) if isinstance(n, ast.ImportFrom)} | {a.name for n in ast.walk(ast.parse(f.read_text())) if isinstance(n, ast.Import) for a in n.names}
        for f in root.rglob("*.py")
    }
    assert names["plans/oracles.py"] == {"__future__"} and names["plans/contract_oracles.py"] == {"__future__", "oracles"}
    assert not any("llm" in m for f, ms in names.items() if not f.startswith("llm/") for m in ms)


def test_config_must_be_complete(seen):
    with pytest.raises(ValueError, match="TOLERANCES_INCOMPLETE"):
        R.reconcile(seen, Config(tolerances={}))


def test_canonical_json_is_that_of_python(spark):
    values = {"a": "plain", "b": "naïve “quote” \\ / \" é中", "c": 3, "d": None, "e": ["x", "y"]}
    kinds = "a string, b string, c int, d string, e array<string>"
    df = spark.createDataFrame([tuple(values.values())], kinds)
    got = df.select(canonical_json(F.struct("*")).alias("x"), canonical_json(F.struct("*"), keep_nulls=True).alias("y")).first()
    dump = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"))
    assert got["x"] == dump({k: v for k, v in values.items() if v is not None}) and got["y"] == dump(values)


def test_replays_conflicts_and_late_versions(spark, orders, tmp_path):
    store = Store(spark, str(tmp_path / "tables"))
    batch = corpus.deliveries(orders)
    first = {r["outcome"]: r["n"] for r in store.ingest(batch).collect()}
    again = {r["outcome"]: r["n"] for r in store.ingest(batch.withColumn("observation_id", F.concat("observation_id", F.lit("_again")))).collect()}
    assert first == {"INSERTED": 570, "DUPLICATE_SOURCE_CONFLICT": 12} and again == {"IDEMPOTENT_REPLAY": 570, "DUPLICATE_SOURCE_CONFLICT": 12}
    assert store.read("source_event_inbox").count() == 570
    runs = store.run("run_a")
    assert sum(r["break_count"] for r in runs.collect()) == 90 + 0 * runs.count()
    with pytest.raises(UniquenessError):
        store.run("run_a")
    with pytest.raises(ingest.SourceConflictError):
        ingest.split(ingest.classified(batch), "raise")
    late = batch.where("kind = 'BOOKING'").limit(1)
    versions = late.withColumn("source_version", F.lit("7")).unionByName(late.withColumn("source_version", F.lit("5")).withColumn("arrival", F.col("arrival") + 1))
    assert {r["outcome"] for r in ingest.classified(versions).collect()} == {"INSERTED"}


def test_stream_agrees_with_batch(spark, orders, tmp_path):
    from tallyspark.streaming.ingest_stream import start

    batch = corpus.deliveries(orders)
    batch.write.parquet(str(tmp_path / "in"))
    store, got = Store(spark, str(tmp_path / "tables")), []
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    start(stream, store, str(tmp_path / "cp"), lambda facts, _: got.extend(facts.drop("watermark").collect())).awaitTermination()
    assert store.read("source_event_inbox").count() == 570 and len({r["trade_id"] for r in got}) == 90


def test_hash_verification_and_validation(seen):
    assert ingest.verified(seen, observation_content()).where("not hash_valid").count() == 0
    forged = seen.withColumn("side", F.lit("NONE"))
    assert ingest.verified(forged, observation_content()).where("hash_valid").count() == 0
    _, bad = V.split(R.reconcile(seen), V.fact_rules())
    assert bad.count() == 0


def test_linkage_and_resolution_rules(spark):
    link = "tenant_id string, portfolio_id string, decision string, reason_code string, chosen_trade_id string, candidates array<struct<trade_id:string,tenant_id:string,portfolio_id:string>>"
    own, other = ("t1", "a", "p"), ("t1", "a", "q")
    cases = [
        (("a", "p", "ACCEPTED", "EXACT_DETERMINISTIC_KEY", "t1", [own]), []),
        (("a", "p", "ACCEPTED", "EXACT_DETERMINISTIC_KEY", "t1", [other]), ["FOREIGN_CANDIDATE"]),
        (("a", "p", "ACCEPTED", "HUMAN_REJECTED", "t1", [own]), ["DECISION_REASON"]),
        (("a", "p", "UNMATCHED", "NO_ELIGIBLE_CANDIDATE", None, [own]), ["UNMATCHED_WITH_CANDIDATE"]),
        (("a", "p", "AMBIGUOUS", "MULTIPLE_ELIGIBLE_CANDIDATES", None, []), ["AMBIGUOUS_TOO_FEW"]),
        (("a", "p", "CROSS_SCOPE_REJECTED", "TENANT_OR_PORTFOLIO_SCOPE_MISMATCH", None, [other]), []),
    ]
    got = V.with_reasons(spark.createDataFrame([c for c, _ in cases], link).coalesce(1), V.linkage_rules()).collect()
    assert [r["reasons"] for r in got] == [x for _, x in cases]
    kinds = "family string, resolution_type string, reconciliation_run_id string, has_proof boolean, disposition_id string, approver_type string, evidence_ids array<string>, evidence_roles array<string>"
    rows = [
        ("ECONOMIC_VALUE_MISMATCH", "RECONCILIATION_PASS", "r", True, None, None, ["e"], ["RECONCILIATION_RESULT"]),
        ("ECONOMIC_VALUE_MISMATCH", "OWNER_APPROVED_NON_ACTION", None, False, "d", "HUMAN", ["e"], ["DISPOSITION_APPROVAL"]),
        ("MISSING_REQUIRED_SOURCE", "OWNER_APPROVED_NON_ACTION", None, False, "d", "SERVICE", ["e"], ["DISPOSITION_APPROVAL"]),
    ]
    got = V.with_reasons(spark.createDataFrame(rows, kinds).coalesce(1), V.resolution_rules()).collect()
    assert [r["reasons"] for r in got] == [[], ["NON_ACTION_FAMILY"], ["NON_ACTION_APPROVER"]]


def test_envelopes(spark):
    case = spark.createDataFrame([("case_1", "t", "p", "trade_1", "/payload/base_amount", "90", "100")], "case_id string, tenant_id string, portfolio_id string, trade_id string, field_path string, expected_old_value string, approved_value string")
    now, secret = F.lit("2026-01-01 10:00:00").cast("timestamp"), b"k"
    made = remediation.envelopes(case, now, secret)
    status = lambda df, at: remediation.verified_envelopes(df, F.lit(at).cast("timestamp"), secret).first()["envelope_status"]
    assert status(made, "2026-01-01 10:14:59") == "VALID" and status(made, "2026-01-01 10:15:00") == "EXPIRED"
    assert status(made.withColumn("approved_value", F.lit("999")), "2026-01-01 11:00:00") == "TAMPERED"


def test_runbooks_and_search(spark, tmp_path):
    from tallyspark.sources.files import runbook_sections

    (tmp_path / "RB-009-x.md").write_text("# Title\n\n## Section 1 — First things\nCheck the booking amount.\n\n## Section 2 — Then\nAsk the checker.\n")
    sections = runbook_sections(spark, str(tmp_path))
    rows = sorted(map(tuple, sections.collect()))
    assert rows == [("RB-009", 1, "First things", "Check the booking amount."), ("RB-009", 2, "Then", "Ask the checker.")]
    found = remediation.keyword_search(sections, "booking AMOUNT check", 3, F.concat_ws(" ", "title", "content"), ["document_id", "section_number"]).collect()
    assert [(r["section_number"], r["overlap"]) for r in found] == [(1, 3)]


def test_observation_documents(spark, tmp_path):
    from tallyspark.sources.files import flat_observations, observation_documents

    document = {"observation_id": "obs_1", "observation_kind": "BOOKING", "extra": 1, "event_time": "2026-01-01T00:00:00Z", "payload": {"base_amount": {"currency": "EUR", "value": "10.50", "scale": 2}, "trade_date": "x"}}
    (tmp_path / "a.json").write_text(json.dumps(document))
    docs = observation_documents(spark, str(tmp_path))
    assert docs.first()["unknown_fields"] == ["extra"]
    row = flat_observations(docs).first()
    assert str(row["base_amount"]) == "10.5000000000" and row["trade_date"] is None and row["kind"] == "BOOKING"


def test_seeded_shuffle_of_input_rows(spark, seen):
    rows = [r.asDict() for r in one_trade(seen).collect()]
    random.Random(3).shuffle(rows)
    again = spark.createDataFrame([tuple(r[c] for c in seen.columns) for r in rows], seen.schema)
    kinds = lambda df: R.numbered(R.trade_rows(df)).orderBy("ordinal").select("kind").collect()
    assert kinds(again) == kinds(one_trade(seen))


def test_corpus_bundle(spark, orders, tmp_path):
    paths = corpus.write_bundle(orders, str(tmp_path / "bundle"))
    counts = {name: spark.read.json(path).count() for name, path in paths.items()}
    assert counts == {"runtime/observations": 582, "evaluator/truth": 144, "evaluator/graph": 582, "evaluator/manifest": 1}
    assert not {"family", "variant", "effect", "target"} & set(spark.read.json(paths["runtime/observations"]).columns)
    assert corpus.manifest(orders).first() == corpus.manifest(orders.repartition(3)).first()
    assert corpus.problems() == [] and corpus.problems("x", ("portfolio_a",), "CET", 3) == ["TENANT", "PORTFOLIOS", "TIME_ZONE", "COUNTS"]


def test_citations_and_providers(spark):
    cases = spark.createDataFrame([("t", ["RB-001#3", "RB-009#9"])], "trade_id string, citations array<string>")
    sections = spark.createDataFrame([("RB-001", 3), ("RB-002", 1)], "document_id string, section_number int")
    assert remediation.with_known_citations(cases, sections).first()["citations"] == ["RB-001#3"]
    assert remediation.with_known_citations(cases, sections.limit(0)).first()["citations"] == []
    assert remediation.recommend(cases, lambda df: df.withColumn("confidence", F.lit(0.1))).first()["confidence"] == 0.1


def test_documents_that_a_cast_would_spoil(spark):
    from tallyspark.sources.files import document_rules, parsed_documents

    good = {"observation_id": "o", "event_time": "2026-01-01T00:00:00+01:00", "payload": {"base_amount": {"value": "1.5"}, "trade_date": "2026-01-01"}}
    changed = [{}, {"event_time": "2026-01-01T00:00:00"}, {"payload": {"base_amount": {"value": "1,5"}}}, {"payload": {"quoted_rate": {"value": "1.00000000001"}}}, {"payload": {"value_date": "1.1.2026"}}, {"more": 1}]
    texts = [json.dumps(good | x) for x in changed] + ["{", None]
    rows = spark.createDataFrame([(t,) for t in texts], "document string").coalesce(1)
    got = [r["reasons"] for r in V.with_reasons(parsed_documents(rows), document_rules()).collect()]
    assert got == [[], ["TIME_WITHOUT_OFFSET"], ["DECIMAL_FORMAT"], ["DECIMAL_TOO_LONG"], ["DATE_FORMAT"], ["UNKNOWN_FIELD"], ["NOT_JSON"], ["NOT_JSON"]]
