"""Tables with more than one writer, and reads that touch only what a batch needs."""

import re

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import reconcile as R
from tallyspark.operators import remediation
from tallyspark.operators.tables import BUCKETS, BusyError, Store, UniquenessError
from tallyspark.plans.service import Engine, NotEligible
from tallyspark.sources import corpus


def orders(spark, first, last):
    return spark.range(first, last).select(
        F.col("id").alias("o_orderkey"), F.lit(1).alias("o_custkey"), F.lit(5000.5).alias("o_totalprice"), F.lit("2026-03-02").cast("timestamp_ntz").alias("o_orderdate")
    )


def at():
    return F.lit("2026-03-03 09:00:00").cast("timestamp")


def test_one_of_two_writers_gets_a_run(spark, tmp_path):
    one, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    one.ingest(corpus.deliveries(orders(spark, 0, 144)))
    assert one.claim("run", "r1", holder="someone") == "someone"
    with pytest.raises(UniquenessError):
        other.run("r1", corpus.CONFIG, at())
    # The first writer is half done: nothing of its run is to be seen.
    rows = R.trade_rows(one.observations(), corpus.CONFIG)
    broken = R.breaks(R.facts(rows, corpus.CONFIG), "r1")
    one.append("trade_breaks", broken)
    assert other.exists("trade_breaks") and other.read("trade_breaks").count() == 0
    done = other.run("r2", corpus.CONFIG, at())
    assert {r["run_id"] for r in done.collect()} == {"r2"} and {r["run_id"] for r in one.read("trade_breaks").select("run_id").distinct().collect()} == {"r2"}
    one.claim("completed-run", "r1", holder="r1")
    assert {r["run_id"] for r in other.read("trade_breaks").select("run_id").distinct().collect()} == {"r1", "r2"}
    with pytest.raises(UniquenessError):
        one.run("r2", corpus.CONFIG, at())


def test_claims(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert [store.claim("booking", "t", 2, holder=x) for x in ("a", "b", "a")] == ["a", "a", "a"]
    assert store.claim("booking", "t", 3, holder="b") == "b" and store.claim("run", "t", 2, holder="b") == "b"
    with store.exclusive("canonical_states"), pytest.raises(BusyError), store.exclusive("canonical_states", patience_s=0):
        pass
    with store.exclusive("canonical_states", patience_s=0):
        pass


def test_a_batch_reads_its_buckets_only(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.ingest(corpus.deliveries(orders(spark, 0, 3000)))
    store.run("r1", corpus.CONFIG, at())
    batch = R.canonical_states(R.trade_rows(store.observations().where("lineage_id < 'lineage_0000000100'"), corpus.CONFIG)).limit(100)
    known = store.touched("canonical_states", batch)
    plan = known._jdf.queryExecution().executedPlan().toString()
    listed = re.search(r"PartitionFilters: \[.*?bucket#\d+ (?:IN|INSET) \(?([0-9,\. more]+)", plan)
    files = {r[0].split("bucket=")[1].split("/")[0] for r in known.select(F.input_file_name()).distinct().collect()}
    assert listed and len(files) <= 100 < BUCKETS
    full, touched = store.read("canonical_states"), R.versioned(batch, known)
    assert touched.count() == R.versioned(batch, full).count() == 0
    changed = batch.withColumn("state_hash", F.lit("sha256:0"))
    assert sorted(map(tuple, R.versioned(changed, known).select("trade_id", "canonical_state_version").collect())) == sorted(map(tuple, R.versioned(changed, full).select("trade_id", "canonical_state_version").collect()))
    store.append_states(changed)
    assert store.read("canonical_states").groupBy("canonical_state_version").count().orderBy("canonical_state_version").collect()[1]["count"] == batch.count()
    again = {r["outcome"]: r["n"] for r in store.ingest(corpus.deliveries(orders(spark, 24, 30))).collect()}
    assert set(again) == {"IDEMPOTENT_REPLAY"}


def opened(spark, folder, **more):
    # Order 102: spot slot 51, family ECONOMIC, variant 3: the booked base amount is 1,000 too high.
    engine = Engine(spark, str(folder), corpus.TENANT, list(corpus.PORTFOLIOS), b"secret", **more)
    engine.load(corpus.deliveries(orders(spark, 102, 103)))
    engine.run("run_1", at())
    row = engine.breaks(family="ECONOMIC_VALUE_MISMATCH").first()
    return engine, engine.open_case(row["break_id"]).first()


def test_a_booking_version_is_applied_once(spark, tmp_path):
    engine, case = opened(spark, tmp_path)
    for role, who in (("MAKER", "ann"), ("CHECKER", "bo")):
        engine.approve(case["case_id"], role, who)
    booking = (case["tenant_id"], case["portfolio_id"], case["trade_id"], 2)
    # Another writer claims version 2 for another action after this attempt has read version 1.
    assert engine.store.claim("booking", *booking, holder="idem:other a0") == "idem:other a0"
    assert engine.execute(case["case_id"], "a1", at()).first()["outcome"] == "REJECTED_VALUE_MISMATCH"
    assert engine.store.read("legacy_booking_records").count() == 1


def test_the_same_action_goes_on_where_its_writer_died(spark, tmp_path):
    engine, case = opened(spark, tmp_path)
    for role, who in (("MAKER", "ann"), ("CHECKER", "bo")):
        engine.approve(case["case_id"], role, who)
    key = remediation.envelopes(engine.case(case["case_id"]), at(), b"secret").first()["idempotency_key"]
    booking = (case["tenant_id"], case["portfolio_id"], case["trade_id"], 2)
    engine.store.claim("booking", *booking, holder=f"{key} a0")
    assert engine.execute(case["case_id"], "a1", at()).first()["outcome"] == "SUCCESS"
    assert engine.store.read("legacy_booking_records").count() == 2 and engine.verification(case["case_id"], "check").first()["result"] == "PASS"
    assert engine.execute(case["case_id"], "a2", at()).first()["outcome"] == "DUPLICATE_NOOP"


def test_approvals_are_bound_to_the_recommendation(spark, tmp_path):
    engine, case = opened(spark, tmp_path)
    with pytest.raises(NotEligible):
        engine.approve(case["case_id"], "MAKER", "ann", "sha256:0")
    engine.approve(case["case_id"], "MAKER", "ann", case["recommendation_hash"])
    # An approval that names another recommendation does not count.
    engine.store.append("remediation_approvals", spark.createDataFrame([(case["case_id"], "CHECKER", "bo", "APPROVED", "sha256:0")], "case_id string, role string, approver_identity string, decision string, approved_recommendation_hash string"))
    assert engine.execute(case["case_id"], "a1", at()).first()["outcome"] == "REJECTED_APPROVALS_MISSING"


def test_a_case_cites_the_runbooks(spark, tmp_path):
    rows = [("RB-001", 3, "Correction of an economic field", "Correct the booking from the authoritative source."), ("RB-002", 1, "Mismatch", "An economic value mismatch of a booking."), ("RB-009", 9, "Lunch", "Noon.")]
    runbooks = spark.createDataFrame(rows, "document_id string, section_number int, title string, content string")
    _, case = opened(spark, tmp_path / "a", runbooks=runbooks)
    assert case["citations"] == ["RB-001#3", "RB-002#1"] and case["policy_outcome"] == "ELIGIBLE_FOR_APPROVAL"
    assert '"citation":"RB-001#3"' in case["prompt"] and "RB-009" not in case["prompt"] and '"expected_value":"5000.50"' in case["prompt"]
    _, case = opened(spark, tmp_path / "b", runbooks=runbooks.where("document_id = 'RB-009'"))
    assert case["citations"] == [] and (case["policy_outcome"], case["policy_reason"]) == ("REJECTED", "missing_citation")
