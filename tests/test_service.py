"""One remediation from load to evidence, with its refusals."""

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.tables import UniquenessError
from tallyspark.plans.service import Engine, NotEligible, NotFound
from tallyspark.sources import corpus


def test_maker_checker_end_to_end(spark, tmp_path):
    # Order 102: spot slot 51, family ECONOMIC, variant 3: the booked base amount is 1,000 too high.
    orders = spark.range(102, 104).select(
        F.col("id").alias("o_orderkey"), F.lit(1).alias("o_custkey"), F.lit(5000.5).alias("o_totalprice"), F.lit("2026-03-02").cast("timestamp_ntz").alias("o_orderdate")
    )
    engine = Engine(spark, str(tmp_path / "tables"), corpus.TENANT, list(corpus.PORTFOLIOS), b"secret")
    engine.load(corpus.deliveries(orders))
    engine.run("run_1", F.lit("2026-03-03 00:00:00").cast("timestamp"))
    assert engine.summary().first()["break_count"] == 2 and engine.runs().count() >= 1
    rows = engine.breaks(family="ECONOMIC_VALUE_MISMATCH", product_type="FX_SPOT").collect()
    assert len(rows) == 1 and engine.break_detail(rows[0]["break_id"]).count() == 1
    assert [b["family"] for b in engine.trade_detail(rows[0]["trade_id"]).first()["breaks"]] == ["ECONOMIC_VALUE_MISMATCH"]
    case = engine.open_case(rows[0]["break_id"]).first()
    assert (case["policy_outcome"], case["approved_value"], case["expected_old_value"]) == ("ELIGIBLE_FOR_APPROVAL", "5000.50", "6000.50")
    at = lambda text: F.lit(text).cast("timestamp")
    assert engine.execute(case["case_id"], "a0", at("2026-03-03 09:00:00")).first()["outcome"] == "REJECTED_APPROVALS_MISSING"
    engine.approve(case["case_id"], "MAKER", "ann")
    with pytest.raises(NotEligible):
        engine.approve(case["case_id"], "CHECKER", "ann")
    engine.approve(case["case_id"], "CHECKER", "bo")
    with pytest.raises(UniquenessError):
        engine.approve(case["case_id"], "CHECKER", "cy")
    assert engine.execute(case["case_id"], "a1", at("2026-03-03 09:05:00")).first()["outcome"] == "SUCCESS"
    assert engine.rerun_trade(case["case_id"]).count() == 0
    state = engine.trade_detail(rows[0]["trade_id"]).first()
    assert state["canonical_state_version"] == "2" and len(state["source_version_set"]) == 4
    assert engine.execute(case["case_id"], "a2", at("2026-03-03 09:06:00")).first()["outcome"] == "DUPLICATE_NOOP"
    assert engine.execute(case["case_id"], "a3", at("2026-03-03 09:07:00"), "TIMEOUT_RECOVERY_ATTEMPT").first()["outcome"] == "TIMEOUT_RECOVERED"
    assert engine.execute(case["case_id"], "a4", at("2026-03-03 10:00:00")).first()["outcome"] == "REJECTED_EXPIRED"
    view = engine.evidence_view(case["case_id"]).first()
    assert view["evidence_hash"] and len(view["executions"]) == 5 and len(view["approvals"]) == 2
    with pytest.raises(NotFound):
        engine.open_case("break_none")
    with pytest.raises(NotFound):
        engine.trade_detail("trade_none")
    assert engine.breaks(search=rows[0]["trade_id"][-6:].upper()).count() == 1 and engine.breaks(search="nothing").count() == 0
    assert [r["n"] for r in engine.summary_tables()["observations"].collect()] == [9] and engine.observation_list().count() == 9
    with pytest.raises(ValueError, match="scope"):
        engine.load(corpus.deliveries(orders).withColumn("tenant_id", F.lit("tenant_other")))
