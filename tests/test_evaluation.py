"""The evaluation's input boundary, the truth's graph and proofs of resolutions, on rows made by hand."""

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import contract
from tallyspark.functions import validation as V
from tallyspark.operators import boundary
from tallyspark.sources import truth_graph

OBS = "lineage_id string, tenant_id string, portfolio_id string, observation_id string, kind string, source_system string, source_version string, content_hash string, ingest_time timestamp"
STATE = "lineage_id string, tenant_id string, portfolio_id string, source_watermark timestamp, source_version_set array<struct<observation_id:string,kind:string,source_system:string,source_version:string,content_hash:string>>"


def test_boundary(spark):
    ts = spark.sql("SELECT timestamp'2026-01-01 10:00:00' a, timestamp'2026-01-01 11:00:00' b").first()
    o = lambda lineage, i, at=ts.a, portfolio="p", h="h": (lineage, "t", portfolio, i, "BOOKING", "S", "1", h, at)
    ref = lambda i, h="h": (i, "BOOKING", "S", "1", h)
    observations = spark.createDataFrame([o("ok", "1"), o("ok", "2", h=None), o("late", "1", ts.b), o("twice", "1"), o("twice", "1"), o("other", "1", portfolio="q"), o("more", "1"), o("more", "2"), o("alone", "1"), o("nowhen", "1")], OBS)
    states = spark.createDataFrame(
        [("ok", "t", "p", ts.a, [ref("1"), ref("2", None)]), ("late", "t", "p", ts.a, [ref("1")]), ("twice", "t", "p", ts.a, [ref("1")]), ("other", "t", "p", ts.a, [ref("1")]), ("more", "t", "p", ts.a, [ref("1"), ref("3")]),
         ("gone", "t", "p", ts.a, [ref("1")]), ("nowhen", "t", "p", None, [ref("1")])], STATE)
    linkage = spark.createDataFrame([("ok", "1"), ("late", "9"), ("twice", None)], "lineage_id string, linkage_observation_id string")
    got = {r["lineage_id"]: r["reasons"] for r in boundary.gate(observations, states, linkage).collect()}
    assert got == {
        "ok": [], "late": ["ARRIVED_AFTER_WATERMARK", "LINKAGE_OUTSIDE_SET"], "twice": ["OBSERVATION_REPEATS"], "other": ["OUT_OF_SCOPE"], "more": ["SOURCE_SET_DIFFERS"], "alone": ["NO_STATE"],
        "gone": ["NO_OBSERVATIONS"], "nowhen": ["NO_WATERMARK"],
    }
    assert boundary.gate(observations.limit(0), states.limit(0)).count() == 0
    with pytest.raises(ValueError, match="break_ids"):
        boundary.gate(observations, states.withColumn("break_ids", F.array()))


def test_a_graph_without_a_link_is_no_whole_path(spark):
    orders = spark.range(48, 144).select(F.col("id").alias("o_orderkey"), F.lit(1).alias("o_custkey"), F.lit(5000.5).alias("o_totalprice"), F.lit("2026-03-02").cast("timestamp_ntz").alias("o_orderdate"))
    edges = truth_graph.edges(orders).persist()
    whole = {r["lineage_id"]: r["whole_path"] for r in truth_graph.paths(edges).collect()}
    assert len(whole) == 96 and all(whole.values())
    kinds = {r[0] for r in truth_graph.nodes(edges).select("node_type").distinct().collect()}
    assert kinds == {"LINEAGE", "SOURCE_OBSERVATION", "SYNTHETIC_CAUSE", "SOURCE_MUTATION", "DELIVERY_BEHAVIOUR", "EXPECTED_SOURCE_ABSENCE", "DIFFERENCE_FACT", "BREAK_FAMILY"}
    for kind, n in (("CAUSE_OF", 0), ("CLASSIFIES_AS", 96), ("MUTATES_OBSERVATION", 84), ("MATERIALIZES_FACT", 12), ("DELIVERED_AS", 96)):
        cut = {r["whole_path"] for r in truth_graph.paths(edges.where(F.col("relationship") != kind)).collect()}
        assert (False in cut) == (n > 0), kind


def test_proofs(spark):
    one = "struct('/payload/base_amount' AS field_path, 'DECIMAL' AS value_type, 'a' AS expected_observation_id, 'b' AS observed_observation_id, 'ABSOLUTE_DECIMAL' AS tolerance_mode, '0.01' AS tolerance_value)"
    sources = "array(struct('a' AS observation_id, '1' AS source_version), struct('b' AS observation_id, '2' AS source_version))"

    def proof(run="r", family="ECONOMIC_VALUE_MISMATCH", held=sources, path="/payload/base_amount", kind="DECIMAL", values=(("a", "1", "1.00"), ("b", "2", "1.01"))):
        listed = ", ".join(f"struct('{i}' AS observation_id, '{v}' AS source_version, '{x}' AS value)" for i, v, x in values)
        return f"struct('{run}' AS run_id, '{family}' AS family, 'C' AS condition_code, {held} AS sources, array(struct('{path}' AS field_path, '{kind}' AS value_type, array({listed}) AS values)) AS comparisons)"

    cases = {
        proof(): [], proof(run="x"): ["PROOF_RUN"], proof(family="x"): ["PROOF_BREAK"], proof(held="array(struct('a' AS observation_id, '1' AS source_version))"): ["PROOF_SOURCES_DIFFER"],
        proof(path="/payload/side"): ["PROOF_PATHS_DIFFER"], proof(kind="DATE"): ["PROOF_VALUE_TYPE"], proof(values=(("a", "1", "1"), ("b", "1", "1"))): ["PROOF_VERSION"],
        proof(values=(("a", "1", "1"), ("b", "2", "1"), ("c", "1", "1"))): ["PROOF_SOURCE_UNKNOWN"], proof(values=(("a", "1", "1"),)): ["PROOF_OPERANDS_MISSING", "PROOF_ONE_SOURCE"],
        proof(values=(("a", "1", "1.00"), ("b", "2", "1.02"))): ["PROOF_DISAGREES"],
    }
    for text, reasons in cases.items():
        row = spark.sql(f"SELECT 'r' AS run_id, 'ECONOMIC_VALUE_MISMATCH' AS family, 'C' AS condition_code, {sources} AS sources, array({one}) AS comparisons, {text} AS proof")
        assert V.with_reasons(row, contract.proof_rules()).first()["reasons"] == reasons, text


def test_the_boundary_of_gathered_trades_is_that_of_rows(spark):
    """what a trade has was made seven times to be met again."""
    key = "observation_id:string,kind:string,source_system:string,source_version:string,content_hash:string"
    schema = f"lineage_id string, observations array<struct<tenant_id:string,portfolio_id:string,ingest_time:timestamp,{key}>>, state struct<tenant_id:string,portfolio_id:string,source_watermark:timestamp,source_version_set:array<struct<{key}>>>, linkage_observation_id string"
    ts = spark.sql("SELECT timestamp'2026-01-01 10:00:00' a, timestamp'2026-01-01 11:00:00' b").first()
    o = lambda i, at=ts.a, portfolio="p", h="h": ("t", portfolio, at, i, "BOOKING", "S", "1", h)
    state = lambda *ids, at=ts.a: ("t", "p", at, [(i, "BOOKING", "S", "1", h) for i, h in ids])
    rows = [
        ("ok", [o("1"), o("2", h=None)], state(("1", "h"), ("2", None)), "1"), ("late", [o("1", ts.b)], state(("1", "h")), "9"), ("twice", [o("1"), o("1")], state(("1", "h")), None),
        ("other", [o("1", portfolio="q")], state(("1", "h")), None), ("more", [o("1"), o("2")], state(("1", "h"), ("3", "h")), None), ("alone", [o("1")], None, None), ("gone", [], state(("1", "h")), None),
        ("nowhen", [o("1")], state(("1", "h"), at=None), None), ("nameless", [o(None)], state((None, "h")), None),
    ]
    trades = spark.createDataFrame(rows, schema)
    observations = trades.selectExpr("lineage_id", "inline(observations)")
    states = trades.where("state is not null").select("lineage_id", "state.*")
    linkage = trades.where("linkage_observation_id is not null").select("lineage_id", "linkage_observation_id")
    listed = lambda df: {r["lineage_id"]: r["reasons"] for r in df.collect()}
    got = listed(boundary.gate_of_trades(trades))
    assert got == listed(boundary.gate(observations, states, linkage)) and got["late"] == ["ARRIVED_AFTER_WATERMARK", "LINKAGE_OUTSIDE_SET"] and got["nameless"] == ["OBSERVATION_REPEATS"]
