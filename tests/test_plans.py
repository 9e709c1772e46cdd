"""How the queries run: what is shuffled, and what is evaluated once."""

import pytest
from pyspark.sql import functions as F

from tallyspark.plans import document_queries, registry
from tallyspark.sources import corpus


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("orders"))
    k = F.col("id")
    day = F.lit("1996-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(k % 300).cast("int"))
    rows = spark.range(600).select(k.alias("o_orderkey"), (k % 90).alias("o_custkey"), (k * 10 + 0.5).alias("o_totalprice"), day.alias("o_orderdate"))
    rows.write.parquet(f"{path}/orders.parquet")
    return path


def test_reasons_are_counted_without_a_row_for_each(spark, folder):
    """rows were multiplied by their reasons, which evaluated all rules three times."""
    got = registry.QUERIES["contract_violations"](spark, folder)
    text = plan(got)
    assert text.count("Generate explode") == 2 and "reasons" not in text
    assert {r["reason"] for r in got.collect()} >= {"UNSUPPORTED_SCHEMA_VERSION", "DECIMAL_SCALE", "ENTITY_VERSION", "SUPERSESSION_PAIR"}


def test_one_narrow_exchange_serves_identities_and_trades(spark, folder):
    """Deliveries were shuffled by identity and again by trade, with all their columns."""
    text = plan(registry.trades(spark, folder))
    assert text.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(portfolio_id" in text
    assert "content_hash" not in text[text.index("Exchange hashpartitioning") :]


def test_documents_are_read_once_to_be_hashed(spark, folder):
    """the hash a document declares was made by reading a draft of the whole document again."""
    text = plan(document_queries.documents(spark, folder))
    assert "parse_json" not in text
    got = document_queries.document_content_hash(spark, folder).groupBy("hash_valid").count().collect()
    wrong = corpus.truth(spark.read.parquet(f"{folder}/orders.parquet")).where("effect = 'BASE_AMOUNT'").count()
    assert {r["hash_valid"]: r["count"] for r in got}[False] == wrong > 0


def test_corrections_stay_with_their_trade(spark, folder):
    """all observations were shuffled again to be met by their corrections."""
    text = plan(registry.trades_after_correction(spark, folder))
    wide = [x for x in text.splitlines() if "Exchange hashpartitioning" in x]
    assert all("Exchange hashpartitioning(portfolio_id" in x for x in wide) and len(wide) <= 3


def test_the_latest_run_evaluates_the_trades_once(spark, folder):
    """the ledger was made twice, to find its last run and to read it."""
    text = plan(registry.QUERIES["latest_run"](spark, folder))
    assert "collect_list" not in text and "parquet" not in text


def test_recommendations_evaluate_economic_rules_only(spark, folder):
    """all families were evaluated, of which one is wanted."""
    rules = lambda df: "/payload/lifecycle_status" in df._jdf.queryExecution().analyzed().toString()
    assert rules(registry.all_facts(spark, folder)) and not rules(registry.QUERIES["recommendation_reasons"](spark, folder))


def wide(df):
    return [x for x in plan(df).splitlines() if "Exchange hashpartitioning" in x]


def test_lineages_are_met_where_they_were_dealt(spark, folder):
    """references and graphs were shuffled again by lineage."""
    for name, again in (("oracle_boundary", 1), ("truth_graph_paths", 0)):
        other = [x for x in wide(registry.QUERIES[name](spark, folder)) if "Exchange hashpartitioning(portfolio_id" not in x]
        assert len(other) <= again and all("Exchange hashpartitioning(home" in x for x in other)


def test_trades_are_made_once(spark, folder):
    """trades were made again to be joined with what was found in them."""
    for name in ("provenance_graph_edges", "run_envelopes", "summary_rollup"):
        assert plan(registry.QUERIES[name](spark, folder)).count("FileScan parquet") == 1


def test_contents_that_need_escapes_are_those_of_the_general_way(spark):
    from tallyspark.functions.columns import canonical_json, flat_json

    texts = ["plain", 'a"b', "back\\slash", "tab\there", "line\n", "delete\x7f", "Zoë", "\U0001f600", "", None]
    rows = spark.createDataFrame([(t, "x") for t in texts], "a string, b string")
    got = rows.select(flat_json(("a", "b")).alias("quick"), canonical_json(F.struct("a", "b")).alias("general")).collect()
    assert len(got) == len(texts) and all(r["quick"] == r["general"] for r in got)


def test_one_window_serves_place_and_first_of_an_identity(spark, folder):
    """Frames of two kinds made two windows, each of which kept and copied all deliveries."""
    assert plan(registry.outcomes(spark, folder)).count("Window [") == 1


def test_rules_are_not_below_a_filter(spark, folder):
    """Facts were filtered out of one array, and what a function of higher order is given is evaluated uncompiled."""
    from tallyspark.operators import reconcile as R

    text = R.reconcile(registry.observed(spark, folder), corpus.CONFIG, families=("ECONOMIC_VALUE_MISMATCH", "LIFECYCLE_STATUS_MISMATCH"))._jdf.queryExecution().analyzed().toString()
    assert "array_compact" not in text


def test_fields_are_searched_only_where_sources_differ(spark, folder):
    rows = registry.trades(spark, folder)
    assert "_agreed" not in rows.columns and "_named" not in rows.columns
    n = rows.where("off_base_amount is not null").count()
    assert n == corpus.truth(spark.read.parquet(f"{folder}/orders.parquet")).where("effect = 'BASE_AMOUNT'").count() > 0


def test_closed_schemas_are_walked_where_documents_are(spark, folder):
    """documents were written to be read at each depth, and shuffled three times by their key."""
    text = plan(registry.QUERIES["document_schema"](spark, folder))
    assert "Join" not in text and "Scan ExistingRDD" not in text
    assert [x for x in text.splitlines() if "Exchange hashpartitioning(break_id" in x or "Exchange hashpartitioning(trade_id" in x] == []


def test_parts_go_by_trades(spark, tmp_path, monkeypatch):
    """Parts went by splits of the files, so that they, and what sorting them spills, grew with the input."""
    k = F.col("id")
    rows = spark.range(4000).select(k.alias("o_orderkey"), k.alias("o_custkey"), (k + 0.5).alias("o_totalprice"), F.lit("1996-01-01").cast("timestamp_ntz").alias("o_orderdate"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(corpus, "TRADES_A_PART", 100)
    dealt = corpus.dealt_orders(spark, str(tmp_path))
    sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert dealt.rdd.getNumPartitions() == 40 and max(sizes) < 200


def test_superseded_sources_are_met_by_trade(spark, folder):
    """corrections were made for each side of a comparison, and facts again for their watermark, and all were shuffled by observation."""
    for name, scans in (("comparison_violations", 3), ("evidence_violations", 4)):
        got = registry.QUERIES[name](spark, folder)
        assert plan(got).count("FileScan parquet") <= scans
        assert not [x for x in wide(got) if "observation_id" in x]


def test_the_boundary_gathers_trades_once(spark, folder):
    """deliveries were made seven times; now once, and those of the corrected trades."""
    assert plan(registry.QUERIES["oracle_boundary"](spark, folder)).count("Window [") == 2


def test_cases_keep_their_trade(spark, folder):
    """observations were met twice and trades twice, to tell a case's systems and what stands around it."""
    events = spark.sql("SELECT id AS event_id, timestamp'2026-01-01 10:00:00' AS ts, id AS user_id, 'signup' AS event_type, 20D AS value, 'x' AS props FROM range(50)")
    events.write.mode("overwrite").parquet(f"{folder}/events.parquet")
    got = registry.QUERIES["executor_outcomes"](spark, folder)
    assert plan(got).count("Window [") == 1 and sum(r["n"] for r in got.collect()) > 0


def test_triage_of_gathered_trades_is_that_of_rows(spark, folder):
    from tallyspark.operators import reconcile as R
    from tallyspark.operators import remediation

    rows = registry.observed(spark, folder)
    columns = ["lineage_id", "expected_observation_id", "expected_source_system", "observed_observation_id", "observed_source_system"]
    listed = lambda df: sorted(df.select(*columns).collect())
    got = listed(remediation.triage_of_trades(R.facts(R.trade_rows(rows, corpus.CONFIG), corpus.CONFIG, more=("obs",))))
    assert got == listed(remediation.triage(R.reconcile(rows, corpus.CONFIG), rows)) and len(got) > 0


def test_evidence_stays_with_its_fact(spark, folder):
    """facts were made for breaks and for evidence, and trades again for their sources."""
    from tallyspark.operators import reconcile as R

    assert plan(registry.QUERIES["break_reference_violations"](spark, folder)).count("Window [") == 2
    facts = registry.all_facts(spark, folder)
    columns = ["lineage_id", "family", "group_key", "field_path", "evidence_id", "source_observation_id"]
    items = facts.select(*columns[:4], F.explode(R.evidence_items("r", corpus.CONFIG)).alias("e")).select(*columns[:4], "e.*")
    assert sorted(map(str, items.collect())) == sorted(map(str, R.evidence(facts, "r", corpus.CONFIG).select(*columns).collect())) and items.count() > 0


def test_proofs_take_both_runs_from_their_trade(spark, folder):
    """facts, both runs and the corrections were four evaluations of all trades."""
    assert plan(registry.QUERIES["resolution_proofs"](spark, folder)).count("Window [") == 2


def test_trades_before_and_after_corrections(spark, folder):
    from tallyspark.operators import reconcile as R

    rows = registry.corrected_trades(spark, folder)
    wrong = corpus.truth(spark.read.parquet(f"{folder}/orders.parquet")).where("effect = 'BASE_AMOUNT' and target = 'BOOKING'").count()
    assert rows.where("obs_after is not null").count() == rows.where("replaced is not null").count() == wrong > 0
    again = R.trade_rows(R.without_superseded(registry.with_corrections(spark, folder)), corpus.CONFIG)
    listed = lambda df: sorted(df.select(F.to_json(F.struct("lineage_id", "obs"))).collect())
    assert listed(rows.withColumn("obs", F.coalesce("obs_after", "obs"))) == listed(again)
    # Superseded by an observation of its own trade, without a correction; and a trade of which nothing is left.
    seen = registry.observed(spark, folder).where("lineage_id in ('lineage_0000000000', 'lineage_0000000002')")
    first = F.col("observation_id").startswith("obs_execution")
    last = F.when(F.col("lineage_id") == "lineage_0000000000", F.when(~first, "obs_execution_0000000000")).otherwise(F.col("observation_id"))
    got = R.corrected(R.gathered(seen.withColumn("supersedes_observation_id", last)), registry.corrected_bookings(spark, folder).limit(0)).collect()
    assert [r["lineage_id"] for r in got] == ["lineage_0000000000"] and len(got[0]["obs_after"]) == len(got[0]["obs"]) - 1


def test_a_rerun_evaluates_corrected_trades_only(spark, folder):
    """all trades were evaluated again after the corrections, and gathered twice."""
    got = registry.QUERIES["run_break_violations"](spark, folder)
    assert plan(got).count("Window [") == 2
    wrong = corpus.truth(spark.read.parquet(f"{folder}/orders.parquet")).where("effect = 'BASE_AMOUNT' and target = 'BOOKING'").select("lineage_id").collect()
    rows = got.collect()
    assert len(rows) == 600 and {r["lineage_id"] for r in rows if r["reasons"] == "BREAK_ORDER"} == {r[0] for r in wrong} and {r["reasons"] for r in rows} == {"", "BREAK_ORDER"}
