"""Windows that end on a stream where only time passes."""

from dataclasses import replace

from pyspark.sql import functions as F

from tallyspark.operators import reconcile as R
from tallyspark.sources import corpus
from tallyspark.streaming import arrival

CONFIG = replace(corpus.CONFIG, windows=dict.fromkeys(corpus.CONFIG.windows, 60))


def test_a_window_ends_without_a_delivery(spark, tmp_path):
    orders = spark.range(48, 60).select(F.col("id").alias("o_orderkey"), F.lit(1).alias("o_custkey"), F.lit(5000.5).alias("o_totalprice"), F.lit("2026-03-02").cast("timestamp_ntz").alias("o_orderdate"))
    rows = corpus.deliveries(orders)
    later = corpus.deliveries(orders.where("o_orderkey = 48").withColumn("o_orderkey", F.lit(2)).withColumn("o_orderdate", F.lit("2026-03-03").cast("timestamp_ntz")))
    source = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(source)
    kept = str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = arrival.missing_sources(stream, CONFIG).writeStream.format("parquet").option("path", kept).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(180) and query.exception() is None
        return {(r["lineage_id"], r["kind"], r["expected_by"]) for r in spark.read.schema(arrival.OUT).parquet(kept).collect()}

    # All trades' windows but the last end at the earliest 60 s after their own watermark: the stream has not got that far.
    first = run()
    last = rows.agg(F.max("ingest_time").alias("t")).first()["t"]
    batch = lambda at: {
        (r["lineage_id"], r["group_key"], r["expected_by"])
        for r in R.facts(R.trade_rows(rows, CONFIG), CONFIG, at).where("family = 'MISSING_REQUIRED_SOURCE'").collect()
    }
    assert first == batch(F.lit(last))
    # Another trade is delivered a day later; nothing of these is.
    later.coalesce(1).write.mode("append").parquet(source)
    wanted = batch(F.lit(last) + F.expr("INTERVAL 1 DAY"))
    assert run() == wanted and len(wanted) == 12 and first < wanted
