"""Synthetic deliveries: one trade per order, four sources per trade, known defects by order key.

A narrow transformation: the orders are read once and each row becomes its deliveries; nothing is shuffled.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import lookup, sha256
from ..functions.documents import observation_content
from ..functions.reference_data import FAMILY_ORDER, SYSTEMS, VARIANTS, Config

TENANT = "tenant_demo"
#: The fixture configuration, effective at the times of the orders.
CONFIG = Config(effective_from="1970-01-01 00:00:00")
PORTFOLIOS = ("portfolio_london", "portfolio_sydney")
#: A source identity of the corpus: business keys are made of the order key, as lineages are, so an identity lies in one lineage.
IDENTITY = ("portfolio_id", "lineage_id", "tenant_id", "source_system", "kind", "source_business_key", "source_version")
#: Trades of a part: few enough that sorting them and meeting them with what else is of them stays in memory, whatever the splits of the files are.
TRADES_A_PART = 10_000
#: kind: (sequence, minutes after the first), fixed values
TIMES = {"EXECUTION": (1, 0), "TRADE_CAPTURE": (2, 1), "BOOKING": (3, 2), "CONFIRMATION": (4, 3)}


def _padded(k: Column) -> Column:
    return F.lpad(k.cast("string"), 10, "0")


def _scope(k: Column) -> tuple[Column, Column]:
    """Portfolio and lineage of an order's trade."""
    portfolio = F.element_at(F.array(*map(F.lit, PORTFOLIOS)), ((F.floor(k / 2) + F.floor(k / 144)) % 2 + 1).cast("int"))
    return portfolio.alias("portfolio_id"), F.concat(F.lit("lineage_"), _padded(k)).alias("lineage_id")


def dealt(orders: DataFrame, n: int) -> DataFrame:
    """Orders with portfolio and lineage, in n parts by these: all that is made of a row stays with its trade, so that what gathers trades later shuffles nothing."""
    return orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", *_scope(F.col("o_orderkey"))).repartition(n, "portfolio_id", "lineage_id")


def trades(orders: DataFrame) -> DataFrame:
    """One row an order: the trade as all sources should see it, and its defect."""
    k = F.col("o_orderkey")
    half = F.floor(k / 2)
    portfolio, lineage = (F.col("portfolio_id"), F.col("lineage_id")) if "lineage_id" in orders.columns else _scope(k)
    slot = (half % 72).cast("int")
    spot = k % 2 == 0
    rate = F.when(spot, F.lit("1.0800").cast("decimal(12,4)") + ((k % 100).cast("decimal(12,4)") / F.lit(10000)).cast("decimal(12,4)")).otherwise(
        F.lit("153.0000").cast("decimal(12,4)") + ((k % 1000).cast("decimal(12,4)") / F.lit(1000)).cast("decimal(12,4)")
    )
    frame = orders.select(
        k.alias("k"),
        portfolio,
        lineage,
        F.concat(F.lit("trade_"), _padded(k)).alias("trade"),
        F.when(spot, "FX_SPOT").otherwise("FX_FORWARD").alias("product_type"),
        F.when(spot, "EUR").otherwise("USD").alias("base_currency"),
        F.when(spot, "USD").otherwise("JPY").alias("terms_currency"),
        F.when(F.floor(k / 4) % 2 == 0, "BUY_BASE").otherwise("SELL_BASE").alias("side"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("base_amount"),
        rate.cast("decimal(12,4)").alias("quoted_rate"),
        F.col("o_orderdate").cast("date").alias("trade_date"),
        F.date_add(F.col("o_orderdate").cast("date"), F.when(spot, 2).otherwise(90)).alias("value_date"),
        F.concat(F.lit("counterparty_"), (F.col("o_custkey") % 50).cast("string")).alias("counterparty_id"),
        F.concat(F.lit("book_"), (k % 7).cast("string")).alias("book_id"),
        F.when(slot >= 24, F.floor((slot - 24) / 6).cast("int")).alias("family_ix"),
        ((slot - 24) % 6).alias("variant"),
    )
    frame = frame.withColumn("terms_amount", F.bround(F.col("base_amount") * F.col("quoted_rate"), 2).cast("decimal(18,2)"))
    # One literal array indexed by defect, not a CASE per column: short generated code.
    defects = F.array(*[F.struct(F.lit(kind).alias("target"), F.lit(effect).alias("effect"), F.lit(late).alias("late")) for _, _, kind, effect, late in ordered_variants()])
    clean = F.struct(F.lit("").alias("target"), F.lit("").alias("effect"), F.lit(False).alias("late"))
    key = (F.col("family_ix") * 6 + F.col("variant") + 1).cast("int")
    return frame.select("*", F.coalesce(F.get(defects, key - 1), clean).alias("defect")).select("*", "defect.*").drop("defect")


def ordered_variants() -> list[tuple]:
    """The variants by family and number, as the defect key counts them."""
    return sorted(VARIANTS, key=lambda v: (FAMILY_ORDER.index(v[0]), v[1]))


def deliveries(orders: DataFrame, config: Config | None = None) -> DataFrame:
    """All deliveries, in the engine's observation columns; ``arrival`` orders them."""
    statuses = (config or Config()).statuses
    t = trades(orders)
    rows = []
    for kind, (seq, minutes) in TIMES.items():
        for copy in (0, 1):
            rows.append(F.struct(F.lit(kind).alias("kind"), F.lit(SYSTEMS[kind]).alias("source_system"), F.lit(seq).alias("source_sequence"), F.lit(minutes).alias("minutes"), F.lit(copy).alias("copy")))
    target, effect = F.col("target"), F.col("effect")
    wanted = F.filter(
        F.array(*rows), lambda r: F.when(r["copy"] == 1, (r["kind"] == target) & effect.isin("DUPLICATE", "AMBIGUOUS")).otherwise(~((r["kind"] == target) & (effect == "DROP")))
    )
    d = t.withColumn("row", F.explode(wanted)).select("*", "row.*").drop("row")
    hit = F.col("kind") == target
    copy = F.col("copy") == 1
    hits = lambda e: hit & (effect == e)
    foreign = F.concat(F.lit("trade_x"), _padded(F.col("k")))
    d = d.select(
        F.lit(TENANT).alias("tenant_id"),
        "portfolio_id",
        "lineage_id",
        F.concat(F.lit("obs_"), F.lower("kind"), F.lit("_"), _padded(F.col("k")), F.when(copy, "_x").otherwise("")).alias("observation_id"),
        "kind",
        "source_system",
        F.when(hits("UNMATCHED"), foreign).otherwise(F.col("trade")).alias("source_business_key"),
        F.when(hits("UNMATCHED") | hits("AMBIGUOUS") & copy, foreign).otherwise(F.col("trade")).alias("source_trade_id"),
        F.when(hits("AMBIGUOUS") & copy, "2").otherwise("1").alias("source_version"),
        "source_sequence",
        "product_type",
        F.lit("1.0.0").alias("settlement_rule_version"),
        F.when(hits("BASE_GBP"), "GBP").otherwise(F.col("base_currency")).alias("base_currency"),
        F.when(hits("TERMS_CHF"), "CHF").otherwise(F.col("terms_currency")).alias("terms_currency"),
        F.when(hits("SIDE"), F.when(F.col("side") == "BUY_BASE", "SELL_BASE").otherwise("BUY_BASE")).otherwise(F.col("side")).alias("side"),
        (F.col("base_amount") + F.when(hits("BASE_AMOUNT"), 1000).otherwise(0)).cast("decimal(18,2)").alias("base_amount"),
        (F.col("terms_amount") + F.when(hits("TERMS_AMOUNT"), 1).otherwise(0)).cast("decimal(18,2)").alias("terms_amount"),
        (F.col("quoted_rate") + F.when(hits("RATE"), F.lit("0.01").cast("decimal(3,2)")).otherwise(F.lit("0").cast("decimal(3,2)"))).cast("decimal(12,4)").alias("quoted_rate"),
        F.date_add("trade_date", F.when(hits("TRADE_DATE"), 1).otherwise(0)).alias("trade_date"),
        F.date_add("value_date", F.when(hits("VALUE_DATE"), 1).otherwise(0)).alias("value_date"),
        "counterparty_id",
        F.when(hits("BOOK_ID"), F.concat("book_id", F.lit("_moved"))).otherwise(F.col("book_id")).alias("book_id"),
        F.when(hit & effect.isin("AMENDED", "CANCELLED"), effect).otherwise(lookup(F.col("kind"), statuses)).alias("lifecycle_status"),
        F.concat(F.lower("kind"), F.lit("_ref_"), F.col("k").cast("string"), F.when(copy & (effect == "DUPLICATE"), "_changed").otherwise("")).alias("kind_reference"),
        F.timestamp_seconds(F.unix_date("trade_date") * 86400 + 32400 + F.col("minutes") * 60).alias("event_time"),
        F.timestamp_seconds(F.unix_date("trade_date") * 86400 + 32405 + F.col("minutes") * 60 + F.when(hit & F.col("late"), 300).otherwise(0)).alias("ingest_time"),
        (F.col("k") * 16 + F.col("source_sequence") * 2 + F.col("copy")).alias("arrival"),
        F.lit(None).cast("string").alias("supersedes_observation_id"),
        F.lit(None).cast("string").alias("supersession_reason"),
    )
    return d.withColumn("content_hash", sha256(observation_content()))


def load(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Deliveries of the orders table, dealt by trade while they are four columns of an order. Parts go by the number of orders, as an order becomes some deliveries of dozens of columns. ``only`` names trades
    (portfolio_id, lineage_id, dealt alike) whose deliveries are wanted."""
    orders = dealt_orders(spark, sf_dir)
    return deliveries(orders if only is None else orders.join(only, ["portfolio_id", "lineage_id"], "left_semi"))


def dealt_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return dealt(orders, max(spark.sparkContext.defaultParallelism, math.ceil(orders.count() / TRADES_A_PART)))


def truth(orders: DataFrame) -> DataFrame:
    """The evaluator's ledger: which defect each trade has. Never joined into what the engine reads."""
    t = trades(orders)
    family = lookup(F.col("family_ix"), dict(enumerate(FAMILY_ORDER)))
    return t.select(
        "lineage_id", "portfolio_id", "product_type",
        F.when(F.col("family_ix").isNull(), "CLEAN").otherwise("BROKEN").alias("population"), family.alias("family"), F.when(F.col("family_ix").isNotNull(), F.col("variant")).alias("variant"),
        "target", "effect", "late",
    )


def problems(tenant_id: str = TENANT, portfolios: tuple[str, ...] = PORTFOLIOS, time_zone: str = "UTC", clean: int = 24, variants: int = 6) -> list[str]:
    """Reasons why a corpus of these parameters would not be the agreed one; empty if it is sound."""
    out = []
    if re.fullmatch(r"tenant_[a-z0-9][a-z0-9_-]{1,63}", tenant_id) is None:
        out.append("TENANT")
    if len(portfolios) < 2 or len(set(portfolios)) != len(portfolios) or any(re.fullmatch(r"portfolio_[a-z0-9][a-z0-9_-]{1,63}", p) is None for p in portfolios):
        out.append("PORTFOLIOS")
    if time_zone != "UTC":
        out.append("TIME_ZONE")
    if (clean, variants) != (24, len(VARIANTS) // len(FAMILY_ORDER)):
        out.append("COUNTS")
    return out


def manifest(orders: DataFrame) -> DataFrame:
    """One row: how many trades, defects and deliveries the corpus has, and a hash of all deliveries that no order of rows changes."""
    rows = deliveries(orders)
    sums = [F.sum(F.conv(F.substring("content_hash", 8 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)]
    counted = rows.agg(
        F.countDistinct("lineage_id").alias("n_trades"), F.count(F.lit(1)).alias("n_deliveries"), F.countDistinct("content_hash").alias("n_contents"),
        F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", *sums), 256)).alias("content_hash"),
    )
    return counted.select(F.lit(TENANT).alias("tenant_id"), "*")


def write_bundle(orders: DataFrame, folder: str) -> dict[str, str]:
    """The four artefacts as JSON: what the engine reads, and, in a folder of their own, the evaluator's truth, its graph and the manifest. Returns their paths."""
    t = truth(orders)
    edges = deliveries(orders).select(F.col("observation_id").alias("source"), F.col("lineage_id").alias("target"), F.lit("OBSERVATION_OF").alias("edge"))
    frames = {
        "runtime/observations": deliveries(orders), "evaluator/truth": t, "evaluator/graph": edges, "evaluator/manifest": manifest(orders),
    }
    for name, frame in frames.items():
        frame.write.mode("errorifexists").json(f"{folder}/{name}")
    return {name: f"{folder}/{name}" for name in frames}
