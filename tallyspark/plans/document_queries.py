"""Queries over observation documents (JSON text): content hashes, and what ingest decides about documents."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions.columns import canonical_json, plain, sha256, utc_micros
from ..operators import ingest
from ..sources import corpus, files
from .oracles import over

#: An unknown part of a document: names out of order, members that are null, characters beyond ASCII, a delete character, and a backslash before a u.
NOTE = '{"über":"naïve \x7f back\\\\u00E9slash","gone":null,"list":[null,1,{"b":null,"a":"x,\\":null}"}]}'
TRADERS = ("Zoë", "Łukasz", "\U0001f600 desk")


def _local(at: Column) -> Column:
    """A time as a source two hours east of UTC writes it."""
    return F.concat(F.date_format(at + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))


def _trader() -> Column:
    return F.element_at(F.array(*map(F.lit, TRADERS)), (F.col("source_sequence") % 3 + 1).cast("int"))


def _document(base_amount: Column, declared: Column) -> Column:
    c = F.col
    amount = lambda value, currency: F.struct(value.cast("string").alias("value"), F.lit(2).alias("scale"), currency.alias("currency"))
    payload = F.struct(
        "side", "book_id", F.when(c("kind") == "EXECUTION", _local(c("event_time"))).alias("execution_time"), amount(base_amount, c("base_currency")).alias("base_amount"), "product_type",
        "lifecycle_status", F.col("kind_reference").alias("reference"), c("source_trade_id").alias("source_trade_id"),
    )
    body = F.struct(
        _trader().alias("trader"), "tenant_id", "source_version", "observation_id", F.lit("corr_1").alias("correlation_id"), declared.alias("content_hash"), payload.alias("payload"),
        c("kind").alias("observation_kind"), _local(c("event_time")).alias("event_time"), _local(c("ingest_time")).alias("ingest_time"), c("lineage_id").alias("lineage_group_id"),
        F.lit(None).cast("string").alias("supersedes_observation_id"), "source_system", "source_business_key", "portfolio_id", "source_sequence",
    )
    text = F.substring(F.to_json(body, {"ignoreNullFields": "false"}), 2, 1 << 30)
    time, base = _local(c("event_time")), base_amount.cast("string")
    quick = _written(
        '"trader":"', _trader(), '","tenant_id":"', c("tenant_id"), '","source_version":"', c("source_version"), '","observation_id":"', c("observation_id"), '","correlation_id":"corr_1","content_hash":"', declared,
        '","payload":{"side":"', c("side"), '","book_id":"', c("book_id"), '","execution_time":', F.when(c("kind") == "EXECUTION", _written('"', time, '"')).otherwise("null"), ',"base_amount":{"value":"', base,
        '","scale":2,"currency":"', c("base_currency"), '"},"product_type":"', c("product_type"), '","lifecycle_status":"', c("lifecycle_status"), '","reference":"', c("kind_reference"), '","source_trade_id":"',
        c("source_trade_id"), '"},"observation_kind":"', c("kind"), '","event_time":"', time, '","ingest_time":"', _local(c("ingest_time")), '","lineage_group_id":"', c("lineage_id"),
        '","supersedes_observation_id":null,"source_system":"', c("source_system"), '","source_business_key":"', c("source_business_key"), '","portfolio_id":"', c("portfolio_id"), '","source_sequence":',
        c("source_sequence").cast("string"), "}",
    )
    return F.concat(F.lit(f'{{"zeta_note": {NOTE}, '), F.coalesce(F.when(_plain_row(), quick), text))


def _written(*parts: Column | str) -> Column:
    """Columns between fixed parts of a text; null if one is."""
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def _plain_row() -> Column:
    """Whether the texts of a delivery need no escapes in JSON, so that its document can be put together as it is."""
    texts = ("tenant_id", "source_version", "observation_id", "side", "book_id", "base_currency", "product_type", "lifecycle_status", "kind_reference", "source_trade_id", "kind", "lineage_id", "source_system")
    return plain(*map(F.col, (*texts, "source_business_key", "portfolio_id")))


#: The unknown part in canonical text.
NOTE_TEXT = r'{"list":[null,1,{"a":"x,\":null}"}],"\u00fcber":"na\u00efve \u007f back\\u00E9slash"}'


def _declared(base_amount: Column) -> Column:
    """The hash a source declares, from its own columns: it knows its fields, their order and its times, and need not read its document again."""
    c = F.col
    at = utc_micros(c("event_time"))
    payload = F.struct(
        F.struct(c("base_currency").alias("currency"), F.lit(2).alias("scale"), base_amount.cast("string").alias("value")).alias("base_amount"), "book_id", F.when(c("kind") == "EXECUTION", at).alias("execution_time"),
        "lifecycle_status", "product_type", c("kind_reference").alias("reference"), "side", "source_trade_id",
    )
    body = F.struct(
        at.alias("event_time"), c("lineage_id").alias("lineage_group_id"), c("kind").alias("observation_kind"), payload.alias("payload"), "portfolio_id", "source_business_key", "source_sequence", "source_system",
        "source_version", "tenant_id", _trader().alias("trader"),
    )
    general = F.regexp_replace(canonical_json(body), r"\}$", "")
    trader = F.element_at(F.array(*[F.lit(json.dumps(t)) for t in TRADERS]), (c("source_sequence") % 3 + 1).cast("int"))
    quick = _written(
        '{"event_time":"', at, '","lineage_group_id":"', c("lineage_id"), '","observation_kind":"', c("kind"), '","payload":{"base_amount":{"currency":"', c("base_currency"), '","scale":2,"value":"',
        base_amount.cast("string"), '"},"book_id":"', c("book_id"), '",', F.when(c("kind") == "EXECUTION", _written('"execution_time":"', at, '",')).otherwise(""), '"lifecycle_status":"', c("lifecycle_status"),
        '","product_type":"', c("product_type"), '","reference":"', c("kind_reference"), '","side":"', c("side"), '","source_trade_id":"', c("source_trade_id"), '"},"portfolio_id":"', c("portfolio_id"),
        '","source_business_key":"', c("source_business_key"), '","source_sequence":', c("source_sequence").cast("string"), ',"source_system":"', c("source_system"), '","source_version":"', c("source_version"),
        '","tenant_id":"', c("tenant_id"), '","trader":', trader,
    )
    text = F.coalesce(F.when(_plain_row(), quick), general)
    return sha256(F.concat(F.lit(f'{{"hash_standard":"{D.STANDARD}","observation":'), text, F.lit(f',"zeta_note":{NOTE_TEXT}}}}}')))


def documents(spark: SparkSession, d: str) -> DataFrame:
    """The deliveries as documents. Where a source got its base amount wrong, it declares the hash of the right one, as a system does that changes a record and not its fingerprint."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    # A trade has one wrong source at most; joined by trade, the deliveries stay where they are, and by hash, they are not sorted.
    wrong = corpus.truth(orders).where("effect = 'BASE_AMOUNT'").select("portfolio_id", "lineage_id", "target")
    rows = corpus.load(spark, d).join(wrong.hint("shuffle_hash"), ["portfolio_id", "lineage_id"], "left")
    more = F.when(F.col("target") == F.col("kind"), 1000).otherwise(0).cast("decimal(18,2)")
    declared = _declared((F.col("base_amount") - more).cast("decimal(18,2)"))
    return rows.withColumn("declared", declared).select(_document(F.col("base_amount"), F.col("declared")).alias("document"))


def document_content_hash(spark: SparkSession, d: str) -> DataFrame:
    found = files.verified_documents(documents(spark, d))
    # What the contract knows has been read with the document; only an unknown part is looked up in its text.
    return found.select(
        "observation_id", "calculated_hash", "hash_valid", F.col("payload.base_amount.value").alias("base_amount"), F.get_json_object("document", D.json_path("/zeta_note/list/2/a")).alias("unknown_value"),
        F.array_join("unknown_fields", ",").alias("unknown_fields"),
    )


def document_ingest_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Documents verified, cast to the engine's columns and classified: those whose hash is wrong are no first delivery of anything."""
    rows = files.flat_observations(files.verified_documents(documents(spark, d)))
    return ingest.classified(rows).groupBy("kind", "outcome").agg(F.count(F.lit(1)).alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"document_content_hash": document_content_hash, "document_ingest_outcomes": document_ingest_outcomes}

#: The canonical text of each document, written down from its columns.
_HASHED = r"""
, texts AS (
  SELECT *, strftime(make_timestamp(event_epoch * 1000000), '%Y-%m-%dT%H:%M:%S.%fZ') AS at_time, ['Zo\u00eb', '\u0141ukasz', '\ud83d\ude00 desk'][source_sequence % 3 + 1] AS trader_text FROM obs
), canon AS (
  SELECT *, 'sha256:' || sha256('{"hash_standard":"observation-canonical-json-v1","observation":{"event_time":"' || at_time || '","lineage_group_id":"' || lineage_id || '","observation_kind":"' || kind
    || '","payload":{"base_amount":{"currency":"' || base_currency || '","scale":2,"value":"' || base_amount || '"},"book_id":"' || book_id || '",'
    || CASE WHEN kind = 'EXECUTION' THEN '"execution_time":"' || at_time || '",' ELSE '' END || '"lifecycle_status":"' || lifecycle_status || '","product_type":"' || product_type || '","reference":"'
    || kind_reference || '","side":"' || side || '","source_trade_id":"' || source_trade_id || '"},"portfolio_id":"' || portfolio_id || '","source_business_key":"' || source_business_key
    || '","source_sequence":' || source_sequence || ',"source_system":"' || source_system || '","source_version":"' || source_version || '","tenant_id":"' || tenant_id || '","trader":"' || trader_text
    || '","zeta_note":{"list":[null,1,{"a":"x,\":null}"}],"\u00fcber":"na\u00efve \u007f back\\u00E9slash"}}}') AS calculated_hash,
    NOT (effect = 'BASE_AMOUNT' AND target = kind) AS hash_valid
  FROM texts
)
"""

ORACLES: dict[str, str] = {
    "document_content_hash": over(
        _HASHED + """SELECT observation_id, calculated_hash, hash_valid, base_amount::varchar AS base_amount, 'x,":null}' AS unknown_value, 'zeta_note,trader' AS unknown_fields FROM canon"""
    ),
    "document_ingest_outcomes": over(
        _HASHED
        + """, ranked AS (
          SELECT kind, hash_valid, calculated_hash, row_number() OVER same AS nth, first_value(calculated_hash) OVER same AS first_hash FROM canon
          WINDOW same AS (PARTITION BY tenant_id, portfolio_id, source_system, kind, source_business_key, source_version, hash_valid ORDER BY ingest_epoch, observation_id))
        SELECT kind, CASE WHEN NOT hash_valid THEN 'CONTENT_HASH_MISMATCH' WHEN nth = 1 THEN 'INSERTED' WHEN calculated_hash = first_hash THEN 'IDEMPOTENT_REPLAY' ELSE 'DUPLICATE_SOURCE_CONFLICT' END AS outcome,
          count(*) AS n FROM ranked GROUP BY 1, 2"""
    ),
}
