"""File sources: observation documents (JSON), policies (JSON) and runbooks (markdown). Schemas are explicit, never inferred."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.documents import STANDARD, document_hash
from ..functions.validation import bad_format

AMOUNT = "struct<currency:string,value:string,scale:int>"
OBSERVATION = (
    "schema_version string, observation_id string, observation_kind string, entity_version int, tenant_id string, portfolio_id string, correlation_id string, source_system string, "
    "source_event_id string, source_business_key string, source_version string, content_hash string, event_time string, effective_time string, ingest_time string, source_sequence int, "
    "lineage_group_id string, actor struct<identity_type:string,actor_id:string>, supersedes_observation_id string, supersession_reason string, payload struct<"
    "product_type:string,settlement_rule_version:string,source_trade_id:string,base_currency:string,terms_currency:string,side:string,"
    f"base_amount:{AMOUNT},terms_amount:{AMOUNT},quoted_rate:struct<value:string,scale:int,orientation:string>,"
    "trade_date:string,value_date:string,counterparty_id:string,book_id:string,lifecycle_status:string,"
    "execution_id:string,execution_type:string,execution_status:string,execution_time:string,order_id:string,"
    "capture_id:string,capture_type:string,capture_status:string,capture_time:string,execution_reference:string,"
    "confirmation_id:string,confirmation_reference:string,confirmation_status:string,confirmation_time:string,fpml_profile:string,"
    "booking_record_id:string,booking_version:int,booking_status:string,last_updated_time:string,record_fingerprint:string>"
)


def observation_documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a file, parsed."""
    return parsed_documents(spark.read.text(path, wholetext=True).select(F.col("value").alias("document")))


def parsed_documents(raw: DataFrame) -> DataFrame:
    """raw (a column ``document``) with the fields of the contract, and ``unknown_fields``: top-level keys outside of it (a closed schema rejects them; null where the text is no JSON object)."""
    known = [f.split(" ")[0] for f in _top_level(OBSERVATION)]
    parsed = raw.withColumn("o", F.from_json("document", OBSERVATION, {"mode": "PERMISSIVE"})).withColumn("keys", F.json_object_keys("document"))
    return parsed.select(*raw.columns, F.array_except("keys", F.array(*map(F.lit, known))).alias("unknown_fields"), "o.*")


def document_rules() -> dict[str, Column]:
    """What would be lost when the text of parsed documents is cast: reported before ``flat_observations``. Decimals of more than 10 places are too long for the engine's arithmetic."""
    p = lambda c: F.col(f"payload.{c}")
    amounts = [p(f"{c}.value") for c in ("base_amount", "terms_amount", "quoted_rate")]
    long = [x.rlike(r"\.[0-9]{11,}\z") for x in amounts]
    bad = lambda values, name: reduce(or_, [bad_format(v, name) for v in values])
    return {
        "NOT_JSON": F.col("unknown_fields").isNull(),
        "UNKNOWN_FIELD": F.size("unknown_fields") > 0,
        "DECIMAL_FORMAT": bad(amounts, "decimal"),
        "DECIMAL_TOO_LONG": reduce(or_, [F.coalesce(x, F.lit(False)) for x in long]),
        "TIME_WITHOUT_OFFSET": bad([F.col(c) for c in ("event_time", "effective_time", "ingest_time")], "aware_timestamp"),
        "DATE_FORMAT": bad([p("trade_date"), p("value_date")], "date"),
    }


def _top_level(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, ch in enumerate(ddl + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(ddl[start:i].strip())
            start = i + 1
    return out


def flat_observations(documents: DataFrame) -> DataFrame:
    """Documents in the engine's columns; decimals and times are cast, malformed ones become null (``document_rules`` reports them)."""
    p = lambda c: F.col(f"payload.{c}")
    amount = lambda c: p(f"{c}.value").try_cast("decimal(28,10)").alias(c)
    at = lambda c: F.col(c).try_cast("timestamp").alias(c)
    reference = F.coalesce(p("execution_id"), p("capture_id"), p("confirmation_id"), p("booking_record_id"))
    return documents.select(
        "tenant_id", "portfolio_id", F.col("lineage_group_id").alias("lineage_id"), "observation_id", F.col("observation_kind").alias("kind"), "source_system", "source_business_key",
        p("source_trade_id").alias("source_trade_id"), "source_version", "source_sequence", p("product_type").alias("product_type"), p("settlement_rule_version").alias("settlement_rule_version"),
        p("base_currency").alias("base_currency"), p("terms_currency").alias("terms_currency"), p("side").alias("side"), amount("base_amount"), amount("terms_amount"), amount("quoted_rate"),
        p("trade_date").try_cast("date").alias("trade_date"), p("value_date").try_cast("date").alias("value_date"), p("counterparty_id").alias("counterparty_id"), p("book_id").alias("book_id"),
        p("lifecycle_status").alias("lifecycle_status"), reference.alias("kind_reference"), at("event_time"), at("ingest_time"), "supersedes_observation_id", "supersession_reason", "content_hash",
        F.unix_micros(F.col("ingest_time").try_cast("timestamp")).alias("arrival"), *[c for c in ("hash_valid",) if c in documents.columns],
    )


def verified_documents(raw: DataFrame, standard: str = STANDARD) -> DataFrame:
    """Documents (as text, or parsed) and ``calculated_hash``, ``hash_valid``: whether a document declares the hash that its whole semantic content has, unknown fields included."""
    parsed = raw if "unknown_fields" in raw.columns else parsed_documents(raw)
    parsed = parsed.withColumn("calculated_hash", document_hash(F.col("document"), standard))
    return parsed.withColumn("hash_valid", F.coalesce(F.col("content_hash") == F.col("calculated_hash"), F.lit(False)) & F.col("observation_id").isNotNull())


def policy(spark: SparkSession, path: str) -> DataFrame:
    """Field rules of a source-of-truth policy: field_path, owner, trusted_sources, source_precedence."""
    rule = "struct<field_path:string,owner:string,trusted_sources:array<string>,source_precedence:array<string>,conflict_outcome:string>"
    raw = spark.read.schema(f"policy_version string, content_hash string, field_rules array<{rule}>").json(path, multiLine=True)
    return raw.select("policy_version", F.explode("field_rules").alias("r")).select("policy_version", "r.*")


def runbook_sections(spark: SparkSession, path: str) -> DataFrame:
    """document_id, section_number, title, content: markdown cut at its level-two section headings."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"(RB-\d+)", 1).alias("document_id"), "value")
    parts = F.slice(F.split("value", r"(?m)^##\s+Section\s+"), 2, 1 << 30)
    cut = raw.select("document_id", F.explode(parts).alias("part"))
    head = r"^(\d+)\s+\x{2014}\s+([^\n]+)\n?"
    return cut.select(
        "document_id", F.regexp_extract("part", head, 1).cast("int").alias("section_number"), F.trim(F.regexp_extract("part", head, 2)).alias("title"), F.regexp_replace(F.regexp_replace("part", head, ""), r"\A\s+|\s+\z", "").alias("content")
    )
