"""Canonical text and content hashes of documents against Python's own JSON, and hashes that tell apart what once ran together."""

import hashlib
import json
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import documents as D
from tallyspark.functions.columns import canonical_json
from tallyspark.operators import ingest, remediation
from tallyspark.operators.tables import Store
from tallyspark.sources import corpus, files


def plain(value, name=None):
    if name in D.TIME_FIELDS and isinstance(value, str):
        return datetime.fromisoformat(value.replace("Z", "+00:00")).astimezone(UTC).isoformat(timespec="microseconds").replace("+00:00", "Z")
    if isinstance(value, dict):
        return {k: plain(v, k) for k, v in value.items() if v is not None}
    return [plain(v) for v in value] if isinstance(value, list) else value


def plain_hash(document, standard=D.STANDARD):
    body = {"hash_standard": standard, "observation": plain({k: v for k, v in document.items() if k not in D.DELIVERY_FIELDS})}
    return "sha256:" + hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


PIECES = ["a", "Z", "é", "Ł", "\U0001f600", "\x7f", "\x1f", "\n", "\\", '"', ":null", ",", "{", "}", "\\u00E9", "/", " ", "event_times", "null"]


def tree(rng, depth=0):
    kind = rng.randrange(8 if depth < 4 else 5)
    if kind == 0:
        return None
    if kind == 1:
        return rng.choice([True, False, 0, -7, 123456789012, 1.5])
    if kind < 5:
        return "".join(rng.choice(PIECES) for _ in range(rng.randrange(6)))
    if kind == 5:
        return [tree(rng, depth + 1) for _ in range(rng.randrange(4))]
    out = {"".join(rng.choice(PIECES) for _ in range(rng.randrange(4))): tree(rng, depth + 1) for _ in range(rng.randrange(5))}
    if rng.random() < 0.5:
        out[rng.choice(D.TIME_FIELDS)] = rng.choice(["2026-03-02T10:00:00+02:00", "2026-03-02T10:00:00.5Z", "2026-12-31T23:59:59.123456-11:30", None, 7])
    return out


def test_hashes_are_those_of_python(spark):
    rng = random.Random(4)
    documents = [{"observation_id": "o", "content_hash": "x", "payload": tree(rng), "a": tree(rng), **{k: tree(rng) for k in rng.sample(PIECES, 3)}} for _ in range(400)]
    documents += [{}, {"content_hash": "x"}, {"a": None}, {"a": {"b": None}, "c": [None]}, {"x,": ":null,", "y": ":null}"}, {"event_time": "2026-03-02T10:00:00Z", "b": '"event_time":"1"'}]
    rows = spark.createDataFrame([(i, json.dumps(d, ensure_ascii=i % 2 == 0)) for i, d in enumerate(documents)], "i int, d string")
    got = {r["i"]: r["h"] for r in rows.select("i", D.document_hash(F.col("d")).alias("h")).collect()}
    assert [got[i] for i in range(len(documents))] == [plain_hash(d) for d in documents]
    one = rows.where("i = 3").select(D.document_hash(F.col("d"), "another-standard").alias("h")).first()["h"]
    assert one == plain_hash(documents[3], "another-standard")


@pytest.mark.parametrize("text", [None, "", "nope", "[1]", '"a"', '{"a":1,"a":2}', '{"event_time":"2026-03-02T10:00:00"}', '{"payload":{"capture_time":"soon"}}', '{"a":'])
def test_what_has_no_canonical_text_never_agrees(spark, text):
    row = spark.createDataFrame([(text,)], "d string").select(D.document_hash(F.col("d")).alias("h")).first()
    assert row["h"] is None


def test_paths(spark):
    document = {"payload": {"base_amount": {"value": "1.00"}, "list": [{"a": 1}, {"b": 2}], "odd.name": "x"}}
    v = F.parse_json(F.lit(json.dumps(document)))
    row = spark.range(1).select(
        D.path_value(v, "/payload/base_amount/value"), D.path_value(v, "/payload/list/1/b", "int"), D.path_value(v, "/payload/odd.name"), D.path_value(v, "/payload/none"),
        D.path_value(v, "/payload/list/9/b"), D.path_value(v, "/payload/base_amount/value", "int"),
    ).first()
    assert list(row) == ["1.00", 2, "x", None, None, None]


def test_canonical_json_of_odd_texts(spark):
    texts = ["\\u00E9", "\x7f", "é", "\\\\u00E9", "\x1f\\", "\U0001f600\\u", '"\\"', "plain"]
    rows = spark.createDataFrame([(t,) for t in texts], "a string")
    assert [r[0] for r in rows.select(canonical_json(F.struct("a"))).collect()] == [json.dumps({"a": t}, separators=(",", ":")) for t in texts]


def test_swapped_nulls_are_a_conflict(spark):
    orders = spark.range(2, 3).select(F.col("id").alias("o_orderkey"), F.lit(1).alias("o_custkey"), F.lit(10.0).alias("o_totalprice"), F.lit("2026-03-02").cast("timestamp_ntz").alias("o_orderdate"))
    one = corpus.deliveries(orders).where("kind = 'BOOKING'")
    with_hash = lambda df, n: df.withColumn("arrival", F.lit(n).cast("long")).withColumn("content_hash", ingest.sha256(D.observation_content()))
    none = F.lit(None).cast("string")
    a = with_hash(one.withColumns({"counterparty_id": none, "book_id": F.lit("b")}), 1)
    b = with_hash(one.withColumns({"counterparty_id": F.lit("b"), "book_id": none}), 2)
    assert {r["arrival"]: r["outcome"] for r in ingest.classified(a.unionByName(b)).collect()} == {1: "INSERTED", 2: "DUPLICATE_SOURCE_CONFLICT"}


def test_an_altered_envelope_is_found(spark):
    case = spark.sql("SELECT 'c' case_id, 't' tenant_id, 'p' portfolio_id, 'x' trade_id, '/payload/base_amount' field_path, '90|100' expected_old_value, '5' approved_value")
    at = F.lit("2026-01-01 10:00:00").cast("timestamp")
    made = remediation.envelopes(case, at, b"s")
    moved = made.withColumns({"expected_old_value": F.lit("90"), "approved_value": F.lit("100|5")})
    assert [remediation.verified_envelopes(x, at, b"s").first()["envelope_status"] for x in (made, moved)] == ["VALID", "TAMPERED"]


def documents_of(spark, folder):
    base = {
        "observation_id": "obs_1", "observation_kind": "BOOKING", "tenant_id": "tenant_demo", "portfolio_id": "portfolio_london", "lineage_group_id": "l1", "source_system": "MOCK_LEGACY_BOOKING",
        "source_business_key": "trade_1", "source_version": "1", "source_sequence": 3, "event_time": "2026-03-02T10:00:00+01:00", "ingest_time": "2026-03-02T09:00:05Z", "surprise": {"b": None, "a": "é"},
        "payload": {"source_trade_id": "trade_1", "base_amount": {"currency": "EUR", "value": "10.00", "scale": 2}},
    }
    good = base | {"content_hash": plain_hash(base)}
    replay = good | {"observation_id": "obs_2", "ingest_time": "2026-03-02T09:00:09Z"}
    changed = base | {"observation_id": "obs_3", "ingest_time": "2026-03-02T09:01:00Z", "surprise": {"a": "e"}}
    conflict = changed | {"content_hash": plain_hash(changed)}
    forged = good | {"observation_id": "obs_0", "ingest_time": "2026-03-02T08:00:00Z", "payload": base["payload"] | {"book_id": "b"}}
    for i, d in enumerate([good, replay, conflict, forged]):
        (folder / f"{i}.json").write_text(json.dumps(d, indent=1))
    return files.verified_documents(files.observation_documents(spark, str(folder)))


def test_documents_are_verified_before_they_are_classified(spark, tmp_path):
    (tmp_path / "in").mkdir()
    found = documents_of(spark, tmp_path / "in")
    rows = files.flat_observations(found)
    assert {r["observation_id"]: r["outcome"] for r in ingest.classified(rows).collect()} == {
        "obs_1": "INSERTED", "obs_2": "IDEMPOTENT_REPLAY", "obs_3": "DUPLICATE_SOURCE_CONFLICT", "obs_0": "CONTENT_HASH_MISMATCH",
    }
    store = Store(spark, str(tmp_path / "tables"))
    with pytest.raises(ingest.ContentHashError):
        store.ingest(rows)
    assert not store.exists("source_event_inbox")
    counted = {r["outcome"]: r["n"] for r in store.ingest(rows, on_mismatch="reject").collect()}
    assert counted == {"INSERTED": 1, "IDEMPOTENT_REPLAY": 1, "DUPLICATE_SOURCE_CONFLICT": 1, "CONTENT_HASH_MISMATCH": 1}
    assert [r["observation_id"] for r in store.read("source_event_inbox").collect()] == ["obs_1"]
    assert store.read("source_event_inbox").first()["supersession_reason"] is None
    again = {r["outcome"]: r["n"] for r in store.ingest(rows.where("hash_valid")).collect()}
    assert again == {"IDEMPOTENT_REPLAY": 2, "DUPLICATE_SOURCE_CONFLICT": 1}


def test_closed_schemas_at_all_depths(spark):
    texts = ['{"a":1,"b":{"c":"x","d":[1,2,{"e":null}]},"z":true}', '{"a":"1"}', "[1]", None, '{"a":null,"b":{"d":[]}}', '{"b":{"d":[[[[1]]]]}}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, d string").select("i", F.try_parse_json("d").alias("v"))
    schema = {"/a": "NUMBER", "/b": "OBJECT", "/b/c": "STRING", "/b/d": "ARRAY", "/b/d/[]": "NUMBER", "/b/d/[]/e": "STRING", "/b/d/[]/[]": "ARRAY"}
    got = {tuple(r) for r in D.schema_violations(rows, ["i"], "v", schema, ("/b",), 4).collect()}
    assert got == {
        (0, "TYPE", "/b/d/[]"), (0, "UNKNOWN_PATH", "/z"), (1, "TYPE", "/a"), (1, "MISSING_PATH", "/b"), (2, "NOT_AN_OBJECT", ""), (3, "NOT_AN_OBJECT", ""), (5, "TYPE", "/b/d/[]"), (5, "TOO_DEEP", "/b/d/[]/[]"),
    }
    assert D.schema_violations(rows.limit(0), ["i"], "v", schema).count() == 0


def test_simple_documents_are_read_as_the_general_way_does(spark):
    """each document went through patterns and functions of higher order, at half a millisecond."""
    rng = random.Random(5)
    texts = [json.dumps({"payload": tree(rng), "a": tree(rng), "content_hash": "x"}, ensure_ascii=i % 2 == 0) for i in range(300)]
    texts += [
        '{"a":1.0}', '{"a":1e2}', '{"a":-0}', '{"a":1234567890123456789012}', '{"a":NaN}', '{"a":"\\ud800"}', '{"a":"\\uD83D\\uDE00"}', '{"\U0001f600":1,"\uffee":2}', '{"a":1,"a":1}', '{"a":null,"a":1}', '{"a":1} x', " {} ", "[]", "1", "",
        '{"event_time":"2026-03-02"}', '{"event_time":"2026-03-02T24:00:00Z"}', '{"event_time":"2026-03-02T10:00:00+18:30"}', '{"event_time":"2026-02-30T10:00:00Z"}', '{"event_time":"0001-01-01T00:00:00+01:00"}',
        '{"event_time":"2026-03-02 10:00:00Z"}', '{"x":{"event_time":"2026-03-02T10:00:00.1-00:30"}}', '{"a":' + "[" * 1200 + "]" * 1200 + "}", '{"a":"' + "x" * 30_000 + '"}', '{"a":"\t"}', '{"a":"\x7f\\u00E9\\\\u00E9"}',
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, d string")
    general = {r["i"]: r["t"] for r in rows.select("i", D.canonical_text(F.try_parse_json("d"), D.DELIVERY_FIELDS).alias("t")).collect()}
    simple = D.simple_texts(D.DELIVERY_FIELDS)(texts)
    assert [t for i, t in enumerate(simple) if t is not None and t != general[i]] == []
    assert sum(t is not None for t in simple) > 150 and D.simple_texts()([None]) == [None]


def test_documents_of_the_corpus_go_the_simple_way(spark):
    from tallyspark.plans import document_queries

    orders = "/root/testdata/sf0.001"
    texts = [r["document"] for r in document_queries.documents(spark, orders).limit(500).collect()]
    assert None not in D.simple_texts(D.DELIVERY_FIELDS)(texts)


def test_documents_put_together_are_those_of_the_general_way(spark, monkeypatch):
    """documents and the hashes they declare were made of structs, whose text was then taken apart for escapes."""
    from tallyspark.plans import document_queries

    written = lambda: sorted(r["document"] for r in document_queries.documents(spark, "/root/testdata/sf0.001").collect())
    quick = written()
    monkeypatch.setattr(document_queries, "_plain_row", lambda: F.lit(False))
    assert quick == written() and len(quick) > 6000
