"""Documents whose shape is not fixed: path walk, canonical text and content hash of JSON, over VARIANT.

A VARIANT keeps the fields of an object in the order of their names, at every depth, so its text is already sorted and compact. What a content hash leaves out or unifies is
then a matter of that text: fields of the delivery at the top, members that are null (of objects; items of lists stay), times in named fields (UTC, microseconds, Z), and all but printable ASCII
(``\\u`` escapes in lower case). Quotes inside of a string are always escaped in such a text, so patterns that begin at a quote after ``{`` or ``,`` or that read strings as a
whole can't be misled by what a string holds.

Defined cases: text that is no JSON, or has a key twice, or a named time without an offset, has no canonical text (null), so its hash never agrees; names sort by UTF-16 units; numbers are written
as VARIANT writes them (decimals without trailing zeros, powers of ten as doubles).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from hashlib import sha256 as digest

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import ascii_only, flat_json, sha256, utc_micros

# Fixed values of the hash standard: what a delivery adds to a document, and the names of fields that are times.
DELIVERY_FIELDS = ("content_hash", "correlation_id", "ingest_time", "observation_id", "source_event_id")
TIME_FIELDS = ("event_time", "effective_time", "execution_time", "capture_time", "confirmation_time", "last_updated_time")
#: Names the standard inside of what is hashed; a parameter, for data of another standard's name.
STANDARD = "observation-canonical-json-v1"
#: A whole JSON string.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: Members that are null: the first ones of an object go with the comma after them, all others with the one before.
_NULL_MEMBER = rf'(?<=\{{)(?:{_STRING}:null,)++|,?{_STRING}:null(?=[,}}])|({_STRING})'
#: A member that is a time, with the brace or comma before it, which a scan finds fast.
_TIME = rf'[{{,]"(?:{"|".join(TIME_FIELDS)})":"[^"\\]*"'
_OFFSET = r"^\d{4}-\d\d-\d\d[T ].*(?:Z|[+-]\d\d:\d\d)$"

#: The engine's columns that say what an observation is about, not how it was delivered.
CONTENT = (
    "base_amount", "base_currency", "book_id", "counterparty_id", "kind", "kind_reference", "lifecycle_status", "product_type", "quoted_rate", "side", "source_business_key", "source_trade_id",
    "source_version", "terms_amount", "terms_currency", "trade_date", "value_date",
)


def json_path(pointer: str) -> str:
    """``/payload/base_amount`` as a path of VARIANT; parts that are numbers are places in lists."""
    parts = [p for p in pointer.split("/") if p]
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in parts)


def path_value(document: Column, pointer: str, kind: str = "string") -> Column:
    """The value at a path of a VARIANT; null where there is none, or where it isn't of that type."""
    return F.try_variant_get(document, json_path(pointer), kind)


def _utc(member: Column) -> Column:
    """A member ``,"name":"time"`` with its time in UTC; null where the time has no offset or is none."""
    raw = F.regexp_extract(member, r':"([^"]*)"$', 1)
    at = F.when(raw.rlike(_OFFSET), raw.try_cast("timestamp"))
    return F.concat(F.regexp_extract(member, r'^(."[a-z_]+":)', 1), F.lit('"'), utc_micros(at), F.lit('"'))


def canonical_text(document: Column, leave_out: tuple[str, ...] = ()) -> Column:
    """Canonical text of an object (VARIANT) without some of its top-level fields."""
    fields = F.try_variant_get(document, "$", "map<string,variant>")
    kept = F.map_filter(fields, lambda k, _: ~k.isin(*leave_out)) if leave_out else fields
    name = lambda k: F.regexp_replace(F.to_json(F.array(k)), r"^\[|\]$", "")
    members = F.transform(F.map_entries(kept), lambda e: F.concat(name(e["key"]), F.lit(":"), F.to_json(e["value"])))
    text = F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))
    times = lambda t: F.aggregate(F.array_distinct(F.regexp_extract_all(t, F.lit(_TIME), F.lit(0))), t, lambda whole, member: F.replace(whole, member, _utc(member)))
    nulls = lambda t: F.when(t.contains(":null"), F.regexp_replace(t, _NULL_MEMBER, "$1")).otherwise(t)
    for step in (times, nulls, ascii_only):
        # An array of one text binds it, so that no step evaluates what came before more than once.
        text = F.get(F.transform(F.array(text), step), F.lit(0))
    return text


#: Times that both ways read alike.
_SIMPLE_TIME = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]{1,6})?(?:Z|[+-](?:0[0-9]|1[0-7]):[0-5][0-9])"
#: Beyond so many characters or containers a document goes the general way, whose reader has limits of its own.
_SIMPLE_LENGTH, _SIMPLE_CONTAINERS = 20_000, 500


def simple_texts(leave_out: tuple[str, ...] = ()) -> Callable[[list], list]:
    """A function that gives the ``canonical_text`` of those of its documents that Python's JSON surely writes alike, at a fraction of the cost; None for any other: those with fractions or long numbers, escaped
    surrogates, names beyond U+D7FF, names that are there twice, times in another form, long ones, and what is no JSON object. It goes to the workers by value."""

    def whole(digits: str) -> int:
        if len(digits) > 18 or digits == "-0":
            raise ValueError(digits)
        return int(digits)

    def no(text: str) -> None:
        raise ValueError(text)

    known: dict[str, str] = {}

    def in_utc(text: str) -> str:
        if text not in known:
            if re.fullmatch(_SIMPLE_TIME, text) is None:
                raise ValueError(text)
            if len(known) >= 1 << 16:
                known.clear()
            known[text] = datetime.fromisoformat(text).astimezone(UTC).isoformat(timespec="microseconds")[:-6] + "Z"
        return known[text]

    def members(pairs: list) -> dict:
        out = dict(pairs)
        names = "".join(out)
        if len(out) != len(pairs) or not names.isascii() and max(names) > "\ud7ff":
            raise ValueError("a name is there twice, or sorts in another way")
        for name in TIME_FIELDS:
            if isinstance(out.get(name), str):
                out[name] = in_utc(out[name])
        return {name: value for name, value in out.items() if value is not None} if None in out.values() else out

    def texts(documents: list) -> list:
        read = json.JSONDecoder(object_pairs_hook=members, parse_int=whole, parse_float=no, parse_constant=no).decode
        write = json.JSONEncoder(sort_keys=True, separators=(",", ":")).encode

        def text(document: str | None) -> str | None:
            if document is None or len(document) > _SIMPLE_LENGTH or document.count("{") + document.count("[") > _SIMPLE_CONTAINERS or "\\ud" in document or "\\uD" in document:
                return None
            try:
                fields = read(document)
            except (ValueError, OverflowError, RecursionError):
                return None
            if not isinstance(fields, dict):
                return None
            for name in leave_out:
                fields.pop(name, None)
            return write(fields)

        return [text(x) for x in documents]

    return texts


def _simple_hash(document: Column, before: str, after: str) -> Column:
    texts = simple_texts(DELIVERY_FIELDS)

    @F.arrow_udf("string")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if x is None else "sha256:" + digest((before + x + after).encode()).hexdigest() for x in texts(batch.to_pylist())], pa.string())

    return hashed(document)


def document_hash(document: Column, standard: str = STANDARD) -> Column:
    """The semantic content hash of an observation document (JSON text): all its fields, known or not, but those of the delivery. Most documents are read by ``simple_texts``; what it leaves open goes the general way."""
    before, after = f'{{"hash_standard":"{standard}","observation":', "}"
    text = canonical_text(F.try_parse_json(document), DELIVERY_FIELDS)
    return F.coalesce(_simple_hash(document, before, after), sha256(F.concat(F.lit(before), text, F.lit(after))))


def observation_content() -> Column:
    """What the content hash of an observation in the engine's columns is over: canonical JSON of the columns that are not null."""
    return flat_json(CONTENT)


#: Kinds of values that a closed schema tells apart.
KINDS = ("OBJECT", "ARRAY", "STRING", "NUMBER", "BOOLEAN", "NULL")


def kind_of(value: Column) -> Column:
    """The kind of a VARIANT's value."""
    named = F.schema_of_variant(value)
    other = F.when(named == "STRING", "STRING").when(named == "BOOLEAN", "BOOLEAN").when(named == "VOID", "NULL").otherwise("NUMBER")
    return F.when(named.startswith("OBJECT"), "OBJECT").when(named.startswith("ARRAY"), "ARRAY").otherwise(other)


_VALUES = "array<struct<path:string,value:variant>>"


def _below(level: Column) -> Column:
    """The values in the containers of a level (path, value); items of lists share the path of their list and ``[]``."""
    inside = lambda entries, x, name, value: F.transform(entries, lambda e: F.struct(F.concat(x["path"], F.lit("/"), name(e)).alias("path"), value(e).alias("value")))

    def values(x: Column) -> Column:
        kind, v = kind_of(x["value"]), x["value"]
        fields = inside(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), x, lambda e: e["key"], lambda e: e["value"])
        items = inside(F.try_variant_get(v, "$", "array<variant>"), x, lambda _: F.lit("[]"), lambda e: e)
        return F.when(kind == "OBJECT", fields).when(kind == "ARRAY", items).otherwise(F.array().cast(_VALUES))

    return F.flatten(F.transform(level, values))


def walked(documents: DataFrame, key: list[str], document: str, depth: int = 6) -> DataFrame:
    """key and ``_values`` of each document (VARIANT): path and kind of every value at all depths. What lies deeper than ``depth`` is one value of kind TOO_DEEP.

    A document is walked where it is, one depth after the other, so nothing is shuffled or kept, and a row comes out for each document.
    """
    rows = documents.select(*key, F.array(F.struct(F.lit("").alias("path"), F.col(document).alias("value"))).cast(_VALUES).alias("_0"))
    for i in range(depth):
        rows = rows.withColumn(f"_{i + 1}", _below(F.col(f"_{i}")))
    named = [F.transform(f"_{i + 1}", lambda x: F.struct(x["path"].alias("path"), kind_of(x["value"]).alias("kind"))) for i in range(depth)]
    deeper = F.filter(f"_{depth}", lambda x: F.schema_of_variant(x["value"]).rlike("^(OBJECT|ARRAY)<.+>"))
    return rows.select(*key, F.concat(*named, F.transform(deeper, lambda x: F.struct(x["path"].alias("path"), F.lit("TOO_DEEP").alias("kind")))).alias("_values"))


def schema_violations(documents: DataFrame, key: list[str], document: str, schema: dict[str, str], required: tuple[str, ...] = (), depth: int = 6) -> DataFrame:
    """key, reason, path of each document, once each: UNKNOWN_PATH of values that a closed schema (path: kind) does not know, TYPE of those of another kind (null is of any), MISSING_PATH of required ones that no
    value stands at, and NOT_AN_OBJECT."""
    known = F.create_map(*[F.lit(x) for pair in schema.items() for x in pair]) if schema else F.create_map().cast("map<string,string>")

    def reason(x: Column) -> Column:
        wanted = F.try_element_at(known, x["path"])
        return F.when(x["kind"] == "TOO_DEEP", "TOO_DEEP").when(wanted.isNull(), "UNKNOWN_PATH").when((x["kind"] != wanted) & (x["kind"] != "NULL"), "TYPE")

    found = lambda r, path: F.struct(r.alias("reason"), path.alias("path"))
    is_object = F.coalesce(F.schema_of_variant(document).startswith("OBJECT"), F.lit(False))
    rows = walked(documents.withColumn("_object", is_object), [*key, "_object"], document, depth)
    bad = F.array_distinct(F.filter(F.transform("_values", lambda x: found(reason(x), x["path"])), lambda x: x["reason"].isNotNull()))
    needed = F.array(*map(F.lit, required)).cast("array<string>")
    missing = F.transform(F.array_except(needed, F.transform("_values", lambda x: x["path"])), lambda p: found(F.lit("MISSING_PATH"), p))
    none = F.array(found(F.lit("NOT_AN_OBJECT"), F.lit("")))
    # Made as a column first: what a generator is given it evaluates uncompiled, and the outer form keeps it from being made twice.
    made = rows.select(*key, F.when(F.col("_object"), F.concat(bad, missing)).otherwise(none).alias("_found")).select(*key, F.explode_outer("_found").alias("_f"))
    return made.where("_f is not null").select(*key, "_f.reason", "_f.path")
