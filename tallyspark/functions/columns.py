"""Column builders: canonical JSON and hashes, decimal tolerance, lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .reference_data import Config

#: Exact for differences of amounts and rates; casts beyond it are flagged by validation first.
DECIMAL = "decimal(28,10)"


def lookup(key: Column, table: dict, otherwise: Column | None = None) -> Column:
    """A fixed table as a CASE over literals: no join, folded by the optimizer."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(None) if otherwise is None else otherwise)


def position(value: Column, order: tuple[str, ...]) -> Column:
    return lookup(value, {x: i for i, x in enumerate(order, 1)}, F.lit(len(order) + 1))


def sha256(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


#: Pieces of a JSON text: an escape of a code unit, any other escape (a backslash and what it stands before), printable characters, any other character.
_PIECES = r"(?s)\\u[0-9A-Fa-f]{4}|\\.|[ -\[\]-~]+|."


def ascii_only(text: Column) -> Column:
    """A JSON text with everything but printable ASCII as \\u escapes of UTF-16 units, all such escapes in lower case. An escaped backslash before a u is no escape."""

    def piece(x: Column) -> Column:
        units = F.lower(F.hex(F.encode(x, "UTF-16BE")))
        return F.when(x.rlike(r"^\\u"), F.lower(x)).when(x.rlike(r"^[ -~]"), x).otherwise(F.regexp_replace(units, "(.{4})", r"\\u$1"))

    def whole(t: Column) -> Column:
        # JSON holds no control characters but this one as they are; lengths and searches cost a fraction of a pattern.
        plain = (F.octet_length(t) == F.length(t)) & ~t.contains("\x7f") & ~t.contains("\\u")
        return F.when(plain, t).otherwise(F.array_join(F.transform(F.regexp_extract_all(t, F.lit(_PIECES), F.lit(0)), piece), ""))

    # An array of one text binds it: it is made once, and the check is one scan.
    return F.get(F.transform(F.array(text), whole), F.lit(0))


def canonical_json(document: Column, keep_nulls: bool = False) -> Column:
    """JSON text of a struct whose fields are in alphabetical order: compact, ASCII only, \\u escapes in lower case."""
    return ascii_only(F.to_json(document, {"ignoreNullFields": str(not keep_nulls).lower()}))


#: Whole texts that JSON holds as they are: printable ASCII without the quote and the backslash. The characters one by one, which a pattern looks up in a table; ranges are called in turn.
_PLAIN = "^[" + "".join(chr(x) if chr(x).isalnum() else f"\\{chr(x)}" for x in range(32, 127) if chr(x) not in '"\\') + r"]*\z"


def plain(*texts: Column) -> Column:
    """Whether JSON holds all these texts as they are; nulls count as empty."""
    return F.concat_ws("", *texts).rlike(_PLAIN)


def flat_json(names: tuple[str, ...]) -> Column:
    """``canonical_json`` of columns as texts, in the order of the names, without those that are null. Rows of plain characters are put together as they are, in compiled code; any other goes the general way."""
    texts = {n: F.col(n).cast("string") for n in names}
    # No function of higher order here: below one, nothing is compiled.
    quick = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":"'), t, F.lit('"')) for n, t in texts.items()]), F.lit("}"))
    return F.when(plain(*texts.values()), quick).otherwise(canonical_json(F.struct(*[t.alias(n) for n, t in texts.items()])))


def utc_micros(at: Column) -> Column:
    """Timestamp text with microseconds and Z; the session's time zone must be UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def offset_time(at: Column) -> Column:
    """Timestamp text with +00:00, microseconds only where there are some; the session's time zone must be UTC."""
    micros = F.date_format(at, "SSSSSS")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def opaque_id(prefix: str, *parts: Column | str) -> Column:
    """prefix and 32 hexadecimal digits of the hash of the parts, joined by a separator that none holds."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32))


def within_tolerance(expected: Column, observed: Column, mode: Column, value: Column) -> Column:
    """Inclusive: NONE is equality, ABSOLUTE_DECIMAL bounds the difference, RELATIVE_DECIMAL bounds it by a share of the expected value. Operands are decimals; an unknown mode fails the query."""
    gap = F.abs(expected.cast(DECIMAL) - observed.cast(DECIMAL))
    relative = F.abs(expected.cast(DECIMAL)) * value.cast("decimal(9,8)")
    unknown = F.raise_error(F.concat(F.lit("unknown tolerance mode "), mode)).cast("boolean")
    return F.when(mode == "ABSOLUTE_DECIMAL", gap <= value.cast(DECIMAL)).when(mode == "RELATIVE_DECIMAL", gap <= relative).when(mode == "NONE", gap == 0).otherwise(unknown)


def tolerance_of(config: Config, product: Column, field: str) -> tuple[Column, Column]:
    """(mode, value) columns of a field for each row's product."""
    rules = {p: rule for (p, f), rule in config.tolerances.items() if f == field}
    return lookup(product, {p: m for p, (m, _) in rules.items()}, F.lit("NONE")), lookup(product, {p: v for p, (_, v) in rules.items() if v is not None})
