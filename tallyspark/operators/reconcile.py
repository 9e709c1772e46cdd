"""The evaluator: observations of a trade -> canonical state, linkage and breaks in eight families.

One shuffle by trade serves everything: a trade's observations are gathered once, in the engine's order, as an array of a few rows, and all rules are array expressions over it; tables of rules
are literals. Queries that need little of it have the rest pruned. A trade's observations meet in one task, as its rules compare them all; they are few by nature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import canonical_json, lookup, offset_time, position, sha256, tolerance_of, within_tolerance
from ..functions.reference_data import (
    CONFIRMATION_FIELDS,
    CONFIRMATION_FIRST,
    CONFIRMATION_TRUSTED,
    DEADLINE_RANK,
    EVIDENCE_ROLES,
    EXECUTION_FIELDS,
    EXECUTION_FIRST,
    EXECUTION_TRUSTED,
    FAMILIES,
    KINDS,
    MISSING_SEVERITY,
    REQUIRED_KINDS,
    SEVERITY_RANK,
    Config,
)

TRADE = ("tenant_id", "portfolio_id", "lineage_id")
#: (family, field, value type) of the compared payload fields.
COMPARED = (
    ("CURRENCY_PAIR_OR_SIDE_MISMATCH", "base_currency", "CURRENCY"),
    ("CURRENCY_PAIR_OR_SIDE_MISMATCH", "terms_currency", "CURRENCY"),
    ("CURRENCY_PAIR_OR_SIDE_MISMATCH", "side", "SIDE"),
    ("ECONOMIC_VALUE_MISMATCH", "base_amount", "DECIMAL"),
    ("ECONOMIC_VALUE_MISMATCH", "terms_amount", "DECIMAL"),
    ("ECONOMIC_VALUE_MISMATCH", "quoted_rate", "DECIMAL"),
    ("TRADE_OR_VALUE_DATE_MISMATCH", "trade_date", "DATE"),
    ("TRADE_OR_VALUE_DATE_MISMATCH", "value_date", "DATE"),
)
#: What identifies an observation wherever one is pointed at.
REFERENCE = ("observation_id", "source_version", "content_hash")


def unite(inbox: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Authoritative rows, then conflicting ones; ``src_ord`` keeps that order."""
    return inbox.withColumn("src_ord", F.lit(0)).unionByName(quarantined.withColumn("src_ord", F.lit(1)), allowMissingColumns=True)


def without_superseded(observations: DataFrame) -> DataFrame:
    """Observations that no other of the same trade supersedes. A window over the trade, whose superseded ids are few, so that the observations are made once and keep their partitioning."""
    gone = F.collect_set("supersedes_observation_id").over(Window.partitionBy(*TRADE))
    kept = ~F.coalesce(F.array_contains("_gone", F.col("observation_id")), F.lit(False))
    return observations.withColumn("_gone", gone).where(kept).drop("_gone")


def ordering() -> list[Column]:
    """The engine's order of a trade's observations."""
    return [position(F.col("kind"), KINDS).alias("kind_rank"), *map(F.col, ("source_sequence", "observation_id", "source_version", "content_hash"))]


def version_number(version: Column) -> Column:
    return version.cast("decimal(19,0)")


def first_where(rows: Column | str, holds: Callable[[Column], Column]) -> Column:
    """The first element that a predicate holds of, or null."""
    return F.try_element_at(F.filter(rows, holds), F.lit(1))


def _each(field: str) -> Column:
    return F.transform("obs", lambda x: x[field])


def _mode_of_keys() -> Column:
    """The business key that most observations have; of equally frequent ones the first seen."""
    def key(k: Column) -> Column:
        mine = F.filter("obs", lambda x: x["source_business_key"].eqNullSafe(k))
        seen = F.array_min(F.transform(mine, lambda x: F.struct(x["src_ord"], x["source_sequence"], x["observation_id"])))
        return F.struct((-F.size(mine)).alias("n"), seen.alias("seen"), k.alias("key"))

    several = F.array_min(F.transform(F.array_distinct(_each("source_business_key")), key))["key"]
    sole = F.get("obs", F.lit(0))["source_business_key"]
    return F.when(F.size(F.array_distinct(_each("source_business_key"))) == 1, sole).otherwise(several)


def _winner(order: tuple[str, ...]) -> Column:
    """The observation that a field is taken from: of those that name the trade as business key or in the payload, the first system of the policy's order, then the highest version."""
    def ranked(x: Column) -> Column:
        place = position(x["source_system"], order)
        return F.struct(place.alias("place"), (-version_number(x["source_version"])).alias("version"), x["observation_id"].alias("id"), x["content_hash"].alias("hash"), x.alias("row"))

    return F.array_min(F.transform("_named", ranked))["row"]


def _names_trade(x: Column) -> Column:
    return (x["source_business_key"] == F.col("trade_id")) | F.coalesce(x["source_trade_id"] == F.col("trade_id"), F.lit(False))


def _listed(observations: DataFrame, more: tuple[str, ...]) -> tuple[DataFrame, Column]:
    """Observations, and the list of those of a trade as an aggregate."""
    if "src_ord" not in observations.columns:
        observations = observations.withColumn("src_ord", F.lit(0))
    fields = ("kind", "source_system", "source_business_key", "source_trade_id", "ingest_time", "src_ord", *EXECUTION_FIELDS, *CONFIRMATION_FIELDS)
    return observations, F.collect_list(F.struct(*ordering(), *fields, *more))


def gathered(observations: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """One row a trade: ``obs``, its observations in the engine's order (with more of their columns if wanted), and ``gone``, the ids that they supersede."""
    observations, listed = _listed(observations, more)
    gone = [F.collect_set("supersedes_observation_id").alias("gone")] if "supersedes_observation_id" in observations.columns else []
    return observations.groupBy(*TRADE).agg(F.sort_array(listed).alias("obs"), *gone)


def corrected(rows: DataFrame, corrections: DataFrame) -> DataFrame:
    """Gathered trades with ``obs_after``: their observations and corrections without what is superseded, null where that is what they were before. ``replaced`` has the new id of each corrected observation.

    Few trades are corrected; the others are the same for a run before and after, so what is made of them need not be made again. Trades of which nothing is left go.
    """
    corrections, listed = _listed(corrections, ())
    pair = F.when(F.col("supersedes_observation_id").isNotNull(), F.struct("supersedes_observation_id", "observation_id"))
    new = corrections.groupBy(*TRADE).agg(listed.alias("_new"), F.collect_list(pair).alias("_pairs"))
    ids = F.concat("gone", F.coalesce(F.transform("_pairs", lambda p: p["supersedes_observation_id"]), F.array().cast("array<string>")))
    left = lambda x: ~F.coalesce(F.array_contains("_ids", x["observation_id"]), F.lit(False))
    after = F.sort_array(F.filter(F.when(F.col("_new").isNull(), F.col("obs")).otherwise(F.concat("obs", "_new")), left))
    # By hash: corrections are few, and gathered trades, which are wide, are not sorted.
    joined = rows.join(new.hint("shuffle_hash"), list(TRADE), "left").withColumn("_ids", ids)
    joined = joined.withColumn("obs_after", F.when(F.col("_new").isNotNull() | (F.size("_ids") > 0), after)).withColumn("replaced", F.map_from_entries("_pairs"))
    return joined.where("obs_after is null or size(obs_after) > 0").drop("_new", "_pairs", "_ids")


def trade_rows(observations: DataFrame, config: Config | None = None) -> DataFrame:
    """One row a trade with everything the families need."""
    return evaluated(gathered(observations).drop("gone"), config)


def evaluated(rows: DataFrame, config: Config | None = None) -> DataFrame:
    """Gathered trades (a row with ``obs`` each) with everything the families need."""
    config = config or Config()
    rows = rows.withColumn("trade_id", _mode_of_keys()).withColumn("_named", F.filter("obs", _names_trade))
    rows = rows.withColumns(
        {
            "by_execution": _winner(EXECUTION_FIRST),
            "by_confirmation": _winner(CONFIRMATION_FIRST),
            "n_observations": F.size("obs"),
            "watermark": F.array_max(_each("ingest_time")),
            "kinds": F.array_distinct(_each("kind")),
            "payload_trades": F.array_distinct(_each("source_trade_id")),
            "first_observation": F.get("obs", F.lit(0)),
            "foreign_key": F.exists("obs", lambda x: x["source_business_key"] != F.col("trade_id")),
            "bad_status": first_where("obs", lambda x: ~_valid_status(x, config)),
        }
    ).drop("_named")
    # Most trades agree in all fields: one comparison tells that, and no field is searched.
    agreed = F.size(F.array_distinct(F.transform("obs", lambda x: F.struct(*[x[name].alias(name) for _, name, _ in COMPARED])))) == 1
    rows = rows.withColumn("_agreed", agreed)
    differs = {f"off_{name}": F.when(~F.col("_agreed"), _first_off(name, kind, config)) for _, name, kind in COMPARED}
    return linkage(rows.withColumns(differs).drop("_agreed"))


def _valid_status(x: Column, config: Config) -> Column:
    return F.coalesce(x["lifecycle_status"] == lookup(x["kind"], config.statuses), F.lit(False))


def _first_off(name: str, kind: str, config: Config) -> Column:
    """The first observation, in order, whose value differs from that of the execution-first winner."""
    winner = F.col("by_execution")

    def off(x: Column) -> Column:
        if kind == "DECIMAL":
            # Equal values are within any tolerance; most are equal.
            differs = (winner[name] != x[name]) & ~within_tolerance(winner[name], x[name], *tolerance_of(config, winner["product_type"], name))
        else:
            differs = winner[name] != x[name]
        return (x["observation_id"] != winner["observation_id"]) & differs

    return first_where("obs", off)


def linkage(trade_row: DataFrame) -> DataFrame:
    """decision, reason_code, candidates, chosen_trade_id from n_observations, payload_trades, foreign_key and trade_id of each trade."""
    many = (F.col("n_observations") > 4) & (F.size("payload_trades") > 1)
    foreign = F.col("foreign_key")
    return trade_row.select(
        "*",
        F.when(many, "AMBIGUOUS").when(foreign, "UNMATCHED").otherwise("ACCEPTED").alias("decision"),
        F.when(many, "MULTIPLE_ELIGIBLE_CANDIDATES").when(foreign, "NO_ELIGIBLE_CANDIDATE").otherwise("EXACT_DETERMINISTIC_KEY").alias("reason_code"),
        F.when(many, F.array_sort("payload_trades")).when(foreign, F.array().cast("array<string>")).otherwise(F.array("trade_id")).alias("candidates"),
        F.when(~many & ~foreign, F.col("trade_id")).alias("chosen_trade_id"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """The observations of trade rows again, one a row, with their place in the engine's order (``ordinal``) and their trade."""
    return rows.select(*TRADE, "trade_id", F.posexplode("obs").alias("_at", "o")).select(*TRADE, "trade_id", (F.col("_at") + 1).alias("ordinal"), "o.*")


FACT = (
    "struct<family:string,group_key:string,field_path:string,value_type:string,expected_value:string,observed_value:string,"
    "expected:struct<observation_id:string,source_version:string,content_hash:string>,observed:struct<observation_id:string,source_version:string,content_hash:string>,"
    "severity:string,deadline_status:string,expected_by:timestamp,source_ids:array<string>>"
)


def reference(x: Column) -> Column:
    """An observation as what points at it; null for none."""
    return F.when(x.isNotNull(), F.struct(*[x[f].alias(f) for f in REFERENCE]))


def source_reference(x: Column, tenant: Column, portfolio: Column) -> Column:
    """An observation as a break or an envelope refers to it, with its own scope."""
    return F.struct(
        x["observation_id"].alias("source_observation_id"), x["kind"].alias("observation_kind"), x["source_system"].alias("source_system"), x["source_business_key"].alias("source_business_key"),
        tenant.alias("source_tenant_id"), portfolio.alias("source_portfolio_id"), x["source_version"].alias("source_version"), x["content_hash"].alias("content_hash"),
    )


def _fact(family: str, path: str, kind: str, expected: Column, observed: Column, sources: tuple[Column, Column], **more: Column) -> Column:
    """One comparison of a break. sources: the expected and the observed observation."""
    none = F.lit(None).cast("timestamp")
    return F.struct(
        F.lit(family).alias("family"), more.get("group", F.lit("")).alias("group_key"), F.lit(path).alias("field_path"), F.lit(kind).alias("value_type"),
        expected.cast("string").alias("expected_value"), observed.cast("string").alias("observed_value"), sources[0].alias("expected"), sources[1].alias("observed"),
        more.get("severity", F.lit(FAMILIES[family][1])).alias("severity"), more.get("deadline", F.lit("NO_CONFIGURED_DEADLINE")).alias("deadline_status"),
        more.get("expected_by", none).alias("expected_by"), more.get("source_ids", F.transform("obs", lambda x: x["observation_id"])).alias("source_ids"),
    ).cast(FACT)


def _if(holds: Column, fact: Column) -> Column:
    """An array of the fact, or an empty one. Rules are put together as arrays: a filter over all of them would be a function of higher order, below which nothing is compiled."""
    return F.when(holds, F.array(fact)).otherwise(F.array()).cast(f"array<{FACT}>")


def _missing(config: Config, at: Column) -> list[Column]:
    product, out = F.col("by_execution.product_type"), []
    nobody = F.lit(None).cast("struct<observation_id:string,source_version:string,content_hash:string>")
    for kind in REQUIRED_KINDS:
        seconds = lookup(product, {p: s for (p, k), s in config.windows.items() if k == kind}, F.lit(0))
        due = F.col("watermark") + F.make_dt_interval(secs=seconds)
        fact = _fact(
            "MISSING_REQUIRED_SOURCE", f"/source/{kind.lower()}_observation", "ABSENCE", F.lit("present"), F.lit("absent_after_watermark"), (nobody, reference(F.col("first_observation"))),
            group=F.lit(kind), severity=F.lit(MISSING_SEVERITY[kind]), deadline=F.when(at > due, "OVERDUE").otherwise("DUE"), expected_by=due,
        )
        out.append(_if(~F.array_contains("kinds", kind) & (at >= due), fact))
    return out


def _unlinked() -> Column:
    first, n = reference(F.col("first_observation")), F.size("candidates").cast("string")
    fact = _fact("AMBIGUOUS_OR_UNMATCHED_LINKAGE", "/linkage/trade_id", "COUNT", F.lit("1"), F.when(n == "1", "0").otherwise(n), (first, first))
    return _if(F.col("decision") != "ACCEPTED", fact)


def _compared(families: tuple[str, ...]) -> list[Column]:
    winner, out = F.col("by_execution"), []
    for family, name, kind in (c for c in COMPARED if c[0] in families):
        off = F.col(f"off_{name}")
        out.append(_if(off.isNotNull(), _fact(family, f"/payload/{name}", kind, winner[name], off[name], (reference(winner), reference(off)))))
    return out


def _lifecycle(config: Config) -> Column:
    """The first invalid status against the first valid one of another observation, else a different one, else any other."""
    bad = F.col("bad_status")
    another = lambda x: x["observation_id"] != bad["observation_id"]
    one = F.coalesce(
        first_where("obs", lambda x: another(x) & _valid_status(x, config)),
        first_where("obs", lambda x: another(x) & (x["lifecycle_status"] != bad["lifecycle_status"])),
        first_where("obs", another),
    )
    expected = F.when(one["lifecycle_status"] == bad["lifecycle_status"], lookup(one["kind"], config.statuses)).otherwise(one["lifecycle_status"])
    statuses = F.array_distinct(_each("lifecycle_status"))
    settled = (F.size(statuses) == 1) & F.get(statuses, F.lit(0)).isin("AMENDED", "CANCELLED")
    sources = (reference(one), reference(bad))
    fact = _fact("LIFECYCLE_STATUS_MISMATCH", "/payload/lifecycle_status", "LIFECYCLE_STATUS", expected, bad["lifecycle_status"], sources)
    return _if(bad.isNotNull() & ~settled & one.isNotNull(), fact)


def _duplicates() -> Column:
    """Same source identity and version with different content: first against second in order, one break a group."""
    identity = lambda x: F.struct(x["kind"], x["source_business_key"], x["source_version"])

    def fact(key: Column) -> Column:
        same = F.filter("obs", lambda x: identity(x) == key)
        first, second = F.get(same, F.lit(0)), F.get(same, F.lit(1))
        found = _fact(
            "DUPLICATE_SOURCE_CONFLICT", "/source/content_hash", "CONTENT_HASH", first["content_hash"], second["content_hash"], (reference(first), reference(second)),
            group=F.concat_ws("/", first["kind"], first["source_business_key"], first["source_version"]), source_ids=F.transform(same, lambda x: x["observation_id"]),
        )
        return F.when(F.size(F.array_distinct(F.transform(same, lambda x: x["content_hash"]))) > 1, found)

    keys = F.array_distinct(F.transform("obs", identity))
    none = F.array().cast(f"array<{FACT}>")
    return F.when(F.size(keys) < F.size("obs"), F.array_compact(F.transform(keys, fact))).otherwise(none)


def facts(
    rows: DataFrame, config: Config | None = None, evaluated_at: Column | None = None, outside: str = "raise", families: tuple[str, ...] = tuple(FAMILIES), clean: bool = False, more: tuple[str, ...] = ()
) -> DataFrame:
    """Break facts, one row for each break and comparison, of trade rows. Without ``evaluated_at`` a trade is evaluated at its watermark. Only the rules of ``families`` are evaluated. With ``clean`` a trade
    without facts has a row whose family is null, so that what counts or lists all trades need not meet them again; ``more`` are further columns of the trade.

    A trade evaluated outside of the configuration's effective interval fails the query, or has no facts with ``outside="skip"``.
    """
    config = config or Config()
    rows = rows.withColumn("evaluated_at", F.col("watermark") if evaluated_at is None else evaluated_at)
    at = F.col("evaluated_at")
    effective = config.effective(at)
    if outside == "skip":
        rows = rows.where(effective)
    else:
        stop = F.raise_error(F.lit("the configuration is not effective at the time of evaluation")).cast("timestamp")
        rows = rows.withColumn("evaluated_at", F.when(effective, at).otherwise(stop))
    found = _compared(families)
    if "MISSING_REQUIRED_SOURCE" in families:
        found = [*_missing(config, at), *found]
    if "AMBIGUOUS_OR_UNMATCHED_LINKAGE" in families:
        found.append(_unlinked())
    if "LIFECYCLE_STATUS_MISMATCH" in families:
        found.append(_lifecycle(config))
    if "DUPLICATE_SOURCE_CONFLICT" in families:
        found.append(_duplicates())
    every = F.concat(*found) if found else F.array().cast(f"array<{FACT}>")
    product = F.col("by_execution.product_type").alias("product_type")
    # Made as a column first: what a generator is given it evaluates uncompiled. The outer form keeps the optimizer from asking for its size beforehand, which would make it twice.
    made = rows.select(*TRADE, "trade_id", product, "watermark", "evaluated_at", *more, every.alias("_facts")).select(*TRADE, "trade_id", "product_type", "watermark", "evaluated_at", *more, F.explode_outer("_facts").alias("fact"))
    return (made if clean else made.where("fact is not null")).select(
        *TRADE, "trade_id", "product_type", "watermark", "evaluated_at", *more, "fact.*",
        F.col("fact.expected.observation_id").alias("expected_observation_id"), F.col("fact.observed.observation_id").alias("observed_observation_id"),
        lookup(F.col("fact.family"), {f: c for f, (c, _) in FAMILIES.items()}).alias("condition_code"),
    )


def reconcile(observations: DataFrame, config: Config | None = None, evaluated_at: Column | None = None, outside: str = "raise", families: tuple[str, ...] = tuple(FAMILIES)) -> DataFrame:
    """Break facts of all trades of the observations."""
    config = config or Config()
    if problems := config.problems():
        raise ValueError(f"configuration: {', '.join(problems)}")
    return facts(trade_rows(observations, config), config, evaluated_at, outside, families)


def breaks(fact_rows: DataFrame, run_id: str, more: tuple[str, ...] = (), by: tuple[str, ...] = (), gather: tuple[str, ...] = ()) -> DataFrame:
    """One row a break: its comparisons in field order, identity, priority. Ids are hashes of the canonical JSON of run, family, sources and comparisons, so reruns agree. ``more`` are further columns of its trade,
    ``by`` those that tell apart evaluations of one trade, ``gather`` columns of its facts to be listed. A row without a family stands for a trade without breaks and stays one, without an id."""
    side = lambda name: (F.col(f"{name}.observation_id").alias(f"{name}_observation_id"), F.col(f"{name}.source_version").alias(f"{name}_source_version"))
    line = F.struct("field_path", "value_type", "expected_value", "observed_value", *side("expected"), *side("observed"))
    grouped = fact_rows.groupBy(*TRADE, *by, "trade_id", "product_type", "family", "group_key", "condition_code").agg(
        F.sort_array(F.collect_list(line)).alias("comparisons"), F.first("severity").alias("severity"), F.first("deadline_status").alias("deadline_status"),
        F.first("evaluated_at").alias("detected_at"), F.first("source_ids").alias("source_ids"), *[F.first(c).alias(c) for c in more],
        *[F.collect_list(c).alias(c) for c in gather],
    )
    in_order = lambda x: F.struct(*[x[f].alias(f) for f in sorted(COMPARISON)])
    document = F.struct(F.transform("comparisons", in_order).alias("comparisons"), "family", F.lit(run_id).alias("run_id"), "source_ids")
    identity = F.sha2(canonical_json(document, keep_nulls=True), 256)
    order = F.struct(
        F.lit(2).alias("materiality"), lookup(F.col("severity"), SEVERITY_RANK).alias("severity"), lookup(F.col("deadline_status"), DEADLINE_RANK).alias("deadline"), F.lit(0).alias("age")
    )
    return grouped.select(
        "*", F.lit(run_id).alias("run_id"), F.lit(1).alias("break_version"), F.lit("OPEN").alias("state"), F.concat(F.lit("break_"), F.lower("family"), F.lit("_"), F.substring(identity, 1, 40)).alias("break_id"),
        order.alias("priority_key"),
    )


COMPARISON = (
    "field_path", "value_type", "expected_value", "observed_value", "expected_observation_id", "expected_source_version", "observed_observation_id", "observed_source_version",
)


def evidence(fact_rows: DataFrame, run_id: str, config: Config | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Evidence records: for each fact one record per role, bound to its source observation; the id is of the hash of a document that names run, configuration and source. ``more`` are further columns of the fact."""
    rows = fact_rows.select("*", F.posexplode(lookup_array(F.col("family"), EVIDENCE_ROLES)).alias("place", "role"))
    rows = rows.withColumn("source", _proof_source(F.col("place")))
    digest = _proof_digest(F.col("place"), F.col("role"), F.col("source"), run_id, config or Config())
    return rows.select(
        *TRADE, "trade_id", "family", "group_key", "field_path", "role", F.col("source.observation_id").alias("source_observation_id"),
        _evidence_id(F.col("role"), digest).alias("evidence_id"), F.concat(F.lit("sha256:"), digest).alias("content_hash"), *more,
    )


def _proof_source(place: Column) -> Column:
    return F.when((place == 0) & F.col("expected").isNotNull(), F.col("expected")).otherwise(F.col("observed"))


def _proof_digest(place: Column, role: Column, source: Column, run_id: str, config: Config) -> Column:
    document = F.struct(
        offset_time(F.col("evaluated_at")).alias("captured_at"), F.lit(config.content_hash()).alias("config_hash"), "field_path", role.alias("role"), F.lit(run_id).alias("run_id"),
        F.concat_ws(":", "group_key", place, "expected_value", "observed_value").alias("salt"), source["content_hash"].alias("source_content_hash"),
        source["observation_id"].alias("source_observation_id"), source["source_version"].alias("source_version"),
    )
    return F.sha2(canonical_json(document, keep_nulls=True), 256)


def _evidence_id(role: Column, digest: Column) -> Column:
    return F.concat(F.lit("evidence_"), F.lower(role), F.lit("_"), F.substring(digest, 1, 24))


def evidence_items(run_id: str, config: Config | None = None) -> Column:
    """The evidence of a fact as structs of evidence_id and source_observation_id, in the order of its roles: what ``evidence`` gives as rows, where a fact's evidence stays with it."""
    def item(place: int) -> Column:
        role, source = F.get(lookup_array(F.col("family"), EVIDENCE_ROLES), F.lit(place)), _proof_source(F.lit(place))
        digest = _proof_digest(F.lit(place), role, source, run_id, config or Config())
        one = F.struct(_evidence_id(role, digest).alias("evidence_id"), source["observation_id"].alias("source_observation_id"))
        return F.when(role.isNotNull(), F.array(one)).otherwise(F.array().cast("array<struct<evidence_id:string,source_observation_id:string>>"))

    return F.concat(*map(item, range(max(map(len, EVIDENCE_ROLES.values())))))


def lookup_array(key: Column, table: dict[str, tuple[str, ...]]) -> Column:
    out = None
    for k, v in table.items():
        value = F.array(*map(F.lit, v))
        out = F.when(key == k, value) if out is None else out.when(key == k, value)
    return out


def source_set() -> Column:
    """The locked source set of a trade row in its own order: kind, system, business key, version as a number, id, hash."""
    order = lambda x: F.struct(
        x["kind"].alias("kind"), x["source_system"].alias("source_system"), x["source_business_key"].alias("source_business_key"), version_number(x["source_version"]).alias("version"),
        x["observation_id"].alias("observation_id"), x["content_hash"].alias("content_hash"), x["source_version"].alias("source_version"),
    )
    return F.sort_array(F.transform("obs", order))


def canonical_states(rows: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Canonical state of each trade: 13 fields, each from its field's winner. The hash is of the canonical JSON of the fields, nulls kept, and of the source set. ``more`` are further columns of the trade."""
    fields = [F.col(f"by_execution.{f}").alias(f) for f in EXECUTION_FIELDS] + [F.col(f"by_confirmation.{f}").alias(f) for f in CONFIRMATION_FIELDS]
    state = rows.select(*TRADE, "trade_id", F.col("watermark").alias("source_watermark"), F.lit("1").alias("canonical_state_version"), *fields, source_set().alias("source_version_set"), *more)
    item = lambda x: F.struct(*[x[f].alias(f) for f in ("content_hash", "kind", "observation_id", "source_business_key", "source_system", "source_version")])
    texts = F.struct(*[F.col(f).cast("string").alias(f) for f in sorted((*EXECUTION_FIELDS, *CONFIRMATION_FIELDS))])
    document = F.struct(F.transform("source_version_set", item).alias("source_version_set"), texts.alias("state"))
    return state.withColumn("state_hash", sha256(canonical_json(document, keep_nulls=True)))


def versioned(states: DataFrame, stored: DataFrame | None) -> DataFrame:
    """The states to append: those whose content is not the stored latest, with the next version of their trade. stored: all versions kept so far."""
    if stored is None:
        return states
    keys = ["tenant_id", "portfolio_id", "trade_id"]
    number = version_number(F.col("canonical_state_version"))
    last = stored.groupBy(*keys).agg(F.max(number).alias("_last"), F.max_by("state_hash", number).alias("_hash"))
    joined = states.drop("canonical_state_version").join(last, keys, "left").where("_hash is null or _hash <> state_hash")
    return joined.withColumn("canonical_state_version", (F.coalesce("_last", F.lit(0)) + 1).cast("decimal(19,0)").cast("string")).select(*states.columns)


def provenance(rows: DataFrame, *more: str) -> DataFrame:
    """Long form of where each canonical field comes from: 13 rows a trade, with more columns of the trade if wanted."""
    def entry(name: str, side: str, trusted: tuple[str, ...]) -> Column:
        w = F.col(side)
        status = F.when(w["source_system"].isin(*trusted), "SELECTED").otherwise("SECONDARY_SUPPORTING")
        where = [w[f].alias(f) for f in ("observation_id", "kind", "source_system", "source_version", "ingest_time")]
        return F.struct(F.lit(f"/payload/{name}").alias("field_path"), *where, status.alias("conflict_status"))

    entries = [entry(f, "by_execution", EXECUTION_TRUSTED) for f in EXECUTION_FIELDS] + [entry(f, "by_confirmation", CONFIRMATION_TRUSTED) for f in CONFIRMATION_FIELDS]
    return rows.select(*TRADE, "trade_id", *more, F.explode(F.array(*entries)).alias("p")).select(*TRADE, "trade_id", *more, "p.*")


def run_envelopes(rows: DataFrame, run_id: str, config: Config | None = None, evaluated_at: Column | None = None) -> DataFrame:
    """One row a trade of a run: result, its breaks in order of family and id, number of facts, and a hash of the envelope itself."""
    config = config or Config()
    found = breaks(facts(rows, config, evaluated_at, clean=True), run_id, ("watermark",))
    item = F.when(F.col("family").isNotNull(), F.struct("family", "break_id", F.size("comparisons").alias("n")))
    joined = found.groupBy(*TRADE, "trade_id").agg(F.sort_array(F.collect_list(item)).alias("_found"), F.first("watermark").alias("watermark"), F.first("detected_at").alias("_at"))
    return enveloped(joined, run_id, config)


def enveloped(rows: DataFrame, run_id: str, config: Config, more: tuple[str, ...] = ()) -> DataFrame:
    """Envelopes of trades, from watermark, _at (time of evaluation) and _found (sorted structs of family, break_id, n: number of comparisons). ``more`` are columns to keep."""
    broken = F.col("_found")
    envelope = rows.select(
        *TRADE, "trade_id", F.lit(run_id).alias("run_id"), F.lit(1).alias("run_version"), F.col("watermark").alias("source_watermark"), F.col("_at").alias("evaluated_at"),
        F.lit(config.config_id).alias("config_id"), F.lit(config.version).alias("config_version"), F.lit(config.content_hash()).alias("config_hash"),
        F.when(F.size(broken) > 0, "BREAKS_DETECTED").otherwise("PASS").alias("result"), F.transform(broken, lambda x: x["break_id"]).alias("break_ids"),
        F.aggregate(broken, F.lit(0), lambda n, x: n + x["n"]).alias("n_facts"), *more,
    )
    return envelope.withColumn("content_hash", envelope_hash())


ENVELOPE = (
    "break_ids", "config_hash", "config_id", "config_version", "evaluated_at", "lineage_id", "n_facts", "portfolio_id", "result", "run_id", "run_version", "source_watermark", "tenant_id", "trade_id",
)


def envelope_hash() -> Column:
    """Hash of the canonical JSON of a run envelope without its hash."""
    times = {c: offset_time(F.col(c)) for c in ("evaluated_at", "source_watermark")}
    return sha256(canonical_json(F.struct(*[times.get(c, F.col(c)).alias(c) for c in ENVELOPE]), keep_nulls=True))


def reopened(rows: DataFrame, run_id: str) -> DataFrame:
    """Breaks that are found again after they were resolved: the next version, under a new id, which names the former one."""
    identity = F.sha2(F.concat_ws("\x1f", F.lit(run_id), "break_id", F.col("break_version").cast("string")), 256)
    return rows.withColumns(
        {
            "supersedes_break_id": F.col("break_id"), "break_id": F.concat(F.lit("break_"), F.lower("family"), F.lit("_"), F.substring(identity, 1, 40)),
            "break_version": F.col("break_version") + 1, "run_id": F.lit(run_id), "state": F.lit("OPEN"),
        }
    )


def in_taxonomy_order(rows: DataFrame) -> DataFrame:
    """Facts by family in the order of the taxonomy, path and sources."""
    return rows.orderBy(position(F.col("family"), tuple(FAMILIES)), "field_path", "expected_observation_id", "observed_observation_id", *TRADE)


def post_action_facts(pairs: DataFrame) -> DataFrame:
    """Facts of post-action verification. pairs: trade columns, pre and post (struct of book_id, lifecycle_status, booking_version, record_fingerprint,
    observation_id; post may be null), changed (array of field_path, expected_value, observed_value), readback_available, original_break_remaining."""
    fields = (("book_id", "IDENTIFIER"), ("lifecycle_status", "LIFECYCLE_STATUS"), ("booking_version", "SOURCE_VERSION"), ("record_fingerprint", "CONTENT_HASH"))
    named = lambda p, e, o: F.struct(p.alias("field_path"), e.cast("string").alias("expected_value"), o.cast("string").alias("observed_value"))
    implicit = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col("post").isNotNull() & ~F.col(f"pre.{f}").eqNullSafe(F.col(f"post.{f}")) & ~F.array_contains(F.transform("changed", lambda c: c["field_path"]), f"/payload/{f}"),
                    named(F.lit(f"/payload/{f}"), F.col(f"pre.{f}"), F.col(f"post.{f}")),
                )
                for f, _ in fields
            ]
        )
    )
    unread = F.array(named(F.lit("/payload/book_id"), F.col("pre.book_id"), F.lit("readback_unavailable")))
    every = F.concat("changed", implicit)
    failed = ~F.col("readback_available") | F.col("original_break_remaining")
    rows = pairs.withColumn("changes", F.when(F.size(every) > 0, every).when(failed, unread).otherwise(F.array().cast("array<struct<field_path:string,expected_value:string,observed_value:string>>")))
    types = lookup(F.col("c.field_path"), {f"/payload/{f}": t for f, t in fields})
    family = "POST_ACTION_VERIFICATION_FAILURE"
    return rows.select(*TRADE, "trade_id", "pre", "post", F.explode("changes").alias("c")).select(
        *TRADE, "trade_id", F.lit(family).alias("family"), F.lit(FAMILIES[family][0]).alias("condition_code"), F.lit(FAMILIES[family][1]).alias("severity"), F.col("c.field_path").alias("field_path"),
        types.alias("value_type"), F.col("c.expected_value").alias("expected_value"), F.col("c.observed_value").alias("observed_value"),
        F.col("pre.observation_id").alias("expected_observation_id"), F.coalesce("post.observation_id", "pre.observation_id").alias("observed_observation_id"),
    )
