"""The truth of the corpus as a graph: from the cause of a defect to the family of breaks it makes.

Typed nodes and edges, each named by its lineage, so that graphs of different trades never touch. Clean trades have observations and their lineage only. The graph is the evaluator's: nothing of it
is in what the engine reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import lookup
from . import corpus

#: Where each effect shows. Effects that are not named here show in the payload field of their name.
FIELD_OF_EFFECT = {
    "UNMATCHED": "/linkage/trade_id", "AMBIGUOUS": "/linkage/trade_id", "DUPLICATE": "/source/content_hash", "BASE_GBP": "/payload/base_currency", "TERMS_CHF": "/payload/terms_currency",
    "SIDE": "/payload/side", "BASE_AMOUNT": "/payload/base_amount", "TERMS_AMOUNT": "/payload/terms_amount", "RATE": "/payload/quoted_rate", "TRADE_DATE": "/payload/trade_date",
    "VALUE_DATE": "/payload/value_date", "AMENDED": "/payload/lifecycle_status", "CANCELLED": "/payload/lifecycle_status", "BOOK_ID": "/payload/book_id",
}
EDGE = "struct<source:string,source_type:string,relationship:string,target:string,target_type:string>"


def _edge(source: Column, source_type: str, relationship: str, target: Column, target_type: str) -> Column:
    return F.struct(source.alias("source"), F.lit(source_type).alias("source_type"), F.lit(relationship).alias("relationship"), target.alias("target"), F.lit(target_type).alias("target_type"))


def behaviours() -> Column:
    """How a trade's sources are delivered, from its defect."""
    effect = F.col("effect")
    return F.array_compact(
        F.array(
            F.when(effect == "DROP", "MISSING"), F.when(effect.isin("DUPLICATE", "AMBIGUOUS"), "DUPLICATE"), F.when(F.col("late"), "OUT_OF_ORDER"),
            F.when((effect != "DROP") & ~effect.isin("DUPLICATE", "AMBIGUOUS") & ~F.col("late"), "IN_ORDER"),
        )
    )


def edges(orders: DataFrame) -> DataFrame:
    """lineage_id, source, source_type, relationship, target, target_type."""
    return graphs(orders).select("lineage_id", F.explode("edges").alias("e")).select("lineage_id", "e.*")


def graphs(orders: DataFrame) -> DataFrame:
    """Each trade with its truth and its edges as an array: a graph is of one trade, and of some tens of edges by nature."""
    trade = ["portfolio_id", "lineage_id"]
    seen = corpus.deliveries(orders).groupBy(*trade).agg(F.collect_list(F.struct(F.concat(F.lit("observation:"), "observation_id").alias("node"), "kind")).alias("obs"))
    rows = corpus.truth(orders).join(seen, trade, "left").withColumn("obs", F.coalesce("obs", F.array().cast("array<struct<node:string,kind:string>>"))).withColumn("delivery", behaviours())
    node = lambda kind, *parts: F.concat(F.lit(f"{kind}:"), "lineage_id", *[x for p in parts for x in (F.lit(":"), p)])
    lineage, cause, mutation, family = (node(k) for k in ("lineage", "cause", "source_mutation", "break_family"))
    fact = node("difference_fact", F.when(F.col("effect") == "DROP", F.concat(F.lit("/source/"), F.lower("target"), F.lit("_observation"))).otherwise(lookup(F.col("effect"), FIELD_OF_EFFECT)))
    absence = node("expected_source_absence", F.col("target"))
    delivered = lambda b: node("delivery", b)
    hit = F.filter("obs", lambda o: o["kind"] == F.col("target"))
    every = lambda items, make: F.transform(items, make)
    belongs = every("obs", lambda o: _edge(o["node"], "SOURCE_OBSERVATION", "BELONGS_TO_LINEAGE", lineage, "LINEAGE"))
    present = F.filter("delivery", lambda b: b != "MISSING")
    missing = F.filter("delivery", lambda b: b == "MISSING")
    none = F.array().cast(f"array<{EDGE}>")
    chain = F.concat(
        F.array(_edge(cause, "SYNTHETIC_CAUSE", "CAUSE_OF", mutation, "SOURCE_MUTATION"), _edge(fact, "DIFFERENCE_FACT", "CLASSIFIES_AS", family, "BREAK_FAMILY")),
        every("delivery", lambda b: _edge(mutation, "SOURCE_MUTATION", "DELIVERED_AS", delivered(b), "DELIVERY_BEHAVIOUR")),
        every(missing, lambda b: _edge(mutation, "SOURCE_MUTATION", "EXPECTS_ABSENCE", absence, "EXPECTED_SOURCE_ABSENCE")),
        every(missing, lambda b: _edge(delivered(b), "DELIVERY_BEHAVIOUR", "DELIVERS_ABSENCE", absence, "EXPECTED_SOURCE_ABSENCE")),
        F.flatten(every(present, lambda b: every("obs", lambda o: _edge(delivered(b), "DELIVERY_BEHAVIOUR", "DELIVERS_OBSERVATION", o["node"], "SOURCE_OBSERVATION")))),
        every(hit, lambda o: _edge(mutation, "SOURCE_MUTATION", "MUTATES_OBSERVATION", o["node"], "SOURCE_OBSERVATION")),
        every(hit, lambda o: _edge(o["node"], "SOURCE_OBSERVATION", "SUPPORTS_DIFFERENCE_FACT", fact, "DIFFERENCE_FACT")),
        F.when(F.size(hit) == 0, F.array(_edge(mutation, "SOURCE_MUTATION", "MATERIALIZES_FACT", fact, "DIFFERENCE_FACT"))).otherwise(none),
    )
    broken = F.col("population") == "BROKEN"
    return rows.select(*trade, "population", "family", F.concat(belongs, F.when(broken, chain).otherwise(none)).alias("edges"))


def nodes_of(edges_of: str) -> Column:
    """The nodes of a graph that is an array of edges, each once."""
    side = lambda s: F.transform(edges_of, lambda e: F.struct(e[s].alias("node"), e[f"{s}_type"].alias("node_type")))
    return F.array_distinct(F.concat(side("source"), side("target")))


def is_whole(edges_of: str) -> Column:
    """``paths`` of one graph that is an array of edges."""
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    to = lambda *kinds: lambda at: F.transform(F.filter(edges_of, lambda e: e["relationship"].isin(*kinds) & F.array_contains(at, e["source"])), lambda e: e["target"])
    start = F.transform(F.filter(edges_of, lambda e: e["relationship"] == "CAUSE_OF"), lambda e: e["target"])

    def leads(at: Column) -> Column:
        delivered = bound(to("DELIVERED_AS")(at), to("DELIVERS_OBSERVATION", "DELIVERS_ABSENCE"))
        over = F.concat(bound(to("MUTATES_OBSERVATION")(at), to("SUPPORTS_DIFFERENCE_FACT")), to("MATERIALIZES_FACT")(at))
        return (F.size(delivered) > 0) & (F.size(bound(over, to("CLASSIFIES_AS"))) > 0)

    return bound(start, leads)


def nodes(edge_rows: DataFrame) -> DataFrame:
    """lineage_id, node, node_type: each once."""
    side = lambda s: edge_rows.select("lineage_id", F.col(s).alias("node"), F.col(f"{s}_type").alias("node_type"))
    return side("source").unionByName(side("target")).distinct()


def paths(edge_rows: DataFrame) -> DataFrame:
    """lineage_id, whole_path: whether the cause of a broken trade leads over a mutation, and what it mutates or expects, to a fact of a family. Joins of the edges of one lineage, step by step."""
    of = lambda *kinds: edge_rows.where(F.col("relationship").isin(*kinds)).select("lineage_id", "source", "target")
    start = of("CAUSE_OF").select("lineage_id", F.col("target").alias("node"))
    step = lambda at, more: at.join(more.withColumnRenamed("source", "node"), ["lineage_id", "node"]).select("lineage_id", F.col("target").alias("node")).distinct()
    # A mutation is delivered, as observations or as an absence, and shows in a fact.
    delivered = step(step(start, of("DELIVERED_AS")), of("DELIVERS_OBSERVATION", "DELIVERS_ABSENCE"))
    over = step(step(start, of("MUTATES_OBSERVATION")), of("SUPPORTS_DIFFERENCE_FACT")).unionByName(step(start, of("MATERIALIZES_FACT"))).distinct()
    ends = step(over, of("CLASSIFIES_AS")).select("lineage_id").distinct().join(delivered.select("lineage_id").distinct(), "lineage_id")
    return start.select("lineage_id").distinct().join(ends.withColumn("_whole", F.lit(True)), "lineage_id", "left").select("lineage_id", F.coalesce("_whole", F.lit(False)).alias("whole_path"))
