"""Connected components of an edge table, with DataFrame operations only.

Alternating large-star and small-star steps (Kiveris et al. 2014): each step links neighbours to the least id seen and ends with stars. Every
step is written to the shared folder, so its plan stays short and lost executors cost one step. Hubs are no problem for the pre-aggregated
minimum; joins on a hub are left to the skew handling of adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored


def _count(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("h")).first()
    return row["n"], row["h"] or 0


def components(edges: DataFrame, most_steps: int = 60) -> DataFrame:
    """edges(u, v), any direction, repeats allowed -> (id, root) for each id with an edge; root is the least id of its component, itself included.

    Raises rather than returning components that ``most_steps`` did not bring to an end.
    """
    with scratch(edges.sparkSession) as keep:
        return keep(_components(edges, most_steps), "roots")


def _components(edges: DataFrame, most_steps: int) -> DataFrame:
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _count(now)
    for _ in range(most_steps):
        if not seen[0]:
            break
        # Large star: neighbours above u go to the least of u and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "edges")
        # Small star: u and its neighbours below go to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        below = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(below.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        found = _count(after)
        now, done = after, found == seen
        seen = found
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_steps} steps")
    roots = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
