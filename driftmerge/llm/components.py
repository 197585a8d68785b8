"""Connected components of a distributed edge list, without collecting edges or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmerge.llm.common import materialize, release


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of `edges` (u, v; longs); root is the smallest node that can be reached.

    Alternating large-star and small-star steps. Each step takes the minimum of a node's neighbours by a
    map-side-combined aggregate and joins it back, so a node with very many neighbours is never one task's list; the
    edge list is written to the shared folder each round. Empty edges give no rows.
    """

    def starred(links: DataFrame, larger: bool) -> DataFrame:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if larger:
            return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v")

    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    print_sum = _fingerprint(now)
    for _ in range(most_rounds):
        if print_sum[0] == 0:
            break
        step = starred(starred(now, True).distinct(), False).distinct()
        after = materialize(step, "edges")
        release(now)
        now, was, print_sum = after, print_sum, _fingerprint(after)
        if was == print_sum:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("v", F.col("v").alias("root")))


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    """Row count and an order-free hash sum: two equal ones in a row mean that nothing moved."""
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return int(row[0]), int(row[1])
