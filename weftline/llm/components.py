"""Connected components with DataFrame operations only.

Alternating large-star and small-star rounds (Kiveris et al., 2014). A round links each
node to the least node it knows; edges only ever point to smaller ids, and a star per
component remains. Nothing is collected; each round's edges are a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.base import drop, keep

ROUNDS, SALTS = 60, 16


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each larger end has one edge and is no smaller end of another. Hubs are combined before the shuffle."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root``: the least node of each linked node's component. Nodes without a link don't appear."""
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = keep(edges, "links")
    for _ in range(ROUNDS):
        if _settled(edges):
            break
        # large star: a node hands its larger neighbours its least smaller one. The hub of a star has none, and as the smaller end of
        # many edges it is dealt out by salt.
        least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        large = edges.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int")).join(least, ["v", "salt"], "left")
        large = large.select("u", F.coalesce("m", "v").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, keep(small, "links")
        drop(before)
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
