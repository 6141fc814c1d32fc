"""Iterative graph work over DataFrames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the session names; a temporary one only for a local master that names none."""
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder: one job, where a checkpoint runs two."""
    at = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def least_labels(links: DataFrame, rounds: int = 50) -> DataFrame:
    """``node, label``: the least node of each node's component; links are ``a, b``. Labels double their reach each round."""
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    for _ in range(rounds):
        seen = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label").union(labels)
        jump = labels.alias("x").join(labels.alias("y"), F.col("x.label") == F.col("y.node")).select(F.col("x.node").alias("node"), F.col("y.label").alias("label"))
        after = checkpointed(seen.union(jump).groupBy("node").agg(F.min("label").alias("label")))
        changed = not after.exceptAll(labels).isEmpty()
        labels = after
        if not changed:
            return labels
    raise RuntimeError("labels did not settle")


def lineage(parents: DataFrame, node: str, parent: str, rounds: int = 64) -> DataFrame:
    """``node, ancestor, distance`` of a parent table, each node its own ancestor at distance 0."""
    step = parents.select(F.col(node).alias("node"), F.col(parent).alias("up")).where(F.col("up").isNotNull())
    out = parents.select(F.col(node).alias("node"), F.col(node).alias("ancestor"), F.lit(0).alias("distance"))
    edge = out
    for d in range(1, rounds):
        edge = checkpointed(edge.join(step.withColumnRenamed("node", "at"), F.col("ancestor") == F.col("at")).select("node", F.col("up").alias("ancestor"), F.lit(d).alias("distance")))
        if edge.isEmpty():
            return out
        out = out.union(edge)
    raise RuntimeError("the parent table has a cycle or is deeper than the limit")


def resolve_versions(values: DataFrame, versions: DataFrame, version: str = "version_id", parent: str = "parent_id", keys: tuple[str, ...] = ("entity", "field")) -> DataFrame:
    """The value of each field at each version: the first found along the chain of the version and its parents."""
    chain = lineage(versions, version, parent)
    found = chain.join(values, chain["ancestor"] == values[version]).select("node", "distance", *keys, "value")
    return found.groupBy(F.col("node").alias(version), *keys).agg(F.min_by("value", "distance").alias("value"))


def flatten_tree(spark: SparkSession, nodes: DataFrame, node: str, parent: str, order: str) -> DataFrame:
    """Depth and path of each node of an adjacency table."""
    out = nodes.where(F.col(parent).isNull()).select(node, F.lit(0).alias("depth"), F.array(F.col(order)).alias("path"))
    level = out
    while not level.isEmpty():
        level = checkpointed(nodes.join(level.withColumnRenamed(node, "__up"), nodes[parent] == F.col("__up")).select(nodes[node], (F.col("depth") + 1).alias("depth"), F.array_append("path", nodes[order]).alias("path")))
        out = out.union(level)
    return out
