"""Merkle manifest of a dataset, kept outside memory as Parquet, with a proof for every row.

A row's leaf is the SHA-256 of its fields, each written with its length, so that no two rows share an encoding. The leaves of a group
ascend by id; every ``fanout`` consecutive nodes are hashed into one, level by level, until one is left, the group's subroot. The
subroots, in the order of the groups' names, make a tree of the same kind, and its last node is the root of the dataset.

The store is a folder with one Parquet table a level, ``level=0`` the leaves:

1. Leaves are dealt by range into sorted runs and numbered within their run; the counts of the runs, one row for each run and group, turn
   that into a node's coordinate ``(g, at)``. A hot group is as many runs as its rows need.
2. A level is one scan of the level below: nodes of one parent lie together, so they are combined before the shuffle.
3. Proofs come down the tree by sort-merge joins on coordinates: a node of level k meets its parent ``(g, at / fanout)``, whose children
   are its siblings and which carries the siblings of all levels above. A parent with its list meets ``fanout`` nodes at most, so a join moves each
   list once for every ``fanout`` nodes, and no join has a hot key.

Everything is a written table or a join of written tables: a lost executor costs the tasks it ran. The driver only holds the number of levels.

Defined cases: null fields are ``-``; null ids come first in their group and null groups first among the groups, apart from a group
with an empty name; rows that share an id are ordered by their leaf, and equal rows are leaves of their own, side by side; rows with a null id are not tampered with. A group of
one row is its own subroot, and one group's subroot is the root. An empty table gives an empty result. Texts of any length are read whole; other
columns of the input are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.base import keep, lower_ascii, read, shared_dir

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before: string, after: string>>"


def field(value: Column) -> Column:
    """A value with its length in bytes; ``-`` for null."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def group_key(group: Column) -> Column:
    """A string that orders as the group's UTF-8 does, null first."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string")))


@dataclass
class Store:
    """``levels[0]`` is ``g, at, n, digest`` and the payload of the leaves, ``levels[k]`` ``g, at, n, digest, kids``; n counts the nodes of the group there."""

    path: str
    levels: list[DataFrame]

    def tops(self) -> DataFrame:
        """``g, digest``: the last node of each group."""
        return reduce(DataFrame.unionByName, (level.where("n = 1").select("g", "digest") for level in self.levels))


def _written(rows: DataFrame, path: str, level: int) -> DataFrame:
    at = f"{path}/level={level}"
    rows.write.option("compression", "zstd").parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def build(leaves: DataFrame, order: Sequence[str], payload: Sequence[str] = (), fanout: int = FANOUT) -> Store:
    """The store of ``leaves``, a table with ``g``, ``digest``, the columns of ``order`` and those of ``payload``."""
    spark = leaves.sparkSession
    path = f"{shared_dir(spark)}/merkle-{uuid.uuid4().hex}"
    by = ["g", *order, "digest"]
    runs = leaves.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("run", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    runs = keep(runs, "merkle-runs")
    sizes = runs.groupBy("g", "run").agg(F.count("*").alias("size"), F.min("row").alias("first"))
    group, earlier = Window.partitionBy("g"), Window.partitionBy("g").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("g", "run", (F.coalesce(F.sum("size").over(earlier), F.lit(0)) - F.col("first")).alias("shift"), F.sum("size").over(group).alias("n"))
    levels = [_written(runs.join(starts, ["g", "run"]).select("g", (F.col("row") + F.col("shift")).alias("at"), "n", "digest", *payload), path, 0)]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        below = levels[-1].where("n > 1")
        up = below.groupBy("g", F.floor(F.col("at") / fanout).alias("up")).agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("nodes"), F.max("n").alias("under"))
        kids = F.transform("nodes", lambda x: x["digest"])
        level = up.select("g", F.col("up").alias("at"), F.ceil(F.col("under") / fanout).alias("n"), F.sha2(F.array_join(kids, "").cast("binary"), 256).alias("digest"), kids.alias("kids"))
        levels.append(_written(level, path, len(levels)))
        most = -(-most // fanout)
    return Store(path, levels)


def paths(store: Store, tops: DataFrame, carried: Sequence[str] = (), fanout: int = FANOUT) -> DataFrame:
    """The leaves with ``path``, their siblings from the lowest level to the top, and the columns ``carried``. ``tops`` has ``g, path`` and those for each group."""
    with_path = None
    for level in reversed(store.levels):
        here = level.where("n = 1").join(tops, "g")
        if with_path is not None:
            parent = with_path.select(F.col("g").alias("up_g"), F.col("at").alias("up_at"), F.col("kids").alias("run"), F.col("path").alias("rest"), *carried)
            rows = level.where("n > 1").join(parent, (F.col("g") == F.col("up_g")) & (F.floor(F.col("at") / fanout) == F.col("up_at")))
            i = (F.col("at") % fanout).cast("int")
            before, after = F.array_join(F.slice("run", F.lit(1), i), ""), F.array_join(F.slice("run", i + 2, F.lit(fanout)), "")
            step = F.array(F.struct(before.alias("before"), after.alias("after")))
            here = here.unionByName(rows.select(*level.columns, F.concat(step, F.col("rest")).alias("path"), *carried))
        with_path = here
    return with_path


def proofs(leaves: DataFrame, order: Sequence[str], payload: Sequence[str] = (), fanout: int = FANOUT) -> DataFrame:
    """The leaves with ``path``, ``subroot`` and ``root``."""
    store = build(leaves, order, payload, fanout)
    roots = build(store.tops().select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), ["name"], ["name"], fanout)
    root = roots.tops().select("g", F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    groups = paths(roots, root, ["root"], fanout).select(F.col("name").alias("g"), "path", F.col("digest").alias("subroot"), "root")
    return paths(store, keep(groups, "merkle-groups"), ["subroot", "root"], fanout)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda node, x: digest(x["before"], node, x["after"]))


def siblings(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), "").cast("binary"), 256)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: Sequence[str] = FIELDS, text_col: str = "text", fanout: int = FANOUT) -> DataFrame:
    """One row per input row: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``. Verified is a row tampered with where
    crc32 of its id is divisible by 3: its text in lower case."""
    other = {text_col: lower_ascii(docs[text_col])}
    tampered = F.coalesce(F.crc32(docs[id_col].cast("string")) % 3 == 0, F.lit(False)) & (docs[text_col] != other[text_col])
    leaf, forged = (digest(*(field(say.get(c, docs[c])) for c in fields)) for say in ({}, other))
    rows = docs.select(docs[id_col].alias("doc_id"), group_key(docs[group_col]).alias("g"), leaf.alias("digest"), F.when(tampered, forged).alias("forged"))
    held = proofs(keep(rows, "merkle-leaves"), ["doc_id"], ["doc_id", "forged"], fanout)
    folded = fold(F.coalesce("forged", "digest"), F.col("path"))
    return held.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        siblings(F.col("path")).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read(spark, sf_dir, "documents"))


_LEAF = "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')" for c in FIELDS) + ")"
#: CRC-32 bit by bit over the decimal id: the byte enters every eighth step.
_BYTE = "CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, i // 8 + 1, 1)) ELSE 0 END::BIGINT"
_CRC = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, range(8 * length(doc_id::VARCHAR))),
    lambda c, i: xor(xor(c, {_BYTE}) >> 1, CASE WHEN xor(c, {_BYTE}) & 1 = 1 THEN 3988292384 ELSE 0 END::BIGINT)), 4294967295::BIGINT)"""


def _tree_sql(name: str, leaves: str) -> str:
    return f"""
{name} AS (
    SELECT g, 0 AS lvl, pos, n, digest FROM {leaves}
    UNION ALL
    SELECT g, lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY g, lvl, pos // 8, n),
{name}_runs AS (SELECT g, lvl, pos // 8 AS up, list(digest ORDER BY pos) AS kids FROM {name} WHERE n > 1 GROUP BY ALL)"""


def _walk_sql(name: str, start: str, runs: str) -> str:
    return f"""
{name} AS (
    SELECT k, g, 0 AS lvl, pos, n, node, sib FROM {start}
    UNION ALL
    SELECT k, w.g, w.lvl + 1, pos // 8, (n + 7) // 8, sha256(array_to_string(list_concat(list_append(kids[1:pos % 8], node), kids[pos % 8 + 2:]), '')),
           sib || array_to_string(list_concat(kids[1:pos % 8], kids[pos % 8 + 2:]), '')
    FROM {name} w JOIN {runs} r ON r.g = w.g AND r.lvl = w.lvl AND r.up = w.pos // 8 WHERE n > 1)"""


ORACLE = f"""
WITH RECURSIVE docs AS (
    SELECT doc_id, coalesce('=' || lang, '') AS g, {_LEAF} AS leaf,
           CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF.replace("text", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS forged
    FROM documents),
leaves AS (
    SELECT *, row_number() OVER () AS k, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n, leaf AS digest FROM docs),
{_tree_sql("tree", "leaves")},
tops AS (SELECT '' AS g, g AS name, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n, digest FROM tree WHERE n = 1),
{_tree_sql("crown", "tops")},
start AS (SELECT k, g, pos, n, coalesce(forged, leaf) AS node, '' AS sib FROM leaves),
{_walk_sql("inner_walk", "start", "tree_runs")},
middle AS (SELECT w.k, t.g, t.pos, t.n, w.node, w.sib FROM inner_walk w JOIN tops t ON t.name = w.g WHERE w.n = 1),
{_walk_sql("outer_walk", "middle", "crown_runs")}
SELECT l.doc_id, l.leaf, t.digest AS subroot, c.digest AS root, sha256(w.sib) AS proof_sha256, w.node AS folded_root, w.node = c.digest AS verified
FROM leaves l JOIN tops t ON t.name = l.g JOIN outer_walk w ON w.k = l.k AND w.n = 1 JOIN crown c ON c.n = 1
"""
