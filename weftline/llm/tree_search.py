"""Approximate nearest neighbours by inner product: a tree of k-means splits, searched best bin first.

1. Equal vectors become one row with the ``k + 1`` smallest of their ids: ties go to smaller ids, so no other copy can be among the ``k`` nearest of any query.
   Copies are combined within each batch, then by salt, then over the salts.
2. A component is added that gives all vectors one norm, so that the nearest in distance has the largest inner product; a query has zero there.
3. The tree is fitted on some ``SAMPLE`` distinct vectors, chosen by hash: k-means with ``BRANCH`` centres, again within each part, down to leaves of some
   ``LEAF`` rows of the whole table, at most ``MOST_LEAVES``. Every vector is put into a leaf, by the nearest centre at each node.
4. A query visits leaves through a priority queue: the bin with the nearest centre is opened first, its children are queued. The number of visits is calibrated:
   for ``PROBES`` queries the true neighbours are found by brute force over the whole table, in one scan, and the visits widen until the mean share found reaches ``RECALL``. A query that has met
   fewer than ``k + 1`` rows goes on beyond that.
5. Queries meet the rows of a leaf in blocks of bounded size (``BLOCK`` rows, ``QUERIES`` queries): a leaf of any size is many groups. Each group scores its pairs in one product and hands on the best
   ``k + 1`` rows of each query; a window keeps the best of all. Scores are then sums of products in order, in double precision. The first ``FIRST`` leaves of a query give it a floor, the
   last score it would keep so far, and the others only hand on rows that reach it.

The fit on a bounded sample is the index's only bound; it is documented here, and all rows are indexed and all queries searched.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a null id. A shorter vector counts as filled
with zeros. Rows alike in id and vector count once; rows that share an id but not the vector are rows of their own, each a query of its own if the id is one. Fewer candidates than ``k``: all of
them. An empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.base import drop, keep, read

K, EVERY = 20, 20
#: Distinct vectors the tree is fitted on, children of a node, rows of the table a leaf aims at.
SAMPLE, BRANCH, LEAF = 32_768, 8, 512
#: Leaves of a small table, and leaves at most: their centres travel with the tasks.
LEAST_LEAVES, MOST_LEAVES = 32, 2048
PROBES, RECALL, FIRST = 200, 0.96, 4
BLOCK, QUERIES, SALTS = 2048, 1024, 16


# -- the tree, in numpy ------------------------------------------------------------------------------------------------


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Centres and labels; the first centres are spread over the rows as they come. Empty clusters are dropped."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        label = np.argmin((centres * centres).sum(1) - 2.0 * (x @ centres.T), axis=1)
        used = np.unique(label)
        centres = np.stack([x[label == c].mean(axis=0) for c in used])
    label = np.argmin((centres * centres).sum(1) - 2.0 * (x @ centres.T), axis=1)
    return centres, label


@dataclass
class Tree:
    """Nodes in the order they were made, the root first; a leaf has no children and a number."""

    kids: list[list[int]] = field(default_factory=lambda: [[]])
    centres: list[np.ndarray | None] = field(default_factory=lambda: [None])  # those of the children
    leaf: list[int] = field(default_factory=lambda: [-1])

    @classmethod
    def fit(cls, x: np.ndarray, per_leaf: float, branch: int = BRANCH) -> Tree:
        tree, n_leaves, todo = cls(), 0, deque([(0, x)])
        while todo:
            node, rows = todo.popleft()
            centres, label = kmeans(rows, min(branch, max(1, round(len(rows) / per_leaf))))
            if len(centres) < 2:
                tree.leaf[node], n_leaves = n_leaves, n_leaves + 1
                continue
            tree.centres[node] = centres
            for c in range(len(centres)):
                tree.kids[node].append(len(tree.kids))
                todo.append((len(tree.kids), rows[label == c]))
                tree.kids.append([])
                tree.centres.append(None)
                tree.leaf.append(-1)
        return tree

    @property
    def n_leaves(self) -> int:
        return max(self.leaf) + 1

    def gaps(self, node: int, x: np.ndarray) -> np.ndarray:
        """Squared distances of rows to the centres of a node's children."""
        centres = self.centres[node]
        return (x * x).sum(-1)[..., None] + (centres * centres).sum(1) - 2.0 * (x @ centres.T)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out, todo = np.zeros(len(x), dtype=np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.kids[node]:
                out[rows] = self.leaf[node]
            elif len(rows):
                near = np.argmin(self.gaps(node, x[rows]), axis=1)
                todo += [(kid, rows[near == i]) for i, kid in enumerate(self.kids[node])]
        return out

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """The leaves for one query, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.kids[node]:
                yield self.leaf[node]
            else:
                for gap, kid in zip(self.gaps(node, q).tolist(), self.kids[node], strict=True):
                    heapq.heappush(queue, (gap, kid))


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """Rows scaled by the largest norm, with the component that makes all norms one."""
    y = x / norm
    return np.concatenate([y, np.sqrt(np.maximum(0.0, 1.0 - (y * y).sum(axis=1)))[:, None]], axis=1)


def as_query(x: np.ndarray) -> np.ndarray:
    """Queries at norm one with nothing in the added component: their length changes no order."""
    y = x / np.abs(x).max(axis=1, keepdims=True)
    return np.concatenate([y / np.linalg.norm(y, axis=1, keepdims=True), np.zeros((len(x), 1))], axis=1)


def ordered_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, added from the first component to the last."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def first_of(query: np.ndarray, score: np.ndarray, low: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first entries of each query, by score, the largest first, then by ``low``."""
    order = np.lexsort((low, -score, query))
    rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    return order[rank < k]


def best(q: np.ndarray, x: np.ndarray, low: np.ndarray, k: int, floor: np.ndarray | float = -np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and score of the ``k`` best rows of each query that reach its ``floor``, ties by ``low``, the least id of a row.

    One product finds all rows that may be among them, whatever its rounding; those get their score in order."""
    rough = q @ x.T
    floor = np.broadcast_to(np.asarray(floor, dtype=np.float64), len(q))
    slack = 1e-12 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
    least = np.maximum(floor, np.partition(rough, len(x) - k, axis=1)[:, len(x) - k]) if len(x) > k else floor
    query, at = np.nonzero(rough >= (least - slack)[:, None])
    score = ordered_dot(q[query], x[at])
    reach = score >= floor[query]
    query, at, score = query[reach], at[reach], score[reach]
    first = first_of(query, score, low[at], k)
    return query[first], at[first], score[first]


# -- tables ------------------------------------------------------------------------------------------------------------


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, dim)


def packed(rows: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """``id, vec, norm`` of the vectors that take part, as packed doubles filled up to ``dim``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            x = np.zeros((len(lengths), dim))
            x[np.arange(dim) < lengths[:, None]] = batch.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            good = np.flatnonzero(np.isfinite(x).all(axis=1) & x.any(axis=1))
            x = x[good] + 0.0  # no negative zeros
            size = np.abs(x).max(axis=1, initial=0.0)
            norm = size * np.linalg.norm(x / size[:, None], axis=1) if len(x) else size
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(norm)], ["id", "vec", "norm"])

    whole = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return whole.mapInArrow(pack, "id long, vec binary, norm double")


def classes(rows: DataFrame, most: int) -> DataFrame:
    """``ids, vec, norm``: each distinct vector with its ``most`` smallest ids."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, set[int]] = {}
            norms = dict(zip(batch.column("vec").to_pylist(), batch.column("norm").to_pylist(), strict=True))
            for key, vec in zip(batch.column("id").to_pylist(), batch.column("vec").to_pylist(), strict=True):
                held.setdefault(vec, set()).add(key)
            ids = pa.array([sorted(held[v])[:most] for v in norms], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(list(norms), pa.binary()), pa.array(list(norms.values()), pa.float64())], ["ids", "vec", "norm"])

    parts = rows.mapInArrow(combine, "ids array<bigint>, vec binary, norm double").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids")
    return parts.groupBy("vec", "salt").agg(smallest, F.max("norm").alias("norm")).groupBy("vec").agg(smallest, F.max("norm").alias("norm"))


def key_of(vec: str = "vec") -> Column:
    """What names a vector."""
    return F.unhex(F.sha2(vec, 256))


def indexed(held: DataFrame, tree: Tree, norm: float, dim: int) -> DataFrame:
    """``key, low, ids, vec, leaf``: the distinct vectors in their leaves; the key names a vector, ``low`` is its least id."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.place(lifted(matrix(batch.column("vec"), dim), norm))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], [*batch.schema.names, "leaf"])

    named = held.select(key_of().alias("key"), F.col("ids")[0].alias("low"), "ids", "vec")
    return named.mapInArrow(place, "key binary, low long, ids array<bigint>, vec binary, leaf int")


def calibrated(table: DataFrame, tree: Tree, probes: list, dim: int, k: int, recall: float) -> tuple[int, float]:
    """Visits a query needs for the wanted mean recall, and that recall. ``probes`` are queries, judged by brute force over the whole table; their own vectors don't count."""
    q, own = np.stack([np.frombuffer(r["vec"], dtype=np.float64) for r in probes]), [bytes(r["key"]) for r in probes]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, score, low, leaf = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            x, keys, lows, leaves = matrix(batch.column("vec"), dim), batch.column("key").to_pylist(), batch.column("low").to_numpy(), batch.column("leaf").to_numpy()
            if not len(x):
                continue
            i, at, s = best(q, x, lows, k + 1)
            other = np.array([keys[a] != own[j] for j, a in zip(i.tolist(), at.tolist(), strict=True)], dtype=bool)
            i, at, s = i[other], at[other], s[other]
            query, score, low, leaf = (np.concatenate(p) for p in ((query, i), (score, s), (low, lows[at]), (leaf, leaves[at])))
            first = first_of(query, score, low, k)
            query, score, low, leaf = query[first], score[first], low[first], leaf[first]
        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(score), pa.array(low), pa.array(leaf.astype(np.int32))], ["query", "score", "low", "leaf"])

    found = table.select("key", "vec", "low", "leaf").mapInArrow(scan, "query int, score double, low long, leaf int")
    first = Window.partitionBy("query").orderBy(F.desc("score"), "low")
    truth = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query", "leaf").collect()  # probes * k rows
    turn = [{leaf: i + 1 for i, leaf in enumerate(tree.visits(x))} for x in as_query(q)]
    needed = np.sort([turn[r["query"]][r["leaf"]] for r in truth] or [1])
    visits = int(needed[int(np.ceil(recall * len(needed))) - 1])
    return visits, float((needed <= visits).mean())


def routed(asked: DataFrame, tree: Tree, rows_in: dict[int, int], visits: int, dim: int, least: int) -> DataFrame:
    """``key, vec, leaves``: the leaves each query visits."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for q in as_query(matrix(batch.column("vec"), dim)) if batch.num_rows else ():
                seen, met = [], 0
                for leaf in tree.visits(q):
                    if len(seen) >= visits and met >= least:
                        break
                    seen.append(leaf)
                    met += rows_in.get(leaf, 0)
                out.append([leaf for leaf in seen if leaf in rows_in])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("vec"), pa.array(out, pa.list_(pa.int32()))], ["key", "vec", "leaves"])

    return asked.select("key", "vec").mapInArrow(route, "key binary, vec binary, leaves array<int>")


def met(table: DataFrame, routes: DataFrame, rows_in: dict[int, int], dim: int, k: int) -> DataFrame:
    """``key, score, id, own``: the best ``k`` of the rows in the ``leaves`` of each query that reach its ``floor``, own ones marked."""
    spark = table.sparkSession
    asked_in = {r["leaf"]: r["n"] for r in routes.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row for each leaf
    sizes = [(leaf, -(-rows_in[leaf] // BLOCK), -(-n // QUERIES)) for leaf, n in asked_in.items()]
    sizes = F.broadcast(spark.createDataFrame(sizes, "leaf int, blocks int, parts int"))  # a row for each leaf
    deal = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = table.join(sizes, "leaf").select("leaf", F.pmod(F.xxhash64("key", F.lit("block")), F.col("blocks")).cast("int").alias("block"), deal("parts").alias("part"), "key", "low", "ids", "vec")
    right = routes.select("key", "vec", "floor", F.explode("leaves").alias("leaf")).join(sizes, "leaf")
    right = right.select("leaf", deal("blocks").alias("block"), F.pmod(F.xxhash64("key", F.lit("part")), F.col("parts")).cast("int").alias("part"), "key", "vec", "floor")

    def score(rows: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["key", "score", "id", "own"]
        if not rows.num_rows or not queries.num_rows:
            return pa.table([pa.array([], t) for t in (pa.binary(), pa.float64(), pa.int64(), pa.bool_())], names)
        low, floor = rows.column("low").to_numpy(), queries.column("floor").to_numpy()
        i, at, s = best(matrix(queries.column("vec"), dim), matrix(rows.column("vec"), dim), low, k, floor)
        asked, key, ids = queries.column("key").to_pylist(), rows.column("key").to_pylist(), rows.column("ids").to_pylist()
        times = np.array([len(ids[a]) for a in at.tolist()], dtype=np.int64)
        own = np.array([asked[j] == key[a] for j, a in zip(i.tolist(), at.tolist(), strict=True)], dtype=bool)
        flat = [v for a in at.tolist() for v in ids[a]]
        return pa.table([pa.array([asked[j] for j in np.repeat(i, times).tolist()], pa.binary()), pa.array(np.repeat(s, times)), pa.array(flat, pa.int64()), pa.array(np.repeat(own, times))], names)

    groups = ("leaf", "block", "part")
    return left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInArrow(score, "key binary, score double, id long, own boolean")


def firsts(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def neighbours(table: DataFrame, routes: DataFrame, rows_in: dict[int, int], dim: int, k: int) -> DataFrame:
    """``key, score, id, own, rank``: the best ``k`` of the rows each query meets."""
    some = routes.select("key", "vec", F.lit(float("-inf")).alias("floor"), F.slice("leaves", 1, FIRST).alias("leaves"))
    near = keep(firsts(met(table, some, rows_in, dim, k), k), "tree-first")
    rest = routes.select("key", "vec", F.slice("leaves", FIRST + 1, MOST_LEAVES * BRANCH).alias("leaves")).where(F.size("leaves") > 0)
    if rest.isEmpty():
        return near
    floors = near.where(F.col("rank") == k).select("key", F.col("score").alias("floor"))
    rest = rest.join(floors, "key", "left").select("key", "vec", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), "leaves")
    return firsts(near.drop("rank").unionByName(met(table, rest, rows_in, dim, k)), k)


def answers(near: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The neighbours of each query row, but for itself. Rows of one vector share a search."""
    entry = F.array_sort(F.collect_list(F.struct("rank", "id", "score", "own"))).alias("near")  # k + 1 entries
    met = queries.join(near.groupBy("key").agg(entry), "key")
    others = F.slice(F.filter("near", lambda x: ~(x["own"] & (x["id"] == F.col("id")))), 1, k)
    rows = met.select(F.col("id").alias("query_id"), F.posexplode(others).alias("pos", "x"))
    return rows.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


@dataclass
class Found:
    """The neighbours, and what calibration measured."""

    rows: DataFrame
    visits: int = 0
    leaves: int = 0
    recall: float = 1.0


def drawn(rows: DataFrame, total: int, most: int, seed: str) -> DataFrame:
    """Some ``most`` of ``total`` rows, chosen by the hash of ``vec``; all, if fewer."""
    return rows if total <= most else rows.where(F.pmod(F.xxhash64("vec", F.lit(seed)), F.lit(1 << 30)) < (1 << 30) * most // total)


def search(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY, recall: float = RECALL, leaf_rows: int = LEAF, sample: int = SAMPLE) -> Found:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest rows found for each row whose id is divisible by ``every``."""
    nothing = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = rows.agg(F.max(F.size(vector_col))).first()[0] or 0
    if dim < 1:
        return Found(nothing)
    held = keep(classes(packed(rows, id_col, vector_col, dim), k + 1), "tree-classes")
    total, norm = held.agg(F.count("*"), F.max("norm")).first()
    queries = keep(packed(rows.where(F.col(id_col) % every == 0), id_col, vector_col, dim).select("id", "vec", key_of().alias("key")).distinct(), "tree-queries")
    asked = keep(queries.select("key", "vec").distinct(), "tree-asked")
    n_asked = asked.count()
    if not n_asked:
        return Found(nothing)
    fit = sorted(bytes(r["vec"]) for r in drawn(held, total, sample, "sample").select("vec").collect())  # some ``sample`` rows
    x = np.frombuffer(b"".join(fit), dtype=np.float64).reshape(-1, dim)
    tree = Tree.fit(lifted(x, norm), max(1.0, len(x) / min(MOST_LEAVES, max(total / leaf_rows, min(LEAST_LEAVES, total / 16)))))
    table = keep(indexed(held, tree, norm, dim), "tree-index")
    drop(held)
    rows_in = {r["leaf"]: r["n"] for r in table.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row for each leaf
    probes = drawn(asked, n_asked, PROBES, "probe").collect() or asked.limit(1).collect()  # some PROBES rows
    visits, measured = calibrated(table, tree, probes, dim, k, recall)
    routes = keep(routed(asked, tree, rows_in, visits, dim, k + 1), "tree-routes")
    near = keep(neighbours(table, routes, rows_in, dim, k + 1), "tree-near")
    drop(table, asked, routes)
    return Found(answers(near, queries.select("id", "key"), k), visits, len(rows_in), measured)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings")).rows
