"""Constrained assignment of chunks to groups by an auction whose prices and bids are tables.

The task: choose pairs (chunk, group) with the largest sum of scores, such that a chunk is in at most ``per_chunk`` groups, a group has exactly its quota of chunks, and a
document has at least so many pairs. No matrix comes to the driver; the table of scores may have any size.

Forward: a group that lacks d chunks bids for the d with the largest score less price, and raises each price until the chunk is worth ``eps`` less to it than the best one it
doesn't bid for. A chunk keeps its ``per_chunk`` highest bids; its price is the lowest of them, or nothing while it has room. Groups look at the head of their ranked list, which is
enough as long as nothing below it can be worth more, because prices only hide value; else the heads are doubled.

Reverse, if documents lack pairs: a document raises a premium on its chunks until enough pairs are worth taking, a chunk that lost a pair lowers its price, and a group takes an offer that is worth more to it than its
worst pair, which it gives up. All groups stay full and their worst pairs only get better, so this ends. 
Where prices or premiums have far to go, as for chunks that many groups need, steps of ``eps`` would take hundreds of rounds; after every ``PATIENCE`` rounds they double, which costs accuracy that ``gap`` tells.

Prices and premiums are a feasible solution of the dual problem, so its value bounds the optimum: ``Assignment.gap`` is by how much the chosen pairs may miss it, a few ``eps`` a pair at most
unless steps were doubled.
Each round is a handful of joins on tables of the size of the choice, written to the shared folder; scores that come from vectors (``Vectors``)
are never a table: blocks of chunks and groups give the heads, and only chunks or documents that make offers are scored with every group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import search
from weftline.operators.graph import written

PAIR = ["group", "chunk", "document", "score"]
#: Rounds before steps double, and chunks that a group looks at first.
PATIENCE, HEAD = 5, 64


@dataclass
class Assignment:
    """``rows`` are ``chunk, group, score``; ``gap`` bounds how far their sum is from the optimum, and is computed when it is asked for."""

    rows: DataFrame
    bound: Callable[[], float]
    rounds: int

    @cached_property
    def gap(self) -> float:
        return self.bound()


class Table:
    """A written table of scores, ``PAIR`` for every chunk and group."""

    def __init__(self, scores: DataFrame) -> None:
        self.all = written(scores.select(*(c for c in PAIR if c != "score"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
        self.groups = written(self.all.select("group").distinct())
        self.chunks = written(self.all.select("chunk", "document").distinct())

    def of_chunks(self, chunks: DataFrame) -> DataFrame:
        """The scores of the ``chunk`` in a table."""
        return self.all.join(chunks.select("chunk"), "chunk", "left_semi")

    def of_documents(self, documents: DataFrame) -> DataFrame:
        return self.all.join(documents.select("document"), "document", "left_semi")

    def first(self, length: int) -> DataFrame:
        """``PAIR`` and ``rank`` of the ``length`` best chunks of each group."""
        return _ranked(self.all, "group", F.desc("score"), F.col("chunk")).where(F.col("rank") <= length)

    def extent(self) -> tuple[float, float]:
        return tuple(self.all.agg(F.min("score"), F.max("score")).first())


class Vectors:
    """The same scores as dot products of the vectors ``v`` of chunks (``chunk, document, v``) and ``a`` of groups (``group, a``), which no table holds: heads and extent come from
    blocks of both, and single chunks' or documents' scores are taken when they are asked for. A chunk is in one row, and all vectors have one length."""

    def __init__(self, chunks: DataFrame, groups: DataFrame) -> None:
        self.rows, self.means = chunks, groups
        self.groups, self.chunks = groups.select("group"), chunks.select("chunk", "document")

    @property
    def all(self) -> DataFrame:
        return self._met(self.rows)

    def _met(self, rows: DataFrame) -> DataFrame:
        pair = F.aggregate(F.zip_with("v", "a", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return rows.crossJoin(self.means).select("group", "chunk", "document", pair.alias("score"))

    def of_chunks(self, chunks: DataFrame) -> DataFrame:
        return self._met(written(self.rows.join(chunks.select("chunk"), "chunk", "left_semi")))

    def of_documents(self, documents: DataFrame) -> DataFrame:
        return self._met(written(self.rows.join(documents.select("document"), "document", "left_semi")))

    def first(self, length: int) -> DataFrame:
        near = search.nearest(self.rows, "chunk", "v", self.means, "group", "a", length, "dot")
        found = near.select(F.col("query").alias("group"), F.col("key").alias("chunk"), F.col("value").alias("score"), "rank")
        return found.join(self.chunks, "chunk").select(*PAIR, "rank")

    def extent(self) -> tuple[float, float]:
        """Of the best and the worst chunk of each group."""
        high = search.nearest(self.rows, "chunk", "v", self.means, "group", "a", 1, "dot").agg(F.max("value")).first()[0]
        away = self.means.select("group", F.transform("a", lambda x: -x).alias("a"))
        low = search.nearest(self.rows, "chunk", "v", away, "group", "a", 1, "dot").agg(F.max("value")).first()[0]
        return -low, high


def group_quota(n_chunks: int, n_groups: int, per_chunk: int, per_group: int) -> int:
    """Chunks each group gets: as asked, or three quarters of an even share if that is less."""
    return int(min(per_group, 0.75 * n_chunks * per_chunk / max(1, n_groups)))


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def _ranked(rows: DataFrame, by: str, *order: Column, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def _heads(cells: Table | Vectors, length: int) -> DataFrame:
    """The ``length`` best chunks of each group, and the score below which its list goes on (none if it is whole)."""
    top = cells.first(length + 1)
    tail = F.max(F.when(F.col("rank") == length + 1, F.col("score"))).over(Window.partitionBy("group"))
    return written(top.withColumn("tail", tail).where(F.col("rank") <= length).drop("rank"))


def _forward(cells: Table | Vectors, groups: DataFrame, n_chunks: int, n_groups: int, per_chunk: int, quota: int, eps: float, rounds: int) -> tuple[DataFrame, int]:
    """``PAIR`` and ``bid`` of full groups."""
    length = max(HEAD, 2 * quota)
    heads = _heads(cells, length)
    held = written(heads.limit(0).select(*PAIR, F.lit(0.0).alias("bid")))
    before, least_step = None, eps
    for turn in range(rounds):
        eps = least_step * 2 ** (turn // PATIENCE)
        price = held.groupBy("chunk").agg(F.min("bid").alias("price"), F.count("*").alias("n")).where(F.col("n") >= per_chunk).select("chunk", "price")
        has = held.groupBy("group").agg(F.count("*").alias("has"))
        lacks = groups.join(has, "group", "left").select("group", (F.lit(quota) - F.coalesce("has", F.lit(0))).alias("lacks")).where("lacks > 0")
        open_ = heads.join(lacks, "group").join(held.select("group", "chunk"), ["group", "chunk"], "left_anti").join(price, "chunk", "left")
        ranked = _ranked(open_.withColumn("net", F.col("score") - _zero("price")), "group", F.desc("net"), F.col("chunk")).where(F.col("rank") <= quota + 1).where(F.col("rank") <= F.col("lacks") + 1)
        rival = F.max(F.when(F.col("rank") == F.col("lacks") + 1, F.col("net"))).over(Window.partitionBy("group"))
        rival = F.greatest(F.coalesce(rival, F.col("tail"), F.min("net").over(Window.partitionBy("group"))), F.col("tail"))  # greatest() skips nulls
        bids = ranked.withColumn("rival", rival).where((F.col("rank") <= F.col("lacks")) & (F.col("net") >= F.col("rival")))
        bids = bids.select(*PAIR, (F.col("score") - F.col("rival") + eps).alias("bid"))
        held = _ranked(held.unionByName(bids), "chunk", F.desc("bid"), F.col("group")).where(F.col("rank") <= per_chunk).drop("rank")
        held = written(held)
        now = tuple(held.agg(F.count("*"), F.sum("bid")).first())
        if now[0] == quota * n_groups:
            return held, turn + 1
        if now == before:  # nobody could bid: the heads are too short
            if length >= n_chunks:
                raise ValueError("no assignment meets the constraints")
            length *= 2
            heads = _heads(cells, length)
        before = now
    raise RuntimeError(f"the auction did not end in {rounds} rounds; take a larger epsilon")


def _profit(rows: DataFrame, price: DataFrame, premium: DataFrame) -> DataFrame:
    worth = F.col("score") - _zero("price") + _zero("premium")
    return rows.join(price, "chunk", "left").join(premium, "document", "left").withColumn("profit", worth).drop("price", "premium")


def _worst(held: DataFrame, price: DataFrame, premium: DataFrame) -> DataFrame:
    return _profit(held, price, premium).groupBy("group").agg(F.min("profit").alias("worst"))


def _reverse(cells: Table | Vectors, documents: DataFrame, held: DataFrame, price: DataFrame, per_chunk: int, quota: int, eps: float, rounds: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """``held``, ``price`` and ``premium`` once every document has its ``least`` pairs."""
    premium = written(documents.limit(0).select("document", F.lit(0.0).alias("premium")))
    least_step = eps
    for turn in range(rounds):
        eps = least_step * 2 ** (turn // PATIENCE)
        fill = held.groupBy("chunk").agg(F.count("*").alias("n"))
        worst = _worst(held, price, premium)
        taken = held.select("group", "chunk")
        room = (F.lit(per_chunk) - F.coalesce("n", F.lit(0))).alias("room")
        needy = written(price.join(fill, "chunk", "left").select("chunk", "price", room).where("room > 0 AND price > 0"))
        if not needy.isEmpty():
            open_ = cells.of_chunks(needy).join(needy, "chunk").join(taken, ["group", "chunk"], "left_anti").join(worst, "group").join(premium, "document", "left")
            ranked = _ranked(open_.withColumn("beta", F.col("score") + _zero("premium") - F.col("worst")), "chunk", F.desc("beta"), F.col("group")).where(F.col("rank") <= F.col("room") + 1)
            rival = F.max(F.when(F.col("rank") == F.col("room") + 1, F.col("beta"))).over(Window.partitionBy("chunk"))
            low = F.greatest(F.lit(0.0), F.least(F.col("price"), F.coalesce(rival - eps, F.lit(0.0))))
            ranked = written(ranked.withColumn("low", low))
            offers = ranked.where((F.col("rank") <= F.col("room")) & (F.col("beta") > F.col("low"))).select(*PAIR)
            lowered = needy.select("chunk").join(ranked.groupBy("chunk").agg(F.min("low").alias("price")), "chunk", "left").select("chunk", _zero("price").alias("price"))
            price = price.join(needy.select("chunk"), "chunk", "left_anti").unionByName(lowered)
        else:
            has = held.groupBy("document").agg(F.count("*").alias("has"))
            short = documents.join(has, "document", "left").select("document", (F.col("least") - F.coalesce("has", F.lit(0))).alias("short")).where("short > 0")
            short = written(short.join(premium, "document", "left").select("document", "short", _zero("premium").alias("old")))
            if short.isEmpty():
                return held, price, premium, turn
            open_ = cells.of_documents(short).join(short, "document").join(taken, ["group", "chunk"], "left_anti").join(fill, "chunk", "left").withColumn("room", room).where("room > 0").join(worst, "group")
            ranked = _ranked(open_.withColumn("beta", F.col("score") - F.col("worst")), "chunk", F.desc("beta"), F.col("group"), name="place").where(F.col("place") <= F.col("room") + 1)
            inside = _ranked(ranked.where(F.col("place") <= F.col("room")), "document", F.desc("beta"), F.col("chunk"), F.col("group")).where(F.col("rank") <= F.col("short") + 1)
            rival = F.coalesce(F.max(F.when(F.col("rank") == F.col("short") + 1, F.col("beta"))).over(Window.partitionBy("document")), F.min("beta").over(Window.partitionBy("document")))
            inside = written(inside.withColumn("premium", F.greatest(F.col("old"), eps - rival)))
            offers = inside.where(F.col("rank") <= F.col("short")).select(*PAIR)
            raised = inside.groupBy("document").agg(F.max("premium").alias("premium"), F.max("old").alias("old"))
            # a full chunk keeps its worth; one that may fill up costs what the next group would give
            full = held.groupBy("chunk", "document").agg(F.count("*").alias("n")).where(F.col("n") >= per_chunk).join(raised, "document").select("chunk", (F.col("premium") - F.col("old")).alias("more"))
            next_ = ranked.where(F.col("place") == F.col("room") + 1).join(raised.select("document", "premium"), "document").select("chunk", (F.col("beta") + F.col("premium")).alias("more")).where(F.col("more") > eps)
            price = price.unionByName(full.unionByName(next_).withColumnRenamed("more", "price")).groupBy("chunk").agg(F.sum("price").alias("price"))
            premium = premium.join(raised, "document", "left_anti").unionByName(raised.select("document", "premium"))
        price, premium = written(price.where("price > 0")), written(premium)
        both = _profit(held.withColumn("new", F.lit(0)).unionByName(offers.withColumn("new", F.lit(1))), price, premium)
        held = written(_ranked(both, "group", F.desc("profit"), F.col("new"), F.col("chunk")).where(F.col("rank") <= quota).select(*PAIR))
    raise RuntimeError(f"the auction did not end in {rounds} rounds; take a larger epsilon")


def _bound(cells: DataFrame, documents: DataFrame, held: DataFrame, price: DataFrame, premium: DataFrame, per_chunk: int, quota: int) -> float:
    """The value of the dual problem: no assignment has a larger sum of scores."""
    worst = written(_worst(held, price, premium))
    more = _profit(cells, price, premium).join(worst, "group").agg(F.sum(F.greatest(F.lit(0.0), F.col("profit") - F.col("worst")))).first()[0] or 0.0
    groups, chunks = worst.agg(F.sum("worst")).first()[0] or 0.0, price.agg(F.sum("price")).first()[0] or 0.0
    least = premium.join(documents, "document").agg(F.sum(F.col("premium") * F.col("least"))).first()[0] or 0.0
    return quota * groups + per_chunk * chunks - least + more


def assign(scores: DataFrame | Vectors, per_chunk: int = 1, per_group: int = 1, per_document: int = 1, epsilon: float = 0.01, rounds: int = 400) -> Assignment:
    """Chosen pairs of ``scores``, which has ``chunk, document, group, score`` for every chunk and group. ``epsilon`` is a share of the spread of the scores; the sum is within some ``epsilon * spread`` a
    pair of the optimum. A group gets ``group_quota`` chunks; a document gets ``per_document`` pairs, or all it can give. Null scores count as 0.

    Raises ValueError if that can't be met. An empty table gives an empty result."""
    cells = scores if isinstance(scores, Vectors) else Table(scores)
    groups, chunks = cells.groups, cells.chunks
    n_groups, n_chunks = groups.count(), chunks.count()
    if not n_chunks or not n_groups:
        return Assignment(cells.all.limit(0).select("chunk", "group", "score"), lambda: 0.0, 0)
    per_chunk = min(per_chunk, n_groups)
    quota = group_quota(n_chunks, n_groups, per_chunk, per_group)
    documents = written(chunks.groupBy("document").agg(F.least(F.lit(per_document), F.count("*") * per_chunk).alias("least")))
    if documents.agg(F.sum("least")).first()[0] > quota * n_groups:
        raise ValueError("no assignment meets the constraints")
    if not quota:
        return Assignment(cells.all.limit(0).select("chunk", "group", "score"), lambda: 0.0, 0)
    low, high = cells.extent()
    eps = epsilon * ((high - low) or 1.0)
    held, turns = _forward(cells, groups, n_chunks, n_groups, per_chunk, quota, eps, rounds)
    price = held.groupBy("chunk").agg(F.min("bid").alias("price"), F.count("*").alias("n")).where(F.col("n") >= per_chunk).select("chunk", "price").where("price > 0")
    held, price, premium, more = _reverse(cells, documents, held.select(*PAIR), written(price), per_chunk, quota, eps * 2 ** ((turns - 1) // PATIENCE), rounds)
    bound = lambda: _bound(cells.all, documents, held, price, premium, per_chunk, quota) - held.agg(F.sum("score")).first()[0]
    return Assignment(held.select("chunk", "group", "score"), bound, turns + more)


def strongest(pairs: DataFrame, most: int) -> DataFrame:
    """At most ``most`` pairs, those with the best scores; all, if that is 0."""
    return pairs.orderBy(F.desc("score"), "chunk", "group").limit(most) if most else pairs


def assigned_chunks(chunks: DataFrame, chunk: str, pairs: DataFrame, name: str = "assigned_to") -> DataFrame:
    """The chunks with the arrays ``name`` and ``name_score``, by group; empty ones where a chunk has no group."""
    told = pairs.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("group", "score"))).alias("__p"))  # per_chunk entries
    out = chunks.join(told.withColumnRenamed("chunk", "__c"), F.col(chunk) == F.col("__c"), "left")
    kind = dict(pairs.dtypes)["group"]
    to, score = F.transform("__p", lambda x: x["group"]), F.transform("__p", lambda x: x["score"])
    return out.select(*(chunks[c] for c in chunks.columns), F.coalesce(to, F.array().cast(f"array<{kind}>")).alias(name), F.coalesce(score, F.array().cast("array<double>")).alias(f"{name}_score"))
