"""Similarity search, clustering and constrained assignment over embedding vectors.

Query sets and anchors are broadcast in blocks of ``MAX_QUERIES`` rows; the vectors of the table are only scanned,
once a block.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import assignment, prompts, search
from weftline.operators.graph import written
from weftline.operators.order import keep_first

MAX_QUERIES = 1000


def bounded(queries: DataFrame, most: int = MAX_QUERIES) -> DataFrame:
    """A broadcast of a table whose size has been checked."""
    if queries.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} queries")
    return F.broadcast(queries)


def in_blocks(queries: DataFrame, key: str, most: int = MAX_QUERIES) -> list[DataFrame]:
    """Broadcasts of the queries in blocks of some ``most`` rows, dealt by a hash of ``key``: each block is scored against the table on its own."""
    n = -(-queries.count() // most)
    return [F.broadcast(queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) if n > 1 else queries) for i in range(max(1, n))]


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Between -1 and 1; equal vectors have exactly 1, since the root is taken of the product. NaN for a vector without length."""
    length = F.sqrt(dot(a, a) * dot(b, b))
    d = dot(a, b)
    c = d / F.when(length != 0, length)
    return F.when(d.isNull() | (F.size(a) == 0), F.lit(None)).when((length == 0) | F.isnan(c), F.lit(float("nan"))).when(c > 1, F.lit(1.0)).when(c < -1, F.lit(-1.0)).otherwise(c)


def top_k(df: DataFrame, vector: str, query: DataFrame, query_vector: str, k: int, order: Sequence[str]) -> DataFrame:
    """The k rows most similar to one query, best first, ties in reverse row order; adds ``sim``."""
    q = bounded(query.select(F.col(query_vector).alias("__q")), 1)
    scored = df.crossJoin(q).withColumn("sim", cosine(F.col(vector), F.col("__q"))).drop("__q")
    return scored.orderBy(F.desc("sim"), *(F.col(o).desc() for o in order)).limit(k)


def top_k_any(df: DataFrame, key: str, vector: str, queries: DataFrame, query_vector: str, k: int) -> DataFrame:
    """``key, dist``: the k rows with the least cosine distance to any of the queries. Each of them is among the k nearest of some query."""
    numbered = queries.select(F.xxhash64(query_vector).alias("query"), F.col(query_vector).alias("q")).dropDuplicates(["query", "q"])
    rows, asked = search.dealt(search.keyed(df, key, vector), search.keyed(numbered, "query", "q"))
    found = search.nearest_within(rows, asked, k, "distance", per_key=True)
    return found.groupBy(F.col("key").alias(key)).agg(F.min("value").alias("dist")).orderBy(F.col("dist").asc_nulls_last(), key).limit(k)


def top_k_uniform(df: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int, rounds: int = 1000) -> DataFrame:
    """``key, query, dist``: k // q rows for each query, none twice; a row goes to the query with the least key that wants it.

    Deferred acceptance: each query asks for the best rows of its list that no query before it holds, a row goes to the first that asks, and the rounds end once nothing
    changes. No query needs more of its list than the rows that all queries take together, at most k."""
    n = queries.count()
    each = k // max(1, n)
    near = search.nearest(df, key, vector, queries, query_key, query_vector, each * n, "distance")
    first = lambda rows, most: rows.withColumn("__r", F.row_number().over(Window.partitionBy("query").orderBy("dist", key))).where(F.col("__r") <= most).drop("__r")
    lists = written(near.select("query", F.col("key").alias(key), F.col("value").alias("dist")))
    held, before = written(lists.limit(0)), None
    for _ in range(rounds):
        holder = held.select(F.col(key).alias("__k"), F.col("query").alias("__holder"))
        free = lists.join(holder, F.col(key) == F.col("__k"), "left").where(F.col("__holder").isNull() | (F.col("__holder") >= F.col("query"))).select(*lists.columns)
        asked = first(free, each)
        held = written(asked.groupBy(key).agg(F.min(F.struct("query", "dist")).alias("x")).select(key, "x.query", "x.dist"))
        now = tuple(held.agg(F.count("*"), F.bit_xor(F.xxhash64(key, "query"))).first())
        if now == before:
            return held
        before = now
    raise RuntimeError(f"rows did not settle in {rounds} rounds")


def top_k_capped(df: DataFrame, key: str, group: str, vector: str, query: DataFrame, query_vector: str, k: int, per_group: int) -> DataFrame:
    """``key, group, sim``: the best k rows with at most ``per_group`` of each group."""
    q = bounded(query.select(F.col(query_vector).alias("__q")), 1)
    scored = df.crossJoin(q).select(key, group, cosine(F.col(vector), F.col("__q")).alias("sim"))
    ranked = scored.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("sim"), key)))
    return ranked.where(F.col("r") <= per_group).drop("r").orderBy(F.desc("sim"), key).limit(k)


def top_k_queries(df: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int) -> DataFrame:
    """``query, key, sim, rank``: the best k rows of each query."""
    best = search.nearest(df, key, vector, queries, query_key, query_vector, k)
    return best.select("query", F.col("key").alias(key), F.col("value").alias("sim"), "rank")


def cells_of(df: DataFrame, key: str, vector: str, n_cells: int = 64) -> DataFrame:
    """``key, v, cell, gap, centre``: the vectors, the nearest of ``n_cells`` rows chosen by hash, and the distance of the two as unit vectors. Vectors without a direction are in
    cell -1 at no distance. Written once; serves any number of searches."""
    rows = df.select(F.col(key), F.col(vector).cast("array<double>").alias("v"))
    chosen = rows.where(search.has_direction(F.col("v"))).orderBy(F.xxhash64(key), key).limit(n_cells).select(unit(F.col("v")).alias("c"))
    centres = [r.c for r in chosen.collect()]  # n_cells vectors
    placed = search.placed(rows, "v", centres)
    return written(placed.select(key, "v", "cell", "gap", F.get(F.lit(centres) if centres else F.lit(None).cast("array<array<double>>"), F.col("cell")).alias("centre")))


def unit(v: Column) -> Column:
    """The vector at length 1; null for one without a direction."""
    length = F.array_repeat(F.sqrt(dot(v, v)), F.size(v))  # taken once a vector, not once a component
    return F.when(search.has_direction(v), F.zip_with(v, length, lambda x, n: x / n))


def pruned_top_k(df: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int, n_cells: int = 64) -> tuple[DataFrame, DataFrame]:
    """The rows of ``top_k_queries``, and ``query, cell, n``: the cells each query was scored against, with their rows.

    A cell has a centre and a radius, the largest distance of its rows to it. A query takes its nearest cells until they hold ``k`` rows and scores those; the k-th distance then
    kills each cell whose centre is further away than that distance and the radius together, by the triangle inequality. Cells meet their queries in blocks; only the best rows of
    a block leave it."""
    table = cells_of(df.select(key, vector), key, vector, n_cells)
    cells = written(table.groupBy("cell").agg(F.coalesce(F.max("gap"), F.lit(float("inf"))).alias("radius"), F.count("*").alias("n"), F.first("centre").alias("centre")))  # n_cells rows
    asked = written(queries.select(F.col(query_key).alias("query"), F.col(query_vector).cast("array<double>").alias("q")))
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot(F.col("u"), F.col("centre"))))
    order = Window.partitionBy("query").orderBy("far", "cell")
    met = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    far = F.coalesce(apart, F.lit(0.0)).alias("far")
    pairs = written(asked.withColumn("u", unit(F.col("q"))).crossJoin(F.broadcast(cells)).select("query", "cell", "n", "radius", far).withColumn("first", met < k))
    rows = F.broadcast(cells.select("cell", F.ceil(F.col("n") / search.ROWS).cast("int").alias("parts")))
    most = max(1, -(-asked.count() // search.QUERIES))
    block = F.pmod(F.xxhash64("query"), F.lit(most)).cast("int").alias("c")
    every = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    held = table.join(rows, "cell").select("cell", F.pmod(F.xxhash64(key, "v"), F.col("parts")).cast("int").alias("r"), F.col(key).alias("key"), "v", every(F.lit(most)).alias("c"))

    def scored(chosen: DataFrame) -> DataFrame:
        part = F.struct("cell", "r", "c").alias("part")
        mine = chosen.select("query", "cell").join(asked, "query").join(rows, "cell").select("cell", every(F.col("parts")).alias("r"), block, F.col("query").alias("key"), F.col("q").alias("v"))
        return search.nearest_within(held.select(part, "key", "v"), mine.select(part, "key", "v"), k, "cosine")

    seen = written(search.ranked(scored(pairs.where("first")), k, "cosine"))
    reach = seen.where(F.col("rank") == k).where("NOT isnan(value)").select("query", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("value"))).alias("reach"))
    left = pairs.where("NOT first").join(reach, "query", "left").where(F.col("reach").isNull() | (F.col("far") <= F.col("reach") + F.col("radius") + 1e-7))
    taken = pairs.where("first").select("query", "cell", "n").unionByName(left.select("query", "cell", "n"))
    best = search.ranked(seen.drop("rank").unionByName(scored(left)), k, "cosine")
    return best.select("query", F.col("key").alias(key), F.col("value").alias("sim"), "rank"), taken


def first_hits(hits: DataFrame, file: str, order: Sequence[str]) -> DataFrame:
    """One hit per file, the first in order."""
    return keep_first(hits, [file], order)


def cluster(df: DataFrame, vector: str, k: int, rerolls: int = 10, seed: int = 0, name: str = "label") -> DataFrame:
    """K-means with ``rerolls`` seeds; the labelling with the least variance of cluster sizes."""
    data = df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>"))).persist()
    best = None
    for i in range(rerolls):
        out = KMeans(k=k, seed=seed + i, featuresCol="__v", predictionCol="__c").fit(data).transform(data)
        spread = out.groupBy("__c").count().agg(F.var_pop("count")).first()[0] or 0.0
        if best is None or spread < best[0]:
            best = (spread, out)
    data.unpersist()
    return best[1].withColumn(name, F.col("__c").cast("string")).drop("__v", "__c")


def cluster_by_size(df: DataFrame, vector: str, per_cluster: int, rerolls: int = 4, seed: int = 0) -> DataFrame:
    return cluster(df, vector, max(1, df.count() // per_cluster), rerolls, seed)


def group_means(anchors: DataFrame, group: str, anchor_vector: str) -> DataFrame:
    """``group, a, n``: the mean of a group's ``n`` anchors, one for each length they have; null for a group without an anchor free of nulls."""
    rows = anchors.select(F.col(group).alias("group"), F.col(anchor_vector).cast("array<double>").alias("a"))
    rows = rows.select("group", F.when(~F.exists("a", lambda x: x.isNull()), F.col("a")).alias("a"))
    parts = rows.select("group", F.size("a").alias("size"), F.posexplode("a").alias("pos", "x")).groupBy("group", "size", "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))  # one vector's components
    means = parts.groupBy("group", "size").agg(F.transform(ordered, lambda s: s["x"]).alias("a"), F.max("n").alias("n"))
    bare = rows.groupBy("group").agg(F.max(F.size("a")).alias("size")).where("size IS NULL OR size <= 0")
    return means.select("group", "a", "n").unionByName(bare.select("group", F.lit(None).cast("array<double>").alias("a"), F.lit(0).cast("long").alias("n")))


def affinity(chunks: DataFrame, chunk_key: str, document: str, vector: str, anchors: DataFrame, group: str, anchor_vector: str) -> DataFrame:
    """``chunk, document, group, score``: mean dot product of each chunk with a group's anchors, taken as the dot product with their mean. Null where no anchor has a chunk's length."""
    named = chunks.select(F.col(chunk_key).alias("chunk"), F.col(document).alias("document"), F.col(vector).cast("array<double>").alias("__v"))
    near = [named.crossJoin(m).select("chunk", "document", "group", dot(F.col("__v"), F.col("a")).alias("s"), "n") for m in in_blocks(written(group_means(anchors, group, anchor_vector)), "group")]
    weight = F.sum(F.when(F.col("s").isNotNull(), F.col("n")))
    return reduce(DataFrame.unionByName, near).groupBy("chunk", "document", "group").agg((F.sum(F.col("s") * F.col("n")) / F.when(weight > 0, weight)).alias("score"))


def anchored_top_k(chunks: DataFrame, chunk_key: str, document: str, vector: str, anchors: DataFrame, group: str, anchor_vector: str, per_chunk: int = 1, per_group: int = 1, per_document: int = 1, epsilon: float = 0.01) -> assignment.Assignment:
    """``chunk, group, score``: chunks assigned to anchored groups within the limits, the sum of scores within ``gap`` of the optimum."""
    means = written(group_means(anchors, group, anchor_vector))
    rows = written(chunks.select(F.col(chunk_key).alias("chunk"), F.col(document).alias("document"), F.col(vector).cast("array<double>").alias("v")))
    lengths = means.agg(F.max(F.size("a")), F.min(F.when(F.col("n") > 0, F.size("a"))), F.count("*"), F.countDistinct("group"), F.count("group")).first()
    once = rows.groupBy("chunk").count().where("count > 1 OR chunk IS NULL").isEmpty()
    if lengths[0] is None or lengths[0] < 1 or lengths[0] != lengths[1] or not lengths[2] == lengths[3] == lengths[4] or not once:
        scores = affinity(chunks, chunk_key, document, vector, anchors, group, anchor_vector)  # several lengths or rows: a table of scores
    else:
        # a score that is null counts as 0, as with a vector of zeros
        none = F.array_repeat(F.lit(0.0), lengths[0])
        whole = lambda c: F.when((F.size(c) == lengths[0]) & ~F.exists(c, lambda x: x.isNull()), F.col(c)).otherwise(none)
        scores = assignment.Vectors(written(rows.withColumn("v", whole("v"))), written(means.select("group", whole("a").alias("a"))))
    return assignment.assign(scores, per_chunk, per_group, per_document, epsilon)


def bullet_assignments(bullets: DataFrame, bullet: str, bullet_vector: str, chunks: DataFrame, chunk: str, vector: str, text: str, k: int) -> DataFrame:
    """``bullet, chunks, context``: the ids of each bullet's k nearest chunks, best first, and their texts joined by blank lines."""
    near = top_k_queries(chunks, chunk, vector, bullets, bullet, bullet_vector, k).join(chunks.select(chunk, text), chunk)
    rows = F.array_sort(F.collect_list(F.struct("rank", F.col(chunk).alias("c"), F.col(text).alias("t"))))  # k rows at most
    held = near.groupBy("query").agg(rows.alias("r"))
    return held.select(F.col("query").alias("bullet"), F.transform("r", lambda x: x["c"]).alias("chunks"), F.array_join(F.transform("r", lambda x: x["t"]), "\n\n").alias("context"))


def section_chunks(
    bullets: DataFrame, section: str, bullet_vector: str, chunks: DataFrame, chunk: str, document: str, vector: str, references: DataFrame, reference: str, per_chunk: int = 1, per_section: int = 1, per_document: int = 1
) -> DataFrame:
    """``section, chunk, document, reference, score``: chunks assigned to the sections whose bullets they fit, within the limits; ``references`` has ``document`` and its
    description, and a document without one gets an empty text."""
    pairs = anchored_top_k(chunks, chunk, document, vector, bullets, section, bullet_vector, per_chunk, per_section, per_document).rows
    of = chunks.select(F.col(chunk).alias("chunk"), F.col(document).alias("document"))
    told = references.select(F.col(document).alias("document"), F.col(reference).alias("reference"))
    rows = pairs.join(of, "chunk").join(told, "document", "left")
    return rows.select(F.col("group").alias("section"), "chunk", "document", F.coalesce("reference", F.lit("")).alias("reference"), "score")


def search_prompt(chunks: DataFrame, chunk: str, source: str, text: str, vector: str, query: DataFrame, query_vector: str, k: int = 30) -> DataFrame:
    """One row with ``prompt``: a user message of the chunks nearest to one query by dot product, best first, at most ``k`` and three quarters of all."""
    most = assignment.group_quota(chunks.count(), 1, 1, k)
    q = bounded(query.select(F.col(query_vector).alias("__q")), 1)
    near = chunks.crossJoin(q).withColumn("__s", dot(F.col(vector), F.col("__q"))).orderBy(F.desc("__s"), chunk).limit(most)
    part = F.concat(F.lit("Chunk ID: "), F.col(chunk).cast("string"), F.lit("\nFrom: "), F.coalesce(F.col(source).cast("string"), F.lit("")), F.lit("\n\n"), F.coalesce(F.col(text), F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("__s")).alias("s"), F.col(chunk).alias("c"), part.alias("p"))))  # k rows at most
    body = near.agg(F.array_join(F.transform(parts, lambda x: x["p"]), f"\n\n{'=' * 33}\n\n").alias("body"))
    return body.select(prompts.start("user", F.col("body")).alias("prompt"))
