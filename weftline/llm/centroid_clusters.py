"""Clustering of vectors around centroids, with few exact distances.

Components become integers and all distances are exact. A vector of 64 components is compressed to the sums of its segments and the norms of
what the segments hold beside their means; both are computed once and written with the vector. For a vector x and a centroid c, in a segment of m components,

    |x - c|^2  =  (sum x - sum c)^2 / m  +  |rest x - rest c|^2  >=  (sum x - sum c)^2 / m  +  (|rest x| - |rest c|)^2

by Cauchy and Schwarz. The sum over the segments screens the centroids: they are taken by ascending bound, one gets an
exact integer distance only while its bound, less what floating point may have added, doesn't exceed the least distance found, and so ties are kept too.

A round is one scan of the written table. Each batch adds to one row per centroid and component of its task, Spark adds those up, and the driver gets
``k * (dim + 1)`` numbers; the centroids travel with the tasks (``k * dim`` numbers). No vector is shuffled, so no cluster is too large.

Defined cases: vectors that are null, of another length or with a null or non-finite component take no part and have no row. An integer beyond
``BOUND`` in size counts as ``BOUND``, so that any distance fits in a long; an inertia beyond a long is null. Fewer vectors than centroids: as
many centroids as vectors. Rows that share an id are vectors of their own, those of one hash ordered by their components; a null id hashes as the empty text. An empty table gives an
empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.base import drop, keep, read

DIM, K, ROUNDS, SCALE, SEGMENT = 64, 16, 3, 64, 8
BOUND = 1 << 27


def vectors_of(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The places in an Arrow list column of vectors with ``dim`` components, none null or non-finite, and these as doubles."""
    at = np.flatnonzero(np.asarray(column.is_valid()) & (np.asarray(column.value_lengths().fill_null(-1)) == dim))
    flat = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(flat).all(axis=1)
    return at[good], flat[good]


def compressed(x: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the segments, over the root of their length, and norms of the rest. The last segment may be shorter."""
    starts = np.arange(0, x.shape[1], segment)
    length = np.diff(np.append(starts, x.shape[1]))
    sums = np.add.reduceat(x, starts, axis=1).astype(np.float64)
    rest = x - np.repeat(sums / length, length, axis=1)
    return sums / np.sqrt(length), np.sqrt(np.add.reduceat(rest * rest, starts, axis=1))


def nearest(x: np.ndarray, small: np.ndarray, centroids: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of each integer vector, ties to the smaller number, and how many distances were computed.

    ``small`` is the compressed form, sums and norms side by side."""
    other = np.concatenate(compressed(centroids, segment), axis=1)
    size, other_size = (small * small).sum(axis=1)[:, None], (other * other).sum(axis=1)[None, :]
    low = size + other_size - 2.0 * (small @ other.T)
    low -= 1e-9 * (size + other_size) + 1e-6
    order = np.argsort(low, axis=1, kind="stable")
    low = np.take_along_axis(low, order, axis=1)
    best = np.full(len(x), np.iinfo(np.int64).max)
    label, computed = np.full(len(x), len(centroids)), 0
    for turn in range(len(centroids)):
        rows = np.flatnonzero(low[:, turn] <= best)
        if not len(rows):
            break
        which = order[rows, turn]
        gap = x[rows].astype(np.int64) - centroids[which]
        far = (gap * gap).sum(axis=1)
        computed += len(rows)
        closer = (far < best[rows]) | ((far == best[rows]) & (which < label[rows]))
        best[rows[closer]], label[rows[closer]] = far[closer], which[closer]
    return label, best, computed


def prepare(rows: DataFrame, id_col: str, vector_col: str, dim: int = DIM, scale: int = SCALE, segment: int = SEGMENT) -> DataFrame:
    """``id, q, small`` of the vectors that take part: integers and compressed form, packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = vectors_of(batch.column(1), dim)
            whole = np.clip(np.floor(scale * x), -BOUND, BOUND).astype(np.int32)
            small = np.concatenate(compressed(whole.astype(np.int64), segment), axis=1)
            packed = [pa.array([r.tobytes() for r in part], pa.binary()) for part in (whole, small)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *packed], ["id", "q", "small"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(pack, f"id {kind}, q binary, small binary")


def unpack(batch: pa.RecordBatch, name: str, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), dtype=kind).reshape(-1, width)


def first_centroids(held: DataFrame, k: int = K, dim: int = DIM) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of ``1:`` and their id."""
    rank = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = held.select(rank.alias("rank"), "q").orderBy("rank", "q").limit(k).collect()  # k rows
    return np.array([np.frombuffer(r["q"], dtype=np.int32) for r in rows], dtype=np.int64).reshape(-1, dim)


def next_centroids(held: DataFrame, centroids: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """The floor of each cluster's mean; the old centroid where a cluster is empty."""
    k, dim = centroids.shape
    width = 2 * -(-dim // segment)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), dtype=np.int64)
        for batch in batches:
            x = unpack(batch, "q", np.int32, dim)
            label, _, _ = nearest(x, unpack(batch, "small", np.float64, width), centroids, segment)
            for c in np.unique(label):
                mine = x[label == c]
                total[c, :dim] += mine.sum(axis=0, dtype=np.int64)
                total[c, dim] += len(mine)
        used = np.flatnonzero(total[:, dim])
        place = (used[:, None] * (dim + 1) + np.arange(dim + 1)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.ravel()[place])], ["place", "part"])

    parts = held.select("q", "small").mapInArrow(add, "place long, part long")
    sums: dict[int, int] = {r["place"]: int(r["total"]) for r in parts.groupBy("place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()}  # k * (dim + 1) rows
    out = centroids.copy()
    for c in range(k):
        if n := sums.get(c * (dim + 1) + dim):
            out[c] = [sums[c * (dim + 1) + i] // n for i in range(dim)]
    return out


def assign(held: DataFrame, centroids: np.ndarray, segment: int = SEGMENT) -> DataFrame:
    """``id, cluster, distance, computed``: the last counts the exact distances of the row's batch, in its first row."""
    dim = centroids.shape[1]
    width = 2 * -(-dim // segment)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, far, computed = nearest(unpack(batch, "q", np.int32, dim), unpack(batch, "small", np.float64, width), centroids, segment)
            counts = np.zeros(len(where), dtype=np.int64)
            counts[:1] = computed
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(where.astype(np.int32)), pa.array(far), pa.array(counts)], ["id", "cluster", "distance", "computed"])

    return held.mapInArrow(label, f"id {held.schema['id'].dataType.simpleString()}, cluster int, distance long, computed long")


def cluster(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, segment: int = SEGMENT) -> tuple[DataFrame, np.ndarray]:
    """The written assignment (see ``assign``) and the final centroids."""
    held = keep(prepare(rows, id_col, vector_col, dim, scale, segment), "centroid-vectors")
    centroids = first_centroids(held, k, dim)
    for _ in range(rounds if len(centroids) else 0):
        centroids = next_centroids(held, centroids, segment)
    done = keep(assign(held, centroids, segment), "centroid-labels")
    drop(held)
    return done, centroids


def centroid_clusters(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """One row per vector that takes part: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    done, centroids = cluster(rows, id_col, vector_col, k, rounds)
    spark = rows.sparkSession
    sums = done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    held = {r["cluster"]: int(r["s"]) for r in sums}
    in_long = lambda n: n if n < 1 << 63 else None
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame(
        [(c, in_long(s), in_long(sum(held.values())), names[c]) for c, s in held.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return done.join(F.broadcast(facts), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(read(spark, sf_dir, "embeddings"))


def _round_sql(i: int) -> str:
    return f"""
a{i} AS (SELECT v.vec_id, v.q, c.c, list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS far FROM kept v CROSS JOIN c{i} c
    QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY far, c.c) = 1),
s{i} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, unnest(range({DIM})) AS i FROM a{i}) GROUP BY c, i),
m{i} AS (SELECT c, list((s - (((s % n) + n) % n)) // n ORDER BY i) AS q FROM s{i} GROUP BY c),
c{i + 1} AS (SELECT c.c, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m ON m.c = c.c)"""


ORACLE = f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, q FROM kept ORDER BY sha256('1:' || vec_id) LIMIT {K}),
{",".join(_round_sql(i).replace(" AS (SELECT", " AS MATERIALIZED (SELECT") for i in range(ROUNDS + 1))}
SELECT a.vec_id, a.c::INTEGER AS cluster, a.far AS distance, (sum(a.far) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.far) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.c = a.c
"""
