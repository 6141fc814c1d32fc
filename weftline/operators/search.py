"""Exact nearest rows of many queries: blocks of rows meet blocks of queries in tasks of bounded size.

A task multiplies its two blocks and takes the exact measure, summed in order of the components, of what may be among a query's best; no table of
scores leaves it, only ``k`` rows a query. The work is rows times queries by nature; what is shuffled is each table as often as the other has blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and queries of a task at most (on average); rows that are multiplied at once; pairs measured at once.
ROWS, QUERIES, STEP, PAIRS = 32_768, 4_096, 512, 1 << 16
#: Least rows of a task, where there are idle cores.
LEAST = 2_048
#: By how much a product of unit vectors may differ from the exact measure.
SLACK = 1e-9


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows, and the length of each; -1 for those that are null or hold a null, and zeros after the end of shorter ones."""
    a = column.combine_chunks().cast(pa.list_(pa.float64()))
    size = np.asarray(a.value_lengths().fill_null(-1)).astype(np.int64)
    flat = a.flatten()
    values = np.asarray(flat.fill_null(0.0))
    at = np.repeat(np.arange(len(size)), np.maximum(size, 0))
    place = np.arange(len(at)) - np.repeat(np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0), np.maximum(size, 0))
    out = np.zeros((len(size), max(1, size.max(initial=0))))
    out[at, place] = values
    if flat.null_count:
        size[at[np.asarray(flat.is_null())]] = -1
    return out, size


def summed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The dot products of the rows of two matrices, summed from the first component to the last."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * y[:, j]
    return out


def measured(measure: str, x: np.ndarray, y: np.ndarray, xx: np.ndarray, yy: np.ndarray) -> np.ndarray:
    """``dot``, ``cosine`` or ``distance`` (1 - cosine) of the rows of ``x`` and ``y`` with squared lengths ``xx`` and ``yy``."""
    d = summed(x, y)
    if measure == "dot":
        return d
    c = np.clip(d / np.sqrt(xx * yy), -1.0, 1.0)
    return c if measure == "cosine" else 1 - c


def order_of(query: np.ndarray, value: np.ndarray, null: np.ndarray, key: np.ndarray, measure: str) -> np.ndarray:
    """By query, best value first (as Spark sorts: not a number is the largest, null the last), then by key."""
    nan = np.isnan(value) & ~null
    v = np.where(np.isnan(value), 0.0, value)
    if measure == "distance":
        return np.lexsort((key, v, nan, null, query))
    return np.lexsort((key, -v, ~nan, null, query))


def merged(parts: list, place: np.ndarray, k: int, measure: str, per_key: bool) -> list[np.ndarray]:
    """The ``k`` best of each query in the row numbers, query numbers, values and nulls of ``parts``, in order."""
    a, b, value, null = (np.concatenate(p) for p in zip(*parts, strict=True))
    o = order_of(b, value, null, place[a], measure)
    if per_key:  # a key that several rows share counts once, by its best row
        once = o[np.lexsort((place[a[o]], b[o]))]
        first = np.ones(len(a), bool)
        first[1:] = (b[once][1:] != b[once][:-1]) | (place[a[once]][1:] != place[a[once]][:-1])
        o = o[np.isin(o, once[first])]
    start = np.searchsorted(b[o], b[o])
    o = o[np.arange(len(o)) - start < k]
    return [a[o], b[o], value[o], null[o]]


def raised(floor: np.ndarray, held: list, k: int, measure: str, qq: np.ndarray) -> np.ndarray:
    """The floors with the k-th value, as a product with the query's unit vector, of each query that has so many."""
    _, b, value, _ = held
    last = np.flatnonzero((np.arange(len(b)) - np.searchsorted(b, b) == k - 1) & ~np.isnan(value))
    score, of = value[last], b[last]
    if measure == "distance":
        score = 1 - score
    elif measure == "dot":
        score = score / np.sqrt(qq[of])
    good = np.isfinite(score)
    out = floor.copy()
    out[of[good]] = np.maximum(out[of[good]], score[good])
    return out


def best_of(rows: pa.Table, queries: pa.Table, k: int, measure: str, per_key: bool = False) -> pa.Table:
    """``query, key, value``: the ``k`` best rows of each query."""
    x, nx = matrix(rows["v"])
    q, nq = matrix(queries["v"])
    width = max(x.shape[1], q.shape[1])
    x, q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, q))
    names = rows["key"].combine_chunks()
    # the place of each key among all, so that keys of any type sort as numbers; a null is the least
    if pa.types.is_integer(names.type) and not names.null_count:
        place = np.asarray(names).astype(np.int64)
    else:
        place = np.asarray(pc.rank(names, null_placement="at_start", tiebreaker="min")).astype(np.int64)
    with np.errstate(all="ignore"):
        xx, qq = summed(x, x), summed(q, q)
        plain_x = (nx >= 0) & np.isfinite(xx) & (xx > 0)
        plain_q = (nq >= 0) & np.isfinite(qq) & (qq > 0)
        ux = np.where(plain_x[:, None], x / np.sqrt(np.where(plain_x, xx, 1.0))[:, None], 0.0)
        uq = np.where(plain_q[:, None], q / np.sqrt(np.where(plain_q, qq, 1.0))[:, None], 0.0)
        scale = np.sqrt(np.where(plain_x, xx, 0.0)) if measure == "dot" else None
        slack = SLACK * (scale.max(initial=0.0) if measure == "dot" else 1.0)
        floor = np.full(len(q), -np.inf)
        held, fresh, pending = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool)], [], 0
        for lo in range(0, len(x), STEP):
            hi = min(lo + STEP, len(x))
            s = ux[lo:hi] @ uq.T
            if measure == "dot":
                s *= scale[lo:hi, None]
            if hi - lo >= k and not per_key and np.isneginf(floor).any():
                some = np.where(plain_x[lo:hi, None], s, -np.inf)
                floor = np.maximum(floor, np.partition(some, hi - lo - k, axis=0)[hi - lo - k])
            may = s >= floor - slack
            # vectors that have no direction, or another length, are measured one by one
            may |= ~plain_x[lo:hi, None] | ~plain_q[None, :] | (nx[lo:hi, None] != nq[None, :])
            i, j = np.nonzero(may)
            i += lo
            for at in range(0, len(i), PAIRS):
                a, b = i[at : at + PAIRS], j[at : at + PAIRS]
                value = measured(measure, x[a], q[b], xx[a], qq[b])
                null = (nx[a] != nq[b]) | (nx[a] < 0) | ((nx[a] == 0) & (measure != "dot"))
                value[null] = np.nan
                fresh.append((a, b, value, null))
                pending += len(a)
                if pending >= max(PAIRS, len(held[0]) // 2):
                    held, fresh, pending = merged([held, *fresh], place, k, measure, per_key), [], 0
                    floor = raised(floor, held, k, measure, qq)
        held = merged([held, *fresh], place, k, measure, per_key)
    a, b, value, null = held
    return pa.table({"query": queries["key"].combine_chunks().take(pa.array(b)), "key": names.take(pa.array(a)), "value": pa.array(value, mask=null)})


def nearest_within(rows: DataFrame, queries: DataFrame, k: int, measure: str, per_key: bool = False) -> DataFrame:
    """``query, key, value``: of ``part, key, v`` the ``k`` best rows of each query in each part, ``queries`` being ``part, key, v`` too."""
    schema = T.StructType([T.StructField("query", queries.schema["key"].dataType), T.StructField("key", rows.schema["key"].dataType), T.StructField("value", T.DoubleType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return best_of(left, right, k, measure, per_key)

    return rows.groupBy("part").cogroup(queries.groupBy("part")).applyInArrow(run, schema)


def has_direction(v: Column) -> Column:
    """Whether a vector has a length other than 0 and infinity, and no null."""
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return F.coalesce((square > 0) & (square < float("inf")), F.lit(False))


def placed(df: DataFrame, vector: str, centres: list[list[float]]) -> DataFrame:
    """``df`` with ``cell``, the place of the nearest of the unit vectors ``centres``, and ``gap``, the distance of the vector, as a unit vector, to it; -1 and
    null for vectors without a direction or of another length."""
    schema = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType())])
    width = len(centres[0]) if centres else 0
    c = np.array([x for x in centres if len(x) == width]).reshape(-1, max(1, width))
    at = np.array([i for i, x in enumerate(centres) if len(x) == width], np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, n = matrix(pa.chunked_array([b.column(vector)]))
            cell, gap = np.full(len(x), -1, np.int32), np.zeros(len(x))
            with np.errstate(all="ignore"):
                xx = summed(x, x)
            good = np.flatnonzero((n == width) & np.isfinite(xx) & (xx > 0)) if len(c) else np.empty(0, np.int64)
            if len(good):
                s = (x[good, :width] / np.sqrt(xx[good])[:, None]) @ c.T
                near = s.argmax(axis=1)
                cell[good] = at[near]
                gap[good] = np.sqrt(np.maximum(0.0, 2 - 2 * s[np.arange(len(good)), near]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(gap, mask=cell < 0)], names=schema.names)

    return df.mapInArrow(run, schema)


def dealt(rows: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``part, key, v`` of the ``key, v`` of both, such that each row meets each query in one part of bounded size."""
    n, m = rows.count(), queries.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    right = max(1, -(-m // QUERIES))
    left = max(1, -(-n // ROWS), min(-(-cores // right), n // LEAST))
    dealt_by = lambda c, parts: F.pmod(F.xxhash64(c, "v"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    x = rows.select("key", "v", dealt_by("key", left).alias("r")).select("*", every(right).alias("c"))
    q = queries.select("key", "v", dealt_by("key", right).alias("c")).select("*", every(left).alias("r"))
    part = (F.col("r") * right + F.col("c")).alias("part")
    return x.select(part, "key", "v"), q.select(part, "key", "v")


def best_order(value: str, measure: str) -> Column:
    return F.col(value).asc_nulls_last() if measure == "distance" else F.col(value).desc_nulls_last()


def ranked(found: DataFrame, k: int, measure: str) -> DataFrame:
    """``query, key, value, rank``: the ``k`` best of what the parts found."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(best_order("value", measure), "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def keyed(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.col(vector).alias("v"))


def nearest(df: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int, measure: str = "cosine") -> DataFrame:
    """``query, key, value, rank``: the ``k`` best rows of each query by ``measure`` (cosine, dot: largest; distance: least), ties to the lesser key."""
    rows, asked = dealt(keyed(df, key, vector), keyed(queries, query_key, query_vector))
    return ranked(nearest_within(rows, asked, max(k, 1), measure), k, measure)
