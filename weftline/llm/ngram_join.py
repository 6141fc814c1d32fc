"""N-gram Jaccard self-join as a blocked sparse product of the document by n-gram incidence.

Rows of the incidence matrix are the documents' sets of five-word shingles, columns the
shingles in the order of their 64-bit hash. Documents with the same set share a row (and
thus have a Jaccard similarity of 1). The first column block of a row is its prefix: its
p(n) first shingles. Two rows that link differ in few columns, so they must agree in

    c >= min(p(a) - (a - o), p(b) - (b - o)),   o = ceil(80 (a + b) / 180)

columns of the prefix block, a and b being their sizes and o the overlap that the
similarity asks for. The product of the prefix blocks is accumulated column by column;
pairs below that bound are dropped, the others get their full overlap from the whole rows.

Columns that more than ``wide`` rows share are not multiplied out one by one. A row is
only carried on in them if it has enough such columns for the bound to be met through
them. Those rows fall into groups that share wide columns; the groups are cut into blocks
of about ``BLOCK`` incidences and multiplied block by block in numpy over whole rows. Such a
task keeps the overlap counts to itself and returns the links that join its components,
so a large group of near copies costs no row per pair.

Words are runs of anything but space and ASCII controls 9 to 13, with A-Z in lower case.
Defined cases: a text with fewer than five words has its whole word sequence as its one
shingle; null, empty and blank texts have no shingle and link with nothing; repeated rows
link with each other; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bloom
from weftline.llm.base import keep, read, text_key
from weftline.llm.components import components

WORDS, PERCENT = 5, 80
#: A column with more rows than this is handled by stars.
WIDE = 24
#: Incidences in a block of the product of wide columns: two blocks of 8-byte numbers meet in a task.
BLOCK = 500_000
#: Least length of a prefix block: a passage that many short documents share stays a small part of it.
SHORT = 80
#: 65,536 blocks of 64 bytes: 4 MB.
NEED_BLOCKS = 1 << 16
MUL, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SHIFT = np.uint64(32)


def shingle_set(text: str | None, width: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    take = min(width, n)
    acc = h[: n - take + 1].copy()
    for k in range(1, take):
        acc = acc * MUL + h[k : n - take + 1 + k]
    acc += np.uint64(take)
    for _ in range(2):
        acc ^= acc >> SHIFT
        acc *= MIX
    acc ^= acc >> SHIFT
    return np.unique(acc)


def signature(s: np.ndarray, seed: int = 0) -> int:
    """A signed 64-bit hash of a set."""
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed) - (1 << 63)


def prefix_len(n, percent: int = PERCENT):
    """Length of the prefix block of a row with n shingles: a twentieth more than a link needs, and ``SHORT`` at least."""
    return np.minimum(n, np.maximum(SHORT, n - -(-percent * n // 100) + 1 + -(-n // 20)))


def least_overlap(a, b, percent: int = PERCENT):
    return -(-percent * (a + b) // (100 + percent))


def shared_least(a, b, percent: int = PERCENT):
    """Columns of the prefix block that linked rows of these sizes share at least."""
    o = least_overlap(a, b, percent)
    return np.minimum(prefix_len(a, percent) - (a - o), prefix_len(b, percent) - (b - o))


@lru_cache(maxsize=100_000)
def least_any(n: int, percent: int = PERCENT) -> int:
    """The least of that over all sizes that may link with n."""
    return max(1, int(shared_least(n, np.arange(-(-n * percent // 100), n * 100 // percent + 1), percent).min()))


def sql_prefix(n: Column, percent: int) -> Column:
    return F.least(n, F.greatest(F.lit(SHORT), n - F.ceil(n * percent / 100) + 1 + F.ceil(n / 20)))


def sql_bound(a: Column, b: Column, percent: int) -> Column:
    """The same as ``shared_least``."""
    o = F.ceil((a + b) * percent / (100 + percent))
    return F.least(sql_prefix(a, percent) - (a - o), sql_prefix(b, percent) - (b - o))


def _sizes(width: int, seed: int) -> Callable:
    """Each row's set size and signature, and a second hash that tells signatures apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, width) for t in b.column(3).to_pylist()]
            more = [[len(s) for s in sets], [signature(s, seed) for s in sets], [signature(s, ~seed & 0xFFFF) for s in sets]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(x, pa.int64()) for x in more)], ["doc_id", "k1", "k2", "n", "sig", "check"])

    return run


def _prefixes(width: int, percent: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[int, np.ndarray] = {}
            for t in b.column(1).to_pylist():
                s = shingle_set(t, width)
                if len(s):
                    seen.setdefault(signature(s, seed), s)
            if not seen:
                continue
            n = np.array([len(s) for s in seen.values()], np.int64)
            p = prefix_len(n, percent)
            token = np.concatenate([s[:k] for s, k in zip(seen.values(), p, strict=True)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat(np.array(list(seen), np.int64), p)), pa.array(np.repeat(n, p).astype(np.int32))], ["token", "sig", "n"])

    return run


def _multiply(wide: int, percent: int) -> Callable:
    """Over rows sorted by token and signature: the products of narrow columns (kind 0), the rows of wide ones (kind 1) with the least bound of their size."""

    def emit(kind: int, a, b, na, nb) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(a), 200_000):
            part = slice(k, k + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[part]), kind, np.int8)), *(pa.array(x[part]) for x in (a, b, na, nb))], ["kind", "a", "b", "na", "nb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, sig, n = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
        before, flowing = None, None  # the last row that left; the wide column of which rows have left
        for batch in chain(batches, [None]):
            if batch is not None:
                token, sig, n = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((token, sig, n)))
            if not len(token):
                continue
            fresh = np.r_[(token[0], sig[0]) != before, (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])]
            token, sig, n = token[fresh], sig[fresh], n[fresh]
            if not len(token):
                continue
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            sizes = np.diff(np.r_[starts, len(token)])
            big, done = sizes > wide, np.ones(len(starts), bool)
            big[0] |= flowing is not None and token[0] == flowing
            done[-1] = batch is None or big[-1]  # else its other rows may be in the next batch
            rows = np.repeat(big & done, sizes)
            if rows.any():
                each, back = np.unique(n[rows], return_inverse=True)
                yield from emit(1, token[rows], sig[rows], n[rows], np.array([least_any(int(x), percent) for x in each], np.int32)[back])
            for size in np.unique(sizes[~big & done]):
                if size > 1:
                    i, j = np.triu_indices(size, 1)
                    at = starts[~big & done & (sizes == size)][:, None]
                    x, y = (at + i).ravel(), (at + j).ravel()
                    fits = 100 * np.minimum(n[x], n[y]).astype(np.int64) >= percent * np.maximum(n[x], n[y]).astype(np.int64)
                    x, y = x[fits], y[fits]
                    yield from emit(0, sig[x], sig[y], n[x], n[y])
            flowing = token[-1] if big[-1] else None
            before = (token[-1], sig[-1]) if done[-1] else None
            rest = slice(len(token) if done[-1] else starts[-1], None)
            token, sig, n = token[rest], sig[rest], n[rest]

    return run


def _needed(width: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, width) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([signature(s, seed) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "sig", "row"])

    return run


def _overlaps(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                o = int((both[1:] == both[:-1]).sum())
                ok.append(100 * o >= percent * (len(both) - o))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _product(percent: int) -> Callable:
    """The links between the rows of two blocks (or within one) that join components."""

    def run(table: pa.Table) -> pa.Table:
        sig, block = table.column("sig").to_numpy(), table.column("block").to_numpy()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        rows = [np.frombuffer(r.as_buffer(), np.uint64) for r in table.column("row")]
        n = np.array([len(r) for r in rows])
        ends = np.cumsum(n)
        _, column = np.unique(np.concatenate(rows), return_inverse=True)
        holders = np.repeat(np.arange(len(rows)), n)[np.argsort(column, kind="stable")]
        starts = np.r_[0, np.cumsum(np.bincount(column))]
        root = np.arange(len(rows))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for i in np.flatnonzero(block == lo):
            o = np.bincount(np.concatenate([holders[starts[c] : starts[c + 1]] for c in column[ends[i] - n[i] : ends[i]]]), minlength=len(rows))
            fits = 100 * o >= percent * (n[i] + n - o)
            fits &= (block == hi) if lo != hi else (np.arange(len(rows)) > i)
            for j in np.flatnonzero(fits):
                x, y = find(i), find(j)
                if x != y:
                    root[x] = y
                    out.append((sig[i], sig[j]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def sets_of(sigs: DataFrame, rows: DataFrame, reps: DataFrame, width: int, seed: int) -> DataFrame:
    """``sig, row`` of the signatures. A filter of fixed size lets only the documents in question into the shuffle."""
    need = keep(sigs.join(reps, "sig").select(F.col("rep").alias("doc_id"), "sig"), "ngram-need")
    maybe = bloom.probe(rows, "doc_id", bloom.build(need, "doc_id", NEED_BLOCKS), NEED_BLOCKS, "needed").where("needed").select("doc_id", "body")
    sets = maybe.mapInArrow(_needed(width, seed), "doc_id long, sig long, row binary").join(need, ["doc_id", "sig"], "left_semi").dropDuplicates(["sig"])
    return keep(sets.select("sig", "row"), "ngram-sets", "none")


def sized_rows(rows: DataFrame, width: int) -> tuple[DataFrame, int]:
    """``doc_id, k1, k2, n, sig`` of each row, and the seed of the signatures: the first under which no two sets share one."""
    for seed in range(16):
        sized = keep(rows.mapInArrow(_sizes(width, seed), "doc_id long, k1 long, k2 long, n long, sig long, check long"), "ngram-sizes")
        if sized.groupBy("sig").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a != b").isEmpty():
            return sized.drop("check"), seed
    raise RuntimeError("sets share a signature under every seed")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, percent: int = PERCENT, wide: int = WIDE, block: int = BLOCK) -> DataFrame:
    """One row per input row: ``doc_id, k1, k2`` (the text's key), ``n_shingles, root`` (the component, null without shingles), ``component_id``."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_key(docs[text_col]).alias("k"), docs[text_col].alias("body")).select("doc_id", "k.k1", "k.k2", "body")
    sized, seed = sized_rows(rows, width)
    reps = sized.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"))

    tokens = rows.select("doc_id", "body").mapInArrow(_prefixes(width, percent, seed), "token long, sig long, n int")
    products = keep(tokens.repartition("token").sortWithinPartitions("token", "sig").mapInArrow(_multiply(wide, percent), "kind byte, a long, b long, na int, nb int"), "ngram-products")
    crowd = products.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("sig"), F.col("na").alias("n"), F.col("nb").alias("least"))
    k = keep(crowd.groupBy("sig", "n", "least").agg(F.count("*").alias("k")), "ngram-wide")
    counted = products.where("kind = 0").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    ka, kb = k.select(F.col("sig").alias("a"), F.col("k").alias("ka")), k.select(F.col("sig").alias("b"), F.col("k").alias("kb"))
    slack = F.least(F.coalesce("ka", F.lit(0)), F.coalesce("kb", F.lit(0)))
    narrow = counted.join(ka, "a", "left").join(kb, "b", "left").where(F.col("c") + slack >= sql_bound(F.col("na"), F.col("nb"), percent))
    narrow = keep(narrow.select("a", "b"), "ngram-pairs")

    crowd = crowd.join(k.where("k >= least").select("sig"), "sig", "left_semi").select("token", "sig")
    hubs = crowd.groupBy("token").agg(F.min("sig").alias("hub"))
    groups = components(crowd.join(hubs, "token").select("hub", "sig"), "hub", "sig").select(F.col("node").alias("sig"), F.col("root").alias("grp"))
    groups = keep(groups.join(k.select("sig", "n"), "sig"), "ngram-groups")

    wanted = narrow.select(F.explode(F.array("a", "b")).alias("sig")).unionByName(groups.select("sig")).distinct()
    sets = sets_of(wanted, rows, reps, width, seed)
    both = narrow.join(sets.select(F.col("sig").alias("a"), F.col("row").alias("x")), "a").join(sets.select(F.col("sig").alias("b"), F.col("row").alias("y")), "b")
    links = both.select("a", "b", "x", "y").mapInArrow(_overlaps(percent), "a long, b long")

    cut = groups.groupBy("grp").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    cut = groups.join(cut, "grp").select("sig", "grp", "blocks", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int").alias("block"))
    cut = cut.join(sets, "sig").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("sig", "row", "grp", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    links = keep(links.unionByName(cut.groupBy("grp", "lo", "hi").applyInArrow(_product(percent), "a long, b long")), "ngram-links")

    named = components(links, "a", "b").withColumnRenamed("node", "sig").join(reps, "sig")
    lowest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = named.join(lowest, "root").select("sig", "root", "component_id")
    group = reps.join(linked, "sig", "left").select("sig", F.coalesce("root", "sig").alias("root"), F.coalesce("component_id", "rep").alias("component_id"))
    names = ["doc_id", "k1", "k2", F.col("n").alias("n_shingles")]
    shown = sized.where("n > 0").join(group, "sig").select(*names, "root", "component_id")
    return shown.unionByName(sized.where("n = 0").select(*names, F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id")))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, percent: int = PERCENT, wide: int = WIDE, block: int = BLOCK) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``."""
    return grouped(docs, id_col, text_col, width, percent, wide, block).select("doc_id", "n_shingles", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, with all its columns: one with the least id (null after all others, then by a hash of the text).

    Rows without shingles all stay. Rows with null or repeated ids are told apart by their texts; of rows alike in both, one stays.
    """
    groups = keep(grouped(docs), "ngram-groups")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    best = groups.where("root IS NOT NULL").groupBy("root").agg(F.min(place).alias("p")).select("p.doc_id", "p.k1", "p.k2", F.lit(True).alias("one"))
    blank = groups.where("root IS NULL").select("doc_id", "k1", "k2", F.lit(False).alias("one")).distinct()
    chosen = keep(best.unionByName(blank), "ngram-chosen")
    rows = docs.select(*(F.col(c).alias(f"d_{i}") for i, c in enumerate(docs.columns)), F.col("doc_id").cast("long").alias("__id"), text_key(docs["text"]).alias("__k"))
    rows = rows.alias("d").join(chosen.alias("c"), F.expr("d.__id <=> c.doc_id AND d.__k.k1 = c.k1 AND d.__k.k2 = c.k2")).drop("doc_id", "k1", "k2")
    # rows alike in id and text are as many as their counts say; only those are dealt out once more
    twice = groups.where("root IS NOT NULL").groupBy("doc_id", "k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "k1", "k2")
    twice = keep(twice, "ngram-twice")
    if not twice.isEmpty():
        marked = rows.alias("d").join(twice.alias("t"), F.expr("d.__id <=> t.doc_id AND d.__k.k1 = t.k1 AND d.__k.k2 = t.k2 AND d.one"), "left").withColumn("again", F.col("t.k1").isNotNull()).drop("doc_id", "k1", "k2")
        rows = marked.where("NOT again").unionByName(marked.where("again").dropDuplicates(["__id", "__k"])).drop("again")
    return rows.select(*(F.col(f"d_{i}").alias(c) for i, c in enumerate(docs.columns)))
