"""Benchmark decontamination with SimHash windows, DataFrame operations only.

1. Every position of every document is looked up among the items' shingles. A window
   without a shingle of an item has similarity 0 with it, so nothing is lost here.
2. For each item and each run of hits, all windows of the item's length that hold a hit
   are taken (the whole document where it is shorter) and get a 64-bit SimHash of their
   shingles, each weighing as often as it occurs.
3. Multi-index blocks: 64 bits are cut into ``radius + 1`` blocks; fingerprints that
   differ in at most ``radius`` bits agree in one block, so joining on item, block and
   value finds them all. The exact distance is checked after that.
4. Those windows are compared exactly: sum of the lesser counts of each shingle over the
   sum of the greater, at least ``percent`` / 100.

SimHash distance estimates an angle: at similarity 0.8 about 10 of 64 bits differ, with a
deviation of 3, so the default radius of 19 leaves a miss beyond three deviations.

Words are lower-cased runs of anything but space and ASCII controls 9 to 13. Defined
cases: null and empty texts and items match nothing; an item with fewer than five words
is one shingle of its length; repeated rows of either table give one row; texts are read
whole; an empty table on either side gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import bloom
from weftline.llm.base import keep, read, words_of

WORDS, PERCENT, RADIUS = 5, 80, 19
#: Item shingles are broadcast up to so many rows (16 MB) and shuffled beyond.
BROADCAST_ROWS = 500_000
#: 16,384 blocks of 64 bytes: 1 MB.
DOC_BLOCKS = 1 << 14
#: Counters of 16 bits; windows with more shingles go to the exact check unfiltered.
MOST = 32_767


def shingles(words: Column, width: int) -> Column:
    """64-bit hashes of all runs of ``width`` words, in order."""
    n = F.size(words)
    hashed = F.transform(F.slice(words, F.lit(1), n - (width - 1)), lambda _, i: F.xxhash64(*(F.get(words, i + k) for k in range(width))))
    return F.when(n >= width, hashed).otherwise(F.array().cast("array<bigint>"))


def majority_bits(hashes: Column, lanes: int) -> Column:
    """Lane j of the fold counts the bits j, j + lanes, and so on, in counters of ``lanes`` bits; one more lane counts the hashes, so that
    they are evaluated once."""
    ones, zero, one = sum(1 << i for i in range(0, 64, lanes)), F.lit(0).cast("long"), F.lit(1).cast("long")
    bits = lambda h, j: F.call_function("shiftrightunsigned", h, j.cast("int")).bitwiseAND(F.lit(ones))
    count = lambda x, k: F.shiftrightunsigned(x, lanes * k).bitwiseAND(F.lit((1 << lanes) - 1))

    def finish(acc: Column) -> Column:
        most = F.element_at(acc, -1)
        word = lambda x, j: sum((F.when(count(x, k) * 2 > most, F.call_function("shiftleft", one, (j + lanes * k).cast("int"))).otherwise(zero) for k in range(64 // lanes)), zero)
        return F.aggregate(F.transform(F.slice(acc, 1, lanes), word), zero, lambda a, b: a.bitwiseOR(b))

    return F.aggregate(hashes, F.array_repeat(zero, lanes + 1), lambda acc, h: F.transform(acc, lambda x, j: x + F.when(j < lanes, bits(h, j)).otherwise(one)), finish)


def simhash(hashes: Column) -> Column:
    """Bit b is set if most of the hashes have it set: counted in 8 longs up to 127 hashes, in 16 up to ``MOST``, null beyond.

    The topmost counter shares its long with the sign, hence the limits at half its range.
    """
    n = F.size(hashes)
    return F.when(n <= 127, majority_bits(hashes, 8)).when(n <= MOST, majority_bits(hashes, 16))


def blocks(fp: Column, radius: int) -> Column:
    """``no, value`` of the radius + 1 blocks."""
    n = radius + 1
    ends = [64 * i // n for i in range(n + 1)]
    return F.array(*(F.struct(F.lit(i).alias("no"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))))


def keyed(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key, id, words``; the key is 128 bits of id and lower-cased text, so rows alike in both share it."""
    rows = table.select(table[id_col].alias("id"), F.lower(table[text_col]).alias("body"))
    key = F.struct(F.xxhash64("id", "body").alias("k1"), F.xxhash64(F.lit("row"), "id", "body").alias("k2"))
    return rows.select(key.alias("key"), "id", words_of(F.col("body")).alias("words"))


def one_width(docs: DataFrame, items: DataFrame, width: int, radius: int, percent: int) -> DataFrame:
    """``doc_id, item_id, start, n_words, similarity`` for the items whose shingles have ``width`` words."""
    items = items.withColumn("row", shingles(F.col("words"), width))
    items = keep(items.select(F.col("key").alias("item"), F.col("id").alias("item_id"), F.size("words").alias("length"), F.size("row").alias("m"), simhash(F.col("row")).alias("item_fp"), "row"), "bench-items")
    counts = items.select("item", "item_id", "m", "length", F.explode_outer("row").alias("h")).groupBy("item", "item_id", "m", "length", "h").agg(F.count("*").alias("ci"))
    index = counts.select("h", "item", "m", "length")
    if index.count() <= BROADCAST_ROWS:
        index = F.broadcast(index)
    at = docs.select("key", F.size("words").alias("n"), F.posexplode_outer(shingles(F.col("words"), width)).alias("pos", "h"))  # outer: else the optimizer adds a filter that makes the shingles twice
    hits = keep(at.join(index, "h").select("key", "n", "pos", "item", "m", "length").distinct(), "bench-hits")

    back = F.lag("pos").over(Window.partitionBy("key", "item").orderBy("pos"))
    first = F.greatest(F.lit(0), F.col("pos") - F.col("m") + 1, F.coalesce(back + 1, F.lit(0)))
    last = F.least("pos", F.greatest(F.lit(0), F.col("n") - F.col("length")))
    starts = hits.withColumn("first", first).withColumn("last", last).where("first <= last").select("key", "item", "m", F.explode(F.sequence("first", "last")).alias("start"))

    wanted = bloom.build(hits.select("key").distinct(), "key", DOC_BLOCKS)
    found = bloom.probe(docs, "key", wanted, DOC_BLOCKS, "hit").where("hit").dropDuplicates(["key"])
    found = found.select("key", F.col("id").alias("doc_id"), shingles(F.col("words"), width).alias("row"))
    found = keep(found, "bench-docs")
    part = F.slice("row", F.col("start") + 1, F.col("m"))
    windows = keep(starts.join(found, "key").select("key", "item", "start", "m", simhash(part).alias("fp")), "bench-windows")

    index = items.select("item", "item_fp", F.explode(blocks(F.col("item_fp"), radius)).alias("b")).select("item", "item_fp", "b.no", "b.value")
    cut = windows.where("fp IS NOT NULL").select("key", "item", "start", "m", "fp", F.explode(blocks(F.col("fp"), radius)).alias("b")).select("key", "item", "start", "m", "fp", "b.no", "b.value")
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.array_position(F.transform(blocks(apart, radius), lambda b: b["value"]), 0) - 1  # a pair comes out of the first block it agrees in
    near = cut.join(index, ["item", "no", "value"]).where((F.bit_count(apart) <= radius) & (first == F.col("no"))).select("key", "item", "start", "m")
    near = near.unionByName(windows.where("fp IS NULL").select("key", "item", "start", "m"))

    close = near.join(found, "key").select("key", "doc_id", "item", "start", part.alias("part"))
    close = close.join(items.select("item", "item_id", "m", "length", F.col("row").alias("item_row")), "item").withColumn("mw", F.size("part"))
    once = lambda c: F.size(F.array_distinct(c)) == F.size(c)
    close = close.withColumn("plain", once("part") & once("item_row"))
    names = ["key", "doc_id", "item", "item_id", "start", "mw", "m", "length"]
    same = close.where("plain").select(*names, F.size(F.array_intersect("part", "item_row")).cast("long").alias("o"))
    said = close.where("NOT plain").select(*names, F.explode("part").alias("h")).groupBy(*names, "h").agg(F.count("*").alias("cw"))
    counted = said.join(counts.select("item", "h", "ci"), ["item", "h"]).groupBy(*names).agg(F.sum(F.least("cw", "ci")).alias("o"))
    same = same.unionByName(counted)
    either = F.col("mw") + F.col("m") - F.col("o")
    good = same.where(100 * F.col("o") >= percent * either).withColumn("similarity", F.col("o") / either)
    best = good.groupBy("key", "doc_id", "item", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "mw")).alias("best"))
    return best.select("key", "doc_id", "item_id", (-F.col("best.back")).cast("long").alias("start"), (F.col("best.mw") + width - 1).cast("long").alias("n_words"), F.col("best.similarity").alias("similarity"))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, radius: int, percent: int) -> DataFrame:
    """``decontaminate`` with the key of the document's row."""
    docs, items = keyed(docs, id_col, text_col), keyed(benchmark, item_col, item_text_col).dropDuplicates(["key"]).where(F.size("words") > 0)
    width = F.least(F.size("words"), F.lit(WORDS))
    widths = [r[0] for r in items.select(width).distinct().orderBy(width).collect()]  # at most five
    parts = [one_width(docs, items.where(width == w), w, radius, percent) for w in widths or [WORDS]]
    return reduce(DataFrame.unionByName, parts)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", radius: int = RADIUS, percent: int = PERCENT) -> DataFrame:
    """The best window of each document and item that match: ``doc_id, item_id, start, n_words, similarity``."""
    return matches(docs, benchmark, id_col, text_col, item_col, item_text_col, radius, percent).drop("key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a match, with all their columns.

    A row's key is its id and text, so rows with null or repeated ids are judged by their own texts, and rows alike in both together. Null, empty
    and blank texts match nothing and stay.
    """
    hit = keep(matches(docs, read(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", RADIUS, PERCENT).select("key").distinct(), "bench-docs")
    body = F.lower(docs["text"])
    key = F.struct(F.xxhash64("doc_id", body).alias("k1"), F.xxhash64(F.lit("row"), "doc_id", body).alias("k2"))
    rows = bloom.probe(docs.select("*", key.alias("__key")), "__key", bloom.build(hit, "key", DOC_BLOCKS), DOC_BLOCKS, "__maybe")
    clean = rows.where("__maybe").join(hit.withColumnRenamed("key", "__key"), "__key", "left_anti")
    return rows.where("NOT __maybe").select(*docs.columns).unionByName(clean.select(*docs.columns))
