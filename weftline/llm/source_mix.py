"""Mixing sources to target weights with a low-discrepancy schedule.

Sources in code point order (null last) get the weights 5, 2, 1, repeating, and share
``share`` times the corpus; a target stops at ``max_epochs`` times its source, and what
is above is shared again by weight (water-filling, solved with running sums).

Each source's documents are laid out in hash order as one stream of words and cut into blocks of equal length, the last one
shorter. The schedule has as many slots as it takes for every source to reach its target, and slot n stands at the point
n * g mod 2^62, g being 2^62 over the golden ratio. The point falls into one source's part of the cumulative weights (epochs times
blocks of each source), and the slots of a source, ranked by n, take its blocks in turn, starting over after the last. The points
alone decide how often a source is drawn: by their low discrepancy that is a few slots at most from its share, and so is what it
takes from its target. Slots beyond ``max_epochs`` rounds of a source stay empty, so no document is taken more often.

Blocks have ``block_words`` words, or a ``FINEST``-th of their source where that is less, so that a few slots are a small part
of any target. Points are whole numbers of 62 bits: exact for any number of slots. Ranks and stream offsets are two-level running
sums (within a chunk or bucket, then over the chunk sums), so no source is gathered into one task.

Defined cases: null text has size 0 and takes 0; a null source is a source of its own; rows alike in id, source and size are
laid out one after another and each is returned; a source without words has target 0; texts of any length are
counted whole; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.base import keep, n_words, read

WEIGHTS = (5, 2, 1)
SHARE, MAX_EPOCHS = 1.5, 2
BLOCK_WORDS, FINEST = 1024, 512
CHUNK, CELLS = 8192, 4096
#: Points are whole numbers below 2^62; this one is 2^62 over the golden ratio, made odd.
BITS = 62
GOLDEN = 2850178704830799621


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``doc_id, source, size, copy`` for each row; rows alike in all three differ in ``copy``."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), n_words(docs[text_col]).alias("size"))
    counted = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    return counted.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))


def targets(rows: DataFrame, weights: Sequence[int], share: float, max_epochs: float) -> DataFrame:
    """One row per source: ``sid, source, source_size, target, quota``. As long as the list of sources."""
    every, before = Window.partitionBy(), Window.orderBy("fill", "sid").rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", w)
    s = s.withColumn("cap", F.col("source_size") * max_epochs).withColumn("fill", F.col("cap") / F.col("w"))
    s = s.withColumn("level", (F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    full = F.col("fill") <= F.col("level")
    s = s.withColumn("open", F.max(F.when(~full, F.col("level"))).over(every))
    s = s.withColumn("target", F.when(full, F.col("cap")).otherwise(F.col("open") * F.col("w")).cast("double"))
    return s.select("sid", "source", "source_size", "target", F.floor("target").cast("long").alias("quota"))


def point(n: Column, golden: int = GOLDEN) -> Column:
    """n * golden mod 2^62, by halves of 31 bits, so that no product overflows. n is below 2^62."""
    half = (1 << 31) - 1
    n0, n1 = n.bitwiseAND(F.lit(half)), F.shiftright(n, 31)
    g0, g1 = golden & half, golden >> 31
    high = (n1 * g0 + n0 * g1).bitwiseAND(F.lit(half))
    return (high * (half + 1) + n0 * g0).bitwiseAND(F.lit((1 << BITS) - 1))


def slots(plan: DataFrame, total: int, golden: int = GOLDEN) -> DataFrame:
    """``n, sid, rank``: the source of each slot, and the slot's place among the source's. ``plan`` has ``sid, lo, hi``, each source's part of the points."""
    at = plan.sparkSession.range(total).select(F.col("id").alias("n"), point(F.col("id"), golden).alias("at"))
    cell = lambda c: F.shiftright(c, BITS - 12).cast("int")
    at = at.withColumn("cell", cell(F.col("at")))
    parts = plan.where("lo < hi").select("sid", "lo", "hi", F.explode_outer(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))).alias("cell"))
    drawn = at.join(parts, "cell").where("at >= lo AND at < hi").select("n", "sid", F.floor(F.col("n") / CHUNK).alias("chunk"))
    local = drawn.withColumn("local", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("n")))
    sums = drawn.groupBy("sid", "chunk").agg(F.count("*").alias("m"))
    sums = sums.withColumn("off", F.coalesce(F.sum("m").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(sums, ["sid", "chunk"]).select("n", "sid", (F.col("off") + F.col("local") - 1).alias("rank"))


def source_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS, seed: str = "0", golden: int = GOLDEN) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken, source, first_slot``, the last the first slot that takes words of it."""
    rows = keep(sized(docs, id_col, text_col, source_col), "mix-sizes")
    plan = targets(rows, weights, share, max_epochs)
    plan = plan.withColumn("b", F.greatest(F.lit(1), F.least(F.lit(block_words), F.ceil(F.col("source_size") / FINEST))).cast("long"))
    plan = plan.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("b")).cast("long"))
    need = F.when(F.col("source_size") > 0, F.ceil(F.col("target") * F.col("n_blocks") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("need", need).withColumn("upto", F.sum("need").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)))
    plan = keep(plan, "mix-plan")
    total = plan.agg(F.sum("need")).first()[0] or 0
    edge = lambda c: F.expr(f"cast({c} as decimal(18,0)) * cast('{1 << BITS}' as decimal(19,0)) div cast({max(total, 1)} as decimal(18,0))")
    plan = plan.withColumn("lo", edge("upto - need")).withColumn("hi", edge("upto"))

    taken = slots(plan, total, golden).join(plan.select("sid", "n_blocks"), "sid").where(F.col("rank") < F.col("n_blocks") * max_epochs)
    visits = taken.groupBy("sid", (F.col("rank") % F.col("n_blocks")).alias("block")).agg(F.count("*").alias("times"), F.min("n").alias("slot"))

    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    laid = rows.join(plan.select("sid", "source", "source_size", "target", "b"), rows["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    laid = laid.withColumn("key", key).withColumn("bucket", F.substring("key", 1, 3))
    ahead = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, -1)
    sums = laid.groupBy("sid", "bucket").agg(F.sum("size").alias("m"))
    sums = sums.withColumn("off", F.coalesce(F.sum("m").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    laid = laid.withColumn("local", F.coalesce(F.sum("size").over(ahead), F.lit(0))).join(sums.drop("m"), ["sid", "bucket"])
    laid = laid.withColumn("start", F.col("off") + F.col("local")).withColumn("end", F.col("start") + F.col("size"))
    cut = laid.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / F.col("b")), F.floor((F.col("end") - 1) / F.col("b"))))))
    cut = cut.join(visits, ["sid", "block"], "left")
    words = (F.least("end", (F.col("block") + 1) * F.col("b")) - F.greatest("start", F.col("block") * F.col("b"))) * F.col("times")
    done = cut.groupBy("doc_id", "source", "size", "copy", "source_size", "target").agg(F.sum(F.coalesce(words, F.lit(0))).alias("taken"), F.min("slot").alias("first_slot"))
    return done.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "source", "first_slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a row of ``source_mix`` for each document it takes words of. Rows that share an id each have a row of their own, told apart
    by source and size; null texts and texts without words are in no mix."""
    return source_mix(docs).where("taken > 0")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM d GROUP BY source
), w AS (
  SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s
), f AS (
  SELECT *, source_size * 2 AS cap, source_size * 2.0::DOUBLE / w AS fill FROM w
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM f WINDOW before AS (ORDER BY fill, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), o AS (
  SELECT *, max(CASE WHEN fill > level THEN level END) OVER () AS open FROM l
), t AS (
  SELECT sid, source, source_size, (CASE WHEN fill <= level THEN cap ELSE open * w END)::DOUBLE AS target FROM o
), b AS (
  SELECT *, greatest(1, least(1024, ceil(source_size / 512)))::BIGINT AS b FROM t
), k AS (
  SELECT *, ceil(source_size / b)::BIGINT AS n_blocks FROM b
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN ceil(target * n_blocks / source_size) ELSE 0 END::BIGINT AS need FROM k
), u AS (
  SELECT *, sum(need) OVER (ORDER BY sid) AS upto, sum(need) OVER () AS total FROM p
), e AS (
  SELECT *, ((upto - need)::HUGEINT * 4611686018427387904) // greatest(total, 1) AS lo, (upto::HUGEINT * 4611686018427387904) // greatest(total, 1) AS hi FROM u
), g AS (
  SELECT n, (n::HUGEINT * 2850178704830799621) % 4611686018427387904 AS at FROM (SELECT unnest(range((SELECT coalesce(sum(need), 0)::BIGINT FROM p))) AS n)
), z AS (
  SELECT n, sid, n_blocks, row_number() OVER (PARTITION BY sid ORDER BY n) - 1 AS rank FROM g JOIN e ON g.at >= e.lo AND g.at < e.hi
), v AS (
  SELECT sid, rank % n_blocks AS block, count(*) AS times, min(n) AS slot FROM z WHERE rank < 2 * n_blocks GROUP BY ALL
), r AS (
  SELECT d.doc_id, d.size, q.*,
         coalesce(sum(d.size) OVER (PARTITION BY q.sid ORDER BY md5('0:' || d.doc_id::VARCHAR), d.doc_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN k q ON d.source IS NOT DISTINCT FROM q.source
), c AS (
  SELECT *, unnest(CASE WHEN size > 0 THEN range(start // b, (start + size - 1) // b + 1) ELSE [-1] END) AS block FROM r
)
SELECT doc_id, size, source_size, target,
       sum(coalesce((least(start + size, (c.block + 1) * b) - greatest(start, c.block * b)) * times, 0))::BIGINT AS taken, source, min(slot) AS first_slot
FROM c LEFT JOIN v ON c.sid = v.sid AND c.block = v.block
GROUP BY doc_id, size, source_size, target, source
"""
