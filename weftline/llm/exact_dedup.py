"""Exact deduplication by skew-safe combining.

Every row is hashed (SHA-256 of the text's UTF-8). Rows whose digest no other row has are settled by the count of digests alone,
which moves no text. All others are combined three times, each time with the full text as part of the key, so equal
digests never stand in for equal texts:

1. within its partition (the partial aggregate of the first grouping),
2. within a salt of its digest group, so a text that a third of all rows share
   is spread over ``salts`` tasks,
3. across the salts, where at most ``salts`` rows of a text meet.

The winners are dealt to the rows again by digest and salt. A Bloom filter of the shared digests, as large as their count asks for up to ``MOST_BLOCKS``, keeps
settled rows out of both shuffles; a digest that it lets through by chance is a group of one. No step brings the texts of a digest together before they are combined.

Null text counts as the empty text. Of equal texts the row with the largest id stays; a null id stays only where its whole
group has none. Rows that repeat id and text share one decision here; of the stage's result exactly one row of each text
is part. Texts of any length are read whole. Other columns of the input are not read. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bloom
from weftline.llm.base import keep, read, text_key

SALTS = 16
#: Digests to a block of 512 bits, and the most blocks: a filter of 75 MB. A full filter lets more rows into the shuffle and changes no result.
PER_BLOCK, MOST_BLOCKS = 32, 1 << 20


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def keyed(docs: DataFrame, id_col: str, text_col: str, salts: int, digest: Callable[[Column], Column]) -> DataFrame:
    """``docs`` with ``__id, __text, __digest, __salt``. The salt is the row's partition, so that neither its id nor its text can bind it to one."""
    rows = docs.select("*", docs[id_col].alias("__id"), F.coalesce(docs[text_col], F.lit("")).alias("__text"))
    return rows.withColumn("__digest", digest(F.col("__text"))).withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(salts)))


def shared_digests(rows: DataFrame) -> DataFrame:
    """The digests of more than one row, counted without the texts."""
    return keep(rows.groupBy("__digest").agg(F.count("*").alias("n")).where("n > 1").select("__digest"), "exact-shared")


def parted(rows: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that certainly have a digest of their own, and those that may share it."""
    blocks = min(MOST_BLOCKS, max(1024, -(-shared.count() // PER_BLOCK)))
    probed = bloom.probe(rows, "__digest", bloom.build(shared, "__digest", blocks), blocks, "__maybe")
    return probed.where("NOT __maybe").drop("__maybe"), probed.where("__maybe").drop("__maybe")


def winners_of(rows: DataFrame) -> DataFrame:
    """``__digest, __text, keep_id, group_size`` of each text among the rows. The first grouping combines before its shuffle and deals by salt."""
    salted = rows.groupBy("__digest", "__text", "__salt").agg(F.max("__id").alias("keep_id"), F.count("*").alias("n"))
    return salted.groupBy("__digest", "__text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = keyed(docs.select(id_col, text_col), id_col, text_col, salts, digest)
    shared = shared_digests(rows)
    single, maybe = parted(rows.select("__id", "__text", "__digest", "__salt"), shared)
    winners = keep(winners_of(maybe), "exact-winners")
    clashing = keep(winners.groupBy("__digest").agg(F.count("*").alias("n")).where("n > 1").select("__digest"), "exact-clashing")
    plain = winners.join(clashing, "__digest", "left_anti").select("__digest", "keep_id", "group_size", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    # a digest of one text: the rows need not carry theirs
    narrow = maybe.select("__id", "__digest", "__salt")
    out = narrow.join(plain, ["__digest", "__salt"], "left").join(clashing.withColumn("odd", F.lit(True)), "__digest", "left").where("odd IS NULL")
    said = out.select(F.col("__id").alias("doc_id"), F.col("__digest").alias("digest"), F.when(F.col("group_size").isNull(), F.col("__id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    said = said.unionByName(single.select(F.col("__id").alias("doc_id"), F.col("__digest").alias("digest"), F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")))
    if not clashing.isEmpty():  # different texts under one digest: these rows are matched by their text
        odd = maybe.join(clashing, "__digest", "left_semi")
        by_text = winners.join(clashing, "__digest", "left_semi").select("__digest", "__text", "keep_id", "group_size")
        said = said.unionByName(odd.join(by_text, ["__digest", "__text"]).select(F.col("__id").alias("doc_id"), F.col("__digest").alias("digest"), "keep_id", "group_size"))
    return said.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, with all its columns: one with the largest id. Rows with null or repeated ids are told apart by their texts; of rows alike in both, the one whose
    other columns come first as JSON stays."""
    rows = keyed(docs, "doc_id", "text", SALTS, sha256)
    single, maybe = parted(rows, shared_digests(rows))
    key = text_key(F.col("__text")).alias("__key")
    best = keep(winners_of(maybe.select("__id", "__text", "__digest", "__salt")).select("__digest", key, F.col("keep_id").alias("__keep")), "exact-winners")
    best = best.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    first = maybe.select("*", key).join(best, ["__digest", "__salt", "__key"]).where(F.col("__id").eqNullSafe(F.col("__keep")))
    others = F.to_json(F.struct(*(c for c in docs.columns if c != "text"), F.col("text").isNull().alias("__null")), {"ignoreNullFields": "false"})
    first = first.groupBy("__digest", "__text").agg(F.min_by(F.struct(*docs.columns), others).alias("__row")).select("__row.*")
    return single.select(*docs.columns).unionByName(first)


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
