"""A blocked Bloom filter as a table: ``block, w0 .. w7``, at most ``n_blocks`` rows of 72 bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bits(key: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, and the bit it sets in each of the block's eight words."""
    h = F.xxhash64(key, F.lit("bits"))
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int"), [F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(8)]


def build(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """The filter of the column ``key``."""
    block, at = bits(F.col(key), n_blocks)
    one = F.lit(1).cast("long")
    words = keys.select(block.alias("block"), *(F.call_function("shiftleft", one, b).alias(f"w{i}") for i, b in enumerate(at)))
    return words.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)))


def probe(rows: DataFrame, key: str, table: DataFrame, n_blocks: int, flag: str) -> DataFrame:
    """``rows`` with a boolean ``flag``: false only for keys that aren't in the filter. Broadcasts the filter, whose size ``n_blocks`` bounds."""
    names = rows.columns
    block, at = bits(F.col(key), n_blocks)
    passes = F.lit(True)
    for i, b in enumerate(at):
        passes = passes & (F.call_function("shiftrightunsigned", F.col(f"__w{i}"), b).bitwiseAND(F.lit(1).cast("long")) == 1)
    table = table.select(F.col("block").alias("__block"), *(F.col(f"w{i}").alias(f"__w{i}") for i in range(8)))
    return rows.withColumn("__at", block).join(F.broadcast(table), F.col("__at") == F.col("__block"), "left").select(*names, F.coalesce(passes, F.lit(False)).alias(flag))
