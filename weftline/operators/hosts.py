"""Registered domains by a table of public suffix rules.

Rules are of three kinds: ``co.uk`` is a suffix, with ``*.ck`` every label below ``ck`` makes one, and ``!www.ck`` takes a name out of such a rule. Of the rules that fit
a host an exception prevails, else the one with the most labels; without any the last label is the suffix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and final dot; empty if there is none."""
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, r"\.$", "")


def suffix_rules(rules: DataFrame, rule: str = "rule") -> DataFrame:
    """``base, kind, size`` of rule texts, each once: the labels to find, and how many labels the suffix then has. Blank rows and ``//`` comments are passed over."""
    text = F.lower(F.regexp_extract(rule, r"^\s*(\S+)", 1))
    rows = rules.select(text.alias("text")).where((F.col("text") != "") & ~F.startswith("text", F.lit("//")))
    kind = F.when(F.startswith("text", F.lit("!")), "exception").when(F.startswith("text", F.lit("*.")), "wildcard").otherwise("plain")
    rows = rows.select(kind.alias("kind"), F.regexp_replace("text", r"^(!|\*\.)", "").alias("base"))
    n = F.size(F.split("base", r"\."))
    return rows.select("base", "kind", F.when(F.col("kind") == "exception", n - 1).when(F.col("kind") == "wildcard", n + 1).otherwise(n).alias("size")).distinct()


def registered_domains(df: DataFrame, url: str, rules: DataFrame, name: str = "domain", rule: str = "rule") -> DataFrame:
    """``df`` with the registered domain of ``url``: one label more than the public suffix, null if the host is a suffix itself, or if there is no host.

    An address of four numbers is its own domain. Each distinct host is looked up once by its endings, an equality join with the rules; Spark
    broadcasts the rules if they are small, and otherwise both sides meet by ending.
    """
    rows = df.withColumn("__host", host_of(F.col(url)))
    hosts = rows.select("__host").where("__host <> ''").distinct()
    labels = F.split("__host", r"\.")
    ends = hosts.select("__host", labels.alias("v")).select("__host", F.size("v").alias("n"), "v", F.explode(F.sequence(F.lit(1), F.size("v"))).alias("k"))
    ends = ends.select("__host", "n", F.array_join(F.expr("slice(v, n - k + 1, k)"), ".").alias("base"))
    met = ends.join(suffix_rules(rules, rule), "base").where("size <= n")
    best = met.groupBy("__host").agg(F.max(F.struct((F.col("kind") == "exception").alias("out"), "size")).alias("best"))
    known = hosts.join(best, "__host", "left").select("__host", labels.alias("v"), F.coalesce("best.size", F.lit(1)).alias("size"))
    domain = F.when(F.col("__host").rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.col("__host")).when(F.size("v") > F.col("size"), F.array_join(F.expr("slice(v, size(v) - size, size + 1)"), "."))
    known = known.select("__host", domain.alias("__domain"))
    return rows.join(known, "__host", "left").select(*(F.col(f"`{c}`") for c in df.columns if c != name), F.col("__domain").alias(name))
