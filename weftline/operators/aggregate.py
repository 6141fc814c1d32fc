"""Aggregations: votes, ordered text building, grouped rendering, tag clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.template import render
from weftline.operators.graph import least_labels


def joined(text: Column, order: Sequence[str | Column], joiner: str) -> Column:
    """Aggregate: texts joined in order. A group's texts meet in one task, as they must in one value, which Spark limits to 2 GB: builders are for groups of that
    size, and without a group for tables of that size."""
    rows = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), text.alias("t"))))
    return F.array_join(F.transform(rows, lambda x: x["t"]), joiner)


def build_text(df: DataFrame, field: str, order: Sequence[str], joiner: str = "\n", group: Sequence[str] = (), name: str = "text") -> DataFrame:
    """Stripped texts of a field joined in order; null counts as empty."""
    return df.groupBy(*group).agg(joined(F.trim(F.coalesce(F.col(field), F.lit(""))), order, joiner).alias(name))


def build_formatted(df: DataFrame, field: str, order: Sequence[str], formatting: str = "__text__", prefix: str = "", joiner: str = "\n", group: Sequence[str] = (), name: str = "text") -> DataFrame:
    """Stripped, non-empty texts, each behind a prefix, joined and put in place of ``__text__``."""
    rows = df.withColumn("__t", F.trim(F.col(field))).where("__t <> ''")
    out = rows.groupBy(*group).agg(joined(F.concat(F.lit(prefix), F.col("__t")), order, joiner).alias(name))
    return out.withColumn(name, F.replace(F.lit(formatting), F.lit("__text__"), F.col(name)))


def concat_multi(df: DataFrame, field: str, order: Sequence[str], joiner: str = "\n\n", first_too: bool = False, group: Sequence[str] = (), name: str = "text") -> DataFrame:
    text = joined(F.col(field), order, joiner)
    return df.groupBy(*group).agg((F.concat(F.lit(joiner), text) if first_too else text).alias(name))


def render_rows(df: DataFrame, formatting: str, order: Sequence[str], joiner: str = "\n", name: str = "text") -> DataFrame:
    """Every row rendered by a template, joined in order."""
    return df.withColumn("__line", render(df, formatting)).groupBy().agg(joined(F.col("__line"), order, joiner).alias(name))


def render_groups(df: DataFrame, formatting: str, group_by: str, group_format: str, order: Sequence[str], joiner: str = "\n", group_joiner: str = "\n") -> DataFrame:
    """``group, ord, text``: a header from each group's first row, then its rows. Groups are ordered by their first row."""
    lines = df.withColumn("__line", render(df, formatting)).withColumn("__head", render(df, group_format))
    return lines.groupBy(F.col(group_by).alias("group")).agg(
        F.min(F.struct(*order)).alias("ord"),
        F.concat(F.min_by("__head", F.struct(*order)), F.lit(joiner), joined(F.col("__line"), order, group_joiner)).alias("text"),
    )


def dump_rows(df: DataFrame, order: Sequence[str], name: str = "text") -> DataFrame:
    """The whole table as one JSON list."""
    return df.groupBy().agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*df.columns).alias("r")))), lambda x: x["r"])).alias(name))


def votes(ballots: DataFrame, keys: Sequence[str], value: str, how: str = "median", analysis: str | None = None, order: Sequence[str] = ()) -> DataFrame:
    """One row per criterion: the mean rounded half to even, or the median; with the justifications in ballot order."""
    made = F.bround(F.avg(value), 0).cast("int") if how == "mean" else F.median(value)
    aggs = [made.alias("vote")]
    if analysis:
        aggs.append(joined(F.concat_ws(" - ", F.col(value).cast("string"), F.col(analysis)), order, "\n ").alias("justification"))
    return ballots.groupBy(*keys).agg(*aggs)


def vote_totals(voted: DataFrame, group: str, vote: str = "vote") -> DataFrame:
    """Sums of the votes per group, and their total in the row with a null group."""
    return voted.rollup(group).agg(F.sum(vote).alias("total"))


UNSURE = "unsure"
MAX_CHOICES = 10_000


def majority(ballots: DataFrame, keys: Sequence[str], decision: str, tie: str = UNSURE) -> DataFrame:
    """``keys, decision, score``: the most frequent decision, ``tie`` where two lead; score is the leader's share in percent."""
    counts = ballots.groupBy(*keys, decision).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.max_by(decision, "n").alias("top"), F.max("n").alias("most"), F.sum("n").alias("all"), F.collect_list("n").alias("each"))
    lead = F.size(F.filter("each", lambda n: n == F.col("most"))) == 1
    return best.select(*keys, F.when(lead, F.col("top")).otherwise(tie).alias("decision"), (F.col("most") / F.col("all") * 100).alias("score"))


def needs_third_ballot(ballots: DataFrame, keys: Sequence[str], decision: str) -> DataFrame:
    """Keys on whose criteria the ballots differ."""
    return ballots.groupBy(*keys).agg(F.min(decision).alias("lo"), F.max(decision).alias("hi")).where("lo <> hi").select(*keys)


def roll_up(decided: DataFrame, key: str, kind: str, decision: str) -> DataFrame:
    """Three-valued summaries over a subject's inclusion and exclusion criteria."""
    inc, exc, d = F.col(kind) == "inclusion", F.col(kind) == "exclusion", F.col(decision)
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    n = F.sum(inc.cast("int"))
    return decided.groupBy(key).agg(
        F.when(some(inc & (d == "include")), "true").when((n > 0) & (n == F.sum((inc & (d == "maybe")).cast("int"))), UNSURE).otherwise("false").alias("any_inclusion"),
        F.when(n == 0, "false").when(n == F.sum((inc & (d == "include")).cast("int")), "true").when(some(inc & (d == "no_include")), "false").otherwise(UNSURE).alias("all_inclusion"),
        F.when(some(exc & (d == "exclude")), "true").when(some(exc & (d == "maybe")), UNSURE).otherwise("false").alias("any_exclusion"),
    )


def closest(left: DataFrame, text: str, choices: DataFrame, choice: str) -> DataFrame:
    """The choice with the least edit distance to each text, the first in order of equals. ``choices`` is a parameter table of at most ``MAX_CHOICES`` rows."""
    if choices.limit(MAX_CHOICES + 1).count() > MAX_CHOICES:
        raise ValueError(f"more than {MAX_CHOICES} choices")
    pairs = left.crossJoin(F.broadcast(choices.select(F.col(choice).alias("closest"))))
    at = F.struct(F.levenshtein(F.col(text), F.col("closest")).alias("distance"), "closest")
    return pairs.groupBy(*left.columns).agg(F.min(at).alias("m")).select(*left.columns, "m.closest", "m.distance")


def canonical_tag(c: Column) -> Column:
    """Without punctuation and a leading number, words capitalised."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\s]", " "), r"^\s*\d+\s*", "")
    return F.initcap(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")))


def tag_clusters(tags: DataFrame, field: str, limit: float = 0.21) -> DataFrame:
    """``tag, cluster``: tags whose edit distance is at most ``limit`` of the longer one, closed transitively.

    By the pigeonhole principle: with at most k edits, one of the k + 1 pieces that the longer tag is cut into occurs whole in the
    shorter one, at most k places from its own. Tags are joined on such pieces, so a tag only meets those it shares one with.
    """
    t = tags.select(F.col(field).alias("tag")).distinct().withColumn("n", F.length("tag"))
    edits = lambda n: F.floor(n * limit + 1e-9).cast("int")
    edge = lambda i, n: F.floor(i * n / (edits(n) + 1)).cast("int")
    i, n = F.col("i"), F.col("n")
    cut = t.withColumn("i", F.explode(F.sequence(F.lit(0), edits(n))))
    cut = cut.select(F.col("tag").alias("y"), n.alias("ny"), "i", F.substring(F.col("tag"), edge(i, n) + 1, edge(i + 1, n) - edge(i, n)).alias("piece"))
    ny = F.col("ny")
    probe = t.withColumn("ny", F.explode(F.sequence(n, F.floor(n / (1 - limit) + 1e-9).cast("int")))).withColumn("i", F.explode(F.sequence(F.lit(0), edits(ny))))
    first, last = F.greatest(F.lit(0), edge(i, ny) - edits(ny)), F.least(n - (edge(i + 1, ny) - edge(i, ny)), edge(i, ny) + edits(ny))
    probe = probe.withColumn("p", F.explode(F.when(first <= last, F.sequence(first, last))))
    probe = probe.select(F.col("tag").alias("x"), "ny", "i", F.substring(F.col("tag"), F.col("p") + 1, edge(i + 1, ny) - edge(i, ny)).alias("piece"))
    pairs = probe.join(cut, ["ny", "i", "piece"]).where("x <> y").select("x", "y", "ny").distinct()
    links = pairs.where(F.levenshtein("x", "y") <= F.col("ny") * limit).select(F.col("x").alias("a"), F.col("y").alias("b"))
    roots = least_labels(links)
    return t.join(roots.withColumnRenamed("node", "tag"), "tag", "left").select("tag", F.coalesce("label", "tag").alias("cluster"))


def related_tags(rows: DataFrame, key: str, tag: str, top: int = 200) -> DataFrame:
    """Tags that occur together: ``tag, other, both, proximity`` with 0.2 c / n(other) + 0.8 c / n(tag), best first."""
    counts = rows.groupBy(tag).agg(F.countDistinct(key).alias("n"))
    pairs = rows.select(key, F.col(tag).alias("t")).distinct().join(rows.select(key, F.col(tag).alias("o")).distinct(), key).where("t <> o").groupBy("t", "o").agg(F.count("*").alias("both"))
    scored = pairs.join(counts.select(F.col(tag).alias("t"), F.col("n").alias("nt")), "t").join(counts.select(F.col(tag).alias("o"), F.col("n").alias("no")), "o")
    scored = scored.withColumn("proximity", 0.2 * F.col("both") / F.col("no") + 0.8 * F.col("both") / F.col("nt"))
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("proximity"), "o"))).where(F.col("r") <= F.least(F.lit(top), 2 * F.col("nt")))
    return best.select(F.col("t").alias("tag"), F.col("o").alias("other"), "both", "proximity")


def newsletter(summary: DataFrame, articles: DataFrame, metrics: DataFrame, analysis: str, order: Sequence[str]) -> DataFrame:
    """One row of three ordered lists and the analysis; each list is ordered by ``order`` where the table has it and has ``MAX_CHOICES`` rows at most."""

    def listed(df: DataFrame, name: str) -> DataFrame:
        if df.limit(MAX_CHOICES + 1).count() > MAX_CHOICES:
            raise ValueError(f"{name} has more than {MAX_CHOICES} rows")
        by = [c for c in order if c in df.columns] or df.columns
        rows = F.array_sort(F.collect_list(F.struct(F.struct(*by).alias("o"), F.struct(*df.columns).alias("r"))))
        return df.agg(F.transform(rows, lambda x: x["r"]).alias(name))

    return listed(summary, "summary").crossJoin(listed(articles, "articles")).crossJoin(listed(metrics, "metrics")).withColumn("summary_analysis", F.lit(analysis))
