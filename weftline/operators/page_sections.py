"""Pages cut into sections within a limit, at their headings.

A page is a row of parts, each beginning with a heading (the first may have none). A section that is longer than the limit is cut at all headings of the highest
level inside it (its own heading apart), and what comes out is cut again. Each round leaves only headings of lower levels inside a section, so
six rounds settle every page, whatever its length: windows over one partitioning by page. Only numbers and titles go through them; the markup
is joined once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 6
HEADING = r"(?is)^<h[1-6][^>]*>(.*?)</h[1-6]\s*>"


def parts_of(html: Column) -> Column:
    """The page without scripts, styles and comments, cut before each heading. Null counts as empty."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    return F.split(bare, r"(?i)(?=<h[1-6][\s/>])")


def letters(html: Column) -> Column:
    """The number of characters outside tags and white space."""
    return F.length(F.regexp_replace(html, r"<[^>]*>|[ \t\r\n\f]+", ""))


def outline(parts: DataFrame, key: str) -> DataFrame:
    """``key, pos, level, title, size`` of ``key, parts``; the level is null without a heading, an unclosed heading has an empty title."""
    rows = parts.select(key, F.posexplode("parts").alias("pos", "part"))
    level = F.regexp_extract("part", r"(?i)^<h([1-6])[\s/>]", 1)
    title = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("part", HEADING, 1), r"<[^>]*>", " "), r"\s+", " "))
    return rows.select(key, "pos", F.when(level != "", level.cast("int")).alias("level"), title.alias("title"), letters(F.col("part")).cast("long").alias("size"))


def cut(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """``rows`` of ``outline`` with the ``start`` of the section each part falls into and the section's ``path`` of titles.

    What stands before the first cut of a section is a section of its own, its last title empty.
    """
    rows = rows.withColumn("start", F.lit(0)).withColumn("path", F.array().cast("array<string>"))
    whole = Window.partitionBy(key, "start")
    run = whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = F.col("pos") > F.col("start")
    for _ in range(LEVELS):
        rows = rows.withColumns({"top": F.min(F.when(inside, F.col("level"))).over(whole), "long": F.sum("size").over(whole) > limit})
        rows = rows.withColumn("cut", F.coalesce(inside & (F.col("level") == F.col("top")) & F.col("long"), F.lit(False)))
        rows = rows.withColumns({
            "into": F.max(F.when(F.col("cut"), F.col("pos"))).over(run),
            "name": F.last(F.when(F.col("cut"), F.col("title")), ignorenulls=True).over(run),
            "any": F.max("cut").over(whole),
        })
        path = F.when(F.col("any"), F.array_append("path", F.coalesce("name", F.lit("")))).otherwise(F.col("path"))
        rows = rows.select(key, "pos", "level", "title", "size", F.coalesce("into", "start").alias("start"), path.alias("path"))
    return rows


def page_sections(df: DataFrame, key: str, html: str, limit: int = 3000) -> DataFrame:
    """``key, section, path, size, html``: the sections of each page in order, numbered from 0, none with more than ``limit`` letters unless no heading is inside it.

    ``path`` holds the titles from the top down; a section's own heading is not in its ``html`` (that of a page's first part, which no cut made, is). A
    page without headings is one section with an empty path, and so is an empty or null one; a section before the first cut is left out if nothing
    but the heading above it is there. ``key`` is unique and not null.
    """
    parts = df.select(key, parts_of(F.col(html)).alias("parts"))
    found = cut(outline(parts, key), key, limit)
    found = found.groupBy(key, "start").agg(F.count("*").cast("int").alias("n"), F.sum("size").alias("size"), F.first("path").alias("path"))
    # a page's list is as long as its headings; the join keeps the parts from being cut anew for each section
    found = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "n", "size", "path"))).alias("found"))
    body = lambda s: F.array_join(F.slice("parts", s["start"] + 1, s["n"]), "")
    own = lambda s: F.when(s["start"] > 0, F.regexp_replace(body(s), HEADING, "")).otherwise(body(s))
    made = F.transform("found", lambda s: F.struct(s["path"].alias("path"), s["size"].alias("size"), own(s).alias("html")))
    blank = lambda s: (F.size(s["path"]) > 0) & (F.element_at(s["path"], -1) == "") & (F.trim(s["html"]) == "")
    rows = parts.join(found, key).select(key, F.posexplode(F.filter(made, lambda s: ~F.coalesce(blank(s), F.lit(False)))).alias("section", "s"))
    return rows.select(key, "section", "s.path", "s.size", "s.html")


def mended_levels(html: Column, depth: Column) -> Column:
    """``html`` with its headings below level ``depth``: the levels in use keep their order, each moves down as little as it takes, none beyond the sixth."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<h([1-6])[\s/>]"), F.lit(1))
    used = F.array_sort(F.array_distinct(F.transform(tags, lambda x: x.cast("int"))))
    down = lambda to, x: F.least(F.greatest(x, F.coalesce(F.get(to, F.size(to) - 1), depth.cast("int")) + 1), F.lit(LEVELS))
    to = F.aggregate(used, F.array().cast("array<int>"), lambda to, x: F.array_append(to, down(to, x)))
    # no level moves up, so a heading that was moved is not met again
    for level in range(LEVELS, 0, -1):
        at = F.get(to, F.array_position(used, F.lit(level)).cast("int") - 1)
        html = F.regexp_replace(html, F.lit(rf"(?i)<(/?)h{level}(?=[\s/>])"), F.concat(F.lit("<$1h"), F.coalesce(at, F.lit(level)).cast("string")))
    return html
