"""The main text of pages: the run of blocks that reads most like prose.

A page is cut at its block elements. A block is worth its words, less ``LINK`` for each word in a link and ``COST`` for the block, so that menus, captions and notices are
worth less than nothing. The main text is the run of consecutive blocks with the largest sum, found by running sums in a window over the page's blocks: the sum at a block less the
least one before it. Of equal runs the one that ends first stays, and of those the longest. Pages without a block that is worth something have an empty text. A null page is an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINK, COST = 4, 8
HIDDEN = r"(?is)<head(?:\s[^>]*)?>.*?</head>|<script(?:\s[^>]*)?>.*?</script>|<style(?:\s[^>]*)?>.*?</style>|<!--.*?-->"
BLOCK = (
    r"(?i)</?(?:html|body|p|div|h[1-6]|ul|ol|li|dl|dt|dd|table|thead|tbody|tr|td|th|section|article|main|header|footer|nav|aside|blockquote|pre|form|figure|figcaption|br|hr)(?:\s[^>]*)?/?>"
)
TAG, LINKED = r"(?s)<[^>]*>", r"(?is)<a(?:\s[^>]*)?>(.*?)</a>"


def _words(c: Column) -> Column:
    return F.regexp_count(F.regexp_replace(c, TAG, " "), F.lit(r"\S+")).cast("long")


def blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key, pos, text, words, linked``: the blocks with words; ``pos`` counts from 0, blocks without words included."""
    parts = F.split(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), HIDDEN, " "), BLOCK, -1)
    rows = pages.select(F.col(key), F.posexplode(parts).alias("pos", "part"))
    linked = F.array_join(F.regexp_extract_all("part", F.lit(LINKED), F.lit(1)), " ")
    text = F.trim(F.regexp_replace(F.regexp_replace("part", TAG, " "), r"\s+", " "))
    return rows.select(key, "pos", text.alias("text"), _words(F.col("part")).alias("words"), _words(linked).alias("linked")).where("words > 0")


def best_run(rows: DataFrame, key: str, order: str, value: Column) -> DataFrame:
    """``rows`` with ``in_run``: whether a row is in its key's consecutive run with the largest sum of ``value``, if that is above 0."""
    page = Window.partitionBy(key)
    so_far = page.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = page.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("__sum", F.sum(value).over(so_far))
    # what came before the run: nothing, or the rows up to the first place with the least sum
    least = F.min(F.struct("__sum", order)).over(earlier)
    none = least.isNull() | (least["__sum"] >= 0)
    summed = summed.withColumn("__gain", F.col("__sum") - F.when(none, F.lit(0)).otherwise(least["__sum"])).withColumn("__after", F.when(~none, least[order]))
    best = F.max(F.struct(F.col("__gain").alias("gain"), (-F.col(order)).alias("end"), F.col("__after").alias("after"))).over(page)
    inside = (best["gain"] > 0) & (F.col(order) <= -best["end"]) & (best["after"].isNull() | (F.col(order) > best["after"]))
    return summed.withColumn("in_run", inside).drop("__sum", "__gain", "__after")


def main_text(pages: DataFrame, key: str, html: str, link: int = LINK, cost: int = COST) -> DataFrame:
    """``key, n_blocks, n_kept, text``: one row per page, blocks joined by line feeds."""
    worth = F.col("words") - link * F.col("linked") - cost
    ranked = best_run(blocks(pages, key, html), key, "pos", worth)
    kept = F.array_sort(F.collect_list(F.when(F.col("in_run"), F.struct("pos", "text"))))  # one page's text
    held = ranked.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("n_blocks"), kept.alias("__kept"))
    out = pages.select(key).join(held, F.col(key).eqNullSafe(F.col("__key")), "left")
    texts = F.transform(F.coalesce("__kept", F.array().cast("array<struct<pos:int,text:string>>")), lambda x: x["text"])
    return out.select(key, F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"), F.size(texts).cast("long").alias("n_kept"), F.array_join(texts, "\n").alias("text"))


def oracle(link: int = LINK, cost: int = COST) -> str:
    """The same over ``pages`` as SQL."""
    q = lambda s: s.replace("'", "''")
    words = lambda c: f"len(regexp_extract_all(regexp_replace({c}, '{TAG}', ' ', 'g'), '\\S+'))"
    return f"""
WITH cut AS (SELECT page_id, regexp_split_to_array(regexp_replace(coalesce(html, ''), '{q(HIDDEN)}', ' ', 'g'), '{q(BLOCK)}') AS parts FROM pages),
part AS (SELECT page_id, unnest(range(len(parts))) AS pos, unnest(parts) AS part FROM cut),
block AS (SELECT page_id, pos, trim(regexp_replace(regexp_replace(part, '{TAG}', ' ', 'g'), '\\s+', ' ', 'g')) AS text, {words("part")} AS words,
          {words(f"array_to_string(regexp_extract_all(part, '{LINKED}', 1), ' ')")} AS linked FROM part),
summed AS (SELECT *, sum(words - {link} * linked - {cost}) OVER (PARTITION BY page_id ORDER BY pos) AS s FROM block WHERE words > 0),
runs AS (SELECT b.page_id, b.pos AS last, a.pos AS after, b.s - coalesce(a.s, 0) AS gain
         FROM summed b LEFT JOIN LATERAL (SELECT * FROM (SELECT pos, s FROM summed x WHERE x.page_id = b.page_id AND x.pos < b.pos UNION ALL SELECT NULL, 0) ORDER BY s, pos NULLS FIRST LIMIT 1) a ON true),
best AS (SELECT * FROM runs WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY gain DESC, last, after NULLS FIRST) = 1),
kept AS (SELECT s.page_id, count(*) AS n, string_agg(text, chr(10) ORDER BY pos) AS text FROM summed s JOIN best b ON b.page_id = s.page_id AND s.pos <= b.last AND (b.after IS NULL OR s.pos > b.after) GROUP BY s.page_id),
size AS (SELECT page_id, count(*) AS n FROM summed GROUP BY page_id)
SELECT p.page_id, coalesce(z.n, 0) AS n_blocks, coalesce(k.n, 0) AS n_kept, coalesce(k.text, '') AS text FROM pages p LEFT JOIN size z USING (page_id) LEFT JOIN kept k USING (page_id)"""
