"""URL filtering against a list of canonical URLs and a few host rules.

The list is held in a blocked Bloom filter: a URL's hash picks one block of eight
64-bit words and one bit in each word. The filter is a table of at most ``n_blocks``
rows of 72 bytes, a row for every ``PER_BLOCK`` listed URLs up to ``MOST_BLOCKS``, and only that is broadcast. URLs it passes
are possible hits and go to an exact hash join with the list, which removes the false
positives; all others are cleared without a shuffle. A list too long for the filter
costs more exact joins, never a wrong result.

Canonical form: host in lower case without a leading ``www.`` or ``m.`` and without the
ports 80 and 443, path without a trailing ``/``, query without ``utm_*`` and ``ref``
parameters, the rest of them sorted; scheme and fragment dropped.

Rules are host and path prefixes. A rule fits its host and all its subdomains if the
URL's path starts with the rule's path; the longest that fits decides, else the list:
``block`` if listed, ``allow`` if not.

Defined cases: a null URL or one without ``://`` has an empty host and path, is never
listed and is allowed; repeated rows are judged one by one; empty tables and an empty
list work. Other columns pass unread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bloom
from weftline.llm.base import lower_ascii, read

#: verdict, rule; the part before the first / is the host.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Listed URLs to a block of 512 bits, and the most blocks: a filter of 75 MB for some 30 million URLs.
PER_BLOCK, MOST_BLOCKS = 32, 1 << 20
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SEARCH_EVERY = 50


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def canonical(url: Column) -> Column:
    """The canonical form; null where there is no ``://``."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), r":(80|443)$", "")
    asked = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(asked, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref)(=|$)")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.contains(url, F.lit("://")), F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), tail))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def url_filter(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, n_blocks: int | None = None) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, listed``. ``listed`` has a column ``url``."""
    url = pages[url_col]
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    p = pages.select(pages[id_col].alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canon"))
    p = p.withColumn("rule", rule).withColumn("ruled", ruled)
    keys = listed.select(canonical(listed["url"]).alias("canon")).where("canon IS NOT NULL").distinct()
    n_blocks = n_blocks or max(1, min(MOST_BLOCKS, -(-keys.count() // PER_BLOCK)))
    tried = bloom.probe(p, "canon", bloom.build(keys, "canon", n_blocks), n_blocks, "maybe")
    hits = tried.where("maybe").join(keys.withColumn("listed", F.lit(True)), "canon", "left")
    both = hits.unionByName(tried.where("NOT maybe").withColumn("listed", F.lit(False)))
    is_listed = F.coalesce("listed", F.lit(False))
    return both.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(is_listed, "block").otherwise("allow")).alias("verdict"), is_listed.alias("listed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is the URLs of the pages whose id is divisible by 50, searched for among all pages."""
    pages = read(spark, sf_dir, "pages")
    return url_filter(pages, pages.where(F.col("page_id") % SEARCH_EVERY == 0).select("url"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
  FROM pages
), c AS (
  SELECT *, list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1, 's'), '&'),
                                  lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)'))) AS params
  FROM p
), k AS (
  SELECT *, CASE WHEN contains(url, '://') THEN
           regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
           || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canon
  FROM c
), r AS (
  SELECT *, coalesce(canon IN (SELECT canon FROM k WHERE page_id % 50 = 0 AND canon IS NOT NULL), false) AS listed,
         CASE WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM k
)
SELECT page_id, host, path, rule,
       CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
            ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict,
       listed
FROM r
"""
