"""Queries on record tables: filters, projections, merges, sets, order, aggregation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import aggregate, convert, filters, graph, order, records
from weftline.queries.base import Book, simplify_sql
from weftline.session import table as t
from weftline.streaming import events as streams

B = Book()
S = simplify_sql


@B.add(f"SELECT p_partkey, p_brand FROM part WHERE coalesce({S('p_brand')} = 'brand12', false)")
def filter_equal(spark, d):
    return filters.filter_value(t(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "Brand#12")


@B.add(f"SELECT c_custkey, c_mktsegment FROM customer WHERE NOT coalesce({S('c_mktsegment')} = 'building', false) AND c_mktsegment IS NOT NULL")
def filter_not_equal(spark, d):
    return filters.filter_value(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "BUILDING", equals=False, remove_nans=True)


@B.add("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IS NULL OR c_mktsegment <> ''")
def filter_equal_strict(spark, d):
    return filters.filter_value(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "BUILDING", compat="strict")


@B.add(f"SELECT event_id, event_type FROM events WHERE {S('event_type')} IN ('click', 'purchase')")
def filter_isin(spark, d):
    return filters.filter_listed(t(spark, d, "events").select("event_id", "event_type"), "event_type", "Click, PURCHASE!")


@B.add("SELECT doc_id, toxic FROM labels WHERE coalesce(toxic <> 0, false)")
def filter_truthy(spark, d):
    return filters.filter_truthy(t(spark, d, "labels").select("doc_id", "toxic"), "toxic")


@B.add("SELECT doc_id, toxic FROM labels WHERE NOT coalesce(toxic <> 0, false)")
def filter_falsy(spark, d):
    return filters.filter_truthy(t(spark, d, "labels").select("doc_id", "toxic"), "toxic", keep_false=True)


@B.add("SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '^(?:[a-z]+ p)', 'i')")
def filter_regex(spark, d):
    return filters.filter_regex(t(spark, d, "part").select("p_partkey", "p_type"), "p_type", "[a-z]+ p", "i")


@B.add("SELECT p_partkey, p_brand FROM part WHERE p_brand IS NULL OR NOT regexp_matches(p_brand, '^(?:Brand#1)')")
def filter_regex_not(spark, d):
    return filters.filter_regex(t(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "!Brand#1")


@B.add("SELECT doc_id FROM documents WHERE contains(text, 'license') OR contains(text, 'password') OR contains(text, 'Licensed')")
def keywords_any(spark, d):
    return filters.filter_keywords(t(spark, d, "documents"), "text", "license, password, Licensed").select("doc_id")


@B.add("SELECT doc_id FROM documents WHERE NOT (contains(text, 'the') OR contains(text, 'der'))")
def keywords_none(spark, d):
    return filters.filter_keywords(t(spark, d, "documents"), "text", "the,der", without=True).select("doc_id")


@B.add("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def filter_exact(spark, d):
    return filters.filter_exact(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "F")


@B.add("SELECT doc_id, lang FROM documents WHERE contains(text, 'secret')")
def filter_contains(spark, d):
    return filters.filter_contains(t(spark, d, "documents"), "text", "secret").select("doc_id", "lang")


GOOD = """length(replace(text, ' ', '')) > 2000 AND
CASE WHEN text = '' THEN 0 ELSE len(string_split(CASE WHEN suffix(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10))) END > 5"""


@B.add(f"SELECT doc_id FROM documents WHERE {GOOD}")
def quality_gate(spark, d):
    return filters.quality_gate(t(spark, d, "documents"), "text", 5, 2000).select("doc_id")


@B.add(f"SELECT doc_id FROM documents WHERE NOT ({GOOD})")
def quality_gate_bad(spark, d):
    return filters.quality_gate(t(spark, d, "documents"), "text", 5, 2000, bad=True).select("doc_id")


def constants(spark):
    return spark.range(1).select(F.lit("given").alias("n_name"), F.lit(7).cast("long").alias("batch"))


@B.add("SELECT n_nationkey, n_name, n_regionkey, 7::BIGINT AS batch FROM nation")
def add_constants_row_wins(spark, d):
    return records.add_constants(t(spark, d, "nation"), constants(spark))


@B.add("SELECT n_nationkey, 'given' AS n_name, n_regionkey, 7::BIGINT AS batch FROM nation")
def add_constants_dic_wins(spark, d):
    return records.add_constants(t(spark, d, "nation"), constants(spark), row_wins=False)


@B.add("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def lookup_join(spark, d):
    return records.lookup(t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", t(spark, d, "customer"), "c_custkey", "c_name", "c_name").drop("o_custkey")


@B.add("SELECT l_orderkey, l_linenumber, l_quantity, round(l_extendedprice * (1 - l_discount), 6) AS net, CASE WHEN l_quantity > 25 AND l_returnflag = 'R' THEN 'big' ELSE l_returnflag END AS kind FROM lineitem")
def expression_column(spark, d):
    df = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    df = records.set_expression(df, "net", "l_extendedprice * (1 - l_discount)")
    df = records.set_expression(df, "kind", "'big' if l_quantity > 25 and l_returnflag == 'R' else l_returnflag")
    return df.select("l_orderkey", "l_linenumber", "l_quantity", F.round("net", 6).alias("net"), "kind")


@B.add("SELECT c_custkey, c_name || ' {' || (c_custkey + 1)::VARCHAR || '} of ' || c_mktsegment || ' Error in expression: nope - name ''nope'' is not defined' AS line FROM customer")
def row_template(spark, d):
    return records.set_template(t(spark, d, "customer"), "line", r"{c_name} \{{c_custkey + 1}\} of {c_mktsegment} {nope}").select("c_custkey", "line")


@B.add("SELECT s_suppkey, 'Supplier ' || s_name || ' in ' || s_nationkey::VARCHAR || ' of unknown' AS line FROM supplier")
def slot_template(spark, d):
    return records.set_slots(t(spark, d, "supplier"), "line", "Supplier __s_name__ in __s_nationkey__ of __planet__").select("s_suppkey", "line")


@B.add("SELECT r_regionkey, true AS ok, 'x' AS tag FROM region")
def set_constants(spark, d):
    return records.set_field(records.set_field(t(spark, d, "region").select("r_regionkey"), "ok", True), "tag", "x")


@B.add("SELECT c_name, c_custkey FROM customer")
def select_fields(spark, d):
    return records.select_fields(t(spark, d, "customer"), "c_name, c_custkey, nothing")


@B.add("SELECT c_custkey, c_name FROM customer")
def remove_fields(spark, d):
    return records.select_fields(t(spark, d, "customer"), "c_nationkey, c_acctbal,c_mktsegment", remove=True)


@B.add("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def drop_unstripped(spark, d):
    return records.drop_fields(t(spark, d, "supplier"), "s_name, s_acctbal")


@B.add("SELECT o_totalprice::VARCHAR AS o_totalprice FROM (SELECT o_orderkey AS o_totalprice FROM orders)")
def extract_text(spark, d):
    return records.extract(t(spark, d, "orders").select(F.col("o_orderkey").alias("o_totalprice")), "o_totalprice")


@B.add("SELECT event_id, row_number() OVER (ORDER BY event_id) AS pos FROM events")
def add_index(spark, d):
    return records.add_index(t(spark, d, "events").select("event_id"), "pos", ["event_id"])


@B.add("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INTEGER AS pos FROM conversations")
def add_group_index(spark, d):
    return records.add_index(t(spark, d, "conversations").select("conv_id", "turn"), "pos", ["turn"], ["conv_id"])


@B.add("SELECT doc_id, quality = 1 AND toxic = 0 AS all_ok FROM labels")
def all_values_true(spark, d):
    df = t(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("q"), (F.col("toxic") == 0).alias("c"))
    return records.all_true(df, "all_ok", ["q", "c"]).drop("q", "c")


@B.add("SELECT doc_id, quality, (quality - coalesce(toxic, 100) + 0)::BIGINT AS total_score FROM labels")
def final_score(spark, d):
    df = t(spark, d, "labels").select("doc_id", "quality", F.col("quality").alias("fit_score"), F.col("toxic").alias("fit_other_score"))
    return records.final_score(df).drop("fit_score", "fit_other_score")


@B.add("SELECT (page_id % 7 + 1)::VARCHAR AS page, page_id::VARCHAR AS chunk, url AS link FROM pages")
def comparison_view(spark, d):
    df = t(spark, d, "pages").select((F.col("page_id") % 7).alias("page_start"), "page_id", "url")
    df = df.withColumn("chunk_id", F.col("page_id").cast("string"))
    return records.comparison_view(df, {"page_start": "page", "chunk_id": "chunk", "url": "link"}, "page_start", "page_id")


@B.add("SELECT n_nationkey, r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def merge_records(spark, d):
    left = t(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("k"), F.col("n_name").alias("name"))
    return records.merge_records(left, t(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), ["k"]).drop("k")


@B.add("SELECT lang AS __NAME__, arg_max(source, doc_id) AS source, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY lang")
def merge_deep(spark, d):
    return records.merge_deep(t(spark, d, "documents"), "lang", ["source", "n_chars"], ["doc_id"])


@B.add("SELECT lang, arg_max(text, (strlen(coalesce(text, '')), -doc_id)) AS text, arg_max(source, (strlen(coalesce(source, '')), -doc_id)) AS source FROM documents GROUP BY lang")
def merge_entropic(spark, d):
    return records.merge_entropic(t(spark, d, "documents"), ["lang"], ["text", "source"], "doc_id")


@B.add("SELECT s_suppkey AS key, s_name AS name, 1 AS id FROM supplier UNION ALL SELECT c_custkey, c_name, 2 FROM customer")
def concat_with_id(spark, d):
    a = t(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return order.union_all([a, t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))], "id")


@B.add("SELECT key, name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY i, key) AS r FROM (SELECT 1 AS i, s_suppkey AS key, s_nationkey AS name FROM supplier UNION ALL SELECT 2, c_custkey, c_nationkey FROM customer)) WHERE r = 1")
def concat_dedup(spark, d):
    a = t(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("name"))
    return order.union_first([a, t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("name"))], "name", ["key"])


@B.add("SELECT s_suppkey AS key FROM supplier UNION ALL SELECT key FROM (SELECT c_custkey AS key FROM customer ORDER BY c_custkey LIMIT (SELECT least(count(*) * 30 // 100, 1000000) FROM supplier))")
def concat_ratio_cap(spark, d):
    return order.union_capped(t(spark, d, "supplier").select(F.col("s_suppkey").alias("key")), t(spark, d, "customer").select(F.col("c_custkey").alias("key")), 30, ["key"])


@B.add("SELECT o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25)")
def keep_top(spark, d):
    return order.keep_top(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], 25)


@B.add("SELECT o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_totalprice, o_orderkey DESC LIMIT 25)")
def keep_top_reverse(spark, d):
    return order.keep_top(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], 25, reverse=True)


@B.add("SELECT event_id, event_type FROM events ORDER BY event_type, event_id")
def sort_stable(spark, d):
    return order.sort_stable(t(spark, d, "events").select("event_id", "event_type"), "event_type", ["event_id"])


@B.add("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def listset_first(spark, d):
    return order.keep_first(t(spark, d, "events").select("event_id", "user_id", "event_type"), ["user_id"], ["event_id"])


@B.add("SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def remove_duplicates(spark, d):
    return order.keep_first(t(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], ["o_orderkey"], strict=True)


@B.add("SELECT event_id, event_type, (dense_rank() OVER (ORDER BY event_type) - 1)::INTEGER AS group_no FROM events")
def split_groups(spark, d):
    return order.split_groups(t(spark, d, "events").select("event_id", "event_type"), "event_type")


@B.add("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, d):
    return order.common(t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), t(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@B.add("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def set_difference(spark, d):
    return order.difference(t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), t(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@B.add("SELECT l_returnflag, l_linestatus, median(l_quantity)::DOUBLE AS vote FROM lineitem GROUP BY ALL")
def votes_median(spark, d):
    return aggregate.votes(t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


@B.add("SELECT source, lang, round_even(avg(quality * 5 + toxic), 0)::INTEGER AS vote FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def votes_mean_round(spark, d):
    b = t(spark, d, "documents").select("doc_id", "source", "lang").join(t(spark, d, "labels"), "doc_id").withColumn("v", F.col("quality") * 5 + F.col("toxic"))
    return aggregate.votes(b, ["source", "lang"], "v", "mean")


@B.add("SELECT l_returnflag, sum(v)::DOUBLE AS total FROM (SELECT l_returnflag, l_linestatus, median(l_quantity) AS v FROM lineitem GROUP BY ALL) GROUP BY ROLLUP (l_returnflag)")
def votes_totals(spark, d):
    return aggregate.vote_totals(votes_median(spark, d), "l_returnflag")


@B.add("""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT user_id, max(n) AS most, sum(n) AS al FROM n GROUP BY ALL)
SELECT user_id, CASE WHEN count(*) = 1 THEN min(event_type) ELSE 'unsure' END AS decision, (max(most) / max(al) * 100)::DOUBLE AS score FROM n JOIN m USING (user_id) WHERE n = most GROUP BY user_id""")
def majority_vote(spark, d):
    return aggregate.majority(t(spark, d, "events"), ["user_id"], "event_type")


@B.add("SELECT user_id FROM events GROUP BY user_id HAVING min(event_type) <> max(event_type)")
def third_ballot(spark, d):
    return aggregate.needs_third_ballot(t(spark, d, "events"), ["user_id"], "event_type")


@B.add("""WITH x AS (SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'inclusion' ELSE 'exclusion' END AS kind,
  CASE WHEN event_type = 'click' THEN 'maybe' WHEN event_id % 2 = 0 THEN (CASE WHEN event_type = 'error' THEN 'no_include' ELSE 'include' END) ELSE (CASE WHEN event_type = 'error' THEN 'exclude' ELSE 'keep' END) END AS dec FROM events)
SELECT user_id,
  CASE WHEN bool_or(kind = 'inclusion' AND dec = 'include') THEN 'true' WHEN count(*) FILTER (kind = 'inclusion') > 0 AND bool_and(dec = 'maybe') FILTER (kind = 'inclusion') THEN 'unsure' ELSE 'false' END AS any_inclusion,
  CASE WHEN count(*) FILTER (kind = 'inclusion') = 0 THEN 'false' WHEN bool_and(dec = 'include') FILTER (kind = 'inclusion') THEN 'true' WHEN bool_or(kind = 'inclusion' AND dec = 'no_include') THEN 'false' ELSE 'unsure' END AS all_inclusion,
  CASE WHEN bool_or(kind = 'exclusion' AND dec = 'exclude') THEN 'true' WHEN bool_or(kind = 'exclusion' AND dec = 'maybe') THEN 'unsure' ELSE 'false' END AS any_exclusion
FROM x GROUP BY user_id""")
def criteria_roll_up(spark, d):
    even = F.col("event_id") % 2 == 0
    e = t(spark, d, "events").withColumn("kind", F.when(even, "inclusion").otherwise("exclusion"))
    bad = F.col("event_type") == "error"
    e = e.withColumn("dec", F.when(F.col("event_type") == "click", "maybe").when(even, F.when(bad, "no_include").otherwise("include")).otherwise(F.when(bad, "exclude").otherwise("keep")))
    return aggregate.roll_up(e, "user_id", "kind", "dec")


@B.add("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_field(spark, d):
    return t(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@B.add("SELECT event_id, regexp_extract('note ' || props || ' end', '\\{.*\\}', 0, 's') AS j FROM events")
def json_longest_bracket(spark, d):
    return t(spark, d, "events").select("event_id", convert.parse_record_text(F.concat(F.lit("note "), "props", F.lit(" end"))).alias("j"))


@B.add("SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS json FROM nation")
def record_json(spark, d):
    df = t(spark, d, "nation").select("n_nationkey", "n_name")
    return df.select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name")).alias("json"))


@B.add("SELECT o_orderkey, o_orderstatus, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def nested_normalise(spark, d):
    lines = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("lines"))
    nested = t(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")
    return convert.normalise(nested)["2_lines"].drop("lines_id")


VERSIONS = """WITH RECURSIVE v AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey = 0 THEN NULL ELSE n_nationkey // 2 END AS up FROM nation),
chain AS (SELECT id AS node, id AS anc, 0 AS dist FROM v UNION ALL SELECT node, v.up, dist + 1 FROM chain JOIN v ON chain.anc = v.id WHERE v.up IS NOT NULL)"""


@B.add(VERSIONS + " SELECT node AS version_id, 'doc' AS entity, 'title' AS field, arg_min('v' || anc, dist) AS value FROM chain WHERE anc % 3 = 0 GROUP BY node")
def version_resolve(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("version_id"), F.when(F.col("n_nationkey") != 0, F.floor(F.col("n_nationkey") / 2).cast("int")).alias("parent_id"))
    values = n.where("version_id % 3 = 0").select("version_id", F.lit("doc").alias("entity"), F.lit("title").alias("field"), F.concat(F.lit("v"), F.col("version_id").cast("string")).alias("value"))
    return graph.resolve_versions(values, n)


@B.add(VERSIONS + " SELECT node, max(dist)::INTEGER AS depth FROM chain GROUP BY node")
def plan_flatten(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.when(F.col("n_nationkey") != 0, F.floor(F.col("n_nationkey") / 2).cast("int")).alias("up"))
    return graph.flatten_tree(spark, n, "node", "up", "node").select("node", "depth")


@B.add("SELECT DISTINCT p.p_brand, q.p_brand AS closest FROM (SELECT DISTINCT p_brand || 'x' AS p_brand FROM part) p, LATERAL (SELECT p_brand FROM (SELECT DISTINCT p_brand FROM part) z ORDER BY levenshtein(p.p_brand, z.p_brand), z.p_brand LIMIT 1) q")
def fuzzy_closest(spark, d):
    brands = t(spark, d, "part").select("p_brand").distinct()
    return aggregate.closest(brands.select(F.concat("p_brand", F.lit("x")).alias("p_brand")), "p_brand", brands, "p_brand").drop("distance")


@B.add("""WITH RECURSIVE g AS (SELECT DISTINCT p_type || ' ' || p_size AS tag FROM part), e AS (SELECT x.tag AS a, y.tag AS b FROM g x, g y WHERE x.tag <> y.tag AND levenshtein(x.tag, y.tag) <= greatest(length(x.tag), length(y.tag)) * 0.1),
r AS (SELECT tag, tag AS cur FROM g UNION SELECT r.tag, e.b FROM r JOIN e ON r.cur = e.a) SELECT tag, min(cur) AS cluster FROM r GROUP BY tag""")
def tag_clusters(spark, d):
    return aggregate.tag_clusters(t(spark, d, "part").select(F.concat_ws(" ", "p_type", F.col("p_size").cast("string")).alias("tag")), "tag", 0.1)


@B.add("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    return streams.hourly_batch(spark, d).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@B.add("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, d):
    x = t(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@B.add("SELECT n_name, c_mktsegment, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_name, c_mktsegment)")
def revenue_cube(spark, d):
    x = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return x.cube("n_name", "c_mktsegment").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@B.add("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@B.add("SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS running, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events")
def running_totals(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t(spark, d, "events").select("event_id", "user_id", F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"), F.lag("event_type").over(w).alias("before"))


QUERIES, ORACLES = B.queries, B.oracles
