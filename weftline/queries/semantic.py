"""Queries on vectors and on provider-backed operators with the offline providers."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import main_text, prompts, providers, vectors
from weftline.queries.base import Book
from weftline.session import table as t

B = Book()
COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def one(spark, d, key: int):
    return t(spark, d, "embeddings").where(F.col("vec_id") == key).select(F.col("embedding").alias("q"))


@B.add(f"SELECT a.vec_id, round({COS}, 6) AS sim FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY {COS} DESC, a.vec_id DESC LIMIT 10")
def top_k(spark, d):
    return vectors.top_k(t(spark, d, "embeddings"), "embedding", one(spark, d, 0), "q", 10, ["vec_id"]).select("vec_id", F.round("sim", 6).alias("sim"))


@B.add(f"SELECT a.vec_id, round(min(1 - {COS}), 6) AS dist FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0 GROUP BY a.vec_id ORDER BY min(1 - {COS}), a.vec_id LIMIT 20")
def topk_multi_min(spark, d):
    q = t(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("embedding").alias("q"))
    return vectors.top_k_any(t(spark, d, "embeddings"), "vec_id", "embedding", q, "q", 20).select("vec_id", F.round("dist", 6).alias("dist"))


@B.add(f"""SELECT vec_id, label, round(sim, 6) AS sim FROM (SELECT a.vec_id, a.label, {COS} AS sim FROM embeddings a, embeddings b WHERE b.vec_id = 5
QUALIFY row_number() OVER (PARTITION BY a.label ORDER BY {COS} DESC, a.vec_id) <= 3) ORDER BY sim DESC, vec_id LIMIT 15""")
def topk_per_document(spark, d):
    return vectors.top_k_capped(t(spark, d, "embeddings"), "vec_id", "label", "embedding", one(spark, d, 5), "q", 15, 3).select("vec_id", "label", F.round("sim", 6).alias("sim"))


@B.add(f"SELECT b.vec_id AS query, a.vec_id, round({COS}, 6) AS sim FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY b.vec_id ORDER BY {COS} DESC, a.vec_id) <= 5")
def topk_queries(spark, d):
    q = t(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return vectors.top_k_queries(t(spark, d, "embeddings"), "vec_id", "embedding", q, "qid", "q", 5).select("query", "vec_id", F.round("sim", 6).alias("sim"))


@B.add(f"""WITH RECURSIVE q AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS t, count(*) OVER () AS n FROM embeddings WHERE vec_id % 50 = 0),
r AS (SELECT q.t, q.n, b.vec_id AS query, a.vec_id, 1 - {COS} AS dist FROM q JOIN embeddings b ON b.vec_id = q.vec_id CROSS JOIN embeddings a),
l AS (SELECT t, n, list(vec_id ORDER BY dist, vec_id) AS ids FROM r GROUP BY t, n),
s AS (SELECT 0::BIGINT AS t, []::BIGINT[] AS used, []::BIGINT[] AS got UNION ALL
      SELECT l.t, list_concat(s.used, list_filter(l.ids, lambda x: NOT list_contains(s.used, x))[1:200 // l.n]), list_filter(l.ids, lambda x: NOT list_contains(s.used, x))[1:200 // l.n] FROM s JOIN l ON l.t = s.t + 1)
SELECT r.vec_id, r.query, round(r.dist, 6) AS dist FROM (SELECT t, unnest(got) AS vec_id FROM s) g JOIN r ON r.t = g.t AND r.vec_id = g.vec_id""")
def topk_uniform(spark, d):
    q = t(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return vectors.top_k_uniform(t(spark, d, "embeddings"), "vec_id", "embedding", q, "qid", "q", 200).select("vec_id", "query", F.round("dist", 6).alias("dist"))


@B.add(f"SELECT b.vec_id AS query, a.vec_id, round({COS}, 6) AS sim FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY b.vec_id ORDER BY {COS} DESC, a.vec_id) <= 5")
def topk_pruned(spark, d):
    q = t(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return vectors.pruned_top_k(t(spark, d, "embeddings"), "vec_id", "embedding", q, "qid", "q", 5)[0].select("query", "vec_id", F.round("sim", 6).alias("sim"))


@B.add("""WITH n AS (SELECT least(30, floor(0.75 * count(*))) AS most FROM embeddings),
r AS (SELECT a.vec_id, a.label, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE b.vec_id = 0),
k AS (SELECT *, row_number() OVER (ORDER BY s DESC, vec_id) AS n FROM r)
SELECT string_agg('Chunk ID: ' || vec_id || chr(10) || 'From: ' || label || chr(10) || chr(10) || 'v' || vec_id, chr(10) || chr(10) || repeat('=', 33) || chr(10) || chr(10) ORDER BY k.n) AS content
FROM k, n WHERE k.n <= n.most""")
def search_prompt(spark, d):
    e = t(spark, d, "embeddings").withColumn("text", F.concat(F.lit("v"), F.col("vec_id").cast("string")))
    return vectors.search_prompt(e, "vec_id", "label", "text", "embedding", one(spark, d, 0), "q").select(F.col("prompt")[0]["content"].alias("content"))


@B.add(main_text.oracle())
def main_runs(spark, d):
    return main_text.main_text(t(spark, d, "pages"), "page_id", "html")


@B.add("SELECT a.vec_id, b.label AS \"group\", round(avg(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0 GROUP BY ALL")
def affinity(spark, d):
    a = t(spark, d, "embeddings").where("vec_id % 50 = 0").select("label", F.col("embedding").alias("q"))
    return vectors.affinity(t(spark, d, "embeddings"), "vec_id", "label", "embedding", a, "label", "q").select(F.col("chunk").alias("vec_id"), "group", F.round("score", 6).alias("score"))


@B.add()
def anchored_top_k(spark, d):
    e = t(spark, d, "embeddings")
    a = t(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("g"), F.col("embedding").alias("q"))
    return vectors.anchored_top_k(e, "vec_id", "label", "embedding", a, "g", "q", 1, 5, 1).rows


@B.add()
def clusterize(spark, d):
    return vectors.cluster(t(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 8, 3, name="cluster").select("vec_id", "cluster")


@B.add("SELECT conv_id, arg_max(text, turn) AS reply FROM conversations GROUP BY conv_id")
def offline_reply(spark, d):
    p = prompts.from_turns(t(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return providers.complete(p, "prompt").select("conv_id", "reply")


@B.add("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def offline_structured(spark, d):
    e = t(spark, d, "events").select("event_id", prompts.start("user", F.col("props")).alias("prompt"))
    return providers.structured(e, "prompt", "struct<k:bigint>", required=["k"]).select("event_id", "record.k")


@B.add()
def offline_embedding(spark, d):
    return providers.embed(t(spark, d, "benchmark").select("item_id", "text"), "text").select("item_id", "embedding")


QUERIES, ORACLES = B.queries, B.oracles
