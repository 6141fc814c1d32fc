"""Clustering, tree search and the Merkle manifest against brute force, and their defined cases."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import centroid_clusters, merkle_manifest, registry, tree_search

VECS = "vec_id long, embedding array<float>, label int, id long, leaf string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, g int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], VECS)


def noisy(seed, n, dim=64, groups=6, spread=0.05):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(groups, dim))
    x = centre[r.integers(groups, size=n)] + spread * r.normal(size=(n, dim))
    return [(int(i), [float(np.float32(v)) for v in row]) for i, row in enumerate(x / np.linalg.norm(x, axis=1)[:, None])]


@pytest.mark.parametrize("name", ["op11_centroid_clusters", "op13_merkle_manifest"])
def test_same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in cur.description]
    df = registry.QUERIES[name](spark, sf)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(cur.fetchall())


# -- clustering


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    ranked = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], np.int32).tobytes()))
    centroids = [v for _, v in ranked[:k]]
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        held = [[] for _ in centroids]
        for _, v in kept:
            held[nearest(v)].append(v)
        centroids = [[sum(x) // len(x) for x in zip(*h, strict=True)] if h else c for h, c in zip(held, centroids, strict=True)]
    at = [(i, nearest(v), v) for i, v in kept]
    per = {}
    for _, c, v in at:
        per[c] = per.get(c, 0) + far(v, centroids[c])
    said = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, c, far(v, centroids[c]), per[c], sum(per.values()), said[c]) for i, c, v in at)


def clusters(spark, rows, **how):
    got = centroid_clusters.centroid_clusters(vectors(spark, rows), **how)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, got.collect()))


def test_clusters_are_exact(spark):
    rows = noisy(1, 150) + noisy(2, 80, groups=80)[40:] + [(500 + i, [0.25] * 64) for i in range(60)]  # a third alike
    rows = [(i + 1000 * (n % 2), v) for n, (i, v) in enumerate(rows)]
    assert clusters(spark, rows) == plain_clusters(rows)


def test_odd_vectors_have_no_cluster(spark):
    good = noisy(3, 20)
    odd = [(90, None), (91, []), (92, [1.0] * 63), (93, [None] + [1.0] * 63), (94, [float("nan")] * 64), (95, [float("inf")] + [0.0] * 63), (96, [1.0] * 65)]
    assert clusters(spark, good + odd) == plain_clusters(good)
    assert clusters(spark, odd) == [] == clusters(spark, [])
    few = good[:5] + good[:5]  # rows that repeat, fewer than centroids
    assert clusters(spark, few) == plain_clusters(few)
    huge = clusters(spark, [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)], k=1)
    assert [r[2] for r in huge] == [1 << 60, 1 << 60, 0]  # integers stop at 2 ** 27


def test_bounds_screen_and_never_lose(spark):
    rows = np.array([v for _, v in noisy(4, 2000, groups=8, spread=0.02)])
    x = np.floor(64 * rows).astype(np.int64)
    small = np.concatenate(centroid_clusters.compressed(x), axis=1)
    centroids = x[:: len(x) // 16][:16]
    label, far, computed = centroid_clusters.nearest(x, small, centroids)
    all_far = ((x[:, None] - centroids) ** 2).sum(2)
    assert (far == all_far.min(1)).all() and (label == all_far.argmin(1)).all()
    assert computed < 0.4 * all_far.size  # most are screened out
    other = np.concatenate(centroid_clusters.compressed(centroids), axis=1)
    low = ((small[:, None] - other) ** 2).sum(2)
    assert (low <= all_far + 1e-6).all()
    ties = np.concatenate([centroids, centroids])
    assert (centroid_clusters.nearest(x, small, ties)[0] < 16).all()


# -- search


def dot(a, b):
    out = 0.0
    for x, y in zip(a, b, strict=True):  # sum() would compensate
        out += x * y
    return out


def plain_search(rows, k=20, every=20):
    width = max((len(v) for _, v in rows if v), default=0)
    kept = {(i, tuple(v) + (0.0,) * (width - len(v))) for i, v in rows if i is not None and v and any(v) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in kept:
        if q % every == 0:
            score = sorted((-dot(a, b), i) for i, b in kept if (i, b) != (q, a))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(score[:k])]
    return sorted(out)


def found(spark, rows, **how):
    return sorted(map(tuple, tree_search.search(vectors(spark, rows), **how).rows.collect()))


def test_search_with_all_visits_is_exact(spark):
    rows = noisy(5, 300, groups=5) + [(1000 + i, [0.125] * 64) for i in range(150)] + [(2000 + i, [float(i % 3), float(i % 2)] + [1.0] * 62) for i in range(40)]
    assert found(spark, rows, recall=1.0, leaf_rows=16) == plain_search(rows)


def test_search_recall(spark):
    rows = noisy(6, 1500, groups=40, spread=0.1)
    got = tree_search.search(vectors(spark, rows), leaf_rows=32)
    near = {(q, v) for q, _, v, _ in map(tuple, got.rows.collect())}
    want = {(q, v) for q, _, v, _ in plain_search(rows)}
    assert got.leaves > 20 and got.visits < got.leaves and got.recall >= tree_search.RECALL
    assert len(near & want) >= 0.9 * len(want) and len(near) == len(want)


def test_search_of_the_test_data(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = list(map(tuple, registry.QUERIES["op12_tree_search"](spark, sf).collect()))
    want = plain_search(rows)
    assert len(got) == len(want) and len({r[:1] + r[2:3] for r in got} & {r[:1] + r[2:3] for r in want}) >= 0.9 * len(want)
    exact = {(q, v): s for q, _, v, s in plain_search(rows, k=len(rows))}
    assert all(exact[q, v] == s for q, _, v, s in got)


def test_odd_vectors_are_not_searched(spark):
    rows = noisy(7, 45, dim=8) + [(60, None), (80, []), (100, [0.0] * 8), (120, [None] * 8), (140, [float("inf")] * 8), (None, [1.0] * 8), (160, [1.0, 2.0])]
    rows += [(20, [2.0] * 8), rows[0], rows[0], (200, [-1.0] * 8), (220, [float(np.float32(1e30))] * 8)]  # an id with two vectors, a row three times
    got, want = found(spark, rows, recall=1.0, leaf_rows=4), plain_search(rows)
    assert [r[:3] for r in got] == [r[:3] for r in want] and all(math.isclose(a[3], b[3], rel_tol=1e-12) for a, b in zip(got, want, strict=True))
    assert found(spark, []) == [] == found(spark, [(1, [1.0])]) == found(spark, [(20, [1.0])])
    assert found(spark, [(20, None), (40, [])]) == []


def test_blocks_of_a_large_leaf(spark, monkeypatch):
    monkeypatch.setattr(tree_search, "BLOCK", 16)
    monkeypatch.setattr(tree_search, "QUERIES", 4)
    rows = noisy(8, 400, groups=1, spread=0.01)
    assert found(spark, rows, recall=1.0, leaf_rows=300) == plain_search(rows)


# -- manifest


def plain_manifest(docs, fanout=8):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = lambda d, t: h("".join(map(enc, (d["doc_id"], d["source"], d["lang"], d["n_chars"], t))))

    def climb(nodes):
        """The top of a list of digests, and each one's siblings as (before, after)."""
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
        while len(level) > 1:
            runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
            for p, a in enumerate(at):
                run, i = runs[a // fanout], a % fanout
                paths[p].append(("".join(run[:i]), "".join(run[i + 1 :])))
                at[p] = a // fanout
            level = [h("".join(r)) for r in runs]
        return level[0], paths

    langs = sorted({d["lang"] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    groups = []
    for lang in langs:
        rows = sorted((d for d in docs if d["lang"] == lang), key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf(d, d["text"])))
        groups.append((rows, *climb([leaf(d, d["text"]) for d in rows])))
    root, upper = climb([g[1] for g in groups]) if groups else (None, [])
    out = []
    for (rows, sub, paths), more in zip(groups, upper, strict=True):
        for d, p in zip(rows, paths, strict=True):
            hit = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 3 == 0 and d["text"] is not None
            node = leaf(d, d["text"].translate(low) if hit else d["text"])
            for before, after in p + more:
                node = h(before + node + after)
            out.append((d["doc_id"], leaf(d, d["text"]), sub, root, h("".join(b + a for b, a in p + more)), node, node == root))
    return sorted(out, key=str)


def documents(seed, n, langs):
    r = random.Random(seed)
    text = lambda: r.choice([None, "", "Ünï Çode", "lower", "UPPER Case", "x" * 5000 + "Y"])
    return [{"doc_id": i, "text": text(), "lang": r.choice(langs), "source": r.choice([None, "web", "a:b"]), "n_chars": r.choice([None, 3]), "digest": "no", "g": 4} for i in range(n)]


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (8, ["en"]), (9, [None]), (65, ["en", None, "", "é", "Z"]), (400, ["en"] * 9 + ["de"]), (200, [chr(65 + i) for i in range(70)])])
def test_manifest(spark, n, langs):
    docs = documents(n, n, langs)
    got = merkle_manifest.manifest(spark.createDataFrame(docs, DOCS).repartition(5))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    if "" in langs and None in langs:  # an empty name orders after null
        assert "" < "="
    assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(docs)


def test_manifest_of_odd_rows(spark):
    docs = documents(9, 30, ["en", "de"])
    docs += docs[:3] + [{**docs[4], "text": "Another"}, {**docs[5], "doc_id": None}, {**docs[6], "doc_id": None}, {**docs[7], "doc_id": -5}]
    got = merkle_manifest.manifest(spark.createDataFrame(docs, DOCS))
    assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(docs)
    assert merkle_manifest.manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_a_changed_sibling_breaks_the_proof(spark):
    rows = spark.createDataFrame([("=en", i, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(30)], "g string, id long, digest string")
    held = merkle_manifest.proofs(rows, ["id"], ["id"])
    good = merkle_manifest.fold(F.col("digest"), F.col("path")) == F.col("root")
    assert held.where(good).count() == 30
    other = F.transform("path", lambda x: F.struct(F.reverse(x["before"]).alias("before"), x["after"].alias("after")))
    assert held.where(merkle_manifest.fold(F.col("digest"), other) == F.col("root")).count() == held.where(F.size(F.filter("path", lambda x: x["before"] != "")) == 0).count()


def test_levels_lie_in_the_store(spark):
    rows = spark.createDataFrame([("=a", i, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(70)], "g string, id long, digest string")
    store = merkle_manifest.build(rows, ["id"], ["id"])
    assert [(level.count(), level.agg(F.max("n")).first()[0]) for level in store.levels] == [(70, 70), (9, 9), (2, 2), (1, 1)]
    assert sorted(r["at"] for r in store.levels[0].collect()) == list(range(70))
    assert spark.read.parquet(store.path).groupBy("level").count().count() == 4
