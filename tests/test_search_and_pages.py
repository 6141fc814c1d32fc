"""Pruned and exclusive searches and the main text of pages on hand-made cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from weftline.operators import main_text, vectors


def points(spark, x, name="id"):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], f"{name} long, v array<double>")


def test_cells_are_skipped_and_nothing_is_lost(spark):
    r = np.random.default_rng(1)
    centre = r.standard_normal((12, 16))
    x = np.concatenate([c + 0.02 * r.standard_normal((60, 16)) for c in centre] + [np.tile(centre[0], (30, 1))])  # copies tie
    q = centre[:6] + 0.02 * r.standard_normal((6, 16))
    got, scored = vectors.pruned_top_k(points(spark, x), "id", "v", points(spark, q, "qid"), "qid", "v", 7, n_cells=24)
    cos = (q / np.linalg.norm(q, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T
    rows = {(g.query, g["rank"]): (g.id, g.sim) for g in got.collect()}
    for i in range(6):
        order = sorted(range(len(x)), key=lambda j: (-round(cos[i, j], 12), j))[:7]
        assert np.allclose([rows[i, k + 1][1] for k in range(7)], cos[i, order])
    assert scored.agg(F.sum("n")).first()[0] < 0.3 * len(x) * len(q)
    few, _ = vectors.pruned_top_k(points(spark, x[:3]), "id", "v", points(spark, q, "qid"), "qid", "v", 7)
    assert few.count() == 18


def test_equal_vectors_are_at_no_distance(spark):
    x = np.random.default_rng(4).standard_normal((60, 64))
    got = vectors.top_k_any(points(spark, x), "id", "v", points(spark, x, "qid"), "v", 20).collect()
    assert [(g.id, g.dist) for g in got] == [(i, 0.0) for i in range(20)]  # all tie, so the least ids stay


def test_queries_that_want_the_same_rows(spark):
    r = np.random.default_rng(2)
    x, q = r.standard_normal((40, 8)), np.tile(r.standard_normal(8), (5, 1)) + 0.001 * r.standard_normal((5, 8))
    got = vectors.top_k_uniform(points(spark, x), "id", "v", points(spark, q, "qid"), "qid", "v", 17).collect()
    dist = 1 - (q / np.linalg.norm(q, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T
    want, taken = set(), set()
    for i in range(5):  # one query after the other
        mine = [j for j in np.argsort(dist[i]) if j not in taken][:3]
        taken |= set(mine)
        want |= {(int(j), i) for j in mine}
    assert {(g.id, g["query"]) for g in got} == want
    assert vectors.top_k_uniform(points(spark, x), "id", "v", points(spark, q, "qid"), "qid", "v", 4).count() == 0


def best_run(values):
    """Plain version: end of the first run with the largest sum, then the longest."""
    best = (0, 0, 0)
    for end in range(len(values)):
        for start in range(end + 1):
            if sum(values[start : end + 1]) > best[0]:
                best = (sum(values[start : end + 1]), start, end + 1)
    return set(range(best[1], best[2]))


def test_runs_with_the_largest_sum(spark):
    r = random.Random(3)
    lists = [[r.randint(-4, 4) for _ in range(r.randint(1, 12))] for _ in range(120)] + [[-1, -2], [0, 0], [2, -2, 2], [0, 3]]
    rows = spark.createDataFrame([(p, i, v) for p, values in enumerate(lists) for i, v in enumerate(values)], "page long, pos int, v long")
    got = {}
    for g in main_text.best_run(rows, "page", "pos", F.col("v")).where("in_run").collect():
        got.setdefault(g.page, set()).add(g.pos)
    assert all(got.get(p, set()) == best_run(values) for p, values in enumerate(lists))


def test_menus_are_left_out(spark):
    prose = "word " * 30
    pages = {
        1: f"<html><head><title>{prose}</title></head><body><nav><ul><li><a href='/'>home</a></li><li><a href='/x'>x y z</a></li></ul></nav><p>{prose}<p>short<p>{prose}</p><div><a href='#'>{prose}</a></div></body></html>",
        2: None, 3: "", 4: "<p>a b c</p>", 5: f"no tags {prose}", 6: f"<script>{prose}</script><!-- {prose} --><p>{prose}",
    }
    got = {g.id: (g.n_blocks, g.n_kept, g.text) for g in main_text.main_text(spark.createDataFrame(list(pages.items()), "id long, html string"), "id", "html").collect()}
    text = prose.strip()
    assert got == {1: (6, 3, f"{text}\nshort\n{text}"), 2: (0, 0, ""), 3: (0, 0, ""), 4: (1, 0, ""), 5: (1, 1, f"no tags {text}"), 6: (1, 1, text)}


def test_blocks_find_what_brute_force_finds(spark, monkeypatch):
    """Copies, and vectors that are null, hold a null, have no length or another one; blocks so small that each table has several."""
    from weftline.operators import search

    monkeypatch.setattr(search, "ROWS", 60)
    monkeypatch.setattr(search, "QUERIES", 4)
    r = np.random.default_rng(5)
    x = [list(map(float, v)) for v in np.concatenate([r.standard_normal((150, 8)), np.tile(r.standard_normal(8), (90, 1))])]
    x += [None, [1.0, None] + [0.0] * 6, [0.0] * 8, [1.0, 2.0]]
    rows = spark.createDataFrame(list(enumerate(x)), "id long, v array<double>")
    asked = rows.where("id % 25 = 3 OR id >= 240")
    got = vectors.top_k_queries(rows, "id", "v", asked, "id", "v", 6)
    both = rows.select("id", "v").crossJoin(asked.select(F.col("id").alias("query"), F.col("v").alias("q")))
    scored = both.select("query", "id", vectors.cosine(F.col("v"), F.col("q")).alias("sim"))
    want: dict = {}
    for g in scored.collect():
        want.setdefault(g.query, []).append((g.sim is None, 0.0 if g.sim is None or g.sim != g.sim else -g.sim, g.sim == g.sim if g.sim is not None else True, g.id))
    best = {q: [v[-1] for v in sorted(v, key=lambda t: (t[0], t[2], t[1], t[3]))[:6]] for q, v in want.items()}
    found: dict = {}
    for g in got.orderBy("query", "rank").collect():
        found.setdefault(g.query, []).append(g.id)
    assert found == best


def test_searches_make_no_table_of_all_pairs(spark):
    """Rows and queries meet in tasks that return the best ones; a join of all with all grew to thousands of seconds."""
    x = np.random.default_rng(6).standard_normal((40, 4))
    for got in (
        vectors.top_k_queries(points(spark, x), "id", "v", points(spark, x, "qid"), "qid", "v", 3),
        vectors.pruned_top_k(points(spark, x), "id", "v", points(spark, x, "qid"), "qid", "v", 3)[0],
    ):
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroups" in plan and "zip_with" not in plan


def test_affinity_is_taken_with_the_mean_of_a_group(spark):
    a = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 0.0]), ("a", [5.0]), ("b", None), (None, [1.0, 1.0])], "g string, q array<double>")
    c = spark.createDataFrame([(1, 7, [1.0, 1.0]), (2, 7, [2.0]), (3, 8, None)], "id long, doc long, v array<double>")
    got = vectors.affinity(c, "id", "doc", "v", a, "g", "q")
    assert {(g.chunk, g.group): g.score for g in got.collect()} == {
        (1, "a"): 3.0, (2, "a"): 10.0, (3, "a"): None, (1, "b"): None, (2, "b"): None, (3, "b"): None, (1, None): 2.0, (2, None): None, (3, None): None,
    }
    copies = a.crossJoin(spark.range(400)).drop("id")
    rows = vectors.group_means(copies, "g", "q")
    assert rows.count() == 4  # a chunk meets a group's means, not its anchors


def test_a_row_is_placed_once_a_vector(spark):
    """Centres are compared in a task's matrix; as expressions they took a row 64 times 64 steps, and the length of a vector as many."""
    x = [*map(list, np.random.default_rng(7).standard_normal((50, 4))), [0.0] * 4, None]
    rows = spark.createDataFrame([(i, None if v is None else [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")
    from weftline.operators import search

    plan = search.placed(rows, "v", [[1.0, 0.0, 0.0, 0.0]])._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "transform" not in plan
    cells = {g.id: (g.cell, g.gap) for g in vectors.cells_of(rows, "id", "v", 8).collect()}
    assert len(cells) == 52 and cells[50] == cells[51] == (-1, None) and min(cells[i][0] for i in range(50)) == 0
    assert all(0 <= cells[i][1] <= 2 for i in range(50))
