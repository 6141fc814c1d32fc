"""The auction against an exact solver, and its limits."""

import numpy as np
import pytest
from exact_assignment import solve_assignment
from pyspark.sql import functions as F

from weftline.operators import assignment, vectors


def scores(spark, matrix, document):
    rows = [(f"c{i:03d}", document[i], g, float(x)) for i, line in enumerate(matrix) for g, x in enumerate(line)]
    return spark.createDataFrame(rows, "chunk string, document int, group int, score double")


def check(spark, matrix, document, per_chunk, per_group, per_document, epsilon=0.01, near=True):
    n, m = matrix.shape
    got = assignment.assign(scores(spark, matrix, document), per_chunk, per_group, per_document, epsilon)
    pairs = [tuple(r) for r in got.rows.collect()]
    per_chunk = min(per_chunk, m)
    quota = assignment.group_quota(n, m, per_chunk, per_group)
    best = sum(matrix[c, g] for c, g in solve_assignment(matrix, document, per_chunk, quota, per_document))
    total = sum(s for _, _, s in pairs)
    assert len({p[:2] for p in pairs}) == len(pairs) == quota * m
    for g in range(m):
        assert sum(p[1] == g for p in pairs) == quota
    at = [int(p[0][1:]) for p in pairs]
    assert max(at.count(c) for c in at) <= per_chunk
    for d in set(document):
        assert sum(document[c] == d for c in at) >= min(per_document, document.count(d) * per_chunk)
    spread = (matrix.max() - matrix.min()) or 1.0
    assert best - 1e-9 <= total + got.gap
    assert not near or got.gap <= 4 * epsilon * spread * quota * m + 1e-9
    assert total <= best + 1e-9
    return got, best - total


@pytest.mark.parametrize("seed", range(2))
def test_auction_is_near_the_optimum(spark, seed):
    r = np.random.default_rng(seed)
    n, m = int(r.integers(14, 22)), int(r.integers(2, 5))
    document = [int(d) for d in np.sort(r.integers(0, 3, n))]
    check(spark, r.standard_normal((n, m)), document, 1 + seed % 2, 3, 1 + seed % 2, near=seed < 2)


def test_groups_that_want_the_same_chunks(spark):
    r = np.random.default_rng(5)
    matrix = np.outer(np.linspace(1, 0, 16), np.ones(4)) + 0.01 * r.standard_normal((16, 4))
    check(spark, matrix, [0] * 16, 1, 3, 1, near=False)


def test_documents_that_nobody_wants(spark):
    r = np.random.default_rng(6)
    matrix = r.random((18, 3))
    matrix[10:] -= 0.5  # documents 1 and 2 are worth less than any other
    got, _ = check(spark, matrix, [0] * 10 + [1] * 5 + [2] * 3, 1, 3, 2, near=False)
    assert got.rows.where("chunk >= 'c010'").count() == 4


def test_ties_and_edges(spark):
    check(spark, np.ones((12, 3)), [0, 1, 2] * 4, 1, 2, 1)
    check(spark, np.zeros((4, 1)), [0, 0, 0, 0], 1, 9, 0)
    empty = scores(spark, np.zeros((0, 0)), [])
    assert assignment.assign(empty).rows.count() == 0
    with pytest.raises(ValueError, match="no assignment"):
        assignment.assign(scores(spark, np.zeros((2, 2)), [0, 1]), 1, 1, 1)


def test_short_heads_grow(spark, monkeypatch):
    grown = []
    heads = assignment._heads
    monkeypatch.setattr(assignment, "HEAD", 1)
    monkeypatch.setattr(assignment, "_heads", lambda cells, length: heads(cells, grown.append(length) or length))
    check(spark, np.outer(np.linspace(1, 0, 12), np.ones(3)), [0] * 12, 1, 2, 0, near=False)
    assert grown[0] == 4 and len(grown) > 1


def test_arrays_per_chunk(spark):
    pairs = spark.createDataFrame([("a", 2, 0.5), ("a", 1, 0.25), ("b", 1, 0.75)], "chunk string, group int, score double")
    chunks = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    got = {r.id: (r.assigned_to, r.assigned_to_score) for r in assignment.assigned_chunks(chunks, "id", pairs).collect()}
    assert got == {"a": ([1, 2], [0.25, 0.5]), "b": ([1], [0.75]), "c": ([], [])}
    assert [r.chunk for r in assignment.strongest(pairs, 2).collect()] == ["b", "a"]
    assert assignment.strongest(pairs, 0).agg(F.count("*")).first()[0] == 3


def test_sections_get_chunks_within_limits(spark):
    r = np.random.default_rng(9)
    chunks = spark.createDataFrame([(i, i % 3, [float(v) for v in r.standard_normal(4)]) for i in range(18)], "chunk long, doc int, v array<double>")
    bullets = spark.createDataFrame([(f"s{i % 2}", [float(v) for v in r.standard_normal(4)]) for i in range(5)], "section string, b array<double>")
    names = spark.createDataFrame([(0, "first"), (1, "second")], "doc int, name string")
    got = vectors.section_chunks(bullets, "section", "b", chunks, "chunk", "doc", "v", names, "name", 1, 3, 1).collect()
    assert sorted(g.section for g in got) == ["s0"] * 3 + ["s1"] * 3 and len({g.chunk for g in got}) == 6
    assert {g.document for g in got} == {0, 1, 2} and all(g.reference == ["first", "second", ""][g.document] and g.document == g.chunk % 3 for g in got)


def test_scores_of_vectors_are_no_table(spark, monkeypatch):
    """The pairs and the bound are those of a table of scores, but no table of all pairs is made before the bound is asked for."""
    r = np.random.default_rng(8)
    made = [(i, i % 4, [float(x) for x in r.standard_normal(6)] if i % 11 else None) for i in range(60)]
    chunks = spark.createDataFrame(made, "chunk long, doc int, v array<double>")
    anchors = spark.createDataFrame([(g, [float(x) for x in r.standard_normal(6)]) for g in range(6)], "g int, q array<double>")
    plain = assignment.assign(vectors.affinity(chunks, "chunk", "doc", "v", anchors, "g", "q"), 1, 4, 2)
    whole = assignment.Vectors.all
    monkeypatch.setattr(assignment.Vectors, "all", property(lambda self: (_ for _ in ()).throw(AssertionError("all pairs"))))
    got = vectors.anchored_top_k(chunks, "chunk", "doc", "v", anchors, "g", "q", 1, 4, 2)
    assert {(x.chunk, x["group"]) for x in got.rows.collect()} == {(x.chunk, x["group"]) for x in plain.rows.collect()}
    monkeypatch.setattr(assignment.Vectors, "all", whole)
    assert abs(got.gap - plain.gap) < 1e-9
