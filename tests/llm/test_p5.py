"""The permutation index against brute force, and its edge cases."""

import numpy as np
from pyspark.sql import functions as F

from curatrix.llm import p5_neighbours as p5
from curatrix.plans.tables import table

SHAPE = "vec_id long, space string, vec array<float>, unit string, pivots string, q long"


def frame(spark, rows):
    return spark.createDataFrame([(i, s, v, "x", "y", 0) for i, s, v in rows], SHAPE)


def test_recall_on_the_given_vectors(spark):
    vectors = table(spark, "/root/testdata/sf0.01", "record_vectors")
    assert all(r["recall"] >= 0.9 for r in p5.recall(vectors).collect())


def test_recall_function_agrees_with_numpy(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 64))
    x = (centres[rng.integers(0, 12, 240)] + 0.2 * rng.normal(size=(240, 64))).astype(np.float32)
    vectors = frame(spark, [(i, "s", v.tolist()) for i, v in enumerate(x)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = np.round(u.astype(np.float64) @ u.T.astype(np.float64), 9)
    np.fill_diagonal(c, -2)
    found = {}
    for r in p5.neighbours(vectors).collect():
        found.setdefault(r["vec_id"], set()).add(r["neighbour"])
    hits = sum(len(found[q] & set(np.argsort(-c[q], kind="stable")[:5].tolist())) for q in range(240))
    assert hits / 1200 >= 0.95
    pairs = {tuple(r) for r in p5.neighbour_pairs(vectors).collect()}
    assert pairs == {(min(q, n), max(q, n)) for q, ns in found.items() for n in ns}


def test_unusable_repeated_and_few_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=64).astype(np.float32)
    other = rng.normal(size=64).astype(np.float32)
    rows = [(i, "a", base.tolist()) for i in range(8)] + [(20, "a", (base * 3).tolist()), (21, "a", other.tolist()), (30, "b", other.tolist()), (31, None, base.tolist()), (32, None, other.tolist())]
    rows += [(40, "a", None), (41, "a", []), (42, "a", [1.0] * 32), (43, "a", [0.0] * 64), (44, "a", [float("nan")] + [1.0] * 63), (45, "a", [float("inf")] + [1.0] * 63), (46, "a", [None] + [1.0] * 63)]
    got = {}
    for r in p5.neighbours(frame(spark, rows)).collect():
        got.setdefault(r["vec_id"], []).append((r["rank"], r["neighbour"]))
    got = {k: [n for _, n in sorted(v)] for k, v in got.items()}
    assert got[0] == [1, 2, 3, 4, 5] and got[7] == [0, 1, 2, 3, 4]
    assert got[20] == [0, 1, 2, 3, 4] and got[21][0] in range(8) or got[21][0] == 20
    assert 30 not in got and got[31] == [32] and got[32] == [31]
    assert not {40, 41, 42, 43, 44, 45, 46} & set(got)


def test_long_files_are_split(spark, monkeypatch):
    monkeypatch.setattr(p5, "PART_ROWS", 16)
    monkeypatch.setattr(p5, "ASKING_ROWS", 25)
    rng = np.random.default_rng(4)
    x = (rng.normal(size=64) + 0.3 * rng.normal(size=(150, 64))).astype(np.float32)
    vectors = frame(spark, [(i, "s", v.tolist()) for i, v in enumerate(x)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -2)
    got = {}
    for r in p5.neighbours(vectors, pivots=4, prefix=4, posts=2, rerank=1000).collect():
        got.setdefault(r["vec_id"], set()).add(r["neighbour"])
    assert np.mean([len(got[q] & set(np.argsort(-c[q])[:5].tolist())) / 5 for q in range(150)]) > 0.9


def test_every_vector_of_a_long_file_is_compared(spark):
    """Every vector is in every file, so the answers must be those of brute force, also far above 256 vectors a file."""
    rng = np.random.default_rng(6)
    x = (rng.normal(size=64) + 0.3 * rng.normal(size=(1500, 64))).astype(np.float32)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -2)
    got = {}
    for r in p5.neighbours(frame(spark, [(i, "s", v.tolist()) for i, v in enumerate(x)]), pivots=4, prefix=4, posts=4).collect():
        got.setdefault(r["vec_id"], set()).add(r["neighbour"])
    assert all(got[q] == set(np.argsort(-c[q])[:5].tolist()) for q in range(1500))


def test_footrule_gain_is_the_footrule_distance():
    rng = np.random.default_rng(5)
    a, b = (np.array([rng.permutation(20)[:6] for _ in range(7)], np.int32) for _ in range(2))

    def weights(order):
        w = np.zeros(20, int)
        w[order] = np.arange(6, 0, -1)
        return w

    gain = p5.footrule_gain(a, b)
    for i in range(7):
        for j in range(7):
            assert np.abs(weights(a[i]) - weights(b[j])).sum() == 2 * 21 - 2 * gain[i, j]


def test_empty(spark):
    empty = frame(spark, []).limit(0)
    assert p5.neighbour_pairs(empty).count() == 0
    assert p5.neighbour_pairs(frame(spark, [(1, "a", None)])).count() == 0
    assert F is not None
