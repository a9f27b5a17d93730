import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sealframe.llm import ann


def brute(rows, k=5):
    """(query_id, rank, vec_id) by plain loops; rows: (id, vector), an id may repeat."""
    out = []
    for a, (q, x) in enumerate(rows):
        if q % 50 == 0:
            s = [(-round(float(np.dot(x, y)) / (np.linalg.norm(x) * np.linalg.norm(y)), 12), i) for b, (i, y) in enumerate(rows) if a != b and len(y) == len(x)]
            out += [(q, r + 1, i) for r, (_, i) in enumerate(sorted(s)[:k])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>")


def found(spark, rows):
    return sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(table(spark, rows), F.col("vec_id") % 50 == 0).collect())


def test_probes_go_by_probability():
    h, spread = np.array([0.3, 2.9, -1.2]), 0.4
    cells = ann.probe_cells(h, spread, 0.9, 1000)

    def p(c):
        return math.prod(0.5 * (math.erf((j + 1 - x) / spread / 2**0.5) - math.erf((j - x) / spread / 2**0.5)) for x, j in zip(h, c))

    got = [p(c) for c in cells]
    assert cells[0] == (0, 2, -2) and len(set(cells)) == len(cells) and all(a >= b - 1e-12 for a, b in zip(got, got[1:]))
    assert sum(got) >= 0.9 > sum(got[:-1])
    every = sorted((p((a, b, c)) for a in range(-4, 6) for b in range(-2, 8) for c in range(-6, 5)), reverse=True)
    assert np.allclose(got, every[: len(got)])
    assert ann.probe_cells(h, 3.0, 0.99, 20) is None


@pytest.mark.parametrize("n", [1, 2, 3, 6, 10])
def test_small_tables_equal_brute_force(spark, n):
    g = np.random.default_rng(n)
    x = g.normal(size=(n, 6))
    rows = [(25 * i, v) for i, v in enumerate(x)] + [(1, -x[0])]
    assert found(spark, rows) == brute(rows)


def test_odd_vectors_ties_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 40)
    monkeypatch.setattr(ann, "GROUP_ROWS", 60)
    monkeypatch.setattr(ann, "GROUP_QUERIES", 2)
    monkeypatch.setattr(ann, "SUCCESS", 0.9999)
    g = np.random.default_rng(3)
    x = g.normal(size=(300, 8))
    x[40:60] = x[3]
    x[200:230] = 2 * x[100]
    rows = [(int(i), v) for i, v in enumerate(x)] + [(50, x[7]), *[(350, x[9])] * 7, (77, x[9])]
    odd = [(900, None), (901, [0.0] * 8), (902, [math.nan] * 8), (903, [1.0] * 7 + [math.inf]), (None, [1.0] * 8), (905, [])]
    short = [(904, np.array([1.0, 2.0])), (950, np.array([2.0, 4.1]))]
    df = table(spark, rows + odd + short)
    got = ann.search(df.withColumn("score", F.lit(0)).withColumn("ROW", F.lit(0)).withColumn("vec", F.lit(0)), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == brute(rows + short)
    vectors = {}
    for i, v in rows + short:
        vectors.setdefault(i, []).append(np.asarray(v))
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert all(any(len(a) == len(b) and abs(cos(a, b) - r.score) < 1e-12 for a in vectors[r.query_id] for b in vectors[r.vec_id]) for r in got)


def recall(spark, x):
    got = {(q, v) for q, _, v in found(spark, list(enumerate(x)))}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[::50] @ u.T
    s[np.arange(len(s)), np.arange(0, len(x), 50)] = -9
    want = {(50 * q, int(v)) for q, row in enumerate(np.argsort(-s, axis=1)[:, :5]) for v in row}
    return len(got & want) / len(want)


def test_recall_on_random_vectors(spark):
    assert recall(spark, np.random.default_rng(5).normal(size=(4000, 64))) >= 0.9


def test_clustered_vectors_need_few_cells(spark):
    g = np.random.default_rng(6)
    x = np.repeat(g.normal(size=(100, 32)), 60, axis=0) + 0.1 * g.normal(size=(6000, 32))
    assert recall(spark, x) >= 0.9
    assert ann.visited_share(table(spark, list(enumerate(x))), F.col("vec_id") % 50 == 0) < 0.35


def test_empty(spark):
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0
