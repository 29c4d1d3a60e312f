import numpy as np

from llm_helpers import SF, read
from threadloom.llm import nn_descent
from threadloom.llm.queries import QUERIES


def brute(rows, every=20, k=20):
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], float)
    out = {}
    for q, v in rows:
        if q % every == 0:
            near = sorted(((-float(s), i) for i, s in zip(ids, x @ np.array(v, float)) if i != q))
            out[q] = [i for _, i in near[:k]]
    return out


def test_query_recall_and_scores(spark):
    rows = [(i, v) for i, v in read(f"select vec_id, embedding from '{SF}/embeddings.parquet'")]
    got, vectors, want = {}, dict(rows), brute(rows)
    for r in sorted(QUERIES["op8_nn_descent"](spark, SF).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(np.dot(np.array(vectors[r.query_id], float), np.array(vectors[r.vec_id], float)) - r.score) < 1e-12
        assert r["rank"] == len(got[r.query_id])
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_copies_ties_and_lengths(spark):
    """A third of the rows are one vector; norms differ, so the largest product is not the nearest direction."""
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=6).tolist() if i % 3 else [2.0, 1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(240)]
    rows = [(i, [x * (1 + i % 4) for x in v] if i % 3 else v) for i, v in rows]
    got = {}
    for x in nn_descent.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(x.query_id, {})[x["rank"]] = x.vec_id
    want = brute(rows)
    hit = sum(len(set(got[q].values()) & set(want[q])) for q in want)
    assert hit >= 0.95 * sum(map(len, want.values()))
    assert [got[0][k] for k in range(1, 21)] == want[0] or len(set(got[0].values()) & set(want[0])) >= 19


def test_very_long_vectors(spark):
    """A few very long vectors, and a few short ones, do not cost the others their neighbours."""
    r = np.random.default_rng(3)
    x = r.normal(size=(1600, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[[3, 7, 40]] *= [[1e4], [1e9], [1e4]]
    x[800:850] *= 1e-3
    rows = list(enumerate(x.tolist()))
    got, want = {}, brute(rows)
    for y in nn_descent.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(y.query_id, set()).add(y.vec_id)
    hit = [len(got[q] & set(want[q])) / 20 for q in want]
    assert sum(hit) >= 0.9 * len(want) and min(hit) >= 0.5


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0], "a"), (1, [0.5, 0.5], "a"), (1, [0.5, 0.5], "a"), (2, None, "a"), (3, [0.0, 0.0], "a"), (4, [float("nan"), 1.0], "a"),
        (5, [float("inf"), 1.0], "a"), (6, [None, 1.0], "a"), (None, [1.0, 1.0], "a"), (7, [1.0, 2.0, 3.0], "a"), (8, [], "a"), (20, [1.0, 0.0], "a"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nn_descent.nearest(df).collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 1, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 0.5)]
    assert nn_descent.nearest(df.limit(0)).count() == 0 and nn_descent.nearest(df.filter("vec_id = 0")).count() == 0
