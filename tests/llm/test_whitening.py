"""Whitening against plain numpy, and its edges."""

import numpy as np
import pytest

from threadloom.llm import whitening
from threadloom.llm.queries import QUERIES
from llm_helpers import SF, read


def test_scatter_is_exact():
    r = np.random.default_rng(1)
    for rows, dim, low, high in ((1, 3, 0, 2), (63, 5, -40, 40), (130, 4, 10**6 - 70, 10**6 + 70), (64, 2, 7, 8), (70, 3, -(2**50), 2**50)):
        x = r.integers(low, high, (rows, dim))
        sums, cross = whitening.scatter(x)
        wide = x.astype(object)
        assert list(sums) == list(wide.sum(axis=0)) and (cross == wide.T @ wide).all()


def test_query(spark):
    got = QUERIES["op13_bit_sliced_whitening"](spark, SF).toPandas()
    given = read(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'")
    x = np.floor(64 * np.array([v for _, v in given], dtype=np.float64)).astype(np.int64) + 1_000_000
    points = np.unique(x, axis=0)
    n, sums = len(points), points.sum(axis=0)
    centred = points - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    assert len(got) == 16 * len(given) and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    whitened = got.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in given]].to_numpy()
    want = (x - sums / n) @ vectors / np.sqrt(values)
    signs = np.sign((whitened * want).sum(axis=0))
    assert np.abs(whitened - want * signs).max() < 1e-6
    share = got.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(share, values / np.trace(centred.T @ centred / n), rtol=1e-9)
    deviation = got.groupby("vec_id")["deviation"].first()
    assert all(deviation[i] == sum((n * v - sums) ** 2) for (i, _), v in zip(given, x))


ODD = "vec_id long, embedding array<double>, n string, dim string, x string"


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [
        (1, [1.0, 2.0]), (None, [1.0, 2.0]), (1, [1.0, 2.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [-inf, 1.0]), (7, [None, 1.0]),
        (8, [1.0, 2.0, 3.0]), (9, [1e30, 2.0]), (10, [-1e16, 2e10]), (11, [5.0, 7.0]), (12, [9.0]), (13, [9.0]),
    ]
    df = spark.createDataFrame([(*v, "a", "b", "c") for v in vectors], ODD)
    rows = whitening.whiten(df).collect()
    assert sorted((r["vec_id"] is not None, r["vec_id"] or 0, r["component"]) for r in rows) == sorted(
        (i is not None, i or 0, c) for i, d in ((1, 2), (1, 2), (None, 2), (8, 3), (10, 2), (11, 2), (12, 1), (13, 1)) for c in range(1, d + 1)
    )
    by_id = {(r["vec_id"], r["component"]): r for r in rows}
    # Equal vectors count once; a single vector has no variance.
    assert by_id[None, 1]["n"] == 3 and by_id[8, 1]["n"] == 1 and by_id[13, 1]["n"] == 1
    assert by_id[8, 2]["whitened"] is None and by_id[8, 2]["explained"] is None and by_id[8, 2]["identity_error"] is None
    assert by_id[8, 1]["deviation"] == 0 and by_id[10, 1]["deviation"] is None
    assert whitening.whiten(df.limit(0)).collect() == []


def test_exact_beyond_64_bits(spark):
    vectors = [(i, [float(i * 2**40), float(-i), 0.25 * i * i]) for i in range(200)]
    rows = whitening.whiten(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in vectors]
    n, sums = 200, [sum(r[j] for r in x) for j in range(3)]
    for r in rows:
        if r["component"] == 1:
            exact = sum((n * v - s) ** 2 for v, s in zip(x[r["vec_id"]], sums))
            assert r["deviation"] == (exact if exact < 2**63 else None)
    assert rows[0]["identity_error"] < 1e-6


def test_models_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MODEL_BYTES", 10)
    with pytest.raises(ValueError, match="models"):
        whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>"))
