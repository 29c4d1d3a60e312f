"""Embedding whitening with a bit-sliced scatter.

Entries become whole numbers.  Per block of rows every dimension is shifted to
start at 0 and its bit planes are packed across the rows into 64-bit words; a
cross-product of two dimensions is then the sum of the popcounts of ANDed planes,
weighted by powers of two.  So scatter and sums are exact, whatever the order in
which tasks finish.  They are centred as integers, and only the centred
covariance becomes floating point, for the eigenvectors.

A task keeps one block of rows and one matrix; what it sends on does not depend
on its number of rows.  Vectors of different lengths lie in different spaces: each
length is fitted and whitened by itself.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from threadloom.llm.common import Scratch

# The workers get this module as code, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Entries are counted in steps of 1/SCALE from -OFFSET/SCALE.
SCALE, OFFSET = 64, 1_000_000
#: Rows whose planes are packed at once.
BLOCK_ROWS = 8192
#: Components that are kept.
COMPONENTS = 16
#: An eigenvalue below this share of the largest one is taken for zero: nothing varies along it.
ZERO_SHARE = 1e-12
#: Most bytes of all fitted models together: a model has ``(components + 1) * length`` numbers.
MODEL_BYTES = 64 << 20
#: Sums are sent as two decimals of at most this many digits below the cut, so that they add up exactly in Spark.
_CUT = 10**20


@dataclass(frozen=True)
class Model:
    """Of the vectors of one length: count, sums per dimension, eigenvalues, their unit eigenvectors as columns, trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def whiten(self, x: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        """Squared deviation and whitened components of each row of ``x``; a component along which nothing varies is NaN."""
        largest = max(max(map(abs, self.sums), default=0), self.n * int(np.abs(x).max(initial=0)))
        wide = largest >= 2**62
        apart = (x.astype(object) if wide else x) * self.n - np.array(self.sums, dtype=object if wide else np.int64)
        top = int(np.abs(apart).max(initial=0))
        squares = apart if top * top * max(1, x.shape[1]) < 2**63 else apart.astype(object)
        deviation = [v if v < 2**63 else None for v in map(int, (squares * squares).sum(axis=1))]
        centred = (apart / self.n).astype(np.float64)
        spread = np.where(self.values > ZERO_SHARE * max(self.values.max(initial=0), 0), np.sqrt(np.maximum(self.values, 0)), np.nan)
        return deviation, (centred @ self.vectors) / spread


def counted(entry: Column) -> Column:
    return F.floor(entry.cast("double") * SCALE) + OFFSET


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, dim, x``: the vectors in whole numbers, without null ones and those with entries that are no finite number.

    An entry beyond 2^61 steps has no whole number of 64 bits; it counts as not finite.
    """
    e = F.col(embedding)
    # NaN is above every number in Spark, so both ends of the range leave it out.
    fits = F.forall(e, lambda c: F.coalesce(F.abs(c.cast("double")) < 2.0**61 / SCALE, F.lit(False)))
    return vectors.filter(e.isNotNull() & fits).select(
        F.col(vec_id).alias("vec_id"), F.size(e).alias("dim"), F.transform(e, counted).alias("x")
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums per dimension and cross-products of the rows of ``x`` (Python integers), by bit planes."""
    rows, dim = x.shape
    low = x.min(axis=0)
    y = (x - low).astype(np.uint64)
    bits = int(y.max(initial=0)).bit_length()
    width = -(-rows // 64)
    planes = np.zeros((bits, dim, width * 8), dtype=np.uint8)
    for p in range(bits):
        packed = np.packbits(((y >> np.uint64(p)) & np.uint64(1)).astype(np.uint8).T, axis=1)
        planes[p, :, : packed.shape[1]] = packed
    words = planes.reshape(bits * dim, width * 8).view(np.uint64)
    counts = np.zeros((bits * dim, bits * dim), dtype=np.int64)
    for i in range(bits * dim):
        counts[i, i:] = np.bitwise_count(words[i:] & words[i]).sum(axis=1, dtype=np.int64)
    counts = np.triu(counts) + np.triu(counts, 1).T
    # Weights up to 2^(2 bits): plain 64-bit sums where they fit, Python integers otherwise.
    kind = np.int64 if 2 * bits + int(rows).bit_length() < 62 else object
    weight = np.array([1 << p for p in range(bits)], dtype=kind)
    by_plane = counts.reshape(bits, dim, bits, dim).astype(kind)
    cross = np.zeros((dim, dim), dtype=object)
    for p in range(bits):
        for q in range(bits):
            cross += (by_plane[p, :, q, :] * (weight[p] * weight[q])).astype(object)
    sums = np.zeros(dim, dtype=object)
    for p in range(bits):
        sums += (np.diagonal(counts).reshape(bits, dim)[p].astype(kind) * weight[p]).astype(object)
    # Undo the shift: (y + l)(y' + l') summed over the rows.
    m = low.astype(object)
    cross = cross + np.outer(m, sums) + np.outer(sums, m) + np.outer(m, m) * rows
    return sums + m * rows, cross


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """The vectors of a task in blocks of one length."""
    held: dict[int, list[np.ndarray]] = {}
    size: dict[int, int] = {}
    total = 0
    for batch in batches:
        dims = batch.column(0).to_numpy(zero_copy_only=False)
        for dim in map(int, np.unique(dims)):
            if dim == 0:
                yield 0, np.zeros((int((dims == 0).sum()), 0), dtype=np.int64)
                continue
            x = _matrix(batch.column(1).filter(pa.array(dims == dim)), dim)
            held.setdefault(dim, []).append(x)
            size[dim] = size.get(dim, 0) + len(x)
            total += len(x)
            if size[dim] >= BLOCK_ROWS:
                yield dim, np.concatenate(held.pop(dim))
                total -= size.pop(dim)
        if total >= 4 * BLOCK_ROWS:  # many lengths: none fills a block, all go on together
            for dim in list(held):
                yield dim, np.concatenate(held.pop(dim))
            size, total = {}, 0
    for dim, parts in held.items():
        yield dim, np.concatenate(parts)


def _partial_scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``dim, a, b, n, high, low`` per pair of dimensions; ``b`` is -1 for the sum of dimension ``a``."""
    totals: dict[int, tuple] = {}
    for dim, x in _blocks(batches):
        sums, cross = scatter(x) if dim else (np.zeros(0, dtype=object), np.zeros((0, 0), dtype=object))
        n, s, c = totals.get(dim, (0, 0, 0))
        totals[dim] = (n + len(x), s + sums, c + cross)
    for dim, (n, sums, cross) in totals.items():
        a, b = np.triu_indices(dim)
        firsts, seconds = [*range(dim), *a.tolist()], [-1] * dim + b.tolist()
        found = [*sums, *cross[a, b]] if dim else []
        if not dim:
            firsts, seconds, found = [-1], [-1], [0]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([dim] * len(found), pa.int32()), pa.array(firsts, pa.int32()), pa.array(seconds, pa.int32()),
                pa.array([n] * len(found), pa.int64()),
                pa.array([str(v // _CUT) for v in found]), pa.array([str(v % _CUT) for v in found]),
            ],
            ["dim", "a", "b", "n", "high", "low"],
        )


def _fit_one(parts: pd.DataFrame) -> pd.DataFrame:
    """Model of one length from its exact sums; ``parts`` has one row per pair of dimensions."""
    dim, n = int(parts["dim"].iloc[0]), int(parts["n"].iloc[0])
    value = [int(h) * _CUT + int(w) for h, w in zip(parts["high"], parts["low"])]
    sums, cross = [0] * dim, {}
    for a, b, v in zip(parts["a"].tolist(), parts["b"].tolist(), value):
        if a < 0:
            continue
        if b < 0:
            sums[a] = v
        else:
            cross[a, b] = v
    covariance = np.zeros((dim, dim))
    for (a, b), v in cross.items():
        # An integer over an integer: centred exactly, rounded once.
        covariance[a, b] = covariance[b, a] = (n * v - sums[a] * sums[b]) / (n * n)
    values, vectors = np.linalg.eigh(covariance) if dim else (np.zeros(0), np.zeros((0, 0)))
    top = np.argsort(-values, kind="stable")[:COMPONENTS]
    return pd.DataFrame(
        {
            "dim": [dim], "n": [n], "sums": [[str(s) for s in sums]], "values": [values[top].tolist()],
            "vectors": [vectors[:, top].T.ravel().tolist()], "trace": [float(np.trace(covariance))],
        }
    )


def fit(points: DataFrame) -> DataFrame:
    """``dim, n, sums, values, vectors, trace``: a model per length of vectors ``dim, x``."""
    parts = points.select("dim", "x").mapInArrow(_partial_scatter, "dim int, a int, b int, n long, high string, low string")
    added = parts.groupBy("dim", "a", "b").agg(
        F.sum("n").alias("n"),
        *(F.sum(F.col(c).cast("decimal(38,0)")).cast("string").alias(c) for c in ("high", "low")),
    )
    # A group is the upper half of one matrix, whatever the number of rows.
    return added.groupBy("dim").applyInPandas(
        _fit_one, "dim int, n long, sums array<string>, values array<double>, vectors array<double>, trace double"
    )


def collected(models: DataFrame) -> dict[int, Model]:
    """The models on the driver: some kilobytes for each length of vectors, checked."""
    held = models.agg(F.sum((F.lit(2) + F.size("values")) * F.col("dim") * 8)).first()[0] or 0
    if held > MODEL_BYTES:
        raise ValueError(f"models of all lengths take {held} bytes, at most {MODEL_BYTES} are sent to the workers")
    return {
        r["dim"]: Model(
            r["n"], [int(s) for s in r["sums"]], np.array(r["values"]), np.array(r["vectors"]).reshape(len(r["values"]), r["dim"]).T, r["trace"]
        )
        for r in models.collect()
    }


def _identity_parts(models: dict[int, Model]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for dim, x in _blocks(batches):
            _, w = models[dim].whiten(x)
            held = totals.setdefault(dim, [0.0, 0.0])
            held[0] = held[0] + w.sum(axis=0)
            held[1] = held[1] + w.T @ w
        for dim, (sums, products) in totals.items():
            k = len(sums)
            a, b = np.meshgrid(range(k), range(k), indexing="ij")
            firsts, seconds = [*range(k), *a.ravel().tolist()], [-1] * k + b.ravel().tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([dim] * len(firsts), pa.int32()), pa.array(firsts, pa.int32()), pa.array(seconds, pa.int32()),
                    pa.array([*np.asarray(sums).tolist(), *np.asarray(products).ravel().tolist()], pa.float64()),
                ],
                ["dim", "a", "b", "v"],
            )

    return run


def identity_errors(points: DataFrame, models: dict[int, Model]) -> dict[int, float | None]:
    """Per length the largest absolute entry of (covariance of the whitened fit list - identity); None without a component."""
    parts = points.select("dim", "x").mapInArrow(_identity_parts(models), "dim int, a int, b int, v double")
    found: dict[int, dict] = {}
    # At most COMPONENTS * (COMPONENTS + 1) rows for each length.
    for r in parts.groupBy("dim", "a", "b").agg(F.sum("v").alias("v")).collect():
        found.setdefault(r["dim"], {})[r["a"], r["b"]] = r["v"]
    errors = {}
    for dim, model in models.items():
        got, k = found.get(dim, {}), len(model.values)
        mean = [got[a, -1] / model.n for a in range(k)]
        off = [abs(got[a, b] / model.n - mean[a] * mean[b] - (a == b)) for a in range(k) for b in range(k)]
        errors[dim] = max((v for v in off if not np.isnan(v)), default=None)
    return errors


def _whitener(models: dict[int, Model], errors: dict[int, float | None], kind: pa.DataType):
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kinds = [kind, pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

    def rows(ids: pa.Array, dim: int, x: np.ndarray) -> pa.RecordBatch:
        model = models[dim]
        k = len(model.values)
        deviation, w = model.whiten(x)
        at = np.repeat(np.arange(len(x)), k)
        share = [float(v) / model.trace if model.trace > 0 else None for v in model.values]
        columns = [
            ids.take(pa.array(at)), np.tile(np.arange(1, k + 1), len(x)), [model.n] * len(at), pa.array(deviation, pa.int64()).take(pa.array(at)),
            pa.array(w.ravel(), from_pandas=True), share * len(x), [errors[dim]] * len(at),
        ]
        return pa.RecordBatch.from_arrays(
            [c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds)], names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            for dim in map(int, np.unique(dims)):
                if dim:
                    same = pa.array(dims == dim)
                    yield rows(batch.column(0).filter(same), dim, _matrix(batch.column(2).filter(same), dim))

    return run


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per vector and component.

    Vectors that are null or hold null or non-finite entries have no rows.  Equal
    whole-number vectors count once in the fit (``n``), but each row has its own
    result, rows without an id or with a repeated one included.  There are as many
    components as dimensions, at most ``COMPONENTS``; an empty vector has none.
    Where nothing varies along a component (one vector only, or fewer vectors than
    dimensions) ``whitened`` is null, and without any variance ``explained`` and
    ``identity_error`` are null too.  A ``deviation`` beyond 64 bits is null.
    Other columns are not read; an empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession, "whitening")
    rows = whole_vectors(vectors, vec_id, embedding)
    # Read twice, and the same list both times: written once.
    points = scratch.write(rows.select("dim", "x").distinct(), "points")
    models = collected(scratch.write(fit(points), "models"))
    errors = identity_errors(points, models)
    kind = rows.schema["vec_id"].dataType
    out = f"vec_id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = rows.mapInArrow(_whitener(models, errors, to_arrow_type(kind)), out)
    scratch.drop("points", "models")
    return found
