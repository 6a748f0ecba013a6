"""Whitening of embeddings by matrix-free block subspace iteration.

No covariance matrix is made: each Spark pass gives X'(XQ) of the centred rows
for one block Q of directions. The block is added to the subspace, QR keeps
that orthonormal, Rayleigh-Ritz on it gives the components, and the next
block are the residuals. Keeping earlier blocks is what makes flat spectra,
as of embeddings spread evenly, end after a few passes: a subspace of fixed
width would shrink errors by two per cent a pass there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An entry c becomes floor(STEPS * c) + SHIFT.
STEPS, SHIFT = 1024, 100000
#: Entries of this size or more are no fit entries; sums of smaller ones stay whole in a batch.
MOST_ENTRY = 2.0**34
#: Directions of a pass.
BLOCK = 32
#: A component is certified if its residual is at most so large against the largest eigenvalue.
RESIDUAL = 1e-12
#: Smaller eigenvalues, against the largest, are no components.
LEAST_VALUE = 1e-10


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` found: rows n, whole sums of their entries, components as columns, their eigenvalues, and checks.

    residuals are those of the components against the largest eigenvalue;
    passes counts the products that were made.
    """

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int
    identity_error: float = 0.0

    @property
    def whole_mean(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """What the sums exceed n whole means by."""
        return np.array([s % self.n for s in self.sums], np.int64)

    @property
    def scaled(self) -> np.ndarray:
        """Components over the roots of their eigenvalues."""
        return self.components / np.sqrt(self.values)


def _entries(column: pa.Array, length: int | None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: (rows, their entries as whole numbers) of the fit vectors; of the given length alone, if any."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    found = {}
    for d in np.unique(sizes[sizes > 0]) if length is None else [length]:
        at = np.flatnonzero(sizes == d)
        own = values.reshape(-1, d) if len(at) == len(sizes) and len(at) else values[starts[at][:, None] + np.arange(d)]
        fit = (np.abs(own) < MOST_ENTRY).all(axis=1)  # false for NaN and infinity
        if not fit.all():
            at, own = at[fit], own[fit]
        if len(at):
            found[int(d)] = at, np.floor(STEPS * own).astype(np.int64) + SHIFT
    return found


def _sum_rows(batches):
    """(vector) -> length, dim, rows and sum of entries, one row for each length and dimension of a task."""
    held: dict[int, tuple[int, list[int]]] = {}
    for batch in batches:
        for d, (at, x) in _entries(batch.column(0), None).items():
            n, sums = held.get(d, (0, [0] * d))
            held[d] = n + len(at), [a + int(b) for a, b in zip(sums, x.sum(axis=0), strict=True)]
    for d, (n, sums) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([str(s) for s in sums])], names=["length", "dim", "n", "total"])


def _centred(model: Whitening, x: np.ndarray) -> np.ndarray:
    return (x - model.whole_mean) - model.rest / model.n


def _product_rows(model: Whitening, block: np.ndarray):
    """(vector) -> a task's part of X'(XQ), a row for each dimension, and its sum of squares."""

    def run(batches):
        d, width = block.shape
        total = np.zeros((d, width + 1))
        for batch in batches:
            for _, x in _entries(batch.column(0), d).values():
                y = _centred(model, x)
                total[:, :width] += y.T @ (y @ block)
                total[:, width] += (y * y).sum(axis=0)
        yield _matrix_rows(total)

    return run


def _identity_rows(model: Whitening):
    """(vector) -> a task's part of the products of whitened rows, and their sums."""

    def run(batches):
        k = len(model.values)
        total = np.zeros((k, k + 1))
        for batch in batches:
            for _, x in _entries(batch.column(0), len(model.sums)).values():
                w = _centred(model, x) @ model.scaled
                total[:, :k] += w.T @ w
                total[:, k] += w.sum(axis=0)
        yield _matrix_rows(total)

    return run


def _matrix_rows(total: np.ndarray) -> pa.RecordBatch:
    names = ["dim", *(f"c{j}" for j in range(total.shape[1]))]
    return pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *(pa.array(c) for c in total.T)], names=names)


def _gathered(vectors: DataFrame, task, width: int) -> np.ndarray:
    """The sum of the matrices that tasks make; as large as one of them, however many tasks there are."""
    names = [f"c{j}" for j in range(width)]
    parts = vectors.mapInArrow(task, "dim int, " + ", ".join(f"{c} double" for c in names))
    rows = parts.groupBy("dim").agg(*[F.sum(c).alias(c) for c in names]).toPandas().sort_values("dim")
    return rows[names].to_numpy()


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    kind = df.schema[vector].dataType
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))):
        return df.select(F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    return df.select(F.col(f"`{vector}`").alias("vector"))


def fit(df: DataFrame, k: int = 8, vector: str = "embedding") -> Whitening | None:
    """The k leading components of all fit vectors of ``df``; None if there is none.

    A vector is fit if it is not null, has no null, non-finite or huge entry
    (MOST_ENTRY) and has the commonest length (of equally common ones the
    longest). Fewer than k components come out if fewer eigenvalues differ
    from zero. Equal rows count as often as they are there.
    """
    rows = _vectors(df, vector)
    # whole sums have more digits than a long where rows are very many
    cells = rows.mapInArrow(_sum_rows, "length int, dim int, n long, total string").groupBy("length", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(30,0)")).alias("total"))
    best = cells.where("dim = 0").orderBy(F.desc("n"), F.desc("length")).first()
    if best is None:
        return None
    d = best["length"]
    sums = tuple(int(r["total"]) for r in cells.where(F.col("length") == d).orderBy("dim").collect())
    model = Whitening(best["n"], sums, np.zeros((d, 0)), np.zeros(0), 0.0, np.zeros(0), 0)
    block = np.linalg.qr(np.random.default_rng(7).standard_normal((d, min(d, BLOCK))))[0]
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    passes = 0
    while True:
        made = _gathered(rows, _product_rows(model, block), block.shape[1] + 1) / model.n
        passes += 1
        basis, image = np.hstack([basis, block]), np.hstack([image, made[:, :-1]])
        trace = float(made[:, -1].sum())
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-values)
        values, turn = values[order], turn[:, order]
        ritz = basis @ turn
        gaps = image @ turn - ritz * values
        k_now = min(k, len(values))
        residuals = np.linalg.norm(gaps[:, :k_now], axis=0) / max(values[0], np.finfo(float).tiny)
        if basis.shape[1] >= d or (k_now == k and (residuals <= RESIDUAL).all()):
            break
        # residuals of the leading vectors, made orthogonal to the subspace twice, and of what is too short at random
        block = gaps[:, : min(BLOCK, d - basis.shape[1])]
        if block.shape[1] < min(BLOCK, d - basis.shape[1]) or np.linalg.norm(block, axis=0).min() <= 1e-14 * max(values[0], 1e-300):
            block = np.random.default_rng(7 + passes).standard_normal((d, min(BLOCK, d - basis.shape[1])))
        for _ in range(2):
            block = block / np.maximum(np.linalg.norm(block, axis=0), 1e-300)
            block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
    kept = np.flatnonzero(values[:k_now] > LEAST_VALUE * max(values[0], 0.0)) if values[0] > 0 else np.zeros(0, int)
    found = Whitening(model.n, sums, ritz[:, kept], values[kept], trace, residuals[kept], passes)
    error = 0.0
    if len(kept):
        w = _gathered(rows, _identity_rows(found), len(kept) + 1) / found.n
        means = w[:, -1]
        error = float(np.abs(w[:, :-1] - np.outer(means, means) - np.eye(len(kept))).max())
    return Whitening(found.n, sums, found.components, found.values, trace, found.residuals, passes, error)


def _whitened_rows(model: Whitening, at: int):
    """Rows with their columns -> those of fit vectors, with deviation and whitened."""

    def run(batches):
        d, scaled, n = len(model.sums), model.scaled, model.n
        for batch in batches:
            for rows, x in _entries(batch.column(at), d).values():
                off = x - model.whole_mean
                # n x - S; null where a long cannot hold the sum of its squares
                rough = ((off * float(n) - model.rest) ** 2).sum(axis=1)
                large = rough > 9e18
                exact = np.where(large[:, None], 0, off) * n - model.rest
                exact[large] = 0
                w = _centred(model, x) @ scaled
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, max(1, w.shape[1]), dtype=np.int32)[: len(rows) + 1] if w.shape[1] else np.zeros(len(rows) + 1, np.int32)), pa.array(w.ravel()))
                taken = [c.take(pa.array(rows)) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*taken, pa.array((exact * exact).sum(axis=1), mask=large), lists], names=[*batch.schema.names, "deviation", "whitened"])

    return run


def whiten(df: DataFrame, model: Whitening | None, vector: str = "embedding") -> DataFrame:
    """The rows of ``df`` with fit vectors, with deviation and whitened (one number for each component) appended.

    deviation is the sum over dimensions of (n x - S)^2, null where a long
    cannot hold it. Rows whose vector is not fit are left out; without a model
    none stays. Columns of ``df`` that share a result's name are replaced.
    """
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("deviation", "whitened")])
    schema = T.StructType([*kept.schema.fields, T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    kind = kept.schema[vector].dataType
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))):
        kept = kept.withColumn(vector, F.col(f"`{vector}`").cast("array<double>"))
        schema[vector].dataType = T.ArrayType(T.DoubleType())
    return kept.mapInArrow(_whitened_rows(model, kept.columns.index(vector)), schema)
