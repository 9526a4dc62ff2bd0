"""Operator 12: whitening of embeddings by QDWH spectral divide and conquer.

Entries become whole numbers, so their sums per dimension are exact. A second pass centres every row and sums outer products per
task; the parts are added by matrix row, and only one d x d matrix reaches the driver. There its principal components are found
by spectral divide and conquer: the polar factor of the shifted covariance (QR-based dynamically weighted Halley iterations) is
+1 and -1 on the spaces of the eigenvalues above and below the shift, so half its sum with the identity is a spectral projector;
its range and the rest are invariant, and each is split again until single directions, or directions with equal eigenvalues, are
left. Parts below the wanted components are not split. The components are sent to all tasks (at most ``COMPONENTS`` rows of d
numbers) and every row is projected once. The covariance of the result is measured over the written rows.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries take no part, nor do rows whose length is not
the commonest one (of equally common ones the longest); entries beyond 2**62 in whole units are held there; there are as many
components as dimensions where these are fewer; a component whose eigenvalue is zero to rounding has no spread: its whitened value
is null and the identity error leaves it out; a deviation that no long holds is null; rows repeated, or without id, are rows like
others; texts play no part; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import BOOK, read
from almanac.storage import written

COMPONENTS = 8
UNITS = 1024
OFFSET = 100_000
MOST = 1 << 62
BATCH = 4096


def polar(a: np.ndarray, most: int = 20) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QR-based dynamically weighted Halley iterations."""
    n = len(a)
    eps = np.finfo(np.float64).eps
    x = a / np.linalg.norm(a)
    low = eps  # lower bound of the smallest singular value; too small a bound costs an iteration or two
    for _ in range(most):
        d = np.cbrt(4 * (1 - low**2) / low**4) if low < 1 else 0.0
        root = np.sqrt(1 + d)
        p = root + np.sqrt(max(8 - 4 * d + 8 * (2 - low**2) / (low**2 * root), 0.0)) / 2
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        basis = np.linalg.qr(np.vstack([np.sqrt(r) * x, np.eye(n)]))[0]
        now = q / r * x + (p - q / r) / np.sqrt(r) * basis[:n] @ basis[n:].T
        now = (now + now.T) / 2
        moved = np.linalg.norm(now - x)
        x, low = now, min(1.0, low * (p + q * low**2) / (1 + r * low**2))
        if moved < np.cbrt(eps) and 1 - low < 10 * eps:  # the iteration is cubic
            break
    return x


def invariant_pair(a: np.ndarray, shift: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the spaces of eigenvalues above and below ``shift``; None if the shift lies on an eigenvalue."""
    n = len(a)
    factor = polar(a - shift * np.eye(n))
    if np.linalg.norm(factor @ factor - np.eye(n)) > 1e-10 * n:
        return None
    above = (factor + np.eye(n)) / 2
    k = int(round(np.trace(above)))
    bases = []
    for projector, size in ((above, k), (np.eye(n) - above, n - k)):
        basis = np.zeros((n, size))
        if size:
            basis = np.linalg.qr(projector @ rng.standard_normal((n, size)))[0]
            basis = np.linalg.qr(projector @ basis)[0]
        bases.append(basis)
    both = np.linalg.qr(np.hstack(bases))[0]
    return both[:, :k], both[:, k:]


def principal(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors in columns. The entry of largest size
    in a vector is positive."""
    a = (a + a.T) / 2
    scale = np.linalg.norm(a)
    rng = np.random.default_rng(len(a))
    found: list[np.ndarray] = []

    def split(basis: np.ndarray) -> None:
        """Add the directions of an invariant space, those of the largest eigenvalues first."""
        if len(found) >= wanted or not basis.shape[1]:
            return
        inner = basis.T @ a @ basis
        inner = (inner + inner.T) / 2
        n = len(inner)
        centre = np.trace(inner) / n
        if n == 1 or np.linalg.norm(inner - centre * np.eye(n)) <= 4 * n * np.finfo(np.float64).eps * scale:
            found.extend(basis.T)
            return
        # The mean of the eigenvalues lies between them; the median of the diagonal often parts them more evenly.
        diagonal = np.sort(np.diag(inner))
        spread = np.linalg.norm(inner - centre * np.eye(n)) / n
        for shift in (float(np.median(diagonal)), centre, *(centre + spread * s for s in (0.01, -0.01, 0.1, -0.1))):
            pair = invariant_pair(inner, shift, rng)
            if pair is not None and pair[0].shape[1] and pair[1].shape[1]:
                split(basis @ pair[0])
                split(basis @ pair[1])
                return
        found.extend(basis.T)  # no shift parts the space: its eigenvalues are equal to rounding

    if scale:
        split(np.eye(len(a)))
    else:
        found.extend(np.eye(len(a)))
    vectors = np.array(found).T
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")[:wanted]
    vectors, values = vectors[:, order], values[order]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * sign


def whole(entries: np.ndarray) -> np.ndarray:
    """Entries in whole units, shifted."""
    return np.clip(np.floor(UNITS * entries), -MOST, MOST).astype(np.int64) + OFFSET


@dataclass
class Whitening:
    """What was fitted: number of rows, exact sums per dimension, eigenvalues and components in columns, trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def spread(self) -> np.ndarray:
        """Which components have an eigenvalue above rounding."""
        return self.values > len(self.sums) * np.finfo(np.float64).eps * self.trace


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x - S/n as double, n*x - S modulo 2**64, the same as double). The second is exact where the third is below 2**63."""
    mean = np.array([s / n for s in sums])
    wrapped = np.array([(s + (1 << 63)) % (1 << 64) - (1 << 63) for s in sums], np.int64)
    with np.errstate(over="ignore"):
        times = np.int64(n) * x - wrapped
    rough = (x - mean) * n
    return np.where(np.abs(rough) < 2.0**62, times / n, x - mean), times, rough


def usable(rows: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The rows that take part, with their vector as ``entries`` of doubles."""
    entries = F.col(vector_col).cast("array<double>")
    sound = F.forall(entries, lambda e: F.coalesce((F.abs(e) < float("inf")) & ~F.isnan(e), F.lit(False)))
    kept = rows.filter(F.coalesce((F.size(entries) > 0) & sound, F.lit(False))).withColumn("entries", entries)
    common = kept.groupBy(F.size("entries").alias("d")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("d")).first()
    return kept.filter(F.size("entries") == (common["d"] if common else 0))


def _matrices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            held = batch.column(column).slice(at, BATCH)
            yield held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)


def _sums(entries: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sum of every dimension. Tasks send high and low halves, which add without overflow."""

    def add(batches):
        n, high, low = 0, 0, 0
        for m in _matrices(batches, 0):
            x = whole(m)
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            carry = low >> 32
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(high))), pa.array(np.full(len(high), n)), pa.array(high + carry), pa.array(low & 0xFFFFFFFF)],
                names=["i", "n", "high", "low"])

    parts = entries.mapInArrow(add, "i long, n long, high long, low long").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    found = sorted(parts.collect())  # one row per dimension
    return (found[0]["n"] if found else 0), [(r["high"] << 32) + r["low"] for r in found]


def _covariance(entries: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of the whole numbers, centred before multiplying."""

    def scatter(batches):
        total = 0.0
        for m in _matrices(batches, 0):
            gap = centred(whole(m), n, sums)[0]
            total = total + gap.T @ gap
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array([row.tobytes() for row in total])], names=["i", "cells"])

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(c, np.float64) for c in pdf["cells"]], axis=0)
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "cells": [total.tobytes()]})

    parts = entries.mapInArrow(scatter, "i long, cells binary").groupBy("i").applyInPandas(together, "i long, cells binary")
    rows = {r["i"]: np.frombuffer(r["cells"], np.float64) for r in parts.collect()}  # one row per dimension
    return np.array([rows[i] for i in range(len(sums))]) / n


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the usable rows; None if there is none."""
    entries = rows.select("entries")
    n, sums = _sums(entries)
    if not n:
        return None
    covariance = _covariance(entries, n, sums)
    values, vectors = principal(covariance, components)
    return Whitening(n, sums, values, vectors, float(np.trace(covariance)))


def whitened(rows: DataFrame, model: Whitening, id_col: str = "vec_id") -> DataFrame:
    """(id, deviation, whitened) of every usable row: the exact sum of squares of n*x - S, and one value per component."""
    spread = model.spread()
    scale = np.where(spread, 1 / np.sqrt(np.where(spread, model.values, 1.0)), np.nan)
    weights = model.vectors * scale

    def project(batches):
        for batch in batches:
            for at, m in zip(range(0, batch.num_rows, BATCH), _matrices(iter([batch]), 1)):
                gap, times, rough = centred(whole(m), model.n, model.sums)
                with np.errstate(over="ignore"):
                    exact = (times * times).sum(axis=1)
                size = (rough * rough).sum(axis=1)
                values = gap @ weights
                flat = pa.array(values.ravel(), mask=np.isnan(values.ravel()))
                steps = pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, BATCH), pa.array(exact, mask=size >= 2.0**63 * (1 - 1e-12)), pa.ListArray.from_arrays(steps, flat)],
                    names=["id", "deviation", "whitened"])

    return rows.select(F.col(id_col).cast("long"), "entries").mapInArrow(project, "id long, deviation long, whitened array<double>")


def identity_error(rows: DataFrame, spread: list[bool]) -> float | None:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity, over the components with spread."""
    kept = [i for i, s in enumerate(spread) if s]
    if not kept:
        return None
    value = {i: F.col("whitened")[i] for i in kept}
    means = rows.agg(*[F.avg(value[i]).alias(f"m{i}") for i in kept]).first()
    pairs = [(i, j) for i in kept for j in kept if i <= j]
    cells = rows.agg(*[F.avg((value[i] - means[f"m{i}"]) * (value[j] - means[f"m{j}"])).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(cells[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


@BOOK.add("op12_embedding_whitening")
def op12_embedding_whitening(spark, sf_dir):
    rows = usable(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    model = fit(rows)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], schema)
    done = written(whitened(rows, model), "whitened")
    error = identity_error(done, model.spread().tolist())
    explained = F.array(*[F.lit(float(e / model.trace) if model.trace else None).cast("double") for e in model.values])
    return done.select(F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))
