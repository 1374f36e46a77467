"""Whitening of embeddings from an exact integer scatter.

Entries become integers, ``floor(256 * c)``. Over the fit list (each different integer vector once) tasks subtract a shift,
any vector of the list, and sum entries and cross-products without rounding: matrix products of limbs so narrow that every
partial sum is exact in a double, added up as Python integers. So ``n * X'X - S S'`` is exact, whatever the shift, the order of
rows or the number of tasks; only then is it divided, once, into doubles and decomposed by ``eigh``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.llm._shared import drop_written, table, written

SCALE = 256
COMPONENTS = 4
#: Bits of a limb, and rows of a block: products of limbs, summed over a block, stay under 2^53.
LIMB, BLOCK = 20, 8192
#: Partial sums of so many tasks meet in one group of the first of two rounds.
FAN = 128


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x``: one row per row whose vector is whole, with its entries as integers.

    Left out are null vectors and vectors with null, infinite or NaN entries, or with entries whose integer is beyond 64 bits. Vectors of
    another length than most have (of two lengths equally frequent, the greater) are left out too. Null and repeated
    ids are given as they come; other columns are not read.
    """
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    limit = F.lit(float(2**63) / SCALE)
    whole = own.where("v IS NOT NULL").where(F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (c >= -limit) & (c < limit), F.lit(False))))
    most = whole.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    kept = whole.where(F.size("v") == (most.d if most else 0))
    return kept.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Integers as doubles of at most ``LIMB`` bits, the lowest first; all but the last are not negative."""
    out = []
    while x.size and max(-int(x.min()), int(x.max())) >= 1 << LIMB:
        out.append((x & ((1 << LIMB) - 1)).astype(float))
        x = x >> LIMB
    return [*out, x.astype(float)]


def cross_products(x: np.ndarray) -> np.ndarray:
    """The exact ``X'X`` of a block of at most ``BLOCK`` rows of 64-bit integers, as Python integers."""
    limbs = _limbs(x)
    out = np.zeros((x.shape[1],) * 2, object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            out += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return out


def _shifted(x: np.ndarray, shift: list[int]) -> np.ndarray:
    """``x - shift``; as Python integers where 64 bits might not hold it."""
    most = max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, shift))
    return x - np.array(shift, np.int64) if most < 1 << 63 else x.astype(object) - np.array(shift, object)


def _scatter_of_task(shift: list[int]):
    """A function for ``mapInArrow``: each task's sums, as rows ``i, sums``; row ``d`` has the entries' sums and the count."""
    d = len(shift)

    def run(batches):
        products, sums, n = np.zeros((d, d), object), np.zeros(d, object), 0
        for batch in batches:
            whole = _matrix(batch.column("x"), d)
            for at in range(0, len(whole), BLOCK):
                x = _shifted(whole[at : at + BLOCK], shift)
                products += cross_products(x) if x.dtype != object else x.T @ x
                sums += x.astype(object).sum(axis=0)
                n += len(x)
        if n:
            rows = [[str(v) for v in r] for r in (*products, [*sums, n])]
            yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array(rows, pa.list_(pa.string()))], ["i", "sums"])

    return run


def _added(part: pa.Table) -> pa.Table:
    """The rows of a group added up."""
    total = [sum(map(int, column)) for column in zip(*part.column("sums").to_pylist(), strict=True)]
    return pa.table({"i": pa.array([part.column("i")[0].as_py()], pa.int32()), "sums": pa.array([[str(v) for v in total]], pa.list_(pa.string()))})


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: count and exact sums of the fit list, axes with their eigenvalues, and the trace. All are small."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, exact."""
        most = max(abs(int(x.min())), abs(int(x.max()))) * self.n + max(map(abs, self.sums)) if x.size else 0
        kind = np.int64 if most < 1 << 63 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def project(self, deviations: np.ndarray) -> np.ndarray:
        """Rows on the axes, over the root of their eigenvalues; zero for an axis without spread."""
        roots = np.sqrt(self.values)
        return ((deviations / self.n).astype(float) @ self.axes) / np.where(roots > 0, roots, np.inf)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table of different vectors ``x`` of one length; None for no vectors or vectors without entries.

    The driver gets one matrix of the vectors' length, whatever their number. Eigenvalues that rounding cannot tell from zero
    count as zero.
    """
    head = vectors.select("x").first()
    if head is None or not head.x:
        return None
    d, shift = len(head.x), list(head.x)
    rows = vectors.select("x").mapInArrow(_scatter_of_task(shift), "i int, sums array<string>").withColumn("part", F.floor(F.spark_partition_id() / FAN))
    for keys in (["i", "part"], ["i"]):
        rows = rows.groupBy(*keys).applyInArrow(_added, "i int, sums array<string>")
        rows = rows.withColumn("part", F.lit(0)) if keys != ["i"] else rows
    by = {r.i: list(map(int, r.sums)) for r in rows.collect()}
    *s, n = by[d]
    scatter = [[n * by[i][j] - s[i] * s[j] for j in range(d)] for i in range(d)]
    covariance = np.array([[v / (n * n) for v in r] for r in scatter])
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    values, axes = values[order], axes[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    values = np.where(values > d * np.finfo(float).eps * max(values[0], 0.0), values, 0.0)
    return Whitening(n, [a + n * c for a, c in zip(s, shift, strict=True)], axes, values, sum(scatter[i][i] for i in range(d)) / (n * n))


def project(vectors: DataFrame, model: Whitening) -> DataFrame:
    """``vec_id, x`` to ``vec_id, deviation, deviation_exact, whitened``.

    ``deviation_exact`` is the sum over the dimensions of ``(n * x - S)^2`` in digits; ``deviation`` is it as a long, null
    where 64 bits do not hold it. ``whitened`` has a double for each component.
    """
    d = len(model.sums)

    def run(batches):
        for batch in batches:
            ids, whole = batch.column("vec_id"), _matrix(batch.column("x"), d)
            for at in range(0, len(whole), BLOCK):
                off = model.deviations(whole[at : at + BLOCK])
                wide = off.dtype == object or d * max(-int(off.min()), int(off.max())) ** 2 >= 1 << 63
                squares = [int(v) for v in ((off.astype(object) if wide else off) ** 2).sum(axis=1)]
                white = model.project(off)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel()))
                columns = [ids.slice(at, len(white)), pa.array([v if v < 1 << 63 else None for v in squares], pa.int64()), pa.array(map(str, squares), pa.string()), flat]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "deviation", "deviation_exact", "whitened"])

    return vectors.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation long, deviation_exact string, whitened array<double>")


def identity_error(fitted: DataFrame, values: np.ndarray) -> float:
    """The largest absolute entry of the covariance of ``whitened``, minus the identity, over the axes that have a spread."""
    used = [k for k, v in enumerate(values) if v > 0]
    if not used:
        return 0.0
    mean = fitted.agg(*(F.avg(F.col("whitened")[k]).alias(f"m{k}") for k in used)).first()
    off = {k: F.col("whitened")[k] - F.lit(mean[f"m{k}"]) for k in used}
    pairs = [(i, j) for i in used for j in used if i <= j]
    found = fitted.agg(*(F.avg(off[i] * off[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per whole vector and component: ``vec_id, component, n, deviation, deviation_exact, whitened, explained, identity_error``.

    Which rows are left out, ``integer_vectors`` says. Repeated rows count once in the fit and each has its rows in the
    result. Vectors shorter than ``components`` have as many components as entries. A component without spread has ``whitened`` and
    ``explained`` 0 and no part in ``identity_error``. No vectors give no rows.
    """
    vectors = integer_vectors(rows, id_col, vector_col)
    different = written(vectors.select("x").distinct(), "vectors")
    model = fit(different, components)
    if model is None:
        drop_written(different)
        none = "vec_id long, component int, n long, deviation long, deviation_exact string, whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], none)
    fitted = written(project(different.select(F.lit(None).cast("long").alias("vec_id"), "x"), model).select("whitened"), "whitened")
    error = identity_error(fitted, model.values)
    for done in (different, fitted):
        drop_written(done)
    explained = F.array(*(F.lit(float(v / model.trace if model.trace else 0.0)) for v in model.values))
    each = project(vectors, model).select("vec_id", "deviation", "deviation_exact", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "deviation_exact", "whitened", explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error")
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of all embeddings."""
    return whiten(table(spark, sf_dir, "embeddings"))
