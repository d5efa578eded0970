"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

The rows are never held anywhere but in their partitions. A step multiplies
them by one vector on the right and by the outcome on the left, X v and
X' u, and both in one pass, since X' u of a partition needs only the u of its
own rows. The left vectors are not stored: each is a combination of rows'
entries (u = X w with a w of the length of a row), made again where the rows
are. A pass also gives the products with all earlier left vectors, so that the
new one is orthogonalised against all of them, and likewise on the right. To
the driver come sums of the length of a row for each step. The small
bidiagonal matrix that results has the singular values of X; its singular
value decomposition gives components and deviations.

One start vector finds each eigenvalue once. So a second run looks in the
space that the found components leave for anything larger than the last of
them, until nothing is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stage, table, widened

#: A singular triplet has converged when its residual is below this share of the largest singular value.
CONVERGED = 1e-14
#: Singular values below this share of the largest count as 0.
RANK = 1e-12
_LIMIT = 2**63 - 1


@dataclass(frozen=True)
class Whitening:
    """A fitted model. ``components`` is (k, d); eigenvalues are of the covariance of the fit list, falling; ``identity_error`` is None without a component."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None
    steps: int

    @property
    def mean(self) -> np.ndarray:
        return self.sums / max(self.n, 1)


def fixed_point(vector: str | Column, scale: int = 256) -> Column:
    """Entries as whole numbers, floor(scale * entry) of the entry as double."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has entries, all of them finite numbers."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite))


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column(0)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _summed(fit: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """Sum over all rows of what ``kernel`` makes of the rows of a batch: added up in each task, then by place in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = kernel(_rows(batch))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["place", "part"])

    found = fit.mapInArrow(run, f"place int, part {kind}").groupBy("place").agg(F.sum("part").alias("part")).orderBy("place").collect()
    return np.array([r["part"] for r in found])


def _orthogonal(r: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    for _ in range(2):  # twice is enough
        for b in bases:
            r = r - b @ (b.T @ r)
    return r


def _bidiagonalise(fit: DataFrame, mean: np.ndarray, avoid: np.ndarray, settled: Callable[[np.ndarray, np.ndarray], bool], seed: int) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """(singular values, right vectors as columns, steps, whether the space is exhausted) of the centred rows, outside the columns of ``avoid``.

    ``settled`` sees the singular values so far and their residuals after
    each step, and ends the run.
    """
    d = len(mean)
    left, images = np.zeros((d, 0)), np.zeros((d, 0))  # w of the left vectors u = X w, and X' u
    v = _orthogonal(np.random.default_rng(seed).standard_normal(d), avoid)
    right = (v / np.linalg.norm(v))[:, None]
    alphas: list[float] = []
    betas: list[float] = []
    while True:
        q = right[:, -1] - (betas[-1] * left[:, -1] if betas else 0.0)

        def kernel(x: np.ndarray, q: np.ndarray = q, left: np.ndarray = left) -> np.ndarray:
            x = x - mean
            p = x @ q
            return np.concatenate([[p @ p], (x @ left).T @ p, x.T @ p])

        found = _summed(fit, kernel)
        k = len(alphas)
        along, image = found[1 : k + 1], found[k + 1 :]
        alpha = float(np.sqrt(max(found[0] - along @ along, 0.0)))
        largest = max(alphas + betas, default=alpha)
        if alpha <= RANK * largest or alpha == 0.0:  # this direction has no extent beyond the earlier ones
            b = _matrix(alphas, betas, len(alphas) + 1)[:-1] if alphas else np.zeros((0, 1))
            values, vectors = _small(b, right)
            return values, vectors, k + 1, True
        left = np.column_stack([left, (q - left @ along) / alpha])
        images = np.column_stack([images, (image - images @ along) / alpha])
        alphas.append(alpha)
        r = _orthogonal(images[:, -1] - alpha * right[:, -1], avoid, right)
        beta = float(np.linalg.norm(r))
        b = _matrix(alphas, betas, len(alphas))
        u, values, _ = np.linalg.svd(b)
        done = len(alphas) + avoid.shape[1] >= d
        if done or beta <= RANK * largest or settled(values, beta * np.abs(u[-1])):
            return *_small(b, right), len(alphas), done
        betas.append(beta)
        right = np.column_stack([right, r / beta])


def _matrix(alphas: list[float], betas: list[float], n: int) -> np.ndarray:
    b = np.zeros((n, n))
    for i, a in enumerate(alphas):
        b[i, i] = a
    for i, x in enumerate(betas[: n - 1]):
        b[i, i + 1] = x
    return b


def _small(b: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, values, turned = np.linalg.svd(b, full_matrices=False)
    return values, right @ turned.T


def leading_components(fit: DataFrame, mean: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``count`` largest singular values of the centred rows and their right vectors (as columns), and the passes taken. Fewer where the rank is smaller."""
    none = np.zeros((len(mean), 0))

    def converged(values: np.ndarray, residuals: np.ndarray) -> bool:
        return len(values) > count and bool((residuals[:count] <= CONVERGED * values[0]).all())

    values, vectors, steps, whole = _bidiagonalise(fit, mean, none, converged, seed=1)
    values, vectors = values[:count], vectors[:, :count]
    run = 1
    while not whole and vectors.shape[1] < len(mean):
        run += 1
        full = len(values) == count
        floor = values[-1] if full else 0.0

        def decided(v: np.ndarray, r: np.ndarray, full: bool = full, floor: float = floor) -> bool:
            if full and v[0] + r[0] < floor:  # nothing above the last component is left
                return True
            return len(v) > count and bool((r[:count] <= CONVERGED * max(v[0], floor)).all())

        more, others, k, _ = _bidiagonalise(fit, mean, vectors, decided, seed=run)
        steps += k
        top = max(values[0], more[0]) if len(values) and len(more) else 0.0
        new = more > (floor * (1 + 1e-9) if full else RANK * top)
        if not new.any():
            break
        values, vectors = np.concatenate([values, more[new]]), np.column_stack([vectors, others[:, new]])
        order = np.argsort(-values, kind="stable")[:count]
        values, vectors = values[order], vectors[:, order]
    real = values > RANK * values[:1].max(initial=0.0)
    return values[real], vectors[:, real], steps


def fit_whitening(df: DataFrame, vector: str, components: int = 4) -> Whitening:
    """Fits on the distinct vectors of ``vector``, an array<bigint> column without nulls whose arrays have one length; covariances have divisor n.

    Each pass reads the distinct vectors, which are written once to the shared
    folder; between the passes nothing is kept in the executors, so a lost
    one costs its tasks. A table without rows gives a model with n = 0 and no
    component; vectors that do not vary give none either.
    """
    fit = stage(df.select(F.col(vector).alias("x")).distinct(), "fit-list")
    counted = _summed(fit, lambda x: np.concatenate([[len(x)], x.sum(axis=0)]).astype(np.int64), "long")
    if not len(counted):
        return Whitening(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0, None, 0)
    n, sums = int(counted[0]), counted[1:].astype(np.int64)
    mean = sums / n
    trace = float(_summed(fit, lambda x: np.array([((x - mean) ** 2).sum()]))[0]) / n
    if trace == 0.0:
        return Whitening(n, sums, np.zeros((0, len(sums))), np.zeros(0), 0.0, None, 0)
    values, vectors, steps = leading_components(fit, mean, min(components, len(sums)))
    eigenvalues, k = values**2 / n, len(values)
    scaled = vectors / np.sqrt(eigenvalues)

    def moments(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ scaled
        return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])

    found = _summed(fit, moments) / n
    covariance = found[k:].reshape(k, k) - np.outer(found[:k], found[:k])
    return Whitening(n, sums, vectors.T, eigenvalues, trace, float(np.abs(covariance - np.eye(k)).max()), steps)


def _deviations(x: np.ndarray, w: Whitening) -> list[int | None]:
    """Sums over the dimensions of (n * x - sums) ** 2, exact; None beyond 64 bits."""
    reach = float(w.n) * np.abs(x).max(initial=0) + float(np.abs(w.sums).max(initial=0))
    if reach * reach * x.shape[1] < 2.0**62:
        return ((w.n * x - w.sums) ** 2).sum(axis=1).tolist()
    exact = [sum((w.n * a - s) ** 2 for a, s in zip(row, w.sums.tolist(), strict=True)) for row in x.tolist()]
    return [v if v <= _LIMIT else None for v in exact]


def apply_whitening(df: DataFrame, w: Whitening, vector: str, new: str = "whitening") -> DataFrame:
    """All rows and columns of ``df`` and ``new``: struct(deviation, whitened). ``whitened`` has a value for each component of ``w``. No shuffle."""
    scaled = (w.components / np.sqrt(w.eigenvalues)[:, None]).T if len(w.eigenvalues) else np.zeros((len(w.sums), 0))
    mean = w.mean

    def run(column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _rows(batch.select([column])) if batch.num_rows else np.zeros((0, len(mean)), np.int64)
                y = pa.array(((x - mean) @ scaled).ravel(), pa.float64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * scaled.shape[1], pa.int32()), y)
                made = pa.StructArray.from_arrays([pa.array(_deviations(x, w), pa.int64()), lists], names=["deviation", "whitened"])
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "made"])

        return each

    return widened(df, run, vector, new, "struct<deviation: bigint, whitened: array<double>>")


def op11_whitening(spark: SparkSession, sf_dir: str, components: int = 4) -> DataFrame:
    """Every usable row of embeddings with its deviation, and its whitened value on each component.

    Vectors that are null, empty, or hold null or non-finite entries are
    dropped; so are those of another length than the commonest (of equals the
    longest). A component that the rank does not give (all its values
    would be 0 / 0) has a row with null for whitened and 0 for explained, null
    if nothing varies; identity_error is then of the others, or null.
    Repeated rows and null ids stay. ``deviation`` is null beyond 64 bits.
    """
    rows = usable(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    common = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = common[0]["d"] if common else 0
    rows = rows.where(F.size("embedding") == d).select("vec_id", fixed_point("embedding").alias("x"))
    w = fit_whitening(rows, "x", components)
    explained = [e / w.trace for e in w.eigenvalues] + [0.0 if w.trace else None] * (min(components, d) - len(w.eigenvalues))
    shares = F.array(*[F.lit(e).cast("double") for e in explained]) if explained else F.array().cast("array<double>")
    out = apply_whitening(rows, w, "x").select("vec_id", "whitening", F.posexplode(shares).alias("k", "explained"))
    return out.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), F.col("whitening.deviation").alias("deviation"),
        F.get("whitening.whitened", F.col("k")).alias("whitened"), "explained", F.lit(w.identity_error).cast("double").alias("identity_error"),
    )
