"""Embedding whitening: the leading components of a covariance by block Jacobi-Davidson, without the matrix.

The table is only ever multiplied with: one product is one pass over the distinct vectors, in blocks of rows that are
centred first. A search space grows by corrections, one for each component that is not settled; their equations are solved
by MINRES on the complement of the Ritz vectors, all in step, so an inner step is one pass for all of them. Rayleigh-Ritz
gives the next vectors; a vector whose residual has reached double precision is locked. The driver holds dimension by
search space and no row of the table.

Defined cases: a vector that is null or empty, or holds a null or non-finite entry, is dropped, as is one with an entry
of 2^46 or more, or of another length than most vectors have (of equally many the longest). Repeated rows count once in the fit and all come out. A null
id stays. There are as many components as dimensions, if fewer than asked for. Where a component has no spread (fewer
distinct vectors than components, or equal ones) ``whitened`` is null; ``explained`` is null where nothing has spread,
``identity_error`` where no component has. ``deviation`` is null if it is no long. An empty table gives an empty one.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foretide.llm.common import stored

COMPONENTS = 16
#: Vectors beyond the wanted ones that the search space carries along: they keep the last wanted ones apart from the next.
GUARD = 4
#: Inner steps of a correction, and outer rounds at most.
INNER, ROUNDS = 8, 60
#: Double precision of a residual, as a part of the largest eigenvalue; rounding of the products stays below it.
PRECISE = 2.0**-46
RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(e: Column) -> Column:
    """An entry as the long that the contract works on."""
    return F.floor(64 * e.cast("double")).cast("long") + F.lit(1_000_000).cast("long")


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x) of the vectors that count."""
    v = F.col(vec_col)
    fine = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < 2.0**46)
    kept = vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(F.forall("v", fine))
    return kept.select("id", F.transform("v", whole).alias("x"))


def _blocks(batches, column: str = "x") -> Iterator[tuple[object, np.ndarray]]:
    """(Arrow batch, its vectors as a matrix of longs)."""
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column(column).flatten().to_numpy().reshape(batch.num_rows, -1)


def _sums(fit: DataFrame) -> list[int]:
    """The exact sum of each dimension: batches add up in whole numbers, Spark adds the batches."""

    def add(batches):
        import pyarrow as pa

        for _, x in _blocks(batches):
            small = int(np.abs(x).max()) * len(x) < 2**62
            total = [int(s) for s in (x if small else x.astype(object)).sum(axis=0)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.decimal128(38, 0))], names=["at", "s"])

    rows = fit.mapInArrow(add, "at int, s decimal(38,0)").groupBy("at").agg(F.sum("s").alias("s")).collect()
    return [int(s) for _, s in sorted(rows)]


class Covariance:
    """The covariance of a stored table of distinct vectors, as something that multiplies: symmetric, centred, never held."""

    def __init__(self, fit: DataFrame, n: int, sums: list[int]) -> None:
        self.fit, self.n, self.dim, self.passes = fit, n, len(sums), 0
        self.base = np.array([s // n for s in sums], dtype=np.int64)
        #: What the mean has beyond whole numbers; subtracting the whole part first loses no digit.
        self.rest = np.array([(s % n) / n for s in sums])

    def gathered(self, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all rows of ``of(centred block)``, a flat array: added up in the task, then by Spark by place."""
        base, rest = self.base, self.rest

        def part(batches):
            import pyarrow as pa

            total = None
            for _, x in _blocks(batches):
                y = of((x - base).astype(np.float64) - rest).ravel()
                total = y if total is None else total + y
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "y"])

        self.passes += 1
        rows = self.fit.mapInArrow(part, "at int, y double").groupBy("at").agg(F.sum("y").alias("y")).collect()
        out = np.zeros(len(rows))
        for at, y in rows:
            out[at] = y
        return out

    def __call__(self, v: np.ndarray) -> np.ndarray:
        return self.gathered(lambda c: c.T @ (c @ v)).reshape(self.dim, -1) / self.n

    def trace(self) -> float:
        return float(self.gathered(lambda c: np.array([np.einsum("ij,ij->", c, c)]))[0]) / self.n


def orthonormal(new: np.ndarray, old: np.ndarray) -> np.ndarray:
    """The part of ``new`` that ``old`` (orthonormal) does not span, as an orthonormal basis; dependent columns go."""
    kept = old
    for column in new.T:
        norm = np.linalg.norm(column)
        if not norm:
            continue
        v = column / norm
        for _ in range(3):
            v = v - kept @ (kept.T @ v)
            size = np.linalg.norm(v)
            if size < 1e-8:
                break
            v = v / size
        else:
            kept = np.column_stack((kept, v))
    return kept[:, old.shape[1] :]


def minres(times: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, least: float) -> np.ndarray:
    """Minimal residuals of a symmetric operator for each column of ``b``, in step; ends when all residuals are ``least``
    of what they were, or after ``steps``."""
    beta = np.linalg.norm(b, axis=0)
    start = np.where(beta > 0, beta, 1.0)
    v, v0 = b / start, np.zeros_like(b)
    w, w0, x = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    c0 = c = np.ones(b.shape[1])
    s0 = s = np.zeros(b.shape[1])
    left, going = beta.copy(), beta > 0
    for _ in range(steps):
        p = times(v)
        alpha = np.einsum("ij,ij->j", v, p)
        p = p - alpha * v - beta * v0
        after = np.linalg.norm(p, axis=0)
        delta, rho2, rho3 = c * alpha - c0 * s * beta, s * alpha + c0 * c * beta, s0 * beta
        rho1 = np.hypot(delta, after)
        going = going & (rho1 > 0)
        safe = np.where(rho1 > 0, rho1, 1.0)
        c0, c, s0, s = c, delta / safe, s, after / safe
        w, w0 = (v - rho3 * w0 - rho2 * w) / safe, w
        x = x + np.where(going, c * left, 0.0) * w
        left = -s * left
        # A column whose Krylov space has ended is solved.
        going = going & (after > 1e-14 * start)
        v, v0, beta = np.where(going, p / np.where(after > 0, after, 1.0), 0.0), v, after
        if not going.any() or (np.abs(left[going]) <= least * start[going]).all():
            break
    return x


def leading(times: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, guard: int = GUARD) -> tuple[np.ndarray, np.ndarray]:
    """(largest eigenvalues, falling; unit eigenvectors as columns) of a symmetric positive operator.

    Ends when every wanted residual is within ``PRECISE``, or, below a millionth of that scale's root, when rounding lets
    none of them fall any more."""
    block = min(dim, wanted + guard)
    v = orthonormal(np.random.default_rng(13).standard_normal((dim, block)), np.zeros((dim, 0)))
    av = times(v)
    locked, locked_av, before, stuck = np.zeros((dim, 0)), np.zeros((dim, 0)), np.inf, 0
    for turn in range(ROUNDS):
        h = v.T @ av
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        u, au = v @ y, av @ y
        need = wanted - locked.shape[1]
        r = au - u * theta
        r = r - locked @ (locked.T @ r)
        size = np.linalg.norm(r, axis=0)
        scale = max(theta[0], np.einsum("ij,ij->j", locked, locked_av).max(initial=0.0), 0.0)
        settled = 0
        while settled < min(need, len(theta)) and size[settled] <= PRECISE * scale:
            settled += 1
        worst = size[settled:need].max(initial=0.0)
        stuck = stuck + 1 if worst > before / 2 else 0
        before = worst
        if settled == need or v.shape[1] + locked.shape[1] == dim or (stuck >= 2 and worst <= 64 * PRECISE * scale):
            locked, locked_av = np.column_stack((locked, u[:, :need])), np.column_stack((locked_av, au[:, :need]))
            break
        # Locked vectors leave the search space, which stays orthogonal to them.
        locked, locked_av = np.column_stack((locked, u[:, :settled])), np.column_stack((locked_av, au[:, :settled]))
        u, au, theta, r, size = u[:, settled:], au[:, settled:], theta[settled:], r[:, settled:], size[settled:]
        block = min(need - settled + guard, u.shape[1])
        if u.shape[1] > 3 * (wanted + guard):  # restart from the best
            u, au, theta, r, size = u[:, : 2 * block], au[:, : 2 * block], theta[: 2 * block], r[:, : 2 * block], size[: 2 * block]
        away = np.column_stack((locked, u[:, :block]))
        project = lambda t, q=away: t - q @ (q.T @ t)
        shift = theta[:block]
        t = minres(lambda z, p=project, e=shift: p(times(p(z)) - e * p(z)), project(-r[:, :block]), INNER, 2.0 ** -(turn + 4))
        new = orthonormal(project(t), np.column_stack((locked, u)))
        if not new.shape[1]:  # nothing left to correct with: a random direction
            new = orthonormal(np.random.default_rng(turn).standard_normal((dim, 1)), np.column_stack((locked, u)))
        v, av = np.column_stack((u, new)), np.column_stack((au, times(new)))
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    e = np.einsum("ij,ij->j", locked, locked_av)
    order = np.argsort(-e, kind="stable")
    locked = locked[:, order]
    top = locked[np.abs(locked).argmax(axis=0), np.arange(locked.shape[1])]
    return np.maximum(e[order], 0.0), locked * np.where(top < 0, -1.0, 1.0)


def whitened(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): each usable vector in each leading component."""
    spark, all_x = vectors.sparkSession, usable(vectors, id_col, vec_col)
    usual = all_x.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    schema = f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, {RESULT}"
    if usual is None:
        return spark.createDataFrame([], schema)
    all_x = all_x.filter(F.size("x") == usual["dim"])
    fit = stored(all_x.select("x").distinct(), "vectors")
    n = fit.count()
    sums = _sums(fit)
    matrix = Covariance(fit, n, sums)
    e, u = leading(matrix, matrix.dim, min(components, matrix.dim))
    trace = matrix.trace()
    spread = e > 1e-13 * max(trace, 0.0) if trace > 0 else np.zeros(len(e), dtype=bool)
    axes = np.where(spread, u / np.sqrt(np.where(spread, e, 1.0)), 0.0)
    used = axes[:, spread]
    error = None
    if spread.any():
        error = float(np.abs(matrix.gathered(lambda c: (c @ used).T @ (c @ used)).reshape(used.shape[1], -1) / n - np.eye(used.shape[1])).max())
    base, rest = matrix.base, matrix.rest
    exact = np.array(sums, dtype=object)

    def project(batches):
        import pyarrow as pa

        for batch, x in _blocks(batches):
            far = x - base  # n * x - S is n * far less what the mean has beyond whole numbers
            if float(np.abs(far).max() + 1) ** 2 * n * n * far.shape[1] < 2.0**62:
                d = n * far - np.array([s % n for s in sums], dtype=np.int64)
                deviation = pa.array(np.einsum("ij,ij->i", d, d))
            else:
                d = n * x.astype(object) - exact
                deviation = pa.array([q if q < 2**63 else None for q in (int(q) for q in (d * d).sum(axis=1))], pa.int64())
            w = (far.astype(np.float64) - rest) @ axes
            lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), deviation, lists], names=["id", "deviation", "w"])

    kind = vectors.schema[id_col].dataType.simpleString()
    out = all_x.mapInArrow(project, f"id {kind}, deviation long, w array<double>")
    share = [float(x) / trace if trace > 0 else None for x in e]
    parts = F.arrays_zip("w", F.array(*[F.lit(bool(x)) for x in spread]).alias("ok"), F.array(*[F.lit(x).cast("double") for x in share]).alias("share"))
    return out.select("id", "deviation", F.posexplode(parts)).select(
        F.col("id").alias(id_col), (F.col("pos") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(F.col("col.ok"), F.col("col.w")).alias("whitened"), F.col("col.share").alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
