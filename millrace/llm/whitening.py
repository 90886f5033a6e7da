"""Whitening of embeddings on leading principal components, by a block Jacobi-Davidson method.

Entries become whole numbers, x = floor(SCALE * entry). The fit list holds each different x vector
once. The covariance V of the fit list is never formed: all that is asked of the table is V u for a
few vectors u at a time, one job that adds up (x - mean) ((x - mean) u) over centred rows. Each
task returns one small array; of many tasks they are added in a tree.

The subspace grows by one direction for each wanted pair that is still open and for ``EXTRA`` more. Rayleigh-Ritz on the
subspace gives the pairs; for each open one the correction equation

    (I - Z Z') (V - theta I) (I - Z Z') t = -residual,   Z: locked and wanted Ritz vectors,

is solved roughly by a few MINRES steps, for all open pairs in step, so that a step costs one job.
A pair is locked once its residual is within rounding (``TOLERANCE`` of the largest eigenvalue), and
everything after is kept orthogonal to it. The subspace is restarted with its leading Ritz vectors
before it outgrows ``MOST`` blocks. The driver holds these few vectors of the embedding's dimension,
never rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.session import materialize

SCALE = 256
COMPONENTS = 4
TOLERANCE = 1e-14           # of a residual, relative to the largest eigenvalue
STALLED = 1e-12             # where rounding keeps residuals from falling any further
INNER = 6                   # MINRES steps for one correction
EXTRA = 4                   # further pairs that are corrected too, as guard for the wanted ones
MOST = 8                    # blocks in the subspace before it is restarted
ROUNDS = 200
WIDE = 64                   # tasks beyond which their arrays are added by tasks first
SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, x`` of the rows that count, x as whole numbers.

    Rows whose vector is null or empty or holds a null or a non-finite entry do not count, nor do
    vectors of another length than the most frequent one (of equally frequent ones the longest).
    """
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    whole = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(
        F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", entry))
    x = whole.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE)).alias("x"))
    sizes = x.groupBy(F.size("x").alias("d")).count()
    most = sizes.agg(F.max(F.struct("count", "d")).alias("most")).select("most.d")
    return x.join(F.broadcast(most), F.size("x") == F.col("d")).select("vec_id", "x")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _added(rows: DataFrame, work) -> np.ndarray | None:
    """The sum of ``work(matrix of x) -> array`` over all batches: one array a task, then a tree."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = work(_matrix(batch))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict(
                {"shape": [list(total.shape)], "part": [total.astype("<f8").tobytes()]},
                pa.schema([("shape", pa.list_(pa.int32())), ("part", pa.binary())]))

    def array(row):
        return np.frombuffer(row["part"], "<f8").reshape(row["shape"])

    parts = rows.mapInArrow(run, "shape array<int>, part binary").rdd.map(array)
    return parts.treeAggregate(None, _plus, _plus, depth=2 if parts.getNumPartitions() > WIDE else 1)


def _plus(a, b):
    return b if a is None else a if b is None else a + b


class Moments:
    """Number, exact sums and exact trace of a fit list, and products with its covariance."""

    def __init__(self, fit: DataFrame):
        self.fit = fit
        found = fit.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(
            F.count("*").alias("n"), F.sum("c").alias("s"), F.sum(F.col("c").cast("decimal(19,0)")
                                                                 * F.col("c")).alias("q"))
        rows = found.orderBy("i").collect()
        self.n = rows[0]["n"] if rows else 0
        self.sums = np.array([r["s"] for r in rows], np.int64)
        self.products = 0
        # n q - s s by whole numbers, so that nothing cancels.
        self.trace = sum((self.n * int(r["q"]) - r["s"] ** 2) / self.n ** 2 for r in rows)

    def centred(self):
        """A function from a matrix of x to the centred one."""
        n, sums = self.n, self.sums
        return lambda x: _deviations(x, n, sums) / n

    def times(self, u: np.ndarray) -> np.ndarray:
        """V u for the columns of u."""
        centred, n = self.centred(), self.n
        self.products += 1

        def work(x):
            c = centred(x)
            return c.T @ (c @ u)

        return _added(self.fit, work) / n


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - s, exactly; as Python's numbers where 64 bits might not hold them."""
    if len(x) and float(n) * float(np.abs(x).max()) + float(np.abs(sums).max()) >= 2.0 ** 62:
        return x.astype(object) * int(n) - sums.astype(object)
    return x * np.int64(n) - sums


def _orthonormal(t: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of t add to those of ``against``."""
    out = against
    for k in range(t.shape[1]):
        v, size = t[:, k], np.linalg.norm(t[:, k])
        for _ in range(3):
            v = v - out @ (out.T @ v)
        if np.linalg.norm(v) > 1e-10 * size and size > 0:
            v = v / np.linalg.norm(v)
            v = v - out @ (out.T @ v)
            out = np.column_stack([out, v / np.linalg.norm(v)])
    return out[:, against.shape[1]:]


def minres(apply, b: np.ndarray, steps: int, goal: float) -> np.ndarray:
    """Solve A x = b for every column of b at once, A symmetric; ``apply`` maps a matrix.

    Stops after ``steps`` products, or when every residual is under ``goal`` of its b.
    """
    beta = np.linalg.norm(b, axis=0)
    live = beta > 0
    v_old, v = np.zeros_like(b), np.where(live, b / np.where(live, beta, 1), 0)
    w_old, w, x = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    eta, start = beta.copy(), np.where(live, beta, 1)
    c_old, c = np.ones_like(beta), np.ones_like(beta)
    s_old, s = np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - beta * v_old
        after = np.linalg.norm(p, axis=0)
        delta = c * alpha - c_old * s * beta
        r1 = np.hypot(delta, after)
        r2 = s * alpha + c_old * c * beta
        r3 = s_old * beta
        # A column whose Krylov space is used up stays as it is.
        live = live & (r1 > 0)
        r1 = np.where(live, r1, 1)
        w_old, w = w, np.where(live, (v - r3 * w_old - r2 * w) / r1, 0)
        c_old, c, s_old, s = c, delta / r1, s, after / r1
        x = x + np.where(live, c * eta, 0) * w
        eta = np.where(live, -s * eta, eta)
        live = live & (after > 1e-14 * start)
        v_old, v = v, np.where(live, p / np.where(after > 0, after, 1), 0)
        beta = after
        if not (live & (np.abs(eta) > goal * start)).any():
            break
    return x


def leading(times, d: int, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors of a symmetric operator that has
    no negative ones; ``times(u)`` is its product with a matrix of d rows."""
    k = min(k, d)
    locked, values = np.zeros((d, 0)), []
    first = np.random.default_rng(seed).standard_normal((d, min(d, 2 * (k + EXTRA))))
    basis = _orthonormal(first, locked)
    image = times(basis)
    before, largest = np.inf, 0.0
    for _ in range(ROUNDS):
        want = k - locked.shape[1]
        theta, y = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        largest = max(largest, theta[0], *values)
        # All pairs that are worked on, the wanted ones first.
        basis, image = basis @ y, image @ y
        width = min(want + EXTRA, basis.shape[1])
        residual = image[:, :width] - basis[:, :width] * theta[:width]
        residual -= locked @ (locked.T @ residual)
        sizes = np.linalg.norm(residual, axis=0)[:want]
        whole = basis.shape[1] + locked.shape[1] >= d
        stalled = before / 2 < sizes.max() <= STALLED * largest
        before = sizes.max()
        near = np.full(want, True) if whole or stalled else sizes <= TOLERANCE * largest
        # Only leading pairs are locked, so that none is passed over.
        ready = want if near.all() else int(np.argmin(near))
        if ready:
            locked = np.column_stack([locked, _orthonormal(basis[:, :ready], locked)])
            values += theta[:ready].tolist()
            if locked.shape[1] == k:
                break
            basis, image, theta = basis[:, ready:], image[:, ready:], theta[ready:]
            residual, width, before = residual[:, ready:], width - ready, np.inf
        if basis.shape[1] + width > MOST * width:
            basis, image = basis[:, :2 * width], image[:, :2 * width]
        z, shift = np.column_stack([locked, basis[:, :width]]), theta[:width]

        def project(t):
            return t - z @ (z.T @ t)

        def shifted(t):
            t = project(t)
            return project(times(t) - t * shift)

        new = _orthonormal(minres(shifted, -project(residual), INNER, 0.01),
                           np.column_stack([locked, basis]))
        if not new.shape[1]:
            # Nothing comes of the corrections: a fresh direction takes their place.
            fresh = np.random.default_rng(basis.shape[1]).standard_normal((d, width))
            new = _orthonormal(fresh, np.column_stack([locked, basis]))
        basis, image = np.column_stack([basis, new]), np.column_stack([image, times(new)])
    else:
        raise RuntimeError(f"no convergence in {ROUNDS} rounds")
    # One last Rayleigh-Ritz over what is locked puts nearly equal pairs in order.
    theta, y = np.linalg.eigh(locked.T @ times(locked))
    return theta[::-1], locked @ y[:, ::-1]


class Whitening:
    """Leading components of a fit list, and how far the whitened list is from identity."""

    def __init__(self, fit: DataFrame, components: int = COMPONENTS):
        self.moments = m = Moments(fit)
        self.values, self.vectors, self.identity_error = np.zeros(0), np.zeros((len(m.sums), 0)), 0.0
        if m.n == 0 or not m.trace > 0:
            return
        values, vectors = leading(m.times, len(m.sums), components)
        # Directions without variance cannot be scaled to one.
        keep = values > 1e-13 * len(m.sums) * values[0]
        self.values, self.vectors = values[keep], vectors[:, keep]
        project = self.projected()

        def work(x):
            y = project(x)
            return np.vstack([y.sum(0), y.T @ y])

        total = _added(fit, work) / m.n
        error = total[1:] - np.outer(total[0], total[0]) - np.eye(len(self.values))
        self.identity_error = float(np.abs(error).max())

    def projected(self):
        """A function from a matrix of x to whitened rows."""
        centred, basis = self.moments.centred(), self.vectors / np.sqrt(self.values)
        return lambda x: centred(x).astype(np.float64) @ basis


def _squares(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """The exact sum of (n x - s)^2 of each row; null where 64 bits do not hold it."""
    away = _deviations(x, n, sums)
    most = float(np.abs(away).max()) if away.size else 0.0
    if away.dtype != object and most * most * x.shape[1] < 2.0 ** 62:
        return pa.array((away * away).sum(1))
    exact = [sum(int(v) ** 2 for v in row) for row in away]
    return pa.array([v if v < 2 ** 63 else None for v in exact], pa.int64())


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each usable row of ``rows`` (``vec_id``, ``embedding``) and component.

    Repeated rows and ids are each answered; they count once in the fit list. Components without
    variance are left out, so an empty table, one vector or equal vectors have no rows. Of equal
    eigenvalues any basis of their space may come out; the sign is any. A null ``vec_id`` stays
    null. Other columns are ignored.
    """
    x = materialize(usable(rows), "vectors")
    fit = materialize(x.select("x").distinct(), "fit")
    white = Whitening(fit, components)
    n, sums, k = white.moments.n, white.moments.sums, len(white.values)
    if not k:
        return x.sparkSession.createDataFrame([], SCHEMA)
    project, error = white.projected(), white.identity_error
    explained = white.values / white.moments.trace

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                matrix = _matrix(batch)
                each = pa.array(np.repeat(np.arange(batch.num_rows), k))
                size = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(each),
                     pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                     pa.array(np.full(size * k, n, np.int64)),
                     _squares(matrix, n, sums).take(each), pa.array(project(matrix).ravel()),
                     pa.array(np.tile(explained, size)), pa.array(np.full(size * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained",
                           "identity_error"])

    return x.mapInArrow(run, SCHEMA)
