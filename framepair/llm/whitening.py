"""Whitening of vectors by an incremental eigendecomposition of their covariance.

1. Each task reads its share of the fit list and keeps ``LANES`` spectra (eigenvalues and
   eigenvectors of a scatter matrix about a running mean). A vector is a centred rank-one update of one of
   them: the new eigenvalues are the roots of the secular equation, after deflation of
   poles that hardly differ or that the vector hardly touches; the eigenvectors follow from weights
   recomputed from the roots, which keeps them orthogonal (``update``). All lanes are updated
   at once, so numpy works on stacks.
2. Two spectra are combined by successive rank-one updates: one for every eigenpair of the second and one
   for the distance of the means. Lanes, then tasks, are combined in a tree of bounded
   fan-in; a spectrum has d^2 + 2 d numbers for vectors of d entries, whatever the number of rows.
3. The eigenvectors are refined over all tasks: the covariance projected on them is summed from
   centred vectors and solved (Rayleigh-Ritz on the whole basis), which removes
   what the updates have rounded.

The driver holds d x d numbers at most. A vector that a third of all rows share is one
entry of the fit list, which is made by an aggregate that combines before it shuffles.

Rows whose vector is null, holds null or non-finite entries or entries beyond 2^40, or has another length
than most (the longer of equally frequent lengths) are left out. A direction without variance is no component;
without rows or without variance the result is empty. A deviation beyond 2^63 - 1 is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framepair.llm.common import materialise, query, table, unused
from framepair.llm.rules import ddl

LANES, FAN_IN, COMPONENTS = 16, 8, 16
EPS = np.finfo(float).eps
STEPS = 60  # of the secular iteration; it ends when all roots are found, after 4 to 8 as a rule
LARGEST = 2.0**40


# -- one update of a stack of spectra ----------------------------------------
def same_poles(d: np.ndarray, q: np.ndarray, z: np.ndarray, tol: np.ndarray) -> None:
    """Turns each pair of neighbouring poles that hardly differ so that only the upper one is touched."""
    close = (d[:, 1:] - d[:, :-1]) <= tol
    for i in np.flatnonzero(close.any(0)):
        at = np.flatnonzero(close[:, i] & (z[:, i] != 0))
        if not len(at):
            continue
        a, b = z[at, i], z[at, i + 1]
        r = np.hypot(a, b)
        c, s = b / r, a / r
        left, right = q[at, :, i], q[at, :, i + 1]
        q[at, :, i], q[at, :, i + 1] = c[:, None] * left - s[:, None] * right, s[:, None] * left + c[:, None] * right
        z[at, i], z[at, i + 1] = 0.0, r


def roots(d: np.ndarray, w: np.ndarray, k: np.ndarray) -> np.ndarray:
    """``pole - root`` of 1 + sum w / (pole - root) = 0 for the first ``k`` poles of each row: [stack, root, pole].

    ``d`` rises over the first k; the others have no weight and lie above. The root is sought as its distance from the
    nearer pole, by a rational model of the poles on either side, held inside a bracket.
    """
    n, m = d.shape
    index = np.arange(m)
    live, last = index < k[:, None], index == k[:, None] - 1
    top = d + w.sum(1, keepdims=True)
    upper = np.where(last, top, np.concatenate([d[:, 1:], d[:, -1:] + 1], 1))
    span = np.where(live, upper - d, 1.0)
    delta = d[:, None, :] - d[:, :, None]
    below = (index[None, :] <= index[:, None])[None]
    weight = w[:, None, :]
    with np.errstate(all="ignore"):
        # Which half the root lies in says from which pole it is measured.
        right = (1 + (weight / (delta - 0.5 * span[:, :, None])).sum(2) < 0) & ~last & live
        delta -= np.where(right, span, 0.0)[:, :, None]
        lo, hi = np.where(right, -0.5, 0.0) * span, np.where(right, 0.0, np.where(last, 1.0, 0.5)) * span
        x = 0.5 * (lo + hi)
        own = np.where(right, -span, 0.0)
        other = own + span
        found = ~live
        for _ in range(STEPS):
            gap = delta - x[:, :, None]
            part = weight / gap
            slope = part / gap
            f1, g1 = np.where(below, part, 0.0).sum(2), np.where(below, slope, 0.0).sum(2)
            f2, g2 = part.sum(2) - f1, slope.sum(2) - g1
            f = 1 + f1 + f2
            found |= (np.abs(f) <= 4 * m * EPS * (1 + np.abs(f1) + np.abs(f2))) | (hi - lo <= 2 * EPS * np.abs(x))
            if found.all():
                break
            lo, hi = np.where(f < 0, x, lo), np.where(f < 0, hi, x)
            d1, d2 = own - x, other - x
            c = 1 + f1 + f2 - g1 * d1 - g2 * d2
            a, b = c * (d1 + d2) + g1 * d1 * d1 + g2 * d2 * d2, d1 * d2 * f
            r = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            move = np.where(a > 0, 2 * b / (a + r), (a - r) / (2 * c))
            move = np.where(last, d1 + g1 * d1 * d1 / (1 + f1 - g1 * d1), move)
            new = x + move
            x = np.where(found, x, np.where((new > lo) & (new < hi), new, 0.5 * (lo + hi)))
    # Strictly inside its interval, so that the weights below are positive.
    return delta - x[:, :, None]


def update(d: np.ndarray, q: np.ndarray, v: np.ndarray, rho: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of ``q diag(d) q' + rho v v'`` for a stack; ``rho`` is not negative."""
    n, m = d.shape
    z = np.matmul(v[:, None, :], q)[:, 0] * np.sqrt(rho)[:, None]
    norm = np.sqrt((z * z).sum(1))
    tol = 8 * EPS * np.maximum(np.abs(d).max(1), norm * norm)[:, None]
    d, q = d.copy(), q.copy()
    same_poles(d, q, z, tol)
    z[np.abs(z) * norm[:, None] <= tol] = 0.0
    touched = z != 0
    if not touched.any():
        return d, q
    k = touched.sum(1)
    order = np.argsort(~touched, axis=1, kind="stable")
    d, z = np.take_along_axis(d, order, 1), np.take_along_axis(z, order, 1)
    q = np.take_along_axis(q, order[:, None, :], 2)
    live = np.arange(m) < k[:, None]
    beyond = np.abs(d).max(1) + norm * norm
    beyond = 2 * beyond + 1
    poles = np.where(live, d, beyond[:, None] * (1 + np.arange(m)))
    gap = roots(poles, z * z, k)
    both = live[:, :, None] & live[:, None, :]
    with np.errstate(all="ignore"):
        root_pole = np.where(both, -gap, 1.0)
        pole_pole = np.where(both, poles[:, :, None] - poles[:, None, :], 1.0)
        pole_pole[:, np.arange(m), np.arange(m)] = 1.0
        weights = np.sqrt(np.abs((root_pole / pole_pole).prod(1)))
        vectors = np.where(both, (np.copysign(weights, z)[:, None, :] / gap), 0.0)
    size = np.sqrt((vectors * vectors).sum(2, keepdims=True))
    good = (size > 0) & np.isfinite(size)
    vectors = np.where(good, vectors / np.where(good, size, 1.0), 0.0)
    still = ~live
    if still.any():
        vectors[:, np.arange(m), np.arange(m)] += still
    q = np.matmul(q, vectors.transpose(0, 2, 1))
    near = np.arange(m)
    d = np.where(live, poles - gap[:, near, near], d)
    order = np.argsort(d, axis=1, kind="stable")
    return np.take_along_axis(d, order, 1), np.take_along_axis(q, order[:, None, :], 2)


# -- spectra -------------------------------------------------------------------
@dataclass
class Spectra:
    """A stack of spectra: number of vectors, exact sums, means, eigenvalues and eigenvectors of the scatter."""

    n: np.ndarray
    total: np.ndarray
    mean: np.ndarray
    d: np.ndarray
    q: np.ndarray

    @classmethod
    def empty(cls, lanes: int, m: int) -> Spectra:
        eye = np.broadcast_to(np.eye(m), (lanes, m, m)).copy()
        return cls(np.zeros(lanes, np.int64), np.zeros((lanes, m), np.int64), np.zeros((lanes, m)), np.zeros((lanes, m)), eye)

    def add(self, x: np.ndarray) -> None:
        """One vector for each of the first ``len(x)`` lanes."""
        k = len(x)
        v = x - self.mean[:k]
        n = self.n[:k].astype(float)
        self.d[:k], self.q[:k] = update(self.d[:k], self.q[:k], v, n / (n + 1))
        self.mean[:k] += v / (n + 1)[:, None]
        self.n[:k] += 1
        self.total[:k] += x

    def at(self, which: slice) -> Spectra:
        return Spectra(self.n[which], self.total[which], self.mean[which], self.d[which], self.q[which])

    def joined(self, other: Spectra) -> Spectra:
        """Lane by lane, both spectra as one."""
        d, q = self.d, self.q
        for j in range(d.shape[1]):
            rho = np.maximum(other.d[:, j], 0)
            if rho.any():
                d, q = update(d, q, other.q[:, :, j], rho)
        n = self.n + other.n
        share = other.n / np.maximum(n, 1)
        apart = np.where((self.n > 0)[:, None], other.mean - self.mean, 0.0)
        d, q = update(d, q, apart, self.n * share)
        mean = np.where((self.n > 0)[:, None], self.mean + share[:, None] * (other.mean - self.mean), other.mean)
        return Spectra(n, self.total + other.total, mean, d, q)

    def folded(self) -> Spectra:
        """All lanes as one, by halves."""
        s = self
        while len(s.n) > 1:
            half = len(s.n) // 2
            two = s.at(slice(0, half)).joined(s.at(slice(half, 2 * half)))
            s = stacked([two, s.at(slice(2 * half, None))]) if len(s.n) % 2 else two
        return s

    def to_bytes(self) -> bytes:
        return b"".join(x[0].tobytes() for x in (self.n.reshape(-1, 1), self.total, self.mean, self.d, self.q))


def stacked(some: list[Spectra]) -> Spectra:
    return Spectra(*[np.concatenate([getattr(s, f) for s in some]) for f in ("n", "total", "mean", "d", "q")])


def from_bytes(raw: bytes, m: int) -> Spectra:
    whole = np.frombuffer(raw, np.int64, 1 + m)
    rest = np.frombuffer(raw, float, 2 * m + m * m, 8 * (1 + m))
    return Spectra(whole[:1].copy(), whole[None, 1:].copy(), rest[None, :m].copy(), rest[None, m : 2 * m].copy(), rest[2 * m :].reshape(1, m, m).copy())


# -- jobs ------------------------------------------------------------------------
def matrix(column: pa.Array, m: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, m)


def per_task(fit: DataFrame, start: Callable, feed: Callable, done: Callable) -> DataFrame:
    """``piece, state``: one row of each task with rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if len(batch):
                state = start() if state is None else state
                feed(state, batch.column("x"))
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([done(state)], pa.binary())], names=["piece", "state"])

    return fit.select("x").mapInArrow(run, "piece long, state binary")


def combined(pieces: DataFrame, join: Callable[[list[bytes]], bytes], fan_in: int = FAN_IN) -> bytes | None:
    """All states as one, in a tree in which a task meets ``fan_in`` of them."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("piece")
        return pa.table({"piece": [part.column("piece")[0].as_py() // fan_in], "state": pa.array([join(part.column("state").to_pylist())], pa.binary())})

    pieces = materialise(pieces, "states")
    width = (pieces.agg(F.max("piece")).first()[0] or 0) + 1
    while width > 1:
        pieces = materialise(pieces.groupBy(F.expr(f"piece div {fan_in}")).applyInArrow(run, "piece long, state binary"), "states")
        width = -(-width // fan_in)
    found = pieces.first()
    return bytes(found["state"]) if found else None


def spectrum(fit: DataFrame, m: int) -> Spectra | None:
    def feed(state: Spectra, column: pa.Array) -> None:
        x = matrix(column, m)
        for lo in range(0, len(x), LANES):
            state.add(x[lo : lo + LANES])

    pieces = per_task(fit, lambda: Spectra.empty(LANES, m), feed, lambda s: s.at(slice(0, max(1, int((s.n > 0).sum())))).folded().to_bytes())
    raw = combined(pieces, lambda some: stacked([from_bytes(s, m) for s in some]).folded().to_bytes())
    return from_bytes(raw, m) if raw else None


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """``x - total / n``, from whole numbers."""
    return (n * x - total).astype(float) / n


def moments(fit: DataFrame, n: int, total: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Covariance of the centred fit list projected on ``basis``, summed over all tasks."""
    m, k = basis.shape

    def feed(state: np.ndarray, column: pa.Array) -> None:
        y = centred(matrix(column, m), n, total) @ basis
        state += y.T @ y

    pieces = per_task(fit, lambda: np.zeros((k, k)), feed, lambda s: s.tobytes())
    raw = combined(pieces, lambda some: np.sum([np.frombuffer(s) for s in some], 0).tobytes())
    return np.frombuffer(raw).reshape(k, k) / n


@dataclass(frozen=True)
class Whitening:
    """Mean as ``total / n``, ``vectors`` [entries, components] by falling eigenvalue ``values``, and the covariance's trace."""

    n: int
    total: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The model of ``fit``, a table whose column ``x`` holds integer vectors of one length; None without variance."""
    first = fit.select(F.size("x").alias("m")).first()
    if first is None or first["m"] < 1:
        return None
    m = first["m"]
    found = spectrum(fit, m)
    n, total = int(found.n[0]), found.total[0]
    basis = np.linalg.qr(found.q[0])[0]
    values, turn = np.linalg.eigh(moments(fit, n, total, basis))
    values, vectors = values[::-1], (basis @ turn)[:, ::-1]
    trace = float(values.sum())
    k = int(((values > 8 * m * EPS * values[0]) & (values > 0)).sum())
    if not k:
        return None
    k = min(k, components)
    vectors = vectors[:, :k] / np.sqrt((vectors[:, :k] ** 2).sum(0))
    # Either sign is right: the largest entry is positive.
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])
    error = float(np.abs(moments(fit, n, total, vectors / np.sqrt(values[:k])) - np.eye(k)).max())
    return Whitening(n, total, vectors, values[:k].copy(), trace, error)


def usable(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """Rows with a usable vector, and its length."""
    c = F.col(vector)
    sound = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) <= LARGEST))
    kept = df.where(c.isNotNull() & sound)
    often = kept.groupBy(F.size(c).alias("m")).count().orderBy(F.desc("count"), F.desc("m")).first()
    m = often["m"] if often else 0
    return kept.where(F.size(c) == m), m


def scaled(vector: str) -> Column:
    """Entries in 64ths, rounded down, as positive whole numbers."""
    return F.transform(vector, lambda v: F.floor(v.cast("double") * 64).cast("long") + 1_000_000)


def deviations(x: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """Exact squared distances of ``n x`` from ``total``; null beyond a long."""
    apart = n * x - total
    if x.size and float(np.abs(apart).max()) ** 2 * x.shape[1] < 2.0**62:
        return (apart * apart).sum(1).tolist()
    exact = (sum(v * v for v in row) for row in apart.tolist())
    return [e if e < 1 << 63 else None for e in exact]


def whiten(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """``df`` with ``whitened`` (array, one entry a component) and ``deviation`` of usable rows, and the model.

    Every distinct scaled vector counts once in the fit. Without a model there are no rows.
    """
    names = unused(df, "whitened", "deviation")
    old, (x,) = df.columns, unused(df, "x")
    rows, m = usable(df, vector)
    fit = materialise(rows.select(scaled(vector).alias("x")).distinct(), "fit")
    model = fit_whitening(fit, components) if m else None
    schema = f"{ddl(df)}, `{names[0]}` array<double>, `{names[1]}` long"
    if model is None:
        return df.sparkSession.createDataFrame([], schema), None
    turn = model.vectors / np.sqrt(model.values)
    n, total, k = model.n, model.total, len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(x), m)
            y = centred(v, n, total) @ turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(v) + 1) * k, k), pa.int32()), pa.array(y.ravel()))
            made = [lists, pa.array(deviations(v, n, total), pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in old], *made], names=[*old, *names])

    return rows.withColumn(x, scaled(vector)).mapInArrow(run, schema), model


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@query("op11_whitening")
def whitening_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, model = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    if model is None:
        return spark.createDataFrame([], SCHEMA)
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    each = done.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return each.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("i")].alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
