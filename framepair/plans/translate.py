"""Bulk translation, the regression translator, validation and the shortcut check.

A model is a picklable ``factory() -> model`` built once per task, where
``model(a, t)`` maps RGB planes ``[n, 3, h, w]`` and conditions ``[n]`` to
``[n, h, w]`` in [-1, 1]. A two-stage model is a factory of a pair
``(base, detail)``: ``base(a, t)`` and ``detail(a, base_output)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framepair.functions import color, kernels
from framepair.functions.arrow import Frames, dtype_of, groups
from framepair.functions.names import condition
from framepair.functions.norm import ThermalNorm
from framepair.functions.pixels import reflect_positions
from framepair.operators import sampling, scores
from framepair.operators.split import batches


def _run_model(model, a: np.ndarray, t: float) -> np.ndarray:
    cond = np.full(len(a), t)
    if isinstance(model, tuple):
        base, detail = model
        s = base(a, cond)
        return np.clip(s + detail(a, s), -1, 1)
    return model(a, cond)


def _translator(factory: Callable, multiple: int, precision: str):
    """UDF ``(bgr, h, w, conditions) -> one frame per condition``: pixels cross once per frame."""

    dtype = dtype_of(precision)

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = factory()
        for px, h, w, conds in batches:
            f = Frames(px, h, w, 3)
            wanted = conds.to_pylist()
            out: list = [None] * len(px)
            for rows in groups(f.ok, *f.shape):
                bgr = f.stack(rows)
                height, width = bgr.shape[1:3]
                planes = np.moveaxis(bgr[..., ::-1], 3, 1) / 127.5 - 1.0
                ys, xs = reflect_positions(height, multiple), reflect_positions(width, multiple)
                planes = planes[:, :, ys][:, :, :, xs]
                made: dict[float, np.ndarray] = {}
                for i, r in enumerate(rows):
                    for t in wanted[r]:
                        if t not in made:
                            made[t] = _run_model(model, planes, t)[:, :height, :width].reshape(len(rows), -1)
                    out[r] = [made[t][i].astype(dtype) for t in wanted[r]]
            yield pa.array(out, pa.list_(pa.list_(pa.from_numpy_dtype(dtype))))

    return F.arrow_udf(run, f"array<array<{precision}>>")


def translate(
    frames: DataFrame,
    factory: Callable,
    norm: ThermalNorm,
    conditions: Sequence[float] | None = None,
    max_size: int = 0,
    multiple: int = 1,
    precision: str = "float",
) -> DataFrame:
    """One prediction row per frame and condition: ``..., cond, cond_label, height, width, px``.

    ``frames`` has BGR ``px`` with ``height, width``; other columns pass
    through. Works unchanged on a streaming DataFrame.
    """
    keep = [c for c in frames.columns if c not in ("px", "height", "width")]
    if max_size:
        nh, nw = kernels.capped_size("height", "width", max_size)
        frames = frames.withColumn("_nh", nh).withColumn("_nw", nw)
        small = F.transform(kernels.resize("px", "height", "width", "_nh", "_nw", "area", 3), lambda v: F.rint(v))
        frames = frames.select(*keep, small.alias("px"), F.col("_nh").alias("height"), F.col("_nw").alias("width"))
    wanted = F.array(*[F.struct(
        F.lit(c).cast("double").alias("cond"),
        condition(norm, F.lit(c).cast("double"))[0].alias("t"),
        condition(norm, F.lit(c).cast("double"))[1].alias("label"),
    ) for c in (conditions or [None])])
    df = frames.withColumn("_c", wanted)
    made = _translator(factory, multiple, precision)("px", "height", "width", F.transform("_c", lambda c: c.t))
    df = df.select(*keep, "height", "width", F.explode(F.arrays_zip(F.col("_c").alias("c"), made.alias("px"))).alias("_z"))
    return df.select(
        *keep, F.col("_z.c.cond").alias("cond"), F.col("_z.c.label").alias("cond_label"), "height", "width", F.col("_z.px").alias("px")
    )


# -- regression translator ------------------------------------------------
class LinearModel:
    """Per-pixel linear translator; picklable, so instances serve as factories' results."""

    def __init__(self, weights: Sequence[float], bias: float):
        self.weights, self.bias = np.asarray(weights, float), float(bias)

    def _features(self, a: np.ndarray, extra: np.ndarray) -> np.ndarray:
        plane = np.broadcast_to(extra.reshape(len(a), 1, *([1, 1] if extra.ndim == 1 else extra.shape[1:])), (len(a), 1, *a.shape[2:]))
        return np.concatenate([a, plane], axis=1)[:, : len(self.weights)]

    def __call__(self, a: np.ndarray, extra: np.ndarray) -> np.ndarray:
        return np.tensordot(self.weights, self._features(a, extra), axes=(0, 1)) + self.bias


def pixel_rows(samples: DataFrame, target: str) -> DataFrame:
    """``r, g, b, t, y`` per pixel from sample rows ``a`` (planes), ``t``, ``target``."""
    n = F.size(target)
    planes = [F.slice("a", n * k + 1, n).alias(c) for k, c in enumerate("rgb")]
    z = samples.select("t", F.arrays_zip(*planes, F.col(target).alias("y")).alias("_z"))
    cast = [F.col(f"_p.{c}").cast("double").alias(c) for c in ("r", "g", "b", "y")]
    return z.select(F.col("t").cast("double").alias("t"), F.explode("_z").alias("_p")).select("t", *cast)


# Columns of the moments: three planes, the condition, one, the target's base and its detail.
MOMENTS = ("r", "g", "b", "t", "one", "base", "detail")
RIDGE = 1e-6


def moments(samples: DataFrame, sigma: float = 0.0, size: int = 0) -> np.ndarray:
    """Sums of products of all pairs of ``MOMENTS`` over all pixels, from one scan of ``a, b, t``.

    A batch of samples becomes one small matrix where it is read; matrices are summed entry by entry. The
    base is the target blurred by ``sigma`` (square targets of ``size``), the detail what is left;
    without a blur the base is the target. Samples with a missing or non-finite value are left out.
    """
    k = len(MOMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            one, n = pa.array(np.ones(len(batch), np.int64)), pa.array(np.diff(np.asarray(batch.column("b").offsets)))
            target = Frames(batch.column("b"), one, n)
            planes = Frames(batch.column("a"), pa.array(np.full(len(batch), 3)), n)
            t = batch.column("t").cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            for rows in groups(target.ok & planes.ok & np.isfinite(t), target.w):
                y, x = target.stack(rows)[:, 0, :, 0], planes.stack(rows)[:, :, :, 0]
                base = kernels.blur_stack(y.reshape(len(rows), size, size, 1), sigma).reshape(y.shape) if sigma > 0 else y
                z = np.stack([x[:, 0], x[:, 1], x[:, 2], np.broadcast_to(t[rows][:, None], y.shape), np.ones_like(y), base, y - base]).reshape(k, -1)
                z = z[:, np.repeat(np.isfinite(z.reshape(k, len(rows), -1)).all((0, 2)), y.shape[1])]
                total += z @ z.T
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])

    parts = samples.select("a", "b", F.col("t").cast("double").alias("t")).mapInArrow(run, "sums array<double>")
    # One row of k * k numbers a task, combined before they are shuffled.
    summed = parts.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(k * k)
    for r in summed:
        out[r["i"]] = r["v"]
    return out.reshape(k, k)


def solve(gram: np.ndarray, cross: np.ndarray, n: float) -> LinearModel:
    """Least squares from sums of products; the last feature is the constant one.

    Features are centred and scaled before a small ridge, so collinear ones share their weight.
    """
    mean, target = gram[:-1, -1] / n, cross[-1] / n
    spread = gram[:-1, :-1] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(spread), 0))
    scale = np.where(scale > 1e-12, scale, 1.0)
    inner = spread / np.outer(scale, scale) + RIDGE * np.eye(len(mean))
    weights = np.linalg.solve(inner, (cross[:-1] / n - mean * target) / scale) / scale
    return LinearModel(weights, target - weights @ mean)


def fit_single(samples: DataFrame) -> Callable:
    """Least-squares RGB to IR: a convex stand-in for the direct translator."""
    # The condition takes no part, so it may be missing.
    g = moments(samples.withColumn("t", F.lit(0.0)))
    at = [0, 1, 2, 4]
    model = solve(g[np.ix_(at, at)], g[at, 5], g[4, 4])
    return lambda: model


def fit_two_stage(samples: DataFrame, sigma: float, size: int) -> Callable:
    """Base from (RGB, condition), detail from (RGB, *predicted* base).

    The predicted base is linear in what the moments hold, so the second stage needs no second scan.
    """
    g = moments(samples, sigma, size)
    at = [0, 1, 2, 3, 4]
    first = solve(g[np.ix_(at, at)], g[at, 5], g[4, 4])
    turn = np.zeros((5, 5))
    turn[[0, 1, 2, 4], [0, 1, 2, 4]] = 1.0
    turn[3] = [*first.weights, first.bias]
    second = solve(turn @ g[np.ix_(at, at)] @ turn.T, turn @ g[at, 6], g[4, 4])
    return lambda: (first, second)


# -- checks ---------------------------------------------------------------
def validate(frames: DataFrame, truth: DataFrame, factory: Callable, norm: ThermalNorm, batch_size: int, max_batches: int) -> DataFrame:
    """Capped validation error of a translator: frames beyond the cap never reach the model.

    ``frames``: ``name, height, width, px`` (BGR) and optional ``t``; ``truth``: ``name, b``.
    """
    order = batches(frames.select("name"), [], ["name"], batch_size, drop_last=False).select("name", "batch_id")
    if max_batches:
        order = order.where(F.col("batch_id") < max_batches)
    made = translate(frames.join(order, "name"), factory, norm)
    both = made.join(truth.select("name", "b"), "name")
    per = both.groupBy("batch_id").agg(F.avg(scores.l1("px", "b")).alias("l1"), F.count(F.lit(1)).alias("n"))
    return scores.capped_validation(per, max_batches, norm)


def shortcut_check(
    frames: DataFrame, real: DataFrame | None, factory: Callable, norm: ThermalNorm, n: int = 24, max_size: int = 640, seed: int = 0
) -> DataFrame:
    """Sampled frames' correlation of output (and of real IR) with luminance, and the verdict."""
    chosen = sampling.take_random(frames.select("name"), "name", n, seed)
    df = frames.join(chosen, "name", "left_semi")
    nh, nw = kernels.capped_size("height", "width", max_size)
    df = df.withColumn("_nh", nh).withColumn("_nw", nw)
    small = F.transform(kernels.resize("px", "height", "width", "_nh", "_nw", "area", 3), lambda v: F.rint(v))
    df = df.select("name", small.alias("px"), F.col("_nh").alias("height"), F.col("_nw").alias("width"))
    df = df.withColumn("lum", color.luma_uint8("px"))
    r = kernels.correlation
    made = translate(df, factory, norm).select("name", "lum", "height", "width", r("lum", "px").alias("r_gen"))
    if real is None:
        made = made.withColumn("r_real", F.lit(None).cast("double"))
    else:
        twin = real.select("name", F.col("px").alias("_t"), F.col("height").alias("_th"), F.col("width").alias("_tw"))
        made = made.join(twin, "name", "left")
        made = made.withColumn("r_real", r("lum", kernels.resize("_t", "_th", "_tw", "height", "width", "linear")))
    out = made.agg(F.count(F.lit(1)).alias("frames"), F.avg("r_gen").alias("r_gen"), F.avg("r_real").alias("r_real"))
    return out.withColumn("verdict", scores.verdict(F.col("r_gen")))
