"""Neighbourhood kernels over frame columns, as Arrow-batched UDFs.

Arithmetic is float64; results are stored as ``precision`` ("float" or
"double"). The batch handling is in ``functions.arrow``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from framepair.functions.arrow import Frames, dtype_of, frame_udf, groups, ints, kernel, lists, numbers

# The 5-tap smoothing before the gradient, and the score window.
SMOOTH5 = (1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16)
SSIM_TAPS, SSIM_SIGMA, SSIM_C1, SSIM_C2 = 11, 1.5, 0.01**2, 0.03**2
MSE_FLOOR = 1e-12


# -- numerics on [n, h, w, c] stacks --------------------------------------
def _convolve(x: np.ndarray, taps: np.ndarray, axis: int) -> np.ndarray:
    r = len(taps) // 2
    pad = [(0, 0)] * x.ndim
    pad[axis] = (r, r)
    x = np.pad(x, pad, mode="reflect")
    size = x.shape[axis] - 2 * r
    at = lambda i: x.take(range(i, i + size), axis=axis)
    return sum(t * at(i) for i, t in enumerate(taps))


def bell(sigma: float, reach: int) -> np.ndarray:
    """Weights of a normal density at whole steps up to ``reach`` from its centre, summing to 1."""
    half = np.exp(-0.5 * np.square(np.arange(reach + 1) / sigma))
    half /= half[0] + 2 * half[1:].sum()
    return np.concatenate([half[:0:-1], half])


def smooth(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """The same taps along rows and columns."""
    return _convolve(_convolve(x, taps, 2), taps, 1)


def blur_stack(x: np.ndarray, sigma: float) -> np.ndarray:
    return smooth(x, bell(sigma, max(1, round(3 * sigma)))) if sigma > 0 else x


def edge_stack(x: np.ndarray) -> np.ndarray:
    """Gradient magnitude of the smoothed frame, scaled to [0, 1] per frame."""
    taps = np.array(SMOOTH5)
    g = _convolve(_convolve(x, taps, 2), taps, 1)
    ramp, tent = np.array([-1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])
    gx = _convolve(_convolve(g, ramp, 2), tent, 1)
    gy = _convolve(_convolve(g, tent, 2), ramp, 1)
    m = np.sqrt(gx * gx + gy * gy)
    m = m - m.min(axis=(1, 2), keepdims=True)
    top = m.max(axis=(1, 2), keepdims=True)
    return np.divide(m, top, out=m, where=top > 0)


def linear_matrix(src: int, dst: int) -> np.ndarray:
    """Bilinear weights on pixel centres, clamped at the borders."""
    at = np.clip((np.arange(dst) + 0.5) * src / dst - 0.5, 0, src - 1)
    lo = np.floor(at).astype(int)
    hi = np.minimum(lo + 1, src - 1)
    m = np.zeros((dst, src))
    np.add.at(m, (np.arange(dst), lo), 1 - (at - lo))
    np.add.at(m, (np.arange(dst), hi), at - lo)
    return m


def area_matrix(src: int, dst: int) -> np.ndarray:
    """Overlap weights of each target cell on the source cells (shrinking)."""
    scale = src / dst
    left, right = np.arange(dst)[:, None] * scale, (np.arange(dst)[:, None] + 1) * scale
    cell = np.arange(src)[None, :]
    m = np.clip(np.minimum(right, cell + 1) - np.maximum(left, cell), 0, None)
    return m / m.sum(axis=1, keepdims=True)


def cell_matrix(src: int, dst: int) -> np.ndarray:
    """What an area resize becomes when a side grows: interpolation only where
    a target cell straddles two source cells."""
    scale = src / dst
    d = np.arange(dst)
    lo = np.floor(d * scale).astype(int)
    share = np.clip(d + 1 - (lo + 1) / scale, 0, None)
    share -= np.floor(share)
    m = np.zeros((dst, src))
    np.add.at(m, (d, lo), 1 - share)
    np.add.at(m, (d, np.minimum(lo + 1, src - 1)), share)
    return m


def resize_stack(x: np.ndarray, h: int, w: int, method: str) -> np.ndarray:
    if x.shape[1:3] == (h, w):
        return x
    if method == "linear":
        build = linear_matrix
    else:
        build = area_matrix if h <= x.shape[1] and w <= x.shape[2] else cell_matrix
    # One product per frame, so a frame's result does not depend on its batch.
    n, src_h, src_w, c = x.shape
    tall = np.matmul(build(src_h, h), x.reshape(n, src_h, src_w * c)).reshape(n, h, src_w, c)
    return np.matmul(build(src_w, w), tall)


def ssim_stack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean structural similarity per frame, from one filtering of all five local moments."""
    moments = np.concatenate([a, b, a * a, b * b, a * b], axis=3)
    first, second, square_a, square_b, product = np.split(smooth(moments, bell(SSIM_SIGMA, SSIM_TAPS // 2)), 5, axis=3)
    crossed = first * second
    energy = first**2 + second**2
    level = (2 * crossed + SSIM_C1) / (energy + SSIM_C1)
    structure = (2 * (product - crossed) + SSIM_C2) / (square_a + square_b - energy + SSIM_C2)
    return (level * structure).mean(axis=(1, 2, 3))


def pool_stack(x: np.ndarray) -> np.ndarray:
    """3x3 mean at stride 2, border cells averaging only what exists."""
    ones = np.ones((1, *x.shape[1:3], 1))
    def sums(z):
        z = np.pad(z, [(0, 0), (1, 1), (1, 1), (0, 0)])
        h, w = z.shape[1] - 2, z.shape[2] - 2
        return sum(z[:, dy : dy + h : 2, dx : dx + w : 2] for dy in range(3) for dx in range(3))
    return sums(x) / sums(ones)


def warp_stack(x: np.ndarray, matrix: np.ndarray, h: int, w: int) -> np.ndarray:
    """Inverse-mapped bilinear warp of a stack by one matrix, black outside."""
    inv = np.linalg.inv(matrix)
    v, u = np.mgrid[0:h, 0:w].astype(float)
    q = np.tensordot(inv, np.stack([u, v, np.ones_like(u)]), axes=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        sx, sy = q[0] / q[2], q[1] / q[2]
    sh, sw = x.shape[1:3]
    sx, sy = (np.clip(np.nan_to_num(s, nan=-2.0), -2.0, n + 2.0) for s, n in ((sx, sw), (sy, sh)))
    # Snap rounding noise so whole-pixel maps stay exact.
    sx, sy = (np.where(np.abs(s - np.rint(s)) < 1e-9, np.rint(s), s) for s in (sx, sy))
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = sx - x0, sy - y0
    out = np.zeros((len(x), h, w, x.shape[3]))
    for dy, wy in ((0, 1 - fy), (1, fy)):
        for dx, wx in ((0, 1 - fx), (1, fx)):
            yy, xx = y0 + dy, x0 + dx
            weight = wy * wx * ((yy >= 0) & (yy < sh) & (xx >= 0) & (xx < sw))
            out += x[:, np.clip(yy, 0, sh - 1), np.clip(xx, 0, sw - 1)] * weight[..., None]
    return out


# -- Column builders ------------------------------------------------------
def gaussian_blur(px, h, w, sigma: float, channels: int = 1, precision: str = "float") -> Column:
    """Separable blur with radius ``max(1, round(3 sigma))``; ``sigma <= 0`` is identity."""
    return frame_udf(lambda x: blur_stack(x, sigma), channels, precision)(px, h, w)


def edge_map(px, h, w, precision: str = "float") -> Column:
    return frame_udf(edge_stack, 1, precision)(px, h, w)


def pool2(px, h, w, channels: int = 1, precision: str = "float") -> Column:
    """One pyramid level down; the new size is ``ceil(size / 2)``."""
    return frame_udf(pool_stack, channels, precision)(px, h, w)


def resize(px, h, w, new_h, new_w, method: str = "linear", channels: int = 1, precision: str = "float") -> Column:
    """Resize to per-row target sizes; ``method`` is "linear" or "area"."""
    if method not in ("linear", "area"):
        raise ValueError(f"unknown resize method {method!r}")
    dtype = dtype_of(precision)

    def run(px: pa.Array, h: pa.Array, w: pa.Array, nh: pa.Array, nw: pa.Array) -> pa.Array:
        f, th, tw = Frames(px, h, w, channels), ints(nh), ints(nw)
        parts = []
        for rows in groups(f.ok & (th > 0) & (tw > 0), *f.shape, th, tw):
            out = resize_stack(f.stack(rows), int(th[rows[0]]), int(tw[rows[0]]), method)
            parts.append((rows, out.reshape(len(rows), -1)))
        return lists(len(px), parts, dtype)

    return kernel(run, f"array<{precision}>", grows=True)(px, h, w, new_h, new_w)


def warp(px, h, w, matrix, out_h, out_w, channels: int = 1, precision: str = "float") -> Column:
    """Warp into ``out_h x out_w`` by each row's matrix (source to target).

    ``channels = 0`` reads the channel count off each frame.
    """
    dtype = dtype_of(precision)

    def run(px: pa.Array, h: pa.Array, w: pa.Array, m: pa.Array, oh: pa.Array, ow: pa.Array) -> pa.Array:
        f, th, tw = Frames(px, h, w, channels), ints(oh), ints(ow)
        ok = f.ok & np.asarray(m.is_valid()) & (th > 0) & (tw > 0)
        mats = np.tile(np.eye(3).ravel(), (len(px), 1))
        mats[ok] = m.filter(pa.array(ok)).flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 9)
        # Frames of one recording share a matrix: map pixels once per distinct matrix.
        _, which = np.unique(mats, axis=0, return_inverse=True)
        parts = []
        for rows in groups(ok, *f.shape, th, tw, which.ravel()):
            r = rows[0]
            out = warp_stack(f.stack(rows), mats[r].reshape(3, 3), int(th[r]), int(tw[r]))
            parts.append((rows, out.reshape(len(rows), -1)))
        return lists(len(px), parts, dtype)

    return kernel(run, f"array<{precision}>", grows=True)(px, h, w, matrix, out_h, out_w)


def score_frames(pred, ph, pw, truth, gh, gw) -> Column:
    """``struct(l1, rmse, psnr, ssim)`` of two [0, 1] frames in one pass.

    A prediction of another size is resized to the truth first.
    """

    def run(pred: pa.Array, ph: pa.Array, pw: pa.Array, truth: pa.Array, gh: pa.Array, gw: pa.Array) -> pa.Array:
        p, g = Frames(pred, ph, pw), Frames(truth, gh, gw)
        n, parts = len(pred), {k: [] for k in ("l1", "rmse", "psnr", "ssim")}
        for rows in groups(p.ok & g.ok, *p.shape, *g.shape):
            b = g.stack(rows)
            a = resize_stack(p.stack(rows), b.shape[1], b.shape[2], "linear")
            d = a - b
            mse = (d * d).mean(axis=(1, 2, 3))
            parts["l1"].append((rows, np.abs(d).mean(axis=(1, 2, 3))))
            parts["rmse"].append((rows, np.sqrt(mse)))
            parts["psnr"].append((rows, 10 * np.log10(1.0 / np.maximum(mse, MSE_FLOOR))))
            parts["ssim"].append((rows, ssim_stack(a, b)))
        return pa.StructArray.from_arrays([numbers(n, v) for v in parts.values()], names=list(parts))

    return kernel(run, "struct<l1 double, rmse double, psnr double, ssim double>")(pred, ph, pw, truth, gh, gw)


def ssim(a, b, h, w) -> Column:
    def run(a: pa.Array, b: pa.Array, h: pa.Array, w: pa.Array) -> pa.Array:
        x, y = Frames(a, h, w), Frames(b, h, w)
        return numbers(len(a), [(r, ssim_stack(x.stack(r), y.stack(r))) for r in groups(x.ok & y.ok, *x.shape)])

    return kernel(run, "double")(a, b, h, w)


def correlation(a, b) -> Column:
    """Pearson r of two equal-length arrays, NULL when either is (nearly) constant."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        ones = pa.array(np.ones(len(a), np.int64))
        x = Frames(a, ones, pa.array(np.diff(np.asarray(a.offsets))))
        y = Frames(b, ones, pa.array(np.diff(np.asarray(b.offsets))))
        parts = []
        for rows in groups(x.ok & y.ok & (x.w == y.w), x.w):
            p, q = (f.stack(rows).reshape(len(rows), -1) for f in (x, y))
            p, q = p - p.mean(1, keepdims=True), q - q.mean(1, keepdims=True)
            sp, sq = np.sqrt((p * p).mean(1)), np.sqrt((q * q).mean(1))
            with np.errstate(divide="ignore", invalid="ignore"):
                r = (p * q).mean(1) / (sp * sq)
            parts.append((rows, np.where((sp < 1e-6) | (sq < 1e-6), np.nan, r)))
        return numbers(len(a), parts)

    return kernel(run, "double")(a, b)


def alignment_scores(rgb, rh, rw, ir, ih, iw, candidates: list[tuple[float, float, float]]) -> Column:
    """Correlation of IR edges with RGB edges of grey frames under each candidate placement.

    A candidate is ``(scale, dx, dy)`` about the IR centre, applied after the
    letterbox fit. Only pixels the warped frame covers are compared. Edge maps, of single precision, live as long as
    their piece of a batch: they are no column that another Python worker would have to read.
    """
    edges = lambda x: edge_stack(x).astype(np.float32).astype(np.float64)

    def run(a: pa.Array, ah: pa.Array, aw: pa.Array, b: pa.Array, bh: pa.Array, bw: pa.Array) -> pa.Array:
        x, y = Frames(a, ah, aw), Frames(b, bh, bw)
        parts = []
        for rows in groups(x.ok & y.ok, *x.shape, *y.shape):
            src, dst = edges(x.stack(rows)), edges(y.stack(rows))[..., 0]
            scores = [_edge_agreement(src, dst, placement_matrix(src.shape[1:3], dst.shape[1:], *c)) for c in candidates]
            parts.append((rows, np.stack(scores, axis=1)))
        out = lists(len(a), parts, np.float64)
        flat = pa.array(out.values.to_numpy(zero_copy_only=False), from_pandas=True)
        return pa.ListArray.from_arrays(out.offsets, flat, mask=out.is_null() if out.null_count else None)

    return kernel(run, "array<double>")(rgb, rh, rw, ir, ih, iw)


def placement_matrix(src_hw, dst_hw, scale: float, dx: float, dy: float) -> np.ndarray:
    (sh, sw), (h, w) = src_hw, dst_hw
    fit = min(w / sw, h / sh)
    k = scale * fit
    return np.array([[k, 0, (w - k * sw) / 2 + dx], [0, k, (h - k * sh) / 2 + dy], [0, 0, 1]])


def _edge_agreement(src, dst, matrix) -> np.ndarray:
    h, w = dst.shape[1:]
    inside = warp_stack(np.ones((1, *src.shape[1:])), matrix, h, w)[0, ..., 0] > 0.999
    if inside.sum() < 16:
        return np.full(len(dst), np.nan)
    p, q = warp_stack(src, matrix, h, w)[:, inside, 0], dst[:, inside]
    p, q = p - p.mean(1, keepdims=True), q - q.mean(1, keepdims=True)
    size = np.sqrt((p * p).sum(1) * (q * q).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(size > 1e-12, (p * q).sum(1) / size, np.nan)


# -- target sizes ---------------------------------------------------------
def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def height_for_width(h, w, width) -> Column:
    """Height that keeps the aspect at a new width: half-even, at least one."""
    return F.greatest(F.lit(1), F.rint(_col(h) * _col(width) / _col(w))).cast("int")


def capped_size(h, w, longest: int) -> tuple[Column, Column]:
    """Size after capping the long side: shrinks only, truncating."""
    h, w = _col(h), _col(w)
    s = F.lit(float(longest)) / F.greatest(h, w)
    fit = lambda v: F.when(s < 1, F.floor(v * s)).otherwise(v).cast("int")
    return fit(h), fit(w)


def at_least(h, w, size: int) -> tuple[Column, Column]:
    """Size after enlarging so that both sides reach ``size``; never shrinks."""
    h, w = _col(h), _col(w)
    short = F.least(h, w)
    s = F.lit(float(size)) / short
    fit = lambda v: F.when(short < size, F.greatest(F.lit(size), F.rint(v * s))).otherwise(v).cast("int")
    return fit(h), fit(w)


