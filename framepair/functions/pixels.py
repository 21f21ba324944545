"""Windows, mirrors, jitter, padding and pointwise arithmetic on frames.

Purely pointwise work stays in SQL lambdas; anything that addresses pixels by
position is an Arrow kernel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from framepair.functions.arrow import Frames, dtype_of, frame_udf, groups, ints, kernel, lists, numbers, offsets32
from framepair.functions.hashing import hash_uniform
from framepair.functions.norm import clip


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _i(x) -> Column:
    return _c(x).cast("int")


# -- windows --------------------------------------------------------------
def crop(px, height, width, x, y, w, h, channels: int = 1, kind: str = "double") -> Column:
    """Window ``[x, y, w, h]`` of each frame, clamped to the frame like a slice.

    ``channels = 0`` reads the channel count off each frame.
    """
    dtype = dtype_of(kind)

    def run(px: pa.Array, fh: pa.Array, fw: pa.Array, x: pa.Array, y: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
        f = Frames(px, fh, fw, channels)
        x0, y0 = np.clip(ints(x), 0, f.w), np.clip(ints(y), 0, f.h)
        cw, ch = np.clip(ints(w), 0, f.w - x0), np.clip(ints(h), 0, f.h - y0)
        ok = f.ok & np.asarray(x.is_valid())
        parts = []
        for rows in groups(ok, *f.shape, cw, ch):
            # One gather per shape; the window's corner differs by row.
            ys = y0[rows][:, None, None, None] + np.arange(ch[rows[0]])[:, None, None]
            xs = x0[rows][:, None, None, None] + np.arange(cw[rows[0]])[:, None]
            depth = f.c[rows[0]]
            at = (ys * f.w[rows[0]] + xs) * depth + np.arange(depth)
            parts.append((rows, f.values[(at + f.offsets[rows][:, None, None, None]).reshape(len(rows), -1)]))
        return lists(len(px), parts, dtype)

    return kernel(run, f"array<{kind}>")(_c(px), *map(_i, (height, width, x, y, w, h)))


def common_crop(px, height, width, other_height, other_width, channels: int = 1, kind: str = "int") -> Column:
    """Top-left window of the size both frames share."""
    w, h = F.least(_i(width), _i(other_width)), F.least(_i(height), _i(other_height))
    return crop(px, height, width, 0, 0, w, h, channels, kind)


def flip(px, height, width, channels: int = 1, when=True, kind: str = "double") -> Column:
    """Left-right mirror of the frames for which ``when`` holds."""
    dtype = dtype_of(kind)

    def run(px: pa.Array, h: pa.Array, w: pa.Array, on: pa.Array) -> pa.Array:
        f = Frames(px, h, w, channels)
        mirrored = ints(on)
        parts = []
        for rows in groups(f.ok, *f.shape, mirrored):
            stack = f.stack(rows)
            parts.append((rows, (stack[:, :, ::-1] if mirrored[rows[0]] else stack).reshape(len(rows), -1)))
        return lists(len(px), parts, dtype)

    return kernel(run, f"array<{kind}>")(_c(px), _i(height), _i(width), _c(when).cast("int"))


def window_origin(width, height, size: int, *seed, train: bool = True) -> tuple[Column, Column]:
    """Top-left of a ``size`` window: seeded in training, centred otherwise."""
    width, height = _i(width), _i(height)
    if not train:
        half = lambda n: F.floor((n - size) / 2).cast("int")
        return half(width), half(height)
    draw = lambda n, tag: F.floor(hash_uniform(*seed, F.lit(tag)) * (n - size + 1)).cast("int")
    return draw(width, "x"), draw(height, "y")


# -- photometric jitter ---------------------------------------------------
# Share of samples that are changed, and how far gain and bias go.
JITTER_SHARE, JITTER_GAIN, JITTER_BIAS = 0.8, 0.15, 15.0


def jitter_terms(*seed) -> tuple[Column, Column, Column]:
    """(apply?, gain, bias) of one sample: 80 % of samples, gain 1 +- 0.15, bias +- 15."""
    apply = hash_uniform(*seed, F.lit("jitter")) < JITTER_SHARE
    gain = F.lit(1.0) + (hash_uniform(*seed, F.lit("gain")) * 2.0 - 1.0) * JITTER_GAIN
    bias = (hash_uniform(*seed, F.lit("bias")) * 2.0 - 1.0) * JITTER_BIAS
    return apply, gain, bias


def jitter(px, apply: Column, gain: Column, bias: Column) -> Column:
    """Gain and bias on 0..255 values, clipped and truncated; untouched where not applied."""

    def run(px: pa.Array, on: pa.Array, gain: pa.Array, bias: pa.Array) -> pa.Array:
        offsets = np.asarray(px.offsets)
        sizes = np.diff(offsets)
        v = px.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64)
        each = lambda a: np.repeat(a.to_numpy(zero_copy_only=False), sizes)
        bent = np.floor(np.clip(v * each(gain) + each(bias), 0, 255))
        out = np.where(each(on), bent, v).astype(np.int32)
        mask = px.is_null() if px.null_count else None
        return pa.ListArray.from_arrays(offsets32(offsets - offsets[0]), pa.array(out), mask=mask)

    return kernel(run, "array<int>")(_c(px), apply, gain, bias)


# -- padding --------------------------------------------------------------
def reflect_positions(n: int, multiple: int) -> np.ndarray:
    """Source positions of a side padded up to a multiple by repeated reflection."""
    i = np.arange(n + (-n) % multiple)
    return (n - 1) - np.abs(i % max(2 * (n - 1), 1) - (n - 1))


def pad_reflect(px, height, width, multiple: int, channels: int = 1, kind: str = "double") -> Column:
    """Reflect right and bottom until both sides are multiples."""
    pad = lambda x: x[:, reflect_positions(x.shape[1], multiple)][:, :, reflect_positions(x.shape[2], multiple)]
    return frame_udf(pad, channels, kind)(_c(px), _i(height), _i(width))


def unpad(px, padded_height, padded_width, height, width, channels: int = 1) -> Column:
    return crop(px, padded_height, padded_width, 0, 0, width, height, channels)


# -- pointwise ------------------------------------------------------------
def abs_error(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x.cast("double") - y.cast("double")))


def subtract(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double"))


def recombine(base, detail) -> Column:
    """Base plus detail, clipped to [-1, 1]."""
    return F.zip_with(_c(base), _c(detail), lambda s, r: clip(s.cast("double") + r.cast("double"), -1, 1))


def array_mean(px) -> Column:
    px = _c(px)
    total = F.aggregate(px, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.try_divide(total, F.size(px))


def mean_abs_diff(a, b) -> Column:
    return array_mean(abs_error(a, b))


def statistics(px) -> Column:
    """``struct(mean, std, min, max)`` of each pixel array; the deviation is the population's."""

    def run(px: pa.Array) -> pa.Array:
        size = np.diff(np.asarray(px.offsets))
        f = Frames(px, pa.array(np.ones(len(px), np.int64)), pa.array(size))
        parts: dict[str, list] = {"mean": [], "std": [], "min": [], "max": []}
        for rows in groups(f.ok, f.w):
            flat = f.stack(rows).reshape(len(rows), -1)
            for name, found in parts.items():
                found.append((rows, getattr(flat, name)(axis=1)))
        return pa.StructArray.from_arrays([numbers(len(px), v) for v in parts.values()], names=list(parts))

    return kernel(run, "struct<mean double, std double, min double, max double>")(_c(px))
