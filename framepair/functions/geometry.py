"""Homography arithmetic as Columns: matrices are ARRAY<ARRAY<DOUBLE>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)).cast("double")


def letterbox(rw, rh, tw, th) -> Column:
    """Uniform scale that fits one frame inside the other, centred."""
    rw, rh, tw, th = map(_d, (rw, rh, tw, th))
    s = F.least(tw / rw, th / rh)
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(
        F.array(s, zero, (tw - s * rw) / 2.0),
        F.array(zero, s, (th - s * rh) / 2.0),
        F.array(zero, zero, one),
    )


def project(h: Column, x, y) -> tuple[Column, Column]:
    """Image of a point under ``h``, with the perspective divide."""
    x, y = _d(x), _d(y)
    row = lambda i: h[i][0] * x + h[i][1] * y + h[i][2]
    w = row(2)
    return F.try_divide(row(0), w), F.try_divide(row(1), w)


def reprojection_error(h: Column, x, y, u, v) -> Column:
    px, py = project(h, x, y)
    return F.sqrt((px - _d(u)) * (px - _d(u)) + (py - _d(v)) * (py - _d(v)))


def auto_crop(h: Column, rw, rh, tw, th, margin: int = 2, smallest: int = 16) -> Column:
    """``[x, y, w, h]`` inside the warped footprint, or NULL when a side is too short."""
    rw, rh, tw, th = map(_d, (rw, rh, tw, th))
    right, bottom = rw - 1, rh - 1
    (ax, ay), (bx, by) = project(h, 0.0, 0.0), project(h, right, 0.0)
    (cx, cy), (dx, dy) = project(h, right, bottom), project(h, 0.0, bottom)
    x0 = F.greatest(F.lit(0), F.ceil(F.greatest(ax, dx)) + margin)
    y0 = F.greatest(F.lit(0), F.ceil(F.greatest(ay, by)) + margin)
    x1 = F.least(tw.cast("bigint"), F.floor(F.least(bx, cx)) - margin)
    y1 = F.least(th.cast("bigint"), F.floor(F.least(cy, dy)) - margin)
    box = F.array(*[c.cast("int") for c in (x0, y0, x1 - x0, y1 - y0)])
    return F.when((x1 - x0 >= smallest) & (y1 - y0 >= smallest), box)


def pad_amount(size: Column, multiple: int) -> Column:
    return F.pmod(F.lit(multiple) - size % multiple, F.lit(multiple))


def parallax(focal_px, baseline, depth) -> Column:
    """Pixel error left by one homography at range ``depth``."""
    return _d(focal_px) * _d(baseline) / _d(depth)
