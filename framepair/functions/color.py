"""Grey conversions and channel arithmetic over interleaved BGR arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from framepair.functions.arrow import flat_udf, frame_udf

# Luma weights in B, G, R order.
LUMA_BGR = (0.114, 0.587, 0.299)


def luma(px: Column | str) -> Column:
    """Weighted grey of a colour frame, unrounded."""
    return flat_udf(lambda v: v @ np.array(LUMA_BGR), 3, "double")(px)


def luma_uint8(px: Column | str) -> Column:
    return flat_udf(lambda v: np.rint(v @ np.array(LUMA_BGR)), 3, "int")(px)


def gray_mean(px: Column | str, channels: int = 3) -> Column:
    """Channel mean rounded half to even: exact for replicated grey."""
    return flat_udf(lambda v: np.rint(v.sum(axis=1) / channels), channels, "int")(px)


def channel_mean(px: Column | str) -> Column:
    return flat_udf(lambda v: v.sum(axis=1) / 3.0, 3, "double")(px)


def plane_mean(chw: Column | str, h, w) -> Column:
    """Mean over three planes (3 channels to 1)."""
    mean = lambda x: x.reshape(len(x), 3, -1).mean(axis=1)
    return frame_udf(mean, 3, "double")(chw, h, w)


def replicate(px: Column | str, channels: int = 3) -> Column:
    """One plane repeated as ``channels`` planes (1 channel to 3)."""
    return F.flatten(F.array_repeat(F.col(px) if isinstance(px, str) else px, channels))


def minmax_stretch(px: Column | str, h, w) -> Column:
    """Stretch to 0..255 and truncate; a constant frame becomes all zero."""

    def stretch(x: np.ndarray) -> np.ndarray:
        lo = x.min(axis=(1, 2, 3), keepdims=True)
        span = x.max(axis=(1, 2, 3), keepdims=True) - lo
        return np.floor(np.divide((x - lo) * 255.0, span, out=np.zeros_like(x), where=span > 0))

    return frame_udf(stretch, 1, "int")(px, h, w)


def with_plane(chw: Column | str, value: Column, size: Column) -> Column:
    """Append a constant plane of ``size`` pixels (a condition as an extra channel)."""
    planes = F.col(chw) if isinstance(chw, str) else chw
    return F.concat(planes.cast("array<double>"), F.array_repeat(value.cast("double"), size.cast("int")))


def drop_alpha(px: Column | str, channels: Column) -> Column:
    """Interleaved 1-, 3- or 4-channel bytes as 3-channel bytes."""
    px = F.col(px) if isinstance(px, str) else px
    quad = F.filter(px, lambda x, i: (i % 4) != 3)
    mono = F.flatten(F.transform(px, lambda x: F.array_repeat(x, 3)))
    return F.when(channels == 4, quad).when(channels == 1, mono).otherwise(px)
