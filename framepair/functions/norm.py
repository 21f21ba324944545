"""Intensity normalisation: relative 8-bit and radiometric 16-bit frames.

Every conversion exists per value (``*_value``) and per pixel array. All
arithmetic is DOUBLE, and integer outputs truncate rather than round.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from framepair.functions.arrow import frame_udf

# Names of the two modes, and below the constants of the radiometric camera.
MODES = ("rel8", "abs16")


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))


def _each(px: Column | str, fn) -> Column:
    return F.transform(px, fn)


@dataclass(frozen=True)
class ThermalNorm:
    """Normalisation settings; methods emit Columns.

    Defaults are the radiometric camera constants every stored dataset assumes.
    """

    mode: str = "rel8"
    raw_scale: float = 0.04
    raw_offset: float = -273.15
    tmin: float = -20.0
    tmax: float = 80.0

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, got {self.mode!r}")

    # -- settings ---------------------------------------------------------
    @property
    def celsius_span(self) -> float:
        return self.tmax - self.tmin

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> ThermalNorm:
        return cls(**values)

    def to_struct(self) -> Column:
        return F.struct(*[F.lit(v).alias(k) for k, v in self.to_dict().items()])

    # -- one value --------------------------------------------------------
    def celsius_to_norm(self, c: Column) -> Column:
        """Unclipped: a logged temperature may lie outside the imaging range."""
        return (c.cast("double") - self.tmin) / self.celsius_span * 2.0 - 1.0

    def norm_to_celsius(self, n: Column) -> Column:
        return (n.cast("double") + 1.0) / 2.0 * self.celsius_span + self.tmin

    def norm_value(self, raw: Column, depth: int | Column = 8) -> Column:
        """Raw count to [-1, 1]; 16-bit counts in rel8 drop to 8 bits first.

        ``depth`` may be a column, for tables that mix bit depths.
        """
        x = raw.cast("double")
        if self.mode == "abs16":
            return clip(self.celsius_to_norm(x * self.raw_scale + self.raw_offset), -1, 1)
        low = F.floor(x / 257.0).cast("double")
        if isinstance(depth, Column):
            x = F.when(depth > 8, low).otherwise(x)
        elif depth > 8:
            x = low
        return clip(x / 127.5 - 1.0, -1, 1)

    def uint8_value(self, n: Column) -> Column:
        return F.floor((clip(n.cast("double"), -1, 1) + 1.0) * 127.5).cast("int")

    def uint16_value(self, n: Column) -> Column:
        """Calibrated counts in abs16, a 16-bit stretch in rel8."""
        if self.mode == "abs16":
            counts = (self.norm_to_celsius(n) - self.raw_offset) / self.raw_scale
            return F.floor(clip(counts, 0, 65535)).cast("int")
        return F.floor((clip(n.cast("double"), -1, 1) + 1.0) * 32767.5).cast("int")

    # -- pixel arrays -----------------------------------------------------
    def normalise(self, px: Column | str, depth: int | Column = 8) -> Column:
        return _each(px, lambda x: self.norm_value(x, depth))

    def to_uint8(self, px: Column | str) -> Column:
        return _each(px, self.uint8_value)

    def to_uint16(self, px: Column | str) -> Column:
        return _each(px, self.uint16_value)


def to_unit(px: Column | str) -> Column:
    """[-1, 1] to [0, 1], the range scores are reported on."""
    return _each(px, lambda x: (x.cast("double") + 1.0) / 2.0)


def interleaved_to_planes(px: Column | str, h, w) -> Column:
    """BGR rows-of-pixels bytes to RGB planes in [-1, 1]."""
    to_planes = lambda x: np.moveaxis(x[..., ::-1], 3, 1) / 127.5 - 1.0
    return frame_udf(to_planes, 3, "double")(px, h, w)


def planes_to_interleaved(chw: Column | str, h, w) -> Column:
    """RGB planes in [-1, 1] to RGB rows-of-pixels bytes (clipped, truncated)."""

    def to_bytes(x: np.ndarray) -> np.ndarray:
        planes = x.reshape(len(x), 3, *x.shape[1:3])
        return np.floor((np.clip(np.moveaxis(planes, 1, 3), -1, 1) + 1.0) * 127.5)

    return frame_udf(to_bytes, 3, "int")(chw, h, w)
