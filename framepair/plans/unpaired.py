"""Preparation and splitting of decoupled RGB and IR frame sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framepair.functions import kernels
from framepair.operators import pairing, split
from framepair.operators.lookup import lookup
from framepair.sources import commits


def prepare(rgb: DataFrame, ir: DataFrame, width: int = 0, skip: int = 0, channels: int = 3) -> tuple[DataFrame, DataFrame]:
    """Shrink RGB to the IR's angular sampling; IR frames are never resampled.

    Tables carry ``rec_id, name, height, width, px``. ``width = 0`` takes the
    width of each recording's first remaining IR frame. Undecodable frames
    (NULL sizes) are left out.
    """
    by = ["rec_id"]
    cut = lambda df: pairing.skip_first(df.select(*by, "name", "height", "width"), by, ["name"], skip)
    rgb_meta, ir_meta = cut(rgb), cut(ir)
    target = pairing.size_at_first(ir_meta, by).select(*by, F.col("width").alias("new_w"))
    meta = lookup(rgb_meta.select(*by, "name", "idx"), target, by, ["name"])
    if width > 0:
        meta = meta.withColumn("new_w", F.lit(width))
    frames = rgb.where(F.col("height").isNotNull()).drop("idx").join(meta, [*by, "name"])
    frames = frames.withColumn("new_h", kernels.height_for_width("height", "width", "new_w"))
    px = kernels.resize("px", "height", "width", "new_h", "new_w", "area", channels)
    small = frames.select(
        *by, "name", "idx", F.col("new_h").alias("height"), F.col("new_w").alias("width"),
        F.transform(px, lambda v: F.rint(v).cast("int")).alias("px"),
    )
    kept = ir.drop("idx").join(ir_meta.select(*by, "name", "idx"), [*by, "name"])
    return small, kept


def write_resumable(rgb: DataFrame, ir: DataFrame, path: str) -> None:
    """Frames that are not committed yet; read them with ``commits.read_committed``."""
    keys = ["rec_id", "name"]
    commits.append_missing(rgb, f"{path}/rgb", keys)
    commits.append_missing(ir, f"{path}/thermal", keys)


def split_domains(frames: DataFrame, val_frac: float, chunk: int = 200, skip: int = 0) -> DataFrame:
    """Both domains split by the same chunk rule but independently.

    ``frames`` has ``modality, name``; the first ``skip`` of each are dropped
    before chunks are counted.
    """
    kept = pairing.skip_first(frames, ["modality"], ["name"], skip).drop("idx") if skip else frames
    return split.chunk_split(kept, ["modality"], ["name"], val_frac, chunk)
