"""Training-sample tables: one row per (frame, epoch) with fixed-size windows.

Every random choice is a hash of (name, epoch, seed), so a sample is the same
whatever partition or retry produces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framepair.functions import kernels, pixels
from framepair.functions.hashing import hash_uniform
from framepair.functions.names import stem
from framepair.functions.norm import ThermalNorm, interleaved_to_planes
from framepair.operators import pairing


def _whole(px: Column) -> Column:
    return F.transform(px, lambda v: F.rint(v).cast("int"))


def _window(df: DataFrame, px: str, h: str, w: str, size: int, channels: int, tag: str, seed: tuple, train: bool) -> DataFrame:
    """Cut and maybe mirror one side; records the window under ``<tag>_x/_y/_flip``."""
    x, y = pixels.window_origin(F.col(w), F.col(h), size, *seed, train=train)
    flip = hash_uniform(*seed, F.lit("flip")) < 0.5 if train else F.lit(False)
    df = df.select("*", x.alias(f"{tag}_x"), y.alias(f"{tag}_y"), flip.alias(f"{tag}_flip"))
    return _cut(df, px, h, w, f"{tag}_x", f"{tag}_y", f"{tag}_flip", size, channels)


def _cut(df: DataFrame, px: str, h: str, w: str, x: str, y: str, flip: str, size: int, channels: int) -> DataFrame:
    kind = "int" if channels == 3 else "double"
    window = pixels.crop(px, h, w, x, y, size, size, channels, kind)
    return df.withColumn(px, pixels.flip(window, size, size, channels, flip, kind))


def _jittered(df: DataFrame, px: str, seed: tuple, train: bool) -> DataFrame:
    if not train:
        return df
    apply, gain, bias = pixels.jitter_terms(*seed)
    df = df.select("*", apply.alias("_j"), gain.alias("_g"), bias.alias("_o"))
    return df.withColumn(px, pixels.jitter(px, F.col("_j"), F.col("_g"), F.col("_o"))).drop("_j", "_g", "_o")


def paired_samples(
    pairs: DataFrame,
    norm: ThermalNorm,
    load_size: int = 286,
    crop_size: int = 256,
    train: bool = True,
    temps: DataFrame | None = None,
    epoch: int = 0,
    seed: int = 0,
    depth: int = 8,
) -> DataFrame:
    """``name, epoch, a`` (RGB planes), ``b``, ``t`` and the window, from aligned pairs.

    ``pairs``: ``name, height, width, rgb_px`` (BGR), ``ir_px``; both sides
    share a size. ``load_size = 0`` keeps native resolution and only enlarges
    frames smaller than the crop.
    """
    df = pairs.withColumn("_b", norm.normalise("ir_px", depth))
    if load_size > 0:
        side = max(load_size, crop_size)
        nh, nw, method = F.lit(side), F.lit(side), "area"
    else:
        (nh, nw), method = kernels.at_least("height", "width", crop_size), "linear"
    df = df.withColumn("_nh", nh.cast("int")).withColumn("_nw", nw.cast("int"))
    df = df.withColumn("_a", _whole(kernels.resize("rgb_px", "height", "width", "_nh", "_nw", method, 3)))
    df = df.withColumn("_b", kernels.resize("_b", "height", "width", "_nh", "_nw", method, 1, "double"))
    ids = (F.col("name"), F.lit(epoch), F.lit(seed))
    df = _window(df, "_a", "_nh", "_nw", crop_size, 3, "crop", ids, train)
    df = _cut(df, "_b", "_nh", "_nw", "crop_x", "crop_y", "crop_flip", crop_size, 1)
    df = _jittered(df, "_a", ids, train)
    df = df.withColumn("stem", stem("name")).withColumn("_mean", pixels.array_mean("_b"))
    if temps is not None:
        df = pairing.attach_temperature(df, temps, norm, F.col("_mean"), ["name"])
    else:
        df = df.withColumn("t", F.col("_mean"))
    return df.select(
        F.col("stem").alias("name"), F.lit(epoch).alias("epoch"),
        interleaved_to_planes("_a", F.lit(crop_size), F.lit(crop_size)).alias("a"), F.col("_b").alias("b"), "t",
        F.struct(F.col("crop_x").alias("x"), F.col("crop_y").alias("y"), F.lit(crop_size).alias("size"), F.col("crop_flip").alias("flip")).alias("crop"),
    )


def unpaired_samples(
    rgb: DataFrame,
    ir: DataFrame,
    norm: ThermalNorm,
    crop_size: int,
    rgb_width: int = 0,
    train: bool = True,
    epoch: int = 0,
    seed: int = 0,
    depth: int = 8,
) -> DataFrame:
    """Decoupled samples: each RGB frame with a drawn (or cyclic) IR partner, ``t = 0``.

    ``rgb_width = 0`` scales RGB to the width of the first IR frame.

    Partners are matched on names alone. Each side is cut to its window
    before the sides meet: full RGB frames are never shuffled, full IR frames
    once.
    """
    partners = pairing.decoupled(rgb, ir, train, epoch, seed).select(F.col("rgb_name").alias("name"), "ir_name")
    ids = lambda tag: (F.col("name"), F.lit(epoch), F.lit(seed), F.lit(tag))
    a = rgb.select("name", F.col("px").alias("_a"), F.col("height").alias("_ah"), F.col("width").alias("_aw"))
    width = F.lit(rgb_width) if rgb_width > 0 else ir.agg(F.min_by("width", "name").alias("w")).scalar()
    a = a.withColumn("_nw", width.cast("int")).withColumn("_nh", kernels.height_for_width("_ah", "_aw", "_nw"))
    a = a.withColumn("_a", _whole(kernels.resize("_a", "_ah", "_aw", "_nh", "_nw", "area", 3)))
    a = _jittered(_grown_window(a, "_a", "_nh", "_nw", crop_size, 3, "a", ids("a"), train), "_a", ids("a"), train)
    b = ir.select(F.col("name").alias("ir_name"), F.col("px").alias("_b"), F.col("height").alias("_bh"), F.col("width").alias("_bw"))
    b = partners.join(b, "ir_name").withColumn("_b", norm.normalise("_b", depth))
    b = _grown_window(b, "_b", "_bh", "_bw", crop_size, 1, "b", ids("b"), train)
    return a.select("name", "_a").join(b.select("name", "ir_name", "_b"), "name").select(
        stem("name").alias("name"), stem("ir_name").alias("ir_name"), F.lit(epoch).alias("epoch"),
        interleaved_to_planes("_a", F.lit(crop_size), F.lit(crop_size)).alias("a"), F.col("_b").alias("b"), F.lit(0.0).alias("t"),
    )


def _grown_window(df: DataFrame, px: str, h: str, w: str, size: int, channels: int, tag: str, seed: tuple, train: bool) -> DataFrame:
    """Enlarge frames smaller than the window, then cut it."""
    gh, gw = kernels.at_least(h, w, size)
    df = df.withColumn("_gh", gh).withColumn("_gw", gw)
    grown = kernels.resize(px, h, w, "_gh", "_gw", "linear", channels, "double")
    df = df.withColumn(px, _whole(grown) if channels == 3 else grown)
    return _window(df, px, "_gh", "_gw", size, channels, tag, seed, train)
