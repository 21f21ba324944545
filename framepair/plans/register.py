"""Raw pairs to aligned, cropped and split frames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framepair.functions import kernels, pixels
from framepair.functions.color import luma
from framepair.functions.geometry import auto_crop, letterbox
from framepair.functions.alignment import Search
from framepair.operators import align, calibrate, pairing, split
from framepair.operators.lookup import lookup
from framepair.session import materialise


@dataclass(frozen=True)
class Registration:
    aligned: DataFrame
    records: DataFrame
    # Common frames of recordings without a calibration: ``rec_id, name, idx, reason``.
    rejects: DataFrame


def calibration_records(
    rgb: DataFrame,
    ir: DataFrame,
    mode: str,
    points: DataFrame | None = None,
    calib_frames: Sequence[int] = (0,),
    candidates: list[tuple[float, float, float]] | None = None,
    crop: Sequence[int] | None = None,
    crop_auto: bool = False,
    search: Search = Search(),
    placements: DataFrame | None = None,
) -> DataFrame:
    """One record per recording: ``mode, H, ecc_cc, crop, thermal_size, rgb_size``.

    Inputs are frame tables with ``rec_id, name, idx, height, width`` (and
    pixels for the search mode). The search mode finds an affine placement (``operators/align.py``) inside
    the limits of ``search``, or takes ``placements`` already found; with ``candidates`` it compares just these.
    """
    by = ["rec_id"]
    first = lambda df, m: pairing.size_at_first(df, by).select(*by, F.col("height").alias(f"{m}_h"), F.col("width").alias(f"{m}_w"))
    sizes = first(rgb, "rgb").join(first(ir, "ir"), by)
    if mode == "identity":
        found = sizes.select("rec_id", letterbox("rgb_w", "rgb_h", "ir_w", "ir_h").alias("H"), F.lit(None).cast("double").alias("ecc_cc"))
    elif mode == "manual":
        if points is None:
            raise ValueError("manual mode needs point correspondences")
        found = calibrate.fit_homography(points, by).withColumn("ecc_cc", F.lit(None).cast("double"))
    elif mode == "search" and candidates:
        pairs = calibration_pairs(rgb, ir, calib_frames)
        found = calibrate.search_alignment(pairs, by, candidates).select("rec_id", "H", F.col("cc").alias("ecc_cc"))
    elif mode == "search":
        if placements is None:
            placements = align.align_recordings(calibration_pairs(rgb, ir, calib_frames), by, search)
        found = placements.where(F.col("H").isNotNull()).select("rec_id", "H", F.col("cc").alias("ecc_cc"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    box = F.lit(None).cast("array<int>")
    if crop:
        box = F.array(*[F.lit(int(v)) for v in crop])
    elif crop_auto:
        box = auto_crop(F.col("H"), "rgb_w", "rgb_h", "ir_w", "ir_h")
    return sizes.join(found, "rec_id").select(
        "rec_id", F.lit(mode).alias("mode"), "H", "ecc_cc", box.alias("crop"),
        F.array("ir_w", "ir_h").alias("thermal_size"), F.array("rgb_w", "rgb_h").alias("rgb_size"),
    )


def calibration_pairs(rgb: DataFrame, ir: DataFrame, frames: Sequence[int], positions: DataFrame | None = None) -> DataFrame:
    """Grey frame pairs at the requested positions, clamped to each recording's last.

    ``positions`` (``rec_id, name, idx``) stands for the frames' own ``idx``. The names of the wanted frames are found first,
    so that pixels of others are not shuffled.
    """
    keys = ["rec_id", "name"]
    wanted = wanted_frames(rgb if positions is None else positions, frames).withColumnRenamed("idx", "frame")
    colour = F.when(F.col("channels") == 3, F.col("px"))
    grey = F.coalesce(luma(colour), F.col("px").cast("array<double>"))
    side = lambda df, m: df.select(
        *keys, grey.alias(f"{m}_px"), F.col("height").alias(f"{m}_h"), F.col("width").alias(f"{m}_w")
    ).join(wanted, keys, "left_semi")
    return side(rgb, "rgb").join(wanted, keys).join(side(ir, "ir"), keys).select(*keys, "frame", *[f"{m}_{c}" for m in ("rgb", "ir") for c in ("px", "h", "w")])


def wanted_frames(positions: DataFrame, frames: Sequence[int]) -> DataFrame:
    """``rec_id, name, idx`` of the requested positions, clamped to each recording's last.

    Who computes pixels joins these first: Spark computes the pixels below a join for all frames.
    """
    last = positions.groupBy("rec_id").agg(F.max("idx").alias("_last"))
    asked = F.explode(F.array(*[F.lit(int(i)).cast("bigint") for i in frames]))
    wanted = last.withColumn("_f", asked).select("rec_id", F.least("_f", "_last").alias("idx")).distinct()
    return materialise(positions.select("rec_id", "name", "idx").join(wanted, ["rec_id", "idx"]).select("rec_id", "name", "idx"), "wanted_frames")


def register(
    rgb: DataFrame, ir: DataFrame, mode: str = "identity", val_frac: float = 0.1, chunk: int = 200, **calibration
) -> Registration:
    """Warp RGB into IR geometry, crop both sides and assign the chunk split.

    ``idx`` is renumbered over the common names. The calibration record joins
    the *metadata*; each side's pixels are shuffled once, by name. Every common
    frame is in ``aligned`` or in ``rejects``.
    """
    keys = ["rec_id", "name"]
    common = pairing.common_names(rgb, ir, keys)
    # Names and positions only, read three times below.
    placed = materialise(split.chunk_split(common, ["rec_id"], ["name"], val_frac, chunk), "placed")
    re_idx = lambda df: df.drop("idx").join(placed.select(*keys, "idx"), keys)
    if mode == "search" and not calibration.get("candidates"):
        chosen = calibration_pairs(rgb, ir, calibration.get("calib_frames", (0,)), placed)
        found = align.align_recordings(chosen, ["rec_id"], calibration.get("search", Search()))
        calibration["placements"] = materialise(found, "placements")
    records = calibration_records(re_idx(rgb), re_idx(ir), mode, **calibration)
    meta = lookup(placed, records.select("rec_id", "H", "crop"), ["rec_id"], ["name"])
    a = rgb.select(*keys, F.col("px").alias("_a"), F.col("height").alias("_ah"), F.col("width").alias("_aw"))
    b = ir.select(*keys, F.col("px").alias("_b"), F.col("height").alias("ir_h"), F.col("width").alias("ir_w"))
    joined = meta.join(a, keys).join(b, keys)
    joined = joined.withColumn("_w", kernels.warp("_a", "_ah", "_aw", "H", "ir_h", "ir_w", channels=0))
    # Without a crop the window is the whole frame: both branches of a
    # conditional around a Python kernel would run for every row.
    whole = F.array(F.lit(0), F.lit(0), F.col("ir_w").cast("int"), F.col("ir_h").cast("int"))
    joined = joined.withColumn("_box", F.coalesce("crop", whole))
    x, y, w, h = (F.col("_box")[i] for i in range(4))
    cut = lambda px: pixels.crop(px, "ir_h", "ir_w", x, y, w, h, 0, "float")
    aligned = joined.select(
        *keys, "idx", "chunk_id", "split", cut("_w").alias("rgb_px"), cut("_b").alias("ir_px"),
        h.alias("height"), w.alias("width"),
    )
    return Registration(aligned, records, rejected(placed, records, mode, calibration.get("points"), calibration.get("placements")))


FAILED = {"identity": "no frame size", "manual": "no solvable sample", "search": "no placement correlates"}


def rejected(placed: DataFrame, records: DataFrame, mode: str, points: DataFrame | None, placements: DataFrame | None = None) -> DataFrame:
    """Frames whose recording has no calibration record, with the reason."""
    usable = records.where(F.col("H").isNotNull()).select(F.col("rec_id").alias("_rec"))
    left = placed.join(usable, F.col("rec_id") == F.col("_rec"), "left_anti").select("rec_id", "name", "idx")
    if placements is not None:
        found = lookup(left, placements.select("rec_id", "reason"), ["rec_id"], ["name"], "left")
        return found.select("rec_id", "name", "idx", F.coalesce("reason", F.lit(FAILED[mode])).alias("reason"))
    if mode != "manual":
        return left.withColumn("reason", F.lit(FAILED[mode]))
    given = points.groupBy("rec_id").agg(F.count(F.lit(1)).alias("_n"))
    why = given.join(calibrate.check_points(points, ["rec_id"]).select("rec_id", "reason"), "rec_id", "left")
    found = lookup(left, why, ["rec_id"], ["name"], "left")
    none = F.when(F.col("_n").isNull(), F.lit("no points"))
    return found.select("rec_id", "name", "idx", F.coalesce("reason", none, F.lit(FAILED[mode])).alias("reason"))
