"""Scoring a prediction set against ground truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framepair.functions import kernels
from framepair.functions.names import score_stem
from framepair.functions.norm import ThermalNorm, to_unit
from framepair.operators import scores


def score_pairs(pred: DataFrame, truth: DataFrame, norm: ThermalNorm, depth: int = 8, keep: Sequence[str] = ()) -> DataFrame:
    """Per-stem ``l1, rmse, psnr, ssim`` on [0, 1] from raw frames ``file, height, width, px``.

    A ``depth`` column, when a side has one, overrides the argument per frame.
    Both sides meet in one aggregation by cleaned stem that also keeps only
    the last file name of each side, so every frame is shuffled once and as
    stored; normalising happens after. ``keep`` names columns of ``truth`` that
    stay on its rows.
    """
    bits = lambda df: (F.col("depth") if "depth" in df.columns else F.lit(depth)).cast("int").alias("depth")
    kept = lambda df: [F.col(c) if df is truth else F.lit(None).cast(truth.schema[c].dataType).alias(c) for c in keep]
    frame = lambda df: F.struct("height", "width", bits(df), "px", F.struct(F.lit(True).alias("_"), *kept(df)).alias("_keep"))
    side = lambda df, m: df.select(score_stem("file").alias("stem"), "file", F.lit(m).alias("_m"), frame(df).alias("_f"))
    both = side(pred, 0).unionByName(side(truth, 1))
    last = lambda m: F.max_by("_f", F.when(F.col("_m") == m, F.col("file")))
    met = both.groupBy("stem").agg(last(0).alias("_p"), last(1).alias("_g"))
    met = met.where(F.col("_p").isNotNull() & F.col("_g").isNotNull())
    unit = lambda c: to_unit(norm.normalise(f"{c}.px", F.col(f"{c}.depth")))
    score = kernels.score_frames(unit("_p"), "_p.height", "_p.width", unit("_g"), "_g.height", "_g.width")
    rest = [F.col(f"_g._keep.{c}").alias(c) for c in keep]
    return met.select("stem", *rest, score.alias("_s")).select("stem", *keep, "_s.*")


def evaluate(pred: DataFrame, truth: DataFrame, norm: ThermalNorm, depth: int = 8, by: Sequence[str] = ()) -> DataFrame:
    """One metrics row (per value of the ``by`` columns of ``truth``): means of per-frame scores.

    No match at all is an error if ``by`` is empty, and no row otherwise.
    """
    out = scores.summarise(score_pairs(pred, truth, norm, depth, by), norm, by)
    failed = F.raise_error("no matching names between predictions and ground truth")
    return out.withColumn("n", F.when(F.col("n") > 0, F.col("n")).otherwise(failed.cast("bigint")))
