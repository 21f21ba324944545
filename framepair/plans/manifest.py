"""Building and verifying the pair manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framepair.functions.names import stem
from framepair.functions.pixels import array_mean
from framepair.operators import pairing, profile


def build(pairs: DataFrame) -> DataFrame:
    """The 12-column manifest from ``name, split, rgb_*, ir_*`` pixels and file bytes."""
    return profile.frame_profile(pairs, "ir_px", "thermal_").select(
        stem("name").alias("frame"), "split",
        F.col("ir_w").cast("int").alias("width"), F.col("ir_h").cast("int").alias("height"),
        F.concat(F.lit("uint"), F.col("ir_depth")).alias("thermal_dtype"),
        "thermal_mean", "thermal_std", "thermal_min", "thermal_max",
        F.bround(array_mean("rgb_px"), 3).alias("rgb_mean"),
        profile.digest("rgb_content").alias("rgb_sha256"), profile.digest("ir_content").alias("thermal_sha256"),
    )


def verify(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Per frame, whether a copy's two checksums agree with the manifest."""
    both = lambda df: df.withColumn("_d", F.concat_ws(":", "rgb_sha256", "thermal_sha256"))
    return pairing.compare_checksums(both(ours), both(theirs), "frame", "_d")
