"""A tree of already aligned session folders to named, checked and split pairs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framepair.functions import color, names, pixels
from framepair.operators import pairing, split
from framepair.operators.lookup import lookup
from framepair.session import materialise
from framepair.sources import images


@dataclass(frozen=True)
class SessionPlan:
    """``pairs``: ``session, suffix, file, idx, out_name, split, sizes, paths``;
    ``rejects``: ``session, suffix, file, reason, text``; ``counts`` per session."""

    pairs: DataFrame
    rejects: DataFrame
    counts: DataFrame


def plan_sessions(
    listing: DataFrame,
    rgb_prefix: str = "RGB",
    ir_prefix: str = "NIR",
    val_sessions: Sequence[str] | None = None,
    val_frac: float = 0.15,
    max_size_diff: int = 4,
    dry_run: bool = False,
) -> SessionPlan:
    """Pair, name, check and split a listing of ``path, height, width``.

    NULL sizes mean the file cannot be decoded. A dry run only needs ``path``
    and counts every twin, including ones a real run would reject.
    """
    dry = dry_run or "height" not in listing.columns
    # One row per folder pair, used by every step below.
    sessions = materialise(images.discover_sessions(listing, rgb_prefix, ir_prefix), "sessions")
    twice = images.duplicate_sessions(sessions).agg(F.count(F.lit(1)).alias("n"), F.min("session").alias("first")).first()
    if twice.n:
        raise ValueError(f"{twice.n} duplicate session names, {twice.first} first; images.duplicate_sessions lists them")
    folder = ["parent", "session", "suffix"]
    sizes = [] if dry else ["height", "width"]
    files = images.session_files(listing.select("path", *sizes), rgb_prefix, ir_prefix).join(sessions, folder, "left_semi")
    side = lambda m: files.where(F.col("modality") == m).select(
        *folder, "file", F.col("path").alias(f"{m}_path"), *[F.col(c).alias(f"{m}_{c[0]}") for c in sizes]
    )
    rgb, ir = side("rgb"), side("ir")
    order = names.numeric_order("file")
    keyed = rgb.select("*", *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    indexed = pairing.index_within(keyed, folder, [f"_o{i}" for i in range(len(order))]).drop(*[f"_o{i}" for i in range(len(order))])
    joined = indexed.join(ir, [*folder, "file"], "left")
    if not dry:
        joined = pairing.size_check(joined, max_size_diff)
    else:
        joined = joined.withColumn("reason", F.lit(None).cast("string"))
    reason = F.when(F.col("ir_path").isNull(), F.lit("no IR twin")).otherwise(F.col("reason"))
    joined = joined.withColumn("reason", reason).withColumn("suffix", names.clean_suffix("suffix"))
    assigned = split.choose_sessions(sessions, val_sessions, val_frac)
    # Names and sizes only; pairs, rejects and counts all read it.
    joined = materialise(lookup(joined, assigned, ["session"], ["file"]), "session-plan")
    named = names.session_frame_name("session", "suffix", F.col("idx"))
    pairs = joined.where(F.col("reason").isNull()).withColumn("out_name", named).drop("reason", "parent")
    text = pairing.reject_text(F.col("session"), F.col("suffix"), F.col("file"), F.col("reason"))
    rejects = joined.where(F.col("reason").isNotNull()).select("session", "suffix", "file", "reason", text.alias("text"))
    ok = F.col("reason").isNull()
    tally = joined.groupBy("session", "split").agg(F.count_if(ok).alias("pairs"), F.count_if(~ok).alias("skipped"))
    counts = assigned.join(tally, ["session", "split"], "left").fillna(0, ["pairs", "skipped"])
    return SessionPlan(pairs, rejects, counts)


def convert_pairs(pairs: DataFrame) -> DataFrame:
    """Crop both sides to their common size and reduce IR to one 8-bit channel.

    Adds ``rgb_px`` and ``ir_px`` from interleaved ``rgb_px, ir_px, ir_channels,
    ir_depth``; IR colour is averaged, deeper IR is stretched before cropping.
    """
    # Kernels see NULL for the frames they do not apply to.
    deeper = [color.gray_mean(F.when(F.col("ir_channels") == c, F.col("ir_px")), c) for c in (3, 4)]
    out = pairs.withColumn("_g", F.coalesce(*deeper, F.col("ir_px").cast("array<int>")))
    deep = F.when(F.col("ir_depth") > 8, F.col("_g"))
    out = out.withColumn("_g", F.coalesce(color.minmax_stretch(deep, "ir_h", "ir_w"), F.col("_g")))
    sizes = lambda a, b: (f"{a}_h", f"{a}_w", f"{b}_h", f"{b}_w")
    return out.select(
        *[c for c in pairs.columns if c not in ("rgb_px", "ir_px")],
        pixels.common_crop("rgb_px", *sizes("rgb", "ir"), channels=3).alias("rgb_px"),
        pixels.common_crop("_g", *sizes("ir", "rgb")).alias("ir_px"),
        F.least("rgb_h", "ir_h").alias("height"), F.least("rgb_w", "ir_w").alias("width"),
    )


def report(plan: SessionPlan) -> DataFrame:
    """Totals over all sessions by split."""
    return plan.counts.groupBy("split").agg(F.count(F.lit(1)).alias("sessions"), F.sum("pairs").alias("pairs"), F.sum("skipped").alias("skipped"))
