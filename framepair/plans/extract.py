"""Two recordings to numbered, synchronised pairs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framepair.functions.names import frame_name
from framepair.operators import ordered, sync


@dataclass(frozen=True)
class Extraction:
    """``pairs``: ``by, n, name, k, t, rgb_id, rgb_t, ir_id, ir_t``; ``counters``: one row per recording."""

    pairs: DataFrame
    counters: DataFrame


def extract_pairs(
    rgb: DataFrame, ir: DataFrame, by: Sequence[str], spec: sync.SyncSpec, level: str | None = None, pixels: DataFrame | None = None
) -> Extraction:
    """Pair on the grid, drop frozen IR frames, number the rest.

    Frozen frames are recognised by ``level`` (a number per IR frame) or by
    ``pixels`` (``by, id, px``). Everything up to the numbering moves ids and
    times only.
    """
    by = list(by)
    if not by:
        one = lambda df: df.withColumn("_rec", F.lit(0)) if df is not None else None
        out = extract_pairs(one(rgb), one(ir), ["_rec"], spec, level, one(pixels))
        return Extraction(out.pairs.drop("_rec"), out.counters.drop("_rec"))
    accepted = sync.nearest_on_grid(rgb, ir, by, spec)
    if level:
        values = ir.select(*by, F.col("id").alias("ir_id"), level)
        accepted = accepted.join(values, [*by, "ir_id"])
    seg = ordered.segment(accepted, by, ["k"])
    if spec.static_below is None:
        marked = seg.withColumn("static", F.lit(False))
    elif level:
        marked = sync.mark_static(seg, by, level, spec.static_below)
    elif pixels is not None:
        marked = sync.mark_static_frames(seg, by, pixels, spec.static_below)
    else:
        raise ValueError("the static filter needs level or pixels")
    kept = ordered.renumber(marked.where(~F.col("static")), by, "n")
    sizes = sync.grid_sizes(spec, rgb, sync.shift_clock(ir, spec.offset_us), by)
    if spec.max_pairs:
        kept = kept.where(F.col("n") < spec.max_pairs)
        # The run ends at the sample that completes the quota.
        ends = kept.where(F.col("n") == spec.max_pairs - 1).select(*by, F.col("k").alias("_end"))
        sizes = sizes.join(ends, by, "left")
        sizes = sizes.withColumn("n_grid", F.coalesce(F.col("_end") + 1, "n_grid"))
        marked = marked.join(ends, by, "left").where(F.col("_end").isNull() | (F.col("k") <= F.col("_end"))).drop("_end")
        sizes = sizes.drop("_end")
    counts = marked.groupBy(*by).agg(
        F.count_if(~F.col("static")).alias("kept"), F.count_if("static").alias("dropped_static")
    )
    counters = sizes.join(counts, by, "left").select(
        *by,
        F.coalesce("kept", F.lit(0)).alias("kept"),
        F.coalesce("dropped_static", F.lit(0)).alias("dropped_static"),
        (F.col("n_grid") - F.coalesce("kept", F.lit(0)) - F.coalesce("dropped_static", F.lit(0))).alias("dropped_tol"),
    )
    cols = [*by, "n", frame_name(F.col("n")).alias("name"), "k", "t", "rgb_id", "rgb_t", "ir_id", "ir_t"]
    return Extraction(ordered.clean(kept).select(*cols), counters)
