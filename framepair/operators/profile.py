"""Profiles and reports over frame tables, splits, streams and training logs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framepair.functions.pixels import statistics
from framepair.operators import sync


def frame_profile(df: DataFrame, px: str, prefix: str = "", digits: int = 3) -> DataFrame:
    """Adds ``mean, std`` (population, rounded) and ``min, max`` of a pixel array."""
    whole = lambda k: F.col(f"_s.{k}").cast("int").alias(f"{prefix}{k}")
    real = lambda k: F.bround(f"_s.{k}", digits).alias(f"{prefix}{k}")
    return df.withColumn("_s", statistics(px)).select("*", real("mean"), real("std"), whole("min"), whole("max")).drop("_s")


def digest(content: Column | str) -> Column:
    return F.sha2(F.col(content) if isinstance(content, str) else content, 256)


def split_composition(manifest: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Pairs, first and last frame, mean and population sigma of the frame means."""
    return manifest.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"), F.min("frame").alias("first"), F.max("frame").alias("last"),
        F.avg("mean").alias("mean_of_means"), F.stddev_pop("mean").alias("sigma"),
    )


def session_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("session", "split").agg(F.count(F.lit(1)).alias("pairs"))


def histogram(frames: DataFrame, px: str, bins: int | None = None, by: Sequence[str] = (), depth: int = 8) -> DataFrame:
    """Normalised intensity histogram over ``bins`` levels, by default all of ``depth`` bits.

    Pixels are counted by Arrow batch and leave it as ``(by, bin, n)``, a row for each level that occurs; counts are
    combined before they are shuffled. Values outside, and missing ones, are counted
    under a NULL bin and are part of the total, so fractions show what is missing.
    """
    bins = bins or 1 << depth
    by = list(by)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in frames.select(*by).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("_px")
            values = column.values.slice(column.offsets[0].as_py(), column.offsets[-1].as_py() - column.offsets[0].as_py()) if len(batch) else column.values
            level = np.floor(values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
            # The last bin stands for all that lies outside.
            level = np.where((level >= 0) & (level < bins), level, bins).astype(np.int64)
            keys = list(zip(*[batch.column(c).to_pylist() for c in by], strict=True)) if by else [()] * len(batch)
            names: dict[tuple, int] = {}
            which = np.array([names.setdefault(k, len(names)) for k in keys], np.int64)
            of = np.repeat(which, np.diff(np.asarray(column.offsets)))
            slot, n = np.unique(of * (bins + 1) + level, return_counts=True)
            groups = list(names)
            columns = [pa.array([groups[g][i] for g in (slot // (bins + 1)).tolist()], batch.column(c).type) for i, c in enumerate(by)]
            found = (slot % (bins + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, mask=found == bins), pa.array(n.astype(np.int64))], names=[*by, "bin", "n"])

    counted = frames.where(F.col(px).isNotNull()).select(*by, F.col(px).alias("_px")).mapInArrow(run, ", ".join([*kinds, "bin int", "n long"]))
    counts = counted.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    # At most ``bins`` rows per group reach this window.
    total = F.sum("n").over(Window.partitionBy(*by))
    return counts.select(*by, "bin", "n", (F.col("n") / total).alias("fraction"))


def quantiles(hist: DataFrame, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by, n, quantiles``: the smallest levels that at least each share of the pixels does not exceed.

    Exact, from a histogram of all levels; values outside it are left out. NULL for a group with none inside.
    """
    inside = hist.where(F.col("bin").isNotNull())
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy(*by))
    ranked = inside.select(*by, "bin", upto.alias("_upto"), total.alias("_n"))
    least = [F.min(F.when(F.col("_upto") >= F.greatest(F.lit(1), F.ceil(F.lit(float(q)) * F.col("_n"))), F.col("bin"))) for q in shares]
    return ranked.groupBy(*by).agg(F.max("_n").alias("n"), F.array(*least).alias("quantiles"))


def saturation(hist: DataFrame, bins: int = 256) -> DataFrame:
    at = lambda b: F.coalesce(F.sum(F.when(F.col("bin") == b, F.col("fraction"))), F.lit(0.0))
    return hist.agg(at(0).alias("at_min"), at(bins - 1).alias("at_max"))


def session_profile(frames: DataFrame, session: str, mean: Column) -> DataFrame:
    """Mean and population sigma of the frame means per session."""
    return frames.groupBy(session).agg(
        F.count(F.lit(1)).alias("frames"), F.avg(mean).alias("mean"), F.stddev_pop(mean).alias("sigma")
    )


def stream_timing(packets: DataFrame, by: Sequence[str], gap_us: int, t: str = "t_us", tie: Sequence[str] = ("id",)) -> DataFrame:
    """Frames, span, effective rate, delta range and gaps of each stream."""
    d = sync.deltas(packets, by, t, tie)
    out = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("frames"), (F.max(t) - F.min(t)).alias("span_us"),
        F.min("delta_us").alias("delta_min_us"), F.max("delta_us").alias("delta_max_us"),
        F.avg("delta_us").alias("delta_mean_us"), F.count_if(F.col("delta_us") > gap_us).alias("gaps"),
    )
    rate = F.try_divide((F.col("frames") - 1) * F.lit(1e6), F.col("span_us"))
    return out.withColumn("fps", rate)


def clock_offset(packets: DataFrame, stream: str, a: str, b: str, by: Sequence[str] = (), t: str = "t_us") -> DataFrame:
    """Difference of the first and of the last shared-clock stamps of two streams, and the drift."""
    pick = lambda fn, s: fn(F.when(F.col(stream) == s, F.col(t)))
    out = packets.groupBy(*by).agg(
        (pick(F.min, b) - pick(F.min, a)).alias("offset_us"), (pick(F.max, b) - pick(F.max, a)).alias("end_offset_us")
    )
    return out.withColumn("drift_us", F.col("end_offset_us") - F.col("offset_us"))


def training_curves(iterations: DataFrame, epochs: DataFrame, iters_per_epoch: int) -> DataFrame:
    """Per epoch: iteration rows, mean terms on the [-1, 1] scale, validation error, seconds."""
    steps = iterations.withColumn("step", F.col("epoch").cast("bigint") * iters_per_epoch + F.col("it"))
    per = steps.groupBy("epoch").agg(
        F.count(F.lit(1)).alias("rows"), F.max("step").alias("last_step"),
        F.avg("D").alias("d"), F.avg("G_gan").alias("g_gan"), (F.avg("G_L1") / 100.0).alias("l1"),
    )
    return per.join(epochs, "epoch", "full_outer")


def run_counters(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """Kept, out-of-tolerance and static sample counts from a ``state`` column."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    return samples.groupBy(*by).agg(n("kept"), n("tolerance"), n("static"))
