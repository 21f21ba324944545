"""Incremental pairing and filtering on Structured Streaming.

A frame is offered to the grid samples within its tolerance and the nearest
offer per sample and stream is kept in an event-time aggregation. State is
bounded by open samples, and a sample is emitted once the watermark passes it.
Offers behind the watermark are late and dropped (resampling: frames, by cell): set ``delay`` to at least
the clock jitter between the two sources.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framepair.operators.sync import SyncSpec
from framepair.streaming import inorder


def _offered(frames: DataFrame, by: Sequence[str], spec: SyncSpec, side: int, delay: str, level: str | None = None) -> DataFrame:
    p, tol, start = float(spec.period_us), spec.tolerance, spec.start_us
    lo = F.greatest(F.ceil((F.col("t_us") - start - tol) / p).cast("bigint"), F.lit(0).cast("bigint"))
    hi = F.floor((F.col("t_us") - start + tol) / p).cast("bigint")
    ks = F.explode(F.when(lo <= hi, F.sequence(lo, hi)))
    df = frames.select(*by, "id", "t_us", (F.col(level) if level else F.lit(None)).cast("double").alias("level"), ks.alias("k"))
    t = F.lit(start) + F.col("k") * spec.period_us
    df = df.withColumns({"_gap": F.col("t_us") - t, "_m": F.lit(side), "sample_ts": F.timestamp_micros(t)})
    return df.select(*by, "k", "sample_ts", "_m", "_gap", "t_us", "id", "level").withWatermark("sample_ts", delay)


def _best(side: int) -> tuple[Column, Column]:
    """A sample's nearest frame at or after it and before it, of one stream.

    As in the batch form, frames with one time give the smallest id after a
    sample and the largest before it.
    """
    mine = lambda when: F.when((F.col("_m") == side) & when, F.struct("_gap", "t_us", "id", "level"))
    return F.min(mine(F.col("_gap") >= 0)).alias(f"_a{side}"), F.max(mine(F.col("_gap") < 0)).alias(f"_b{side}")


def _nearer(side: int, spec: SyncSpec) -> Column:
    """The nearer of the two, the earlier at equal distance; NULL after the end of the run.

    Frames past the end are offered like any other, because they move the watermark.
    A filter on ``k`` alone would be pushed below it and hold the last samples back.
    """
    after, before = F.col(f"_a{side}"), F.col(f"_b{side}")
    late = before["_gap"].isNull() | (after["_gap"] < -before["_gap"])
    found = F.when(late, after).otherwise(before)
    return found if spec.duration_us is None else F.when(F.col("k") <= spec.duration_us // spec.period_us, found)


def pair_streams(rgb: DataFrame, ir: DataFrame, by: Sequence[str], spec: SyncSpec, delay: str) -> DataFrame:
    """Streaming twin of ``sync.nearest_on_grid`` with the same output columns.

    ``t_us`` is time since the epoch. Watermarks are set per stream, so the
    slower stream decides when a sample is complete.
    """
    if spec.max_pairs or spec.static_below is not None:
        raise ValueError("a quota or a static filter needs extract_stream")
    return _paired(rgb, ir, by, spec, delay, None).drop("sample_ts", "level")


def _paired(rgb: DataFrame, ir: DataFrame, by: Sequence[str], spec: SyncSpec, delay: str, level: str | None) -> DataFrame:
    ir = ir.withColumn("t_us", F.col("t_us") - spec.offset_us)
    both = _offered(rgb, by, spec, 0, delay).unionByName(_offered(ir, by, spec, 1, delay, level))
    best = both.groupBy(*by, "sample_ts", "k").agg(*_best(0), *_best(1))
    best = best.withColumns({"_r": _nearer(0, spec), "_i": _nearer(1, spec)}).where(F.col("_r").isNotNull() & F.col("_i").isNotNull())
    return best.select(
        *by, "k", "sample_ts", F.unix_micros("sample_ts").alias("t"),
        F.col("_r.id").alias("rgb_id"), F.col("_r.t_us").alias("rgb_t"),
        F.col("_i.id").alias("ir_id"), F.col("_i.t_us").alias("ir_t"), F.col("_i.level").alias("level"),
    )


CELL_US = 60_000_000


def _in_cells(frames: DataFrame, by: Sequence[str], spec: SyncSpec, delay: str, cell_us: int) -> DataFrame:
    """Each frame once for every cell of time in which it is within the tolerance of a sample.

    ``k`` is the first such sample of the cell, ``at_us`` the time of the last.
    """
    p, tol, start = spec.period_us, spec.tolerance, spec.start_us
    lo = F.greatest(F.ceil((F.col("t_us") - start - tol) / float(p)).cast("bigint"), F.lit(0).cast("bigint"))
    hi = F.floor((F.col("t_us") - start + tol) / float(p)).cast("bigint")
    cell = lambda k: F.floor((k * p + start) / cell_us).cast("bigint")
    met = F.explode(F.when(lo <= hi, F.sequence(cell(lo), cell(hi))))
    df = frames.select(*by, "id", F.col("t_us").cast("bigint").alias("t_us"), lo.alias("_lo"), hi.alias("_hi"), met.alias("_cell"))
    begin = F.col("_cell") * cell_us - start
    df = df.withColumns({"k": F.greatest("_lo", F.ceil(begin / p).cast("bigint")), "_hi": F.least("_hi", F.ceil((begin + cell_us) / p).cast("bigint") - 1)})
    df = df.where("k <= _hi").select(*by, "id", F.col("id").isNotNull().alias("known"), "t_us", "k", (F.col("_hi") * p + start).cast("bigint").alias("at_us"))
    return inorder.with_watermark(df, "at_us", delay)


def resample(frames: DataFrame, by: Sequence[str], spec: SyncSpec, delay: str, cell_us: int = CELL_US) -> DataFrame:
    """One stream on the regular grid: nearest frame of each sample.

    Frames wait in cells of ``cell_us`` of sample time: state has rows for frames, not for samples. Samples come out when the
    watermark has passed their cell. A frame is kept once for each cell that its tolerance reaches, so cells are
    best some times as long as the tolerance.
    """
    by, p, start = list(by), spec.period_us, spec.start_us

    def fold(rows: pd.DataFrame, rec: np.ndarray, state: None) -> tuple[pd.DataFrame, None]:
        t, far = rows["t_us"].to_numpy(np.int64), np.iinfo(np.int64).max
        # The last sample that is not nearer to the next frame of the recording; at equal distance the earlier frame serves.
        # Of frames with one time the first serves what lies before them and the last what lies after.
        upto = np.append((t[:-1] + t[1:] - 2 * start) // (2 * p), far)
        first, last = inorder.ends(rec)
        lo = np.maximum(rows["k"].to_numpy(np.int64), np.where(first, 0, np.roll(upto, 1) + 1))
        hi = np.minimum((rows["at_us"].to_numpy(np.int64) - start) // p, np.where(last, far, upto))
        if spec.duration_us is not None:
            hi = np.minimum(hi, spec.duration_us // p)
        n = np.maximum(hi - lo + 1, 0)
        which = np.repeat(np.arange(len(rows)), n)
        k = np.arange(len(which)) - (np.cumsum(n) - n)[which] + lo[which]
        return rows[[*by, "id"]].iloc[which].assign(k=k, t=k * p + start, frame_t=t[which]), None

    rows = _in_cells(frames, by, spec, delay, cell_us)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in (*by, "id")]
    out = ", ".join([*kinds, "k bigint", "t bigint", "frame_t bigint"])
    done = inorder.fold_in_order(rows, by, ["at_us", "t_us", "known", "id"], fold, "", out, cell_us)
    return done.select(*by, "k", "t", "id", "frame_t")


def mark_static_stream(frames: DataFrame, by: Sequence[str], below: float, delay: str, cell_us: int = CELL_US) -> DataFrame:
    """Flags frames whose ``level`` barely moved since the recording's frame before.

    ``frames``: ``by, id BIGINT, t_us BIGINT, level DOUBLE``, in any order inside ``delay``; equal times
    are ordered by id. A recording's first frame is never static; a NULL level compares with nothing.
    """

    def fold(rows: pd.DataFrame, rec: np.ndarray, state: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        level = rows["level"].to_numpy(float)
        moved = np.abs(level - inorder.before(level, rec, state["level"].to_numpy(float)))
        return rows.assign(static=moved < below), pd.DataFrame({"level": level[inorder.ends(rec)[1]]})

    frames = frames.select(*by, F.col("id").cast("bigint").alias("id"), F.col("t_us").cast("bigint").alias("t_us"), F.col("level").cast("double").alias("level"))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in frames.schema]
    rows = inorder.with_watermark(frames, "t_us", delay)
    return inorder.fold_in_order(rows, by, ["t_us", "id"], fold, "level double", ", ".join([*fields, "static boolean"]), cell_us)


def extract_stream(rgb: DataFrame, ir: DataFrame, by: Sequence[str], spec: SyncSpec, delay: str, level: str | None = None, cell_us: int = CELL_US) -> DataFrame:
    """Streaming twin of ``plans.extract.extract_pairs``: numbered pairs up to the quota, without frozen frames.

    ``level`` names a number of each infrared frame by which frozen frames are known. Pairs come
    out when the watermark has passed their cell of ``cell_us``; numbers and names equal those of the batch form.
    """
    by = list(by)
    if spec.static_below is not None and not level:
        raise ValueError("the static filter needs a level")
    below, quota = spec.static_below, spec.max_pairs

    def fold(rows: pd.DataFrame, rec: np.ndarray, state: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        values, so_far = rows["level"].to_numpy(float), state["n"].fillna(0).to_numpy(np.int64)
        kept = np.ones(len(rows), bool)
        if below is not None:
            kept = ~(np.abs(values - inorder.before(values, rec, state["last"].to_numpy(float))) < below)
        first, last = inorder.ends(rec)
        upto = np.cumsum(kept)
        n = upto - (upto - kept)[first][rec] + so_far[rec]
        after = pd.DataFrame({"n": n[last], "last": values[last]})
        numbered = rows.assign(n=n - 1)[kept]
        if quota:
            numbered = numbered[numbered["n"] < quota]
        return numbered.assign(name=[f"{i:06d}.png" for i in numbered["n"]]), after

    pairs = _paired(rgb, ir, by, spec, delay, level)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema if f.name not in ("sample_ts", "level")]
    out = ", ".join([*kinds, "n bigint", "name string"])
    done = inorder.fold_in_order(pairs, by, ["t", "k"], fold, "n bigint, last double", out, cell_us)
    return done.select(*by, "n", "name", "k", "t", "rgb_id", "rgb_t", "ir_id", "ir_t")
