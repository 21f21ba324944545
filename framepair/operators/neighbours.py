"""Neighbouring frames of a recording compared where they lie, after one range shuffle of their pixels.

The table is range-partitioned and sorted by (recording, order). Inside a task each frame is compared
with the one before it, which is still at hand; only the first and the last frame of a task
keep their pixels, and the first is compared with the last of the task before. So pixels are shuffled once,
and two frames a task once more.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framepair.session import materialise

PART, HEAD, TAIL, HELD = "_part", "_head", "_tail", "_held"


def _moved(a: np.ndarray | None, b: np.ndarray | None) -> float | None:
    """Mean absolute difference; None if a frame is missing, empty or of another size."""
    if a is None or b is None or len(a) != len(b) or not len(a):
        return None
    return float(np.abs(a.astype(np.float64) - b).mean())


def _pixels(column: pa.Array) -> list[np.ndarray | None]:
    ends, valid = np.asarray(column.offsets), np.asarray(column.is_valid())
    values = column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] if ok else None for a, b, ok in zip(ends[:-1], ends[1:], valid, strict=True)]


def change(frames: DataFrame, by: Sequence[str], order: Sequence[str], px: str = "px", name: str = "change") -> DataFrame:
    """``frames`` without pixels, with the mean absolute difference to the recording's frame before.

    NULL on a recording's first frame, next to a frame without pixels, and between frames of
    different sizes. A NULL recording is one of its own. ``order`` should make rows distinct.
    """
    by, order = list(by), list(order)
    rest = [c for c in frames.columns if c != px]
    ranged = frames.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.select(*rest).schema)
    held = f"array<{frames.schema[px].dataType.elementType.simpleString()}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last_key, last_px, last_row, head = TaskContext.get().partitionId(), None, None, None, True
        for batch in batches:
            if not len(batch):
                continue
            keys = list(zip(*[batch.column(c).to_pylist() for c in by], strict=True)) if by else [()] * len(batch)
            frames_px = _pixels(batch.column(px))
            moved = []
            for key, p in zip(keys, frames_px, strict=True):
                moved.append(_moved(last_px, p) if key == last_key else None)
                last_key, last_px = key, p
            last_px = None if last_px is None else last_px.copy()
            heads = np.zeros(len(batch), bool)
            heads[0], head = head, False
            keep = pa.array([frames_px[i].tolist() if heads[i] and frames_px[i] is not None else None for i in range(len(batch))], batch.column(px).type)
            marks = [pa.array(np.full(len(batch), part)), pa.array(heads), pa.array(np.zeros(len(batch), bool)), keep, pa.array(moved, pa.float64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *marks], names=[*rest, PART, HEAD, TAIL, HELD, name])
            last_row = batch.slice(len(batch) - 1)
        if last_row is not None:
            keep = pa.array([None if last_px is None else last_px.tolist()], last_row.column(px).type)
            marks = [pa.array([part]), pa.array([False]), pa.array([True]), keep, pa.array([None], pa.float64())]
            yield pa.RecordBatch.from_arrays([*[last_row.column(c) for c in rest], *marks], names=[*rest, PART, HEAD, TAIL, HELD, name])

    marks = f"{PART} long, {HEAD} boolean, {TAIL} boolean, {HELD} {held}, `{name}` double"
    done = materialise(ranged.mapInArrow(run, f"{kinds}, {marks}"), "neighbours")
    # As many rows as tasks, without pixels: which task with rows is the one before.
    tails = done.where(TAIL)
    before = tails.select(PART, F.lag(PART).over(Window.orderBy(PART)).alias("_before"))
    heads = done.where(HEAD).join(before, PART)
    other = tails.select(F.col(PART).alias("_before"), F.col(HELD).alias("_other"), *[F.col(c).alias(f"_o_{c}") for c in by])
    met = heads.join(other, "_before", "left")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    comparable = same & (F.size(HELD) == F.size("_other")) & (F.size(HELD) > 0)
    diff = F.aggregate(F.zip_with(HELD, "_other", lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, d: s + d) / F.size(HELD)
    mended = met.select(*rest, F.when(F.col("_before").isNotNull() & comparable, diff).alias(name))
    return done.where(~F.col(TAIL) & ~F.col(HEAD)).select(*rest, name).unionByName(mended)
