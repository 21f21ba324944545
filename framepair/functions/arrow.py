"""Arrow batches of frames: the plumbing under every vectorised kernel.

A frame column is a row-major pixel array next to its height and width. A
kernel takes one Arrow batch, groups its rows by frame shape and works on
``[rows, height, width, channels]`` stacks, so there is no per-pixel and, for
equal shapes, no per-row Python.

These are used wherever an operator would otherwise index an array inside a
SQL lambda: Spark evaluates whatever a lambda captures again for every
element, which is quadratic in the frame size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


PIECE, GROWN = 2 << 20, 8 << 20  # bytes of input that a kernel works on at once, and of output that leaves a growing one at once


def _pieces(columns: tuple[pa.Array, ...]) -> Iterator[tuple[pa.Array, ...]]:
    """A batch in runs of rows of about ``PIECE`` bytes: temporaries do not grow with the batch."""
    n = len(columns[0])
    rows = max(1, PIECE * n // max(1, sum(c.nbytes for c in columns)))
    for at in range(0, n, rows):
        yield tuple(c.slice(at, rows) for c in columns)


def _whole(run: Callable) -> Callable:
    def all_pieces(*columns: pa.Array) -> pa.Array:
        out = [run(*piece) for piece in _pieces(columns)]
        return out[0] if len(out) == 1 else pa.concat_arrays(out) if out else run(*columns)

    return all_pieces


def _growing(run: Callable) -> Callable:
    def by_output(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        rows = 1
        for columns in batches:
            at, n = 0, len(columns[0])
            while at < n:
                out = run(*[c.slice(at, rows) for c in columns])
                at += len(out)
                # Twice as many rows at most: the next ones may be larger.
                rows = max(1, min(2 * rows, GROWN * len(out) // max(1, out.nbytes)))
                yield out

    return by_output


def kernel(run: Callable, returns: str, grows: bool = False) -> Callable[..., Column]:
    """An Arrow UDF that also takes column names and plain numbers.

    Spark bounds the bytes of a batch's input. ``run`` gets a batch piece by piece, so that its temporaries are
    bounded as well. A kernel of two columns or more whose results may be larger than its input ``grows``: its results leave
    as batches of bounded size, which costs a Python worker of its own.
    """
    udf = F.arrow_udf(_growing(run) if grows else _whole(run), returns)
    as_col = lambda x: F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)
    return lambda *args: udf(*[as_col(a) for a in args])


def ints(a: pa.Array) -> np.ndarray:
    return a.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


class Frames:
    """The pixel lists of one batch, sliceable into equal-shape stacks.

    ``channels = 0`` takes each row's channel count from its length. A row
    whose length does not fit its size is left out, like a missing frame.
    """

    def __init__(self, px: pa.Array, h: pa.Array, w: pa.Array, channels: int = 1):
        ends = np.asarray(px.offsets)
        self.offsets, length = ends[:-1] - ends[0], np.diff(ends)
        # A piece of a batch shares the values of the whole batch.
        values = px.values.slice(ends[0], ends[-1] - ends[0])
        self.values = (values.fill_null(np.nan) if values.null_count else values).to_numpy(zero_copy_only=False)
        self.h, self.w = ints(h), ints(w)
        area = self.h * self.w
        self.ok = np.asarray(px.is_valid()) & (self.h > 0) & (self.w > 0)
        self.c = np.where(self.ok, length // np.maximum(area, 1), 0) if channels == 0 else np.full(len(px), channels)
        self.ok &= (length == area * self.c) & (self.c > 0)

    @property
    def shape(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Grouping keys of equal-shape rows."""
        return self.h, self.w, self.c

    def stack(self, rows: np.ndarray) -> np.ndarray:
        h, w, c = (int(k[rows[0]]) for k in self.shape)
        take = self.offsets[rows][:, None] + np.arange(h * w * c)
        return self.values[take].astype(np.float64).reshape(len(rows), h, w, c)


def groups(ok: np.ndarray, *keys: np.ndarray):
    """Row numbers of every distinct key combination among the usable rows."""
    rows = np.flatnonzero(ok)
    if not len(rows):
        return
    table = np.stack([k[rows] for k in keys], axis=1)
    _, which = np.unique(table, axis=0, return_inverse=True)
    which = which.ravel()
    order = np.argsort(which, kind="stable")
    for part in np.split(rows[order], np.flatnonzero(np.diff(which[order])) + 1):
        yield part


def offsets32(offsets: np.ndarray) -> pa.Array:
    """List offsets of a batch; one that grew past what a list column holds is an error, not wrapped."""
    if len(offsets) and offsets[-1] >= 1 << 31:
        raise ValueError("a batch holds 2^31 values or more: lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.array(offsets.astype(np.int32))


def lists(n: int, parts: list[tuple[np.ndarray, np.ndarray]], dtype) -> pa.Array:
    """Assemble per-group 2-D results into one list array in row order."""
    lengths = np.zeros(n, np.int64)
    missing = np.ones(n, bool)
    for rows, flat in parts:
        lengths[rows], missing[rows] = flat.shape[1], False
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    values = np.empty(offsets[-1], dtype)
    for rows, flat in parts:
        values[offsets[rows][:, None] + np.arange(flat.shape[1])] = flat
    mask = pa.array(missing) if missing.any() else None
    return pa.ListArray.from_arrays(offsets32(offsets), pa.array(values), mask=mask)


def numbers(n: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """Assemble per-group scalars; NaN becomes NULL."""
    out = np.full(n, np.nan)
    for rows, v in parts:
        out[rows] = v
    return pa.array(out, from_pandas=True)


def dtype_of(precision: str):
    return {"int": np.int32, "float": np.float32, "double": np.float64}[precision]


def frame_udf(fn: Callable[[np.ndarray], np.ndarray], channels: int, precision: str):
    """UDF ``(px, h, w) -> px`` from a function on equal-shape stacks."""
    dtype = dtype_of(precision)

    def run(px: pa.Array, h: pa.Array, w: pa.Array) -> pa.Array:
        f = Frames(px, h, w, channels)
        parts = [(rows, fn(f.stack(rows)).reshape(len(rows), -1)) for rows in groups(f.ok, *f.shape)]
        return lists(len(px), parts, dtype)

    return kernel(run, f"array<{precision}>")


def flat_udf(fn: Callable[[np.ndarray], np.ndarray], per: int, returns: str):
    """UDF ``(px) -> px`` from a function on ``[values / per, per]`` of the whole batch.

    ``fn`` returns one value per row of its input.
    """
    dtype = dtype_of(returns)

    def run(px: pa.Array) -> pa.Array:
        offsets = np.asarray(px.offsets)
        values = px.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64)
        out = fn(values.reshape(-1, per)).astype(dtype)
        mask = px.is_null() if px.null_count else None
        return pa.ListArray.from_arrays(offsets32((offsets - offsets[0]) // per), pa.array(out), mask=mask)

    return kernel(run, f"array<{returns}>")
