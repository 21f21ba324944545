"""Rows of recordings folded in event-time order on a stream, however they arrive.

Recordings are dealt to buckets by hash. A bucket's rows wait in state by cells of event time, as they came. A timer at a
cell's end fires when the watermark has passed it; the cell's rows are then complete, are sorted by recording and time
and folded, all recordings of the bucket at once, into one small state a recording. State is called once for a bucket, a cell
and a trigger, not for a recording. Cells are folded in order, so the result does not depend on triggers or on the order of
arrival inside the watermark's delay. Memory is one cell of one bucket and the small states of its recordings, state is
the open cells. Runs on ``transformWithState``, which keeps its state in RocksDB.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

RECORDING = "recording_key"  # no underscore first: columns lose such names on their way to a processor

BUCKETS = 256

# Rows in order, the number of each row's recording among those met, and their states before (NULL where there is none), to
# rows and the states after. Rows of one recording lie together. A fold without state gets and gives None for it.
Fold = Callable[[pd.DataFrame, np.ndarray, pd.DataFrame | None], tuple[pd.DataFrame, pd.DataFrame | None]]


def ends(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the first and which the last of their recording."""
    change = rec[1:] != rec[:-1]
    return np.r_[True, change], np.r_[change, True]


def before(values: np.ndarray, rec: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Each row's predecessor in its recording; that of the first is the recording's ``last``."""
    return np.where(ends(rec)[0], last[rec], np.r_[np.nan, values[:-1]])


class _Cells(StatefulProcessor):
    def __init__(self, schema: pa.Schema, order: Sequence[str], cell_us: int, fold: Fold, state: pa.Schema | None, out: Sequence[str]) -> None:
        self.schema, self.order, self.cell_us, self.fold, self.state, self.out = schema, list(order), cell_us, fold, state, list(out)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getMapState("cells", "cell bigint, part bigint", "rows binary")
        self.so_far = handle.getValueState("so_far", "states binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for chunk in rows:
            for cell, part in chunk.groupby(chunk[self.order[0]] // self.cell_us):
                cell = int(cell)
                new = pa.Table.from_pandas(part[self.schema.names], self.schema, preserve_index=False)
                # What came before is not read again.
                self.cells.updateValue((cell, uuid.uuid4().int >> 65), (self.written(new),))
                self.handle.registerTimer((cell + 1) * self.cell_us // 1000)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Timers of one bucket fire in no particular order: the first one folds all complete cells.
        complete = timerValues.getCurrentWatermarkInMs() * 1000
        parts = sorted(k for k in self.cells.keys() if (k[0] + 1) * self.cell_us <= complete)
        if not parts:
            return
        states = None
        if self.state:
            states = self.read(self.so_far.get()[0]).to_pandas() if self.so_far.exists() else self.state.empty_table().to_pandas()
            states = states.set_index(RECORDING)
        for _, same in groupby(parts, key=lambda k: k[0]):
            same = list(same)
            rows = pa.concat_tables([self.read(self.cells.getValue(k)[0]) for k in same]).to_pandas(integer_object_nulls=True)
            rows = rows.sort_values([RECORDING, *self.order], ignore_index=True)
            rec, met = pd.factorize(rows[RECORDING])
            if self.state:
                made, after = self.fold(rows, rec, states.reindex(met).reset_index(drop=True))
                states = pd.concat([states.drop(met, errors="ignore"), after.set_index(pd.Index(met, name=RECORDING))])
            else:
                made, _ = self.fold(rows, rec, None)
            for k in same:
                self.cells.removeKey(k)
            if len(made):
                yield made[self.out]
        if self.state:
            self.so_far.update((self.written(pa.Table.from_pandas(states.rename_axis(RECORDING).reset_index()[self.state.names], self.state, preserve_index=False)),))

    def close(self) -> None:
        pass

    def written(self, table: pa.Table) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        return sink.getvalue().to_pybytes()

    def read(self, raw: bytes) -> pa.Table:
        return pa.ipc.open_stream(raw).read_all()


def fold_in_order(
    rows: DataFrame, by: Sequence[str], order: Sequence[str], fold: Fold, state: str, out: str, cell_us: int, buckets: int = BUCKETS
) -> DataFrame:
    """Folds each recording's ``rows`` in the order of ``order``, of which the first is event time in microseconds.

    ``rows`` carries a watermark on a timestamp of that time. ``state`` (empty: none) and ``out`` are the schemas of
    a recording's state and of the rows that ``fold`` makes. ``cell_us`` is in whole milliseconds. ``buckets`` stays
    what it was for as long as a checkpoint is used.
    """
    if cell_us % 1000 or cell_us <= 0:
        raise ValueError("a cell is a positive number of whole milliseconds")
    names = [c.split()[0] for c in out.split(", ")]
    # One text stands for the whole key. Keys with other gaps go to other buckets: a column that is NULL in part would lose its type.
    gaps = sum((F.col(c).isNull().cast("int") * (1 << i) for i, c in enumerate(by)), F.lit(0))
    keyed = rows.withColumn(RECORDING, F.to_json(F.struct(*by))).withColumns({"_bucket": F.pmod(F.xxhash64(RECORDING), F.lit(buckets)), "_gaps": gaps})
    schema = to_arrow_schema(keyed.drop("_bucket", "_gaps", *_event_times(rows)).schema)
    states = to_arrow_schema(StructType.fromDDL(f"{RECORDING} string, {state}")) if state else None
    processor = _Cells(schema, order, cell_us, fold, states, names)
    return keyed.groupBy("_bucket", "_gaps").transformWithStateInPandas(processor, out, "append", "EventTime")


def _event_times(rows: DataFrame) -> list[str]:
    """Timestamp columns: they only carry the watermark."""
    return [f.name for f in rows.schema if f.dataType.typeName() == "timestamp"]


def with_watermark(rows: DataFrame, t: str, delay: str) -> DataFrame:
    return rows.withColumn("event_time", F.timestamp_micros(t)).withWatermark("event_time", delay)
