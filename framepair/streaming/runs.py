"""Running streams to completion and over growing folders."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from framepair.functions.norm import ThermalNorm
from framepair.plans.translate import translate
from framepair.session import staging_path


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def catch_up(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available, then stop. Progress lives in ``checkpoint``.

    State is kept in RocksDB, which ordered folds need (``inorder.py``) and which does not grow with the heap.
    """
    sink = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint)
    conf = stream.sparkSession.conf
    before = conf.get(STORE, None)
    conf.set(STORE, ROCKSDB)
    try:
        query = sink.trigger(availableNow=True).start(path)
    finally:
        conf.unset(STORE) if before is None else conf.set(STORE, before)
    query.awaitTermination()


def drain(stream: DataFrame) -> DataFrame:
    """:func:`catch_up` into a fresh staging folder and read the result back."""
    spark = stream.sparkSession
    path = staging_path(spark, "stream")
    catch_up(stream, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def frame_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 0) -> DataFrame:
    """A growing Parquet frame folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def translate_folder(
    frames: DataFrame, factory: Callable, norm: ThermalNorm, path: str, checkpoint: str, conditions: Sequence[float] | None = None, **options
) -> None:
    """Translate what has arrived since the last run; the checkpoint replaces re-listing."""
    catch_up(translate(frames, factory, norm, conditions, **options), path, checkpoint)
