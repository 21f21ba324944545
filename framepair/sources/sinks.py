"""Sinks: partitioned frame tables and one-row records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framepair.functions.norm import ThermalNorm


def write_pairs(pairs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    pairs.write.mode(mode).parquet(path)


def both_modalities(pairs: DataFrame, keys: Sequence[str], rgb: str, ir: str) -> DataFrame:
    """Two payload columns to two rows labelled ``rgb`` and ``thermal``."""
    side = lambda m, c: F.struct(F.lit(m).alias("modality"), F.col(c).alias("px"))
    return pairs.select(*keys, F.inline(F.array(side("rgb", rgb), side("thermal", ir))))


def write_split(frames: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``split=<s>/modality=<m>`` folders; a reader of one split scans only that one."""
    frames.write.mode(mode).partitionBy("split", "modality").parquet(path)


def write_conditions(predictions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per condition label."""
    predictions.write.mode(mode).partitionBy("cond_label").parquet(path)


def with_16bit(predictions: DataFrame, norm: ThermalNorm, px: str = "px") -> DataFrame:
    """Each prediction at 8 and 16 bits, the latter under a ``_16bit`` name."""
    copy = lambda bits, suffix, v: F.struct(
        F.lit(bits).alias("bit_depth"), F.concat("stem", F.lit(f"{suffix}.png")).alias("file"), v.alias("counts")
    )
    both = F.array(copy(8, "", norm.to_uint8(px)), copy(16, "_16bit", norm.to_uint16(px)))
    rest = [c for c in predictions.columns if c != px]
    return predictions.select(*rest, F.inline(both))


def write_record(record: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A small report (calibration, metrics, configuration, split) as JSON lines."""
    record.write.mode(mode).option("ignoreNullFields", "false").json(path)


def split_report(sessions: DataFrame, root: str, skipped: int = 0, skipped_path: str | None = None) -> DataFrame:
    """One nested report row from ``session, split, pairs`` (one row per session).

    Rejects are a table of their own (:func:`write_split_report`): the record has their number and its place.
    """
    entry = F.struct("session", F.struct("split", "pairs"))
    count = lambda s: F.coalesce(F.sum(F.when(F.col("split") == s, F.col("pairs"))), F.lit(0)).cast("bigint")
    return sessions.agg(
        F.lit(root).alias("root"),
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("sessions"),
        F.sort_array(F.collect_list(F.when(F.col("split") == "val", F.col("session")))).alias("val_sessions"),
        F.array().cast("array<string>").alias("skipped"),
        F.struct(count("train").alias("train"), count("val").alias("val")).alias("counts"),
        F.lit(skipped).cast("bigint").alias("n_skipped"), F.lit(skipped_path).cast("string").alias("skipped_path"),
    )


def write_split_report(sessions: DataFrame, root: str, rejects: DataFrame, path: str) -> None:
    """The report under ``path/report`` and the ``text`` of every reject, in order, under ``path/skipped``.

    Texts are sorted by range, so no task and no row holds all of them.
    """
    texts = f"{path}/skipped"
    rejects.select("text").repartitionByRange("text").sortWithinPartitions("text").write.mode("overwrite").json(texts)
    skipped = rejects.sparkSession.read.schema("text string").json(texts).count()
    write_record(split_report(sessions, root, skipped, texts), f"{path}/report")


def run_record(spark: SparkSession, settings: dict, norm: ThermalNorm) -> DataFrame:
    """Run settings and normalisation as one row."""
    values = F.map_from_arrays(
        F.array(*[F.lit(k) for k in settings]), F.array(*[F.lit(None if v is None else str(v)) for v in settings.values()])
    )
    return spark.range(1).select(values.alias("args"), norm.to_struct().alias("thermal_norm"))
