"""Leak-free train/val splits: whole temporal chunks or whole sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framepair.functions.picks import even_pick, is_even_pick, val_count
from framepair.operators import ordered
from framepair.operators.lookup import lookup


def chunk_ids(df: DataFrame, by: Sequence[str], order: Sequence[str], chunk: int) -> DataFrame:
    """Adds ``idx``, group size ``n`` and the contiguous chunk id."""
    if chunk < 1:
        raise ValueError("chunk must be positive")
    out = ordered.dense_index(df, by, order, "idx", total="n")
    return out.withColumn("chunk_id", F.floor(F.col("idx") / chunk).cast("bigint"))


def chunk_split(df: DataFrame, by: Sequence[str], order: Sequence[str], val_frac: float, chunk: int = 200) -> DataFrame:
    """Temporal-chunk split: evenly spaced chunks of each group go to ``val``.

    Membership is arithmetic on the row's chunk id, so no list of validation
    chunks is built or joined.
    """
    out = chunk_ids(df, by, order, chunk)
    n_chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / chunk)).cast("bigint")
    held = is_even_pick(F.col("chunk_id"), n_chunks, val_count(val_frac, n_chunks))
    return out.withColumn("split", F.when(held, F.lit("val")).otherwise(F.lit("train"))).drop("n")


def missing_sessions(sessions: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Requested hold-out sessions that do not exist."""
    spark = sessions.sparkSession
    asked = spark.createDataFrame([(w,) for w in wanted], "session string").distinct()
    return asked.exceptAll(sessions.select("session").distinct())


def choose_sessions(df: DataFrame, val_sessions: Sequence[str] | None = None, val_frac: float = 0.15) -> DataFrame:
    """``(session, split)``: an explicit list, else evenly spaced in name order."""
    sessions = df.select("session").distinct()
    if val_sessions:
        # At most as many as were asked for.
        unknown = [r.session for r in missing_sessions(sessions, val_sessions).collect()]
        if unknown:
            raise ValueError(f"hold-out sessions not found: {sorted(unknown)}")
        held = F.col("session").isin(*val_sessions)
        return sessions.withColumn("split", F.when(held, F.lit("val")).otherwise(F.lit("train")))
    ranked = ordered.dense_index(sessions, [], ["session"], "rank", total="n")
    held = is_even_pick(F.col("rank"), F.col("n"), val_count(val_frac, F.col("n")))
    return ranked.select("session", F.when(held, F.lit("val")).otherwise(F.lit("train")).alias("split"))


def session_split(
    df: DataFrame, spread: Sequence[str], val_sessions: Sequence[str] | None = None, val_frac: float = 0.15
) -> DataFrame:
    """Whole-session split; ``spread`` names the row columns a hot session is salted by."""
    return lookup(df, choose_sessions(df, val_sessions, val_frac), ["session"], spread)


def even_picks(df: DataFrame, by: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """``k`` evenly spaced rows of each group (all rows when ``k`` covers them)."""
    ranked = ordered.dense_index(df, by, order, "idx", total="n")
    return ranked.where(is_even_pick(F.col("idx"), F.col("n"), F.lit(k))).drop("n")


def pick_table(sizes: DataFrame, k: int) -> DataFrame:
    """The pick positions themselves, one row per distinct position of each ``n``."""
    i = F.explode(F.sequence(F.lit(0), F.lit(k - 1))) if k else F.explode(F.array().cast("array<int>"))
    return sizes.select("*", i.alias("_i")).withColumn("pos", even_pick(F.col("_i"), F.col("n"), F.lit(k))).drop("_i").distinct()


def pick_index(df: DataFrame, by: Sequence[str], order: Sequence[str], at: int) -> DataFrame:
    """The row at position ``at`` of each group, clamped to the last."""
    ranked = ordered.dense_index(df, by, order, "idx", total="n")
    return ranked.where(F.col("idx") == F.least(F.lit(at), F.col("n") - 1)).drop("n")


def batches(df: DataFrame, by: Sequence[str], order: Sequence[str], size: int, drop_last: bool) -> DataFrame:
    """Batch ids in ``order``; a training epoch drops the last partial batch."""
    out = ordered.dense_index(df, by, order, "idx", total="n").withColumn("batch_id", F.floor(F.col("idx") / size).cast("bigint"))
    if drop_last:
        out = out.where(F.col("batch_id") < F.floor(F.col("n") / size))
    return out.drop("n")
