"""Registry of the queries of this folder, table access and small helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framepair.session import materialise, staging_path, staging_root

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

__all__ = ["ORACLES", "QUERIES", "Staging", "chosen", "lower_ascii", "materialise", "query", "staging_path", "splittable", "staging_root", "table", "unused"]


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` and, when SQL can express it, its oracle."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


class Staging:
    """Tables of one job in the shared folder, which go when no later step reads them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        path = staging_path(self.spark, tag)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Removes the tables kept so far; only after all that was made of them has been written."""
        jvm = self.spark._jvm
        while self.paths:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def chosen(docs: DataFrame, rows: int, total: int, salt: str, *columns: str) -> DataFrame:
    """About ``rows`` of ``total`` rows by a hash of their values, the same ones every time.

    Rows that are equal in ``columns`` are chosen together: bound what is collected as well.
    """
    share = min(1.0, rows / max(1, total))
    h = F.pmod(F.xxhash64(F.lit(salt), *[F.col(c) for c in columns]), F.lit(1 << 62))
    return docs.where(h < int(share * (1 << 62)))


def splittable(summary: DataFrame, key: str, always: Column) -> DataFrame:
    """``summary`` (one row a key) for a join whose other side may hold a hot ``key``.

    Adaptive execution splits a skewed join only if both sides come straight
    from a shuffle. An aggregate by the join key would be joined without one, so
    the key is hidden behind a condition that always holds.
    """
    return summary.withColumn(key, F.when(always, F.col(key)))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have (names compare without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
