"""Registry of queries and their SQL oracles, and the frame tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framepair.functions.norm import ThermalNorm

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SIDE = 8  # embeddings are read as 8 x 8 single-band frames
EIGHT = (SIDE, SIDE)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` and, when SQL can express it, its oracle."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str | Column) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


REL8 = ThermalNorm()
ABS16 = ThermalNorm("abs16")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, label, b`` (normalised), ``px`` (8-bit): one frame per embedding."""
    e = table(spark, sf_dir, "embeddings")
    b = F.transform("embedding", lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double") * 2.0)))
    return e.select("vec_id", F.col("label").cast("bigint").alias("label"), b.alias("b")).withColumn("px", REL8.to_uint8("b"))


def with_size(df: DataFrame, side: int = SIDE) -> DataFrame:
    return df.withColumn("height", F.lit(side)).withColumn("width", F.lit(side))


def colour(px: str = "px") -> Column:
    """A BGR version of a grey frame: ``(v, 255 - v, 3v mod 256)`` per pixel."""
    return F.flatten(F.transform(px, lambda v: F.array(v, 255 - v, v * 3 % 256)))


def name_of(col: str = "vec_id") -> Column:
    return F.format_string("%06d.png", F.col(col))


def pixels(df: DataFrame, px: str | Column, *keep: str, value: str = "v") -> DataFrame:
    """One row per pixel: ``keep..., i, value``."""
    col = F.col(px) if isinstance(px, str) else px
    out = df.select(*keep, F.posexplode(col).alias("_i", value))
    return out.withColumn("i", F.col("_i").cast("bigint")).drop("_i")


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


# -- the same tables in SQL ----------------------------------------------
FRAMES = """
frames AS (SELECT vec_id, label::BIGINT AS label,
  list_transform(embedding, lambda x: greatest(-1e0, least(1e0, x::DOUBLE * 2e0))) AS b FROM embeddings)"""
# One row per pixel: x in [-1, 1], v its 8-bit level, r/c its row and column.
PIX = (
    FRAMES
    + """,
pix AS (SELECT vec_id, label, i::BIGINT AS i, (i // 8)::BIGINT AS r, (i % 8)::BIGINT AS c, b[i + 1] AS x,
  floor((b[i + 1] + 1e0) * 127.5e0)::BIGINT AS v FROM frames, range(64) t(i))"""
)
# BGR channels of the coloured frame, ch = 0 for blue.
BGR = (
    PIX
    + """,
bgr AS (SELECT vec_id, label, i, r, c, ch::BIGINT AS ch, v AS level,
  CASE ch WHEN 0 THEN v WHEN 1 THEN 255 - v ELSE (v * 3) % 256 END AS v FROM pix, range(3) t(ch))"""
)


def uniform_sql(*parts: str) -> str:
    key = " || '|' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296e0)"


def pick_sql(pos: str, n: str, k: str) -> str:
    """Whether ``pos`` is among k evenly spaced picks of n, by listing the picks."""
    step = f"((({n}) - 1)::DOUBLE / nullif(({k}) - 1, 0))"
    return (
        f"(({k}) > 0 AND list_contains(list_transform(range(({k})::BIGINT), lambda j: "
        f"CASE WHEN ({k}) <= 1 OR ({n}) <= 1 THEN 0 WHEN j = ({k}) - 1 THEN ({n}) - 1 "
        f"ELSE floor(j * {step})::BIGINT END), ({pos})::BIGINT))"
    )
