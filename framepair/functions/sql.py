"""The library's functions for SQL users: registered UDFs and table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framepair.functions.norm import ThermalNorm

# SQL bodies are plain expressions, so Catalyst inlines them.
_SCALARS = {
    "celsius_to_norm": ("c DOUBLE, tmin DOUBLE, tmax DOUBLE", "DOUBLE", "(c - tmin) / (tmax - tmin) * 2D - 1D"),
    "norm_to_celsius": ("n DOUBLE, tmin DOUBLE, tmax DOUBLE", "DOUBLE", "(n + 1D) / 2D * (tmax - tmin) + tmin"),
    "rel8_to_norm": ("v DOUBLE", "DOUBLE", "greatest(-1D, least(1D, v / 127.5D - 1D))"),
    "norm_to_uint8": ("n DOUBLE", "INT", "cast(floor((greatest(-1D, least(1D, n)) + 1D) * 127.5D) AS INT)"),
    "hash_uniform": ("key STRING", "DOUBLE", "cast(conv(substring(md5(key), 1, 8), 16, 10) AS DOUBLE) / 4294967296D"),
}

# Table functions: k evenly spaced positions on 0..n-1; a rate that is flat, then falls to zero.
_TABLES = {
    "even_picks": (
        "n BIGINT, k BIGINT", "i BIGINT, pos BIGINT",
        "SELECT i, CASE WHEN k <= 1 OR n <= 1 THEN 0 WHEN i = k - 1 THEN n - 1 "
        "ELSE cast(floor(i * (cast(n - 1 AS DOUBLE) / (k - 1))) AS BIGINT) END "
        "FROM (SELECT explode(CASE WHEN k > 0 THEN sequence(0L, k - 1) ELSE array() END) AS i)",
    ),
    "learning_rates": (
        "flat INT, decay INT, lr DOUBLE", "epoch INT, lr DOUBLE",
        "SELECT e, greatest(0D, 1D - greatest(0, e + 1 - flat) / cast(greatest(1, decay) AS DOUBLE)) * learning_rates.lr "
        "FROM (SELECT explode(CASE WHEN flat + decay > 0 THEN sequence(0, flat + decay - 1) ELSE array() END) AS e)",
    ),
}


def register(spark: SparkSession) -> None:
    """Temporary SQL functions for this session."""
    for name, (args, returns, body) in _SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
    for name, (args, returns, body) in _TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE({returns}) RETURN {body}")


def lr_at(epoch, flat: int, decay: int, lr: float):
    """Learning rate of an epoch (0-based) as a Column."""
    past = F.greatest(F.lit(0), epoch + 1 - flat) / F.lit(float(max(1, decay)))
    return F.greatest(F.lit(0.0), F.lit(1.0) - past) * lr


def lr_schedule(spark: SparkSession, flat: int, decay: int, lr: float = 2e-4) -> DataFrame:
    epochs = spark.range(flat + decay).select(F.col("id").cast("int").alias("epoch"))
    return epochs.withColumn("lr", lr_at(F.col("epoch"), flat, decay, lr))


def norm_from_json(text: str) -> ThermalNorm:
    """Settings rebuilt from a stored configuration record."""
    import json

    return ThermalNorm.from_dict(json.loads(text))
