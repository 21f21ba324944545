"""Seeded, partition-independent sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framepair.functions.hashing import hash_uniform
from framepair.operators import ordered


def shuffle_key(df: DataFrame, key: str, seed: int, name: str = "u") -> DataFrame:
    return df.withColumn(name, hash_uniform(key, seed))


def take_random(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in seeded random order: a top-n, so only n rows per task travel."""
    return shuffle_key(df, key, seed, "_u").orderBy("_u", key).limit(n).drop("_u")


def take_random_per(df: DataFrame, by: Sequence[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` random rows of every group."""
    return ordered.take_first(shuffle_key(df, key, seed, "_u"), by, ["_u", key], n).drop("_u")
