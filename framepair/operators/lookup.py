"""Attaching a per-recording record to every frame without a hot task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_SALTS = 16


def lookup(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """Equi-join ``rows`` to a one-row-per-key ``table``, salting the key.

    No broadcast is forced: Spark broadcasts ``table`` when its measured size
    is under the configured threshold, and otherwise shuffles on
    ``(on, salt)``, which splits a key that holds a large share of ``rows``
    over ``salts`` tasks. ``spread`` names the columns the salt is hashed from.
    """
    if how not in ("inner", "left"):
        raise ValueError("lookup supports inner and left joins")
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keyed = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    return keyed.join(salted, [*on, "_salt"], how).drop("_salt")
