"""Reproducible randomness: a uniform number from a hash of identifying values.

Results do not depend on partitioning, retries or engine; MD5 keeps the same
sequence available to plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def hash_uniform(*parts: Column | str | int) -> Column:
    """Uniform in [0, 1) from the ``|``-joined text of ``parts``.

    Strings are column names; ints are literals.
    """
    cols = [F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p) for p in parts]
    key = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(TWO32)


def hash_choice(n: Column, *parts: Column | str | int) -> Column:
    """Uniform integer in [0, n)."""
    return F.floor(hash_uniform(*parts) * n).cast("bigint")
