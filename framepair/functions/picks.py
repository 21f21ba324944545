"""Evenly spaced picks of k positions out of n, as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def val_count(frac: float | Column, n: Column) -> Column:
    """Held-out units: half-even ``frac * n``, never zero unless ``frac`` is."""
    frac = _col(frac)
    wanted = F.greatest(F.lit(1), F.rint(frac * n).cast("bigint"))
    return F.when(frac > 0, wanted).otherwise(F.lit(0)).cast("bigint")


def even_pick(i: Column, n: Column, k: Column) -> Column:
    """Position of pick ``i`` of ``k`` on ``0..n-1``; the last pick is ``n-1`` exactly."""
    i, n, k = _col(i), _col(n), _col(k)
    step = (n - 1).cast("double") / F.nullif(k - 1, F.lit(0))
    inner = F.floor(i.cast("double") * step)
    return F.when(k <= 1, F.lit(0)).when(i == k - 1, n - 1).otherwise(inner).cast("bigint")


def is_even_pick(pos: Column, n: Column, k: Column) -> Column:
    """Whether ``pos`` is one of the ``k`` evenly spaced picks: no join, no pick list.

    ``even_pick`` is monotone in ``i``, so only the picks around ``pos / step``
    can land on ``pos``.
    """
    pos, n, k = _col(pos), _col(n), _col(k)
    step = F.nullif((n - 1).cast("double") / F.nullif(k - 1, F.lit(0)), F.lit(0.0))
    guess = F.floor(pos.cast("double") / step)
    near = F.lit(False)
    for delta in (-1, 0, 1, 2):
        i = guess + delta
        ok = (i >= 0) & (i <= k - 1) & (even_pick(i, n, k) == pos)
        near = near | F.coalesce(ok, F.lit(False))
    return F.when(k <= 0, F.lit(False)).when((k == 1) | (n <= 1), pos == 0).otherwise(near)
