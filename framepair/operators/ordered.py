"""Ordered operators that scale past one key.

A window partitioned by recording puts a whole recording into one task, which
fails as soon as one recording holds a large share of the table. Everything
here instead cuts the *globally sorted* table into range segments of similar
size, runs the window inside ``(by, segment)`` and carries one small row per
segment across the boundary:

    segment()          one range shuffle, written once
    number()           0-based dense position      (carry: row counts)
    previous()         lag by one                  (carry: last row)
    fill_around()      last/next non-null value    (carry: last/first non-null)

The carry tables have at most ``segments + distinct(by)`` rows, so their own
window never sees more than ``segments`` rows per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framepair.session import materialise

PART, POS = "_part", "_pos"


def segment(df: DataFrame, by: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """Sort ``df`` by ``(by, order)`` into range segments ``_part`` with position ``_pos``.

    ``order`` should make rows distinct (end it with an id): equal keys always
    share a segment. Pass metadata columns only and join payloads back by key.
    """
    keys = [*by, *order]
    # Without a fixed count, adaptive execution joins small neighbouring ranges.
    ranged = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    ranged = ranged.sortWithinPartitions(*keys)
    placed = ranged.withColumn(POS, F.monotonically_increasing_id())
    return materialise(placed.withColumn(PART, F.shiftright(POS, 33).cast("int")), "segment")


def _within(by: Sequence[str]) -> Window:
    return Window.partitionBy(*by, PART).orderBy(POS)


def _across(by: Sequence[str]) -> Window:
    return Window.partitionBy(*by).orderBy(PART)


def _beside(seg: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """``seg`` with the columns of a table of one row per ``(by, segment)``; a NULL group is a group."""
    keys = [*by, PART]
    other = small.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by] + [F.col(PART) == F.col(f"_k_{PART}")]
    return seg.join(other, same).drop(*[f"_k_{k}" for k in keys])


def number(seg: DataFrame, by: Sequence[str], name: str = "idx", total: str | None = None) -> DataFrame:
    """Dense 0-based position within ``by`` over an already segmented table.

    The position is ``_pos`` minus the segment's first ``_pos`` when the rows
    are contiguous, so no window runs over the rows themselves.
    """
    bounds = seg.groupBy(*by, PART).agg(F.min(POS).alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = _across(by).rowsBetween(Window.unboundedPreceding, -1)
    cols = [*by, PART, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base")]
    if total:
        cols.append(F.sum("_n").over(Window.partitionBy(*by)).alias(total))
    out = _beside(seg, bounds.select(*cols), by)
    return out.withColumn(name, (F.col(POS) + F.col("_base")).cast("bigint")).drop("_base")


def renumber(seg: DataFrame, by: Sequence[str], name: str = "idx") -> DataFrame:
    """Like :func:`number` for a segmented table that has been filtered since."""
    counts = seg.groupBy(*by, PART).agg(F.count(F.lit(1)).alias("_n"))
    before = _across(by).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*by, PART, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    out = _beside(seg.withColumn("_rn", F.row_number().over(_within(by)) - 1), base, by)
    return out.withColumn(name, (F.col("_rn") + F.col("_base")).cast("bigint")).drop("_rn", "_base")


def clean(df: DataFrame) -> DataFrame:
    return df.drop(PART, POS)


def dense_index(
    df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "idx", total: str | None = None
) -> DataFrame:
    """Row number from 0 in ``order`` within ``by`` (and the group size as ``total``)."""
    return clean(number(segment(df, by, order), by, name, total))


def previous(seg: DataFrame, by: Sequence[str], cols: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Columns of the preceding row within ``by`` over a segmented table."""
    packed = F.struct(*[F.col(c) for c in cols])
    last = seg.groupBy(*by, PART).agg(F.max_by(packed, POS).alias("_last"))
    carry = last.select(*by, PART, F.lag("_last").over(_across(by)).alias("_carry"))
    out = _beside(seg.withColumn("_lag", F.lag(packed).over(_within(by))), carry, by)
    # A lagged struct is NULL only on a segment's first row.
    out = out.withColumn("_lag", F.coalesce("_lag", "_carry"))
    return out.select("*", *[F.col(f"_lag.{c}").alias(f"{prefix}{c}") for c in cols]).drop("_lag", "_carry")


def following(seg: DataFrame, by: Sequence[str], cols: Sequence[str], prefix: str = "next_") -> DataFrame:
    """Columns of the succeeding row within ``by`` over a segmented table."""
    packed = F.struct(*[F.col(c) for c in cols])
    first = seg.groupBy(*by, PART).agg(F.min_by(packed, POS).alias("_first"))
    carry = first.select(*by, PART, F.lead("_first").over(_across(by)).alias("_carry"))
    out = _beside(seg.withColumn("_lead", F.lead(packed).over(_within(by))), carry, by)
    out = out.withColumn("_lead", F.coalesce("_lead", "_carry"))
    return out.select("*", *[F.col(f"_lead.{c}").alias(f"{prefix}{c}") for c in cols]).drop("_lead", "_carry")


def fill_around(seg: DataFrame, by: Sequence[str], value: Column, before: str, after: str) -> DataFrame:
    """Nearest earlier and later non-null ``value`` of every row (the row itself counts)."""
    seg = seg.withColumn("_v", value)
    present = F.when(F.col("_v").isNotNull(), F.col(POS))
    ends = seg.groupBy(*by, PART).agg(
        F.max_by("_v", present).alias("_l"), F.min_by("_v", present).alias("_f")
    )
    # Looking ahead is a running window in reverse order: a frame that reaches
    # to the end of the partition would be rescanned for every row.
    latest = lambda c, w, end: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, end))
    reverse = lambda cols, key: Window.partitionBy(*cols).orderBy(F.desc(key))
    carry = ends.select(
        *by, PART, latest("_l", _across(by), -1).alias("_cl"), latest("_f", reverse(by, PART), -1).alias("_cf")
    )
    back, ahead = latest("_v", _within(by), 0), latest("_v", reverse([*by, PART], POS), 0)
    out = _beside(seg.withColumn("_b", back).withColumn("_a", ahead), carry, by)
    out = out.withColumn(before, F.coalesce("_b", "_cl")).withColumn(after, F.coalesce("_a", "_cf"))
    return out.drop("_v", "_b", "_a", "_cl", "_cf")


def take_first(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of every group: a limit applied after all filters."""
    return dense_index(df, by, order, "_i").where(F.col("_i") < n).drop("_i")
