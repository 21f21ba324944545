"""Time synchronisation of two recordings.

``nearest_on_grid`` pairs a regular sampling grid with two frame streams.
Frames are first reduced to the earliest and latest frame of each grid cell
(combined map-side), so the data that is shuffled is bounded by the grid and
not by the frame rate, and no two-sided join is needed at all.
``nearest`` pairs two irregular streams through one range sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framepair.operators import neighbours, ordered

GRID_BLOCK = 4096


@dataclass(frozen=True)
class SyncSpec:
    """Sampling settings. Zero means "unset" for all but ``start_us``, ``duration_us`` and ``reach``.

    ``reach``: with more samples than this inside the tolerance, one range sort is cheaper than offering every
    frame to every sample it could serve; both forms give the same rows.
    """

    period_us: int
    tol_us: int = 0
    offset_us: int = 0
    start_us: int = 0
    duration_us: int | None = None
    max_pairs: int = 0
    ir_fps: float = 0.0
    static_below: float | None = None
    reach: int = 32

    @property
    def tolerance(self) -> int:
        """Explicit tolerance, else half the IR frame period."""
        if self.tol_us:
            return self.tol_us
        if not self.ir_fps:
            raise ValueError("a tolerance or the IR frame rate is needed")
        return int(round(5e5 / self.ir_fps))


def frame_times(frames: DataFrame, by: Sequence[str], order: Sequence[str], fps: float) -> DataFrame:
    """Adds ``idx`` and ``t_us = idx / fps`` to an ordered frame listing."""
    if not fps:
        raise ValueError("a frame directory needs its frame rate")
    indexed = ordered.dense_index(frames, by, order, "idx")
    return indexed.withColumn("t_us", F.rint(F.col("idx") * (1e6 / fps)).cast("bigint"))


def shift_clock(frames: DataFrame, offset_us: int, t: str = "t_us") -> DataFrame:
    """Moves IR times onto the RGB clock (offset = IR clock minus RGB clock)."""
    return frames.withColumn(t, F.col(t) - F.lit(int(offset_us)))


def grid_sizes(spec: SyncSpec, rgb: DataFrame, ir: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(by, n_grid)``: samples from the start to the earlier stream end plus tolerance.

    ``ir`` is already on the RGB clock.
    """
    tagged = lambda df, m: df.select(*by, "t_us", F.lit(m).alias("_m"))
    end = lambda m: F.max(F.when(F.col("_m") == m, F.col("t_us")))
    both = tagged(rgb, 0).unionByName(tagged(ir, 1))
    bounds = both.groupBy(*by).agg(end(0).alias("_r"), end(1).alias("_i")).where("_r IS NOT NULL AND _i IS NOT NULL")
    stop = F.least("_r", "_i") + spec.tolerance
    if spec.duration_us is not None:
        stop = F.least(stop, F.lit(spec.start_us + spec.duration_us))
    last = F.floor((stop - spec.start_us) / F.lit(float(spec.period_us)))
    return bounds.select(*by, F.greatest(last + 1, F.lit(0)).cast("bigint").alias("n_grid"))


def sample_grid(spec: SyncSpec, rgb: DataFrame, ir: DataFrame, by: Sequence[str]) -> DataFrame:
    """The samples ``(by, k, t)`` themselves, generated on executors from the bounds.

    Blocks first, spread over tasks, then the samples of each block: a very
    long recording is neither one array nor one task.
    """
    sizes = grid_sizes(spec, rgb, ir, by).where("n_grid > 0")
    last_block = F.floor((F.col("n_grid") - 1) / GRID_BLOCK).cast("bigint")
    blocks = sizes.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), last_block))).repartition(*by, "_b")
    low = F.col("_b") * GRID_BLOCK
    ks = F.explode(F.sequence(low, F.least(low + GRID_BLOCK, F.col("n_grid")) - 1))
    return blocks.select(*by, ks.alias("k")).withColumn("t", F.lit(spec.start_us) + F.col("k") * spec.period_us)


def _offers(frames: DataFrame, by: Sequence[str], spec: SyncSpec) -> DataFrame:
    """Each grid cell's earliest and latest frame, offered to the samples they can serve."""
    p, tol, start = spec.period_us, spec.tolerance, spec.start_us
    rel = F.col("t_us") - start
    cell = F.floor(rel / F.lit(float(p))).cast("bigint")
    cells = frames.groupBy(*by, cell.alias("_c")).agg(
        F.min(F.struct("t_us", "id")).alias("_first"), F.max(F.struct("t_us", "id")).alias("_last")
    )
    reach = lambda t, sign: (t - start + sign * tol) / F.lit(float(p))
    lo = F.greatest(F.ceil(reach(F.col("_first.t_us"), -1)).cast("bigint"), F.lit(0).cast("bigint"))
    hi = F.floor(reach(F.col("_last.t_us"), 1)).cast("bigint")
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    # A frame at or after a sample comes from the sample's own or a later cell.
    after = F.transform(span(lo, F.col("_c")), lambda k: F.struct(k.alias("k"), F.col("_first").alias("f")))
    from_k = F.greatest(F.col("_c") + 1, F.lit(0).cast("bigint"))
    before = F.transform(span(from_k, hi), lambda k: F.struct(k.alias("k"), F.col("_last").alias("f")))
    offers = cells.select(*by, F.inline(F.concat(after, before)))
    gap = F.col("f.t_us") - (F.lit(start) + F.col("k") * p)
    # Distance first, the earlier side on a tie: one LONG orders all offers.
    rank = F.abs(gap) * 2 + F.when(gap > 0, F.lit(1)).otherwise(F.lit(0))
    return offers.select(*by, "k", rank.alias("rank"), F.col("f.id").alias("id"))


def nearest_on_grid(rgb: DataFrame, ir: DataFrame, by: Sequence[str], spec: SyncSpec) -> DataFrame:
    """Samples where both streams have a frame within tolerance.

    Inputs carry ``by``, ``id`` and ``t_us``. Output: ``by, k, t, rgb_id,
    rgb_t, ir_id, ir_t`` with the IR times already on the RGB clock. The
    nearer frame wins; at equal distance the earlier one.
    """
    ir = shift_clock(ir, spec.offset_us)
    by = list(by)
    if spec.tolerance > spec.reach * spec.period_us:
        return _nearest_by_sort(rgb, ir, by, spec)
    tagged = _offers(rgb, by, spec).withColumn("_m", F.lit(0)).unionByName(_offers(ir, by, spec).withColumn("_m", F.lit(1)))
    # Offers of one stream to one sample have distinct times, so the rank has
    # no ties and plain numbers keep this a hash aggregation.
    mine = lambda m, c: F.when(F.col("_m") == m, F.col(c))
    pick = lambda m: (F.min(mine(m, "rank")).alias(f"_d{m}"), F.min_by("id", mine(m, "rank")).alias(f"_i{m}"))
    best = tagged.groupBy(*by, "k").agg(*pick(0), *pick(1))
    best = best.where((F.col("_d0") <= 2 * spec.tolerance + 1) & (F.col("_d1") <= 2 * spec.tolerance + 1))
    if spec.duration_us is not None:
        best = best.where(F.col("k") * spec.period_us <= spec.duration_us)
    t = F.lit(spec.start_us) + F.col("k") * spec.period_us
    time_of = lambda m: t + F.shiftright(f"_d{m}", 1) * F.when(F.col(f"_d{m}") % 2 == 1, F.lit(1)).otherwise(F.lit(-1))
    return best.select(
        *by, "k", t.alias("t"),
        F.col("_i0").alias("rgb_id"), time_of(0).alias("rgb_t"), F.col("_i1").alias("ir_id"), time_of(1).alias("ir_t"),
    )


def _nearest_by_sort(rgb: DataFrame, ir: DataFrame, by: list[str], spec: SyncSpec) -> DataFrame:
    grid = sample_grid(spec, rgb, ir, by).withColumnRenamed("t", "t_us").withColumn("id", F.col("k"))
    one = lambda frames, m: nearest(grid, frames, by, spec.tolerance).select(
        *by, "k", F.col("t_us").alias("t"), F.col("match_id").alias(f"{m}_id"), F.col("match_t").alias(f"{m}_t")
    )
    return one(rgb, "rgb").join(one(ir, "ir").drop("t"), [*by, "k"])


def bracket(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Last right row strictly before and first right row at or after each left row.

    Adds structs ``before`` and ``after`` of ``(t_us, id)``. Both sides are
    sorted together once, so the cost does not depend on how dense they are.
    """
    by = list(by)
    extra = [c for c in left.columns if c not in (*by, "t_us", "id")]
    l = left.select(*by, "t_us", "id", F.struct(*extra).alias("_x") if extra else F.lit(None).alias("_x"), F.lit(0).alias("_side"))
    r = right.select(*by, "t_us", "id", F.lit(None).alias("_x"), F.lit(1).alias("_side"))
    seg = ordered.segment(l.unionByName(r), by, ["t_us", "_side", "id"])
    found = ordered.fill_around(seg, by, F.when(F.col("_side") == 1, F.struct("t_us", "id")), "before", "after")
    keep = [F.col(f"_x.{c}").alias(c) for c in extra]
    return found.where(F.col("_side") == 0).select(*by, "t_us", "id", *keep, "before", "after")


def nearest(left: DataFrame, right: DataFrame, by: Sequence[str], tol_us: int) -> DataFrame:
    """Nearest right row within ``tol_us`` of each left row (inner); earlier wins ties."""
    b = bracket(left, right, by)
    offer = lambda c: F.when(
        F.col(c).isNotNull(),
        F.struct(F.abs(F.col(f"{c}.t_us") - F.col("t_us")).alias("dt"), F.col(f"{c}.t_us").alias("t_us"), F.col(f"{c}.id").alias("id")),
    )
    b = b.withColumn("_m", F.least(offer("before"), offer("after"))).where(F.col("_m.dt") <= tol_us)
    return b.select(
        *[c for c in b.columns if c not in ("before", "after", "_m")],
        F.col("_m.id").alias("match_id"), F.col("_m.t_us").alias("match_t"), F.col("_m.dt").alias("dt_us"),
    )


def mark_static(seg: DataFrame, by: Sequence[str], level: str, below: float) -> DataFrame:
    """Flags rows whose ``level`` moved less than ``below`` since the previous row.

    The previous row counts even if it was itself static, and the first row
    of a recording never is. Input is a segmented table of accepted samples.
    """
    lagged = ordered.previous(seg, by, [level], prefix="_p_")
    moved = F.abs(F.col(level) - F.col(f"_p_{level}"))
    return lagged.withColumn("static", F.coalesce(moved < below, F.lit(False))).drop(f"_p_{level}")


def mark_static_frames(seg: DataFrame, by: Sequence[str], frames: DataFrame, below: float) -> DataFrame:
    """:func:`mark_static` for pixel frames ``by, id, px``.

    Each frame is compared with the accepted frame before it (``operators/neighbours.py``). A frame that serves
    several samples in a row is static from its second on.
    """
    by = list(by)
    used = seg.groupBy(*by, "ir_id").agg(F.min("k").alias("_k"))
    shown = frames.select(*by, F.col("id").alias("ir_id"), "px").join(used, [*by, "ir_id"])
    moved = neighbours.change(shown, by, ["_k", "ir_id"], name="_d")
    out = seg.join(moved, [*by, "ir_id"], "left")
    still = F.when(F.col("k") > F.col("_k"), F.lit(below > 0)).otherwise(F.col("_d") < below)
    return out.withColumn("static", F.coalesce(still, F.lit(False))).drop("_k", "_d")


def deltas(frames: DataFrame, by: Sequence[str], t: str = "t_us", tie: Sequence[str] = ("id",)) -> DataFrame:
    """Time to the previous frame of the stream (NULL on the first)."""
    seg = ordered.segment(frames, by, [t, *tie])
    lagged = ordered.previous(seg, by, [t], prefix="_p_")
    return ordered.clean(lagged.withColumn("delta_us", F.col(t) - F.col(f"_p_{t}")).drop(f"_p_{t}"))
