"""Calibration of many recordings at once: one matrix per recording.

Robust homography: seeded 4-point hypotheses are solved in batches, scored
against blocks of points in one kernel, and the winner is refitted from
summed normal equations, so no recording's points are gathered in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framepair.functions import kernels
from framepair.functions.geometry import letterbox, reprojection_error
from framepair.functions.hashing import hash_choice
from framepair.functions.picks import even_pick
from framepair.operators import ordered
from framepair.operators.lookup import lookup
from framepair.session import materialise

INLIER_PX = 3.0
FLAG_PX = 5.0


def _solve_batch(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Stacked 8x8 systems to row-major 3x3 matrices; NaN where singular."""
    out = np.full((len(a), 9), np.nan)
    if not len(a):
        return out
    size = np.abs(a).max(axis=(1, 2))
    good = np.isfinite(a).all(axis=(1, 2)) & (size > 0)
    good[good] = np.linalg.cond(a[good]) < 1e13
    out[good, :8] = np.linalg.solve(a[good], b[good][..., None])[..., 0]
    out[good, 8] = 1.0
    return out


BLOCK_POINTS = 256
_SCORES = "struct<n_in: array<bigint>, e: array<double>>"


def _block_scores(points: pa.Array, hypotheses: pa.Array) -> pa.Array:
    """Inliers and their summed error under each hypothesis, for every block of points."""
    counts, errors, sizes = [], [], []
    for p, h in zip(points, hypotheses, strict=True):
        x, y, u, v = (p.values.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "u", "v"))
        m = h.values.field("H").flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 3, 3)
        q = m @ np.stack([x, y, np.ones_like(x)])
        with np.errstate(divide="ignore", invalid="ignore"):
            err = np.sqrt((q[:, 0] / q[:, 2] - u) ** 2 + (q[:, 1] / q[:, 2] - v) ** 2)
        near = err <= INLIER_PX
        counts.append(near.sum(1))
        errors.append(np.where(near, err, 0.0).sum(1))
        sizes.append(len(m))
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
    columns = [pa.ListArray.from_arrays(offsets, flat(counts, pa.int64())), pa.ListArray.from_arrays(offsets, flat(errors, pa.float64()))]
    return pa.StructArray.from_arrays(columns, names=["n_in", "e"])


def _matrix_udf(build):
    """UDF from equal-length ARRAY<DOUBLE> rows to ARRAY<ARRAY<DOUBLE>> or NULL."""

    def run(v: pa.Array) -> pa.Array:
        rows = np.array(v.to_pylist(), float).reshape(len(v), -1) if len(v) else np.zeros((0, 1))
        h = build(rows) if len(rows) else np.zeros((0, 9))
        data = [None if np.isnan(m).any() else m.reshape(3, 3).tolist() for m in h]
        return pa.array(data, pa.list_(pa.list_(pa.float64())))

    return F.arrow_udf(run, "array<array<double>>")


def _from_four(rows: np.ndarray) -> np.ndarray:
    """Exact homography through 4 correspondences, rows of ``x, y, u, v`` x 4."""
    p = rows.reshape(len(rows), 4, 4)
    s = np.abs(p[..., :2]).max(axis=(1, 2)).clip(1e-9)
    t = np.abs(p[..., 2:]).max(axis=(1, 2)).clip(1e-9)
    x, y = p[..., 0] / s[:, None], p[..., 1] / s[:, None]
    u, v = p[..., 2] / t[:, None], p[..., 3] / t[:, None]
    one, zero = np.ones_like(x), np.zeros_like(x)
    top = np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], axis=-1)
    low = np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], axis=-1)
    h = _solve_batch(np.concatenate([top, low], axis=1), np.concatenate([u, v], axis=1))
    return _unscale(h, s, t)


def _unscale(h: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Undo coordinate scaling (source by ``1/s``, target by ``1/t``)."""
    m = h.reshape(-1, 3, 3) * np.stack([t, t, np.ones_like(t)], axis=-1)[:, :, None]
    m = m / np.stack([s, s, np.ones_like(s)], axis=-1)[:, None, :]
    return m.reshape(-1, 9)


_UPPER = [(i, j) for i in range(8) for j in range(i, 8)]


def _normal_terms(s: Column, t: Column) -> list[Column]:
    """Summed upper triangle and right-hand side of the least-squares system."""
    x, y, u, v = F.col("x") / s, F.col("y") / s, F.col("u") / t, F.col("v") / t
    one, zero = F.lit(1.0), F.lit(0.0)
    top = [x, y, one, zero, zero, zero, -u * x, -u * y]
    low = [zero, zero, zero, x, y, one, -v * x, -v * y]
    left = [F.sum(top[i] * top[j] + low[i] * low[j]) for i, j in _UPPER]
    return left + [F.sum(top[i] * u + low[i] * v) for i in range(8)]


def _from_normal(rows: np.ndarray) -> np.ndarray:
    a = np.zeros((len(rows), 8, 8))
    for k, (i, j) in enumerate(_UPPER):
        a[:, i, j] = a[:, j, i] = rows[:, k]
    n = len(_UPPER)
    return _unscale(_solve_batch(a, rows[:, n : n + 8]), rows[:, -2], rows[:, -1])


def check_points(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Recordings with fewer than four usable correspondences, with the reason."""
    whole = F.count_if(F.col("x").isNotNull() & F.col("u").isNotNull())
    counted = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), whole.alias("n_whole"))
    unequal = F.when(F.col("n") != F.col("n_whole"), F.lit("unequal lists"))
    reason = F.coalesce(unequal, F.when(F.col("n_whole") < 4, F.lit("fewer than 4 points")))
    return counted.withColumn("reason", reason).where(F.col("reason").isNotNull())


FIRST_DRAWS, MOST_DRAWS, SURE = 48, 4096, 0.999


def draws_needed(share: Column) -> Column:
    """Draws after which one of four inliers has come up with probability ``SURE``, if ``share`` of the points are inliers."""
    miss = F.log(F.greatest(F.lit(1e-15), 1 - F.pow(share, F.lit(4.0))))
    needed = F.when(miss < -1e-9, F.ceil(F.lit(float(np.log(1 - SURE))) / miss)).otherwise(F.lit(MOST_DRAWS))
    return F.least(F.lit(MOST_DRAWS), needed).cast("int")


def fit_homography(points: DataFrame, by: Sequence[str], first: int = FIRST_DRAWS, seed: int = 0) -> DataFrame:
    """Robust ``H`` per recording from ``points(by, i, x, y, u, v)``.

    Every recording gets ``first`` draws. The share of inliers of its best one says how many it
    needs, at most ``MOST_DRAWS``; a recording that needs more than it had gets them in a second round, after which
    the share can only be larger and the need smaller. Recordings that :func:`check_points`
    rejects, or whose points admit no solvable sample, are absent from the result.
    """
    by = list(by)
    usable = points.join(check_points(points, by).select(*by), by, "left_anti")
    pts = ordered.dense_index(usable.select(*by, "i", "x", "y", "u", "v"), by, ["i"], "idx", total="n")
    groups = pts.groupBy(*by).agg(F.max("n").alias("n"))
    blocks = pts.groupBy(*by, F.floor(F.col("idx") / BLOCK_POINTS).alias("_blk")).agg(F.collect_list(F.struct("x", "y", "u", "v")).alias("_pts"))
    best = materialise(_round(pts, blocks, groups.withColumns({"_lo": F.lit(0), "_hi": F.lit(first)}), by, seed), "best_draws")
    wanted = draws_needed(F.coalesce(F.col("n_in") / F.col("n"), F.lit(0.0)))
    more = groups.join(best, by, "left").select(*by, "n", F.lit(first).alias("_lo"), wanted.alias("_hi")).where("_hi > _lo")
    more = materialise(more, "open_recordings")
    if not more.isEmpty():
        both = best.unionByName(_round(pts, blocks, more, by, seed))
        # The better of two rounds: more inliers, then less error, then the earlier draw.
        rank = F.struct("n_in", -F.round("e", 9), -F.col("hyp"))
        best = materialise(both.groupBy(*by).agg(F.max_by("H", rank).alias("H")), "best_draws")
    return _refit(pts, best.select(*by, "H"), by)


def _round(pts: DataFrame, blocks: DataFrame, bounds: DataFrame, by: list[str], seed: int) -> DataFrame:
    """The best of the draws ``_lo`` to ``_hi - 1`` of each recording: ``by, H, n_in, e, hyp``."""
    draws = bounds.withColumn("hyp", F.explode(F.sequence("_lo", F.col("_hi") - 1)))
    # Hypothesis 0 is evenly spaced, so even four points give one valid sample.
    slot = lambda j: F.when(F.col("hyp") == 0, even_pick(F.lit(j), F.col("n"), F.lit(4))).otherwise(
        hash_choice(F.col("n"), *by, F.col("hyp"), j, seed)
    )
    draws = draws.withColumn("_p", F.array(*[slot(j) for j in range(4)])).where(F.size(F.array_distinct("_p")) == 4)
    picks = draws.select(*by, "hyp", F.posexplode("_p").alias("j", "idx"))
    four = picks.join(pts.select(*by, "idx", "x", "y", "u", "v"), [*by, "idx"])
    four = four.groupBy(*by, "hyp").agg(F.sort_array(F.collect_list(F.struct("j", "x", "y", "u", "v"))).alias("_s"))
    flat = F.flatten(F.transform("_s", lambda s: F.array(s.x, s.y, s.u, s.v)))
    # Used twice below: solve once.
    solved = materialise(four.select(*by, "hyp", _matrix_udf(_from_four)(flat).alias("H")).where("H IS NOT NULL"), "hypotheses")
    # At most ``MOST_DRAWS`` matrices per recording.
    packed = solved.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("hyp", "H"))).alias("_hs"))
    # A block of points meets all hypotheses in one kernel call and leaves two arrays,
    # one entry per hypothesis: no row for a pair of point and hypothesis.
    tried = lookup(blocks, packed, by, ["_blk"])
    tried = tried.select(*by, F.transform("_hs", lambda h: h.hyp).alias("_h"), F.arrow_udf(_block_scores, _SCORES)("_pts", "_hs").alias("_s"))
    tried = tried.select(*by, F.inline(F.arrays_zip(F.col("_h").alias("hyp"), F.col("_s.n_in").alias("n_in"), F.col("_s.e").alias("e"))))
    scored = tried.groupBy(*by, "hyp").agg(F.sum("n_in").alias("n_in"), F.sum("e").alias("e"))
    best = scored.groupBy(*by).agg(F.max(F.struct("n_in", -F.round("e", 9), -F.col("hyp"))).alias("_b"))
    best = best.select(*by, "_b.n_in", (-F.col("_b.col2")).alias("e"), (-F.col("_b.col3")).alias("hyp"))
    return best.join(solved, [*by, "hyp"]).select(*by, "H", "n_in", "e", "hyp")


def _refit(pts: DataFrame, best: DataFrame, by: list[str]) -> DataFrame:
    scale = pts.groupBy(*by).agg(
        F.greatest(F.max(F.abs("x")), F.max(F.abs("y")), F.lit(1e-9)).alias("_s"),
        F.greatest(F.max(F.abs("u")), F.max(F.abs("v")), F.lit(1e-9)).alias("_t"),
    )
    close = lookup(pts, best.join(scale, by), by, ["idx"])
    close = close.where(reprojection_error(F.col("H"), "x", "y", "u", "v") <= INLIER_PX)
    sums = close.groupBy(*by, "_s", "_t").agg(F.array(*_normal_terms(F.col("_s"), F.col("_t"))).alias("_n"))
    refit = sums.select(*by, _matrix_udf(_from_normal)(F.concat("_n", F.array("_s", "_t"))).alias("_H"))
    out = best.join(refit, by, "left")
    return out.select(*by, F.coalesce("_H", "H").alias("H"))


def reproject(points: DataFrame, matrices: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per-point error, inlier flag and outlier flag under each recording's ``H``."""
    joined = lookup(points, matrices.select(*by, "H"), by, ["i"])
    out = joined.withColumn("err", reprojection_error(F.col("H"), "x", "y", "u", "v")).drop("H")
    out = out.withColumn("inlier", F.col("err") <= INLIER_PX)
    return out.withColumn("flagged", ~F.col("inlier") | (F.col("err") > FLAG_PX))


def reprojection_report(points: DataFrame, matrices: DataFrame, by: Sequence[str]) -> DataFrame:
    return reproject(points, matrices, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("inlier").alias("inliers"),
        F.avg("err").alias("mean_err"), F.max("err").alias("max_err"),
    )


def best_calibration(scored: DataFrame, by: Sequence[str], order: str = "frame") -> DataFrame:
    """The ``H`` with the highest correlation; the first frame wins ties, NULLs are failures."""
    tried = scored.where(F.col("cc").isNotNull() & ~F.isnan("cc"))
    rank = F.struct(F.col("cc"), -F.col(order))
    return tried.groupBy(*by).agg(F.max_by("H", rank).alias("H"), F.max("cc").alias("cc"), F.max_by(order, rank).alias(order))


def candidate_grid(shifts: Sequence[float], scales: Sequence[float]) -> list[tuple[float, float, float]]:
    return [(s, dx, dy) for s in scales for dx in shifts for dy in shifts]


def search_alignment(pairs: DataFrame, by: Sequence[str], candidates: list[tuple[float, float, float]]) -> DataFrame:
    """Best placement per calibration frame by edge-map correlation, then per recording.

    ``pairs``: ``by, frame, rgb_px, rgb_h, rgb_w, ir_px, ir_h, ir_w`` with grey
    frames. A search over a fixed candidate list, not an iterative solver.
    """
    sizes = ("rgb_h", "rgb_w", "ir_h", "ir_w")
    cc = kernels.alignment_scores("rgb_px", "rgb_h", "rgb_w", "ir_px", "ir_h", "ir_w", candidates)
    tried = pairs.select(*by, "frame", *sizes, F.posexplode(cc).alias("_c", "cc"))
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in candidates])
    scored = tried.withColumn("H", placement(table[F.col("_c")]))
    # Frame first, then earlier candidate, breaks ties.
    scored = scored.withColumn("_o", F.col("frame").cast("bigint") * len(candidates) + F.col("_c"))
    best = best_calibration(scored, by, "_o")
    return best.withColumn("frame", F.floor(F.col("_o") / len(candidates)).cast("bigint")).drop("_o")


def placement(candidate: Column) -> Column:
    """Matrix of a ``(scale, dx, dy)`` candidate for columns ``rgb_w/h`` and ``ir_w/h``."""
    fit = letterbox("rgb_w", "rgb_h", "ir_w", "ir_h")
    k = candidate[0] * fit[0][0]
    zero = F.lit(0.0)
    shift = lambda size, src, d: (F.col(size) - k * F.col(src)) / 2.0 + d
    return F.array(
        F.array(k, zero, shift("ir_w", "rgb_w", candidate[1])),
        F.array(zero, k, shift("ir_h", "rgb_h", candidate[2])),
        F.array(zero, zero, F.lit(1.0)),
    )
