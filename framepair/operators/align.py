"""Automatic alignment of recordings: affine placements of colour frames on infrared frames, coarse to fine.

1. Each calibration pair gives a pyramid of edge maps as binary rows, one a level.
2. Scales and angles are rows next to the smallest level; each tries all shifts at once. The best
   few placements of a pair survive.
3. At every finer level the survivors are rows again, each refined by Gauss-Newton steps,
   and fewer survive.
4. The best placement of a pair is polished at full resolution, the best pair of a recording is
   its calibration. A best placement on the edge of what was searched is no calibration.

Only calibration frames are read and shuffled: the pixels of a pair meet the numbers that are tried on them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framepair.functions import alignment
from framepair.functions.alignment import Level, Search
from framepair.functions.arrow import Frames, kernel
from framepair.session import materialise

SIZES = ("rgb_h", "rgb_w", "ir_h", "ir_w")
EDGE, NOTHING = "best placement lies on the edge of the search", "no placement correlates"
_LEVEL = ["rh", "rw", "ih", "iw", "rgb", "ir", "grey"]
_LEVELS = "array<struct<level:int,top:boolean,rh:int,rw:int,ih:int,iw:int,rgb:binary,ir:binary,grey:binary>>"
_TRIED = pa.struct([("score", pa.float64()), ("cc", pa.float64()), ("m", pa.list_(pa.float64()))])
_TRIED_DDL = "struct<score:double,cc:double,m:array<double>>"


def _pyramids(coarsest: int) -> Column:
    def run(rgb: pa.Array, rh: pa.Array, rw: pa.Array, ir: pa.Array, ih: pa.Array, iw: pa.Array) -> pa.Array:
        a, b, out = Frames(rgb, rh, rw), Frames(ir, ih, iw), []
        for i in range(len(rgb)):
            if not (a.ok[i] and b.ok[i] and min(a.h[i], a.w[i], b.h[i], b.w[i]) > 7):
                out.append(None)
                continue
            row = np.array([i])
            levels = alignment.pyramid(a.stack(row)[0, :, :, 0], b.stack(row)[0, :, :, 0], coarsest)
            raw = lambda x: None if x is None else x.astype("<f4").tobytes()
            out.append([
                {"level": n, "top": n == len(levels) - 1, "rh": x.rgb.shape[0], "rw": x.rgb.shape[1], "ih": x.ir.shape[0], "iw": x.ir.shape[1],
                 "rgb": raw(x.rgb), "ir": raw(x.ir), "grey": raw(x.grey)} for n, x in enumerate(levels)
            ])
        kind = pa.list_(pa.struct([("level", pa.int32()), ("top", pa.bool_()), *[(c, pa.int32()) for c in _LEVEL[:4]], *[(c, pa.binary()) for c in _LEVEL[4:]]]))
        return pa.array(out, kind)

    return kernel(run, _LEVELS, grows=True)("rgb_px", "rgb_h", "rgb_w", "ir_px", "ir_h", "ir_w")


def _each(columns: Sequence[pa.Array]):
    """Per row: its level (None without one), full sizes of both frames, and the values behind them."""
    for rgb_h, rgb_w, ir_h, ir_w, rh, rw, ih, iw, rgb, ir, grey, *rest in zip(*[c.to_pylist() for c in columns], strict=True):
        full = (rgb_h, rgb_w), (ir_h, ir_w)
        if rgb is None:
            yield None, full, rest
            continue
        frame = lambda raw, h, w: None if raw is None else np.frombuffer(raw, "<f4").astype(float).reshape(h, w)
        maps = [alignment.shrink_map(f, s) for f, s in zip(full, ((rh, rw), (ih, iw)), strict=True)]
        yield Level(frame(rgb, rh, rw), frame(ir, ih, iw), *maps, grey=frame(grey, rh, rw)), full, rest


def _packed(score: float, cc: float, h: np.ndarray) -> dict | None:
    return {"score": score, "cc": cc, "m": (h / h[2, 2])[:2].ravel().tolist()} if np.isfinite(score) else None


def _matrix(m: Sequence[float]) -> np.ndarray:
    return np.vstack([np.reshape(m, (2, 3)), [0, 0, 1]])


def _coarse(search: Search) -> Column:
    def run(*columns: pa.Array) -> pa.Array:
        out = []
        for level, full, (scale, angle) in _each(columns):
            found = alignment.coarse_placements(level, *full, scale, angle, search)
            out.append([_packed(score, np.nan, h) for score, h in found])
        return pa.array(out, pa.list_(_TRIED))

    return kernel(run, f"array<{_TRIED_DDL}>")(*SIZES, *_LEVEL, "seed.scale", "seed.angle")


def _refined(steps: int) -> Column:
    def run(*columns: pa.Array) -> pa.Array:
        out = []
        for level, _, (kept,) in _each(columns):
            # A pair without this level keeps its survivors as they are.
            out.append(kept if level is None else _packed(*alignment.refine(level, _matrix(kept["m"]), steps)))
        return pa.array(out, _TRIED)

    return kernel(run, _TRIED_DDL)(*SIZES, *_LEVEL, "kept")


def _polished(search: Search) -> Column:
    kind = pa.struct([*_TRIED, ("edge", pa.bool_())])

    def run(*columns: pa.Array) -> pa.Array:
        out = []
        for level, full, (kept,) in _each(columns):
            start = _matrix(kept["m"])
            score, cc, h = alignment.polish(level, start)
            if not np.isfinite(score):
                score, cc, h = kept["score"], kept["cc"], start
            out.append(_packed(score, cc, h) | {"edge": alignment.on_the_edge(h, *full, search)})
        return pa.array(out, kind)

    return kernel(run, "struct<score:double,cc:double,m:array<double>,edge:boolean>")(*SIZES, *_LEVEL, "kept")


def _best(tried: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The ``n`` best placements of each pair; as many are compared as are tried on a pair."""
    tried = tried.where(F.col("t").isNotNull())
    ranked = F.sort_array(F.collect_list("t"), asc=False)
    return tried.groupBy(*keys).agg(F.slice(ranked, 1, n).alias("survivors"))


def place_pairs(pairs: DataFrame, by: Sequence[str], search: Search = Search()) -> DataFrame:
    """``by, frame, cc, H, edge`` of every calibration pair that has a placement.

    ``pairs``: ``by, frame, rgb_px, rgb_h, rgb_w, ir_px, ir_h, ir_w`` with grey
    frames. Frames with a side of seven pixels or less have none.
    """
    keys = [*by, "frame"]
    levels = pairs.select(*keys, *SIZES, F.inline(_pyramids(search.coarsest)))
    levels = materialise(levels, "levels")
    seeds = F.array(*[F.struct(F.lit(s).alias("scale"), F.lit(a).alias("angle")) for s in search.scales for a in search.angles])
    tried = levels.where("top").withColumn("seed", F.explode(seeds)).repartition(*keys, "seed")
    best = _best(tried.select(*keys, F.explode(_coarse(search)).alias("t")), keys, search.survivors)
    highest = levels.agg(F.max("level")).first()[0] or 0
    keep = search.survivors
    for level in range(highest, -1, -1):
        here = levels.where(F.col("level") == level).select(*keys, *_LEVEL)
        rows = best.withColumn("kept", F.explode("survivors")).join(here, keys, "left")
        rows = rows.join(levels.where("top").select(*keys, *SIZES), keys)
        keep = max(2, keep // 2)
        best = materialise(_best(rows.select(*keys, _refined(30 if level else 15).alias("t")), keys, keep), "survivors")
    rows = best.withColumn("kept", F.col("survivors")[0]).join(levels.where("level = 0"), keys)
    done = rows.select(*keys, _polished(search).alias("t"))
    m = F.col("t.m")
    h = F.array(F.slice(m, 1, 3), F.slice(m, 4, 3), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    return done.select(*keys, F.col("t.cc").alias("cc"), h.alias("H"), F.col("t.edge").alias("edge"))


def align_recordings(pairs: DataFrame, by: Sequence[str], search: Search = Search()) -> DataFrame:
    """``by, H, cc, frame, reason``: the best placement of each recording, or why it has none."""
    placed = materialise(place_pairs(pairs, by, search), "placed_pairs")
    sound = F.when(~F.col("edge"), F.struct("cc", (-F.col("frame")).alias("first"), "H"))
    found = placed.groupBy(*by).agg(F.max_by("H", F.struct(sound["cc"], sound["first"])).alias("_h"), F.max(F.struct(sound["cc"].alias("cc"), sound["first"].alias("first"))).alias("_b"))
    all_of = pairs.select(*by).distinct().join(found, list(by), "left")
    ok = F.col("_b.cc").isNotNull()
    reason = F.when(F.col("_h").isNull(), F.lit(NOTHING)).when(~ok, F.lit(EDGE))
    return all_of.select(*by, F.when(ok, F.col("_h")).alias("H"), F.col("_b.cc").alias("cc"), (-F.col("_b.first")).alias("frame"), reason.alias("reason"))
