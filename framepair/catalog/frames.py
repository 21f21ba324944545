"""Queries over whole frames: kernels, windows, scores and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from framepair.catalog.base import (
    BGR, EIGHT, PIX, REL8, SIDE, colour, frames, name_of, pixels, query, r6, table, uniform_sql, with_size,
)
from framepair.functions import kernels
from framepair.functions import pixels as px_ops
from framepair.functions.hashing import hash_uniform
from framepair.functions.norm import ThermalNorm
from framepair.operators import neighbours, ordered, profile, scores, sync
from framepair.sources import images
from framepair.plans.evaluate import evaluate, score_pairs


def refl(i: str) -> str:
    return f"(CASE WHEN {i} < 0 THEN -({i}) WHEN {i} > 7 THEN 14 - ({i}) ELSE {i} END)"


def taps_sql(name: str, weights: str, radius: int) -> str:
    """Normalised taps ``d, w`` from a weight expression in ``d``."""
    return f"{name} AS (SELECT d, {weights} / sum({weights}) OVER () AS w FROM range(-{radius}, {radius + 1}) t(d))"


def conv_sql(src: str, out: str, taps: str, cols: str = "x") -> str:
    """Both passes of a separable convolution of pixel columns, reflecting at the border."""
    names = cols.split()
    sums = ", ".join(f"sum(t.w * s.{c}) AS {c}" for c in names)
    one = lambda a, b, keep, move: (
        f"{b} AS (SELECT o.vec_id, o.r, o.c, {sums} FROM {a} o CROSS JOIN {taps} t JOIN {a} s ON s.vec_id = o.vec_id "
        f"AND s.{keep} = o.{keep} AND s.{move} = {refl(f'o.{move} + t.d')} GROUP BY o.vec_id, o.r, o.c)"
    )
    return one(src, f"{out}_h", "r", "c") + ",\n" + one(f"{out}_h", out, "c", "r")


GAUSS1 = taps_sql("g1", "exp(-(d * d) / 2e0)", 3)


@query("gaussian_blur", f"WITH {PIX}, {GAUSS1}, {conv_sql('pix', 'b', 'g1')} SELECT vec_id, r * 8 + c AS i, round(x, 6) + 0e0 AS v FROM b")
def gaussian_blur(spark, sf):
    f = frames(spark, sf).withColumn("s", kernels.gaussian_blur("b", *EIGHT, sigma=1.0, precision="double"))
    return pixels(f, "s", "vec_id").select("vec_id", "i", r6("v").alias("v"))


@query("two_band_spread", f"""WITH {PIX}, {GAUSS1}, {conv_sql('pix', 'b', 'g1')}
SELECT vec_id, round(stddev_pop(p.x), 6) AS target, round(stddev_pop(b.x), 6) AS base, round(stddev_pop(p.x - b.x), 6) AS detail,
  round(max(abs(greatest(-1e0, least(1e0, b.x + (p.x - b.x))) - p.x)), 6) AS recombined
FROM pix p JOIN b USING (vec_id, r, c) GROUP BY 1""")
def two_band_spread(spark, sf):
    f = frames(spark, sf).withColumn("s", kernels.gaussian_blur("b", *EIGHT, sigma=1.0, precision="double"))
    f = f.withColumn("d", px_ops.subtract("b", "s"))
    back = F.array_max(px_ops.abs_error(px_ops.recombine("s", "d"), "b"))
    std = lambda c: r6(px_ops.statistics(c).getField("std"))
    return f.select("vec_id", std("b").alias("target"), std("s").alias("base"), std("d").alias("detail"), r6(back).alias("recombined"))


_SMOOTH = taps_sql("sm", "CASE abs(d) WHEN 0 THEN 6e0 WHEN 1 THEN 4e0 ELSE 1e0 END", 2)


@query("edge_map", f"""WITH {PIX}, lev AS (SELECT vec_id, r, c, v::DOUBLE AS x FROM pix), {_SMOOTH}, {conv_sql('lev', 'g', 'sm')},
k AS (SELECT dy, dx, dx * CASE dy WHEN 0 THEN 2e0 ELSE 1e0 END AS wx, dy * CASE dx WHEN 0 THEN 2e0 ELSE 1e0 END AS wy FROM range(-1, 2) a(dy), range(-1, 2) b(dx)),
m AS (SELECT o.vec_id, o.r, o.c, sqrt(sum(wx * s.x) ** 2 + sum(wy * s.x) ** 2) AS m FROM g o CROSS JOIN k
  JOIN g s ON s.vec_id = o.vec_id AND s.r = {refl('o.r + k.dy')} AND s.c = {refl('o.c + k.dx')} GROUP BY 1, 2, 3),
z AS (SELECT *, min(m) OVER (PARTITION BY vec_id) AS lo, max(m) OVER (PARTITION BY vec_id) AS hi FROM m)
SELECT vec_id, r * 8 + c AS i, round(coalesce((m - lo) / nullif(hi - lo, 0), 0), 6) + 0e0 AS v FROM z""")
def edge_map(spark, sf):
    f = frames(spark, sf).withColumn("e", kernels.edge_map("px", *EIGHT, precision="double"))
    return pixels(f, "e", "vec_id").select("vec_id", "i", r6("v").alias("v"))


@query("pyramid_level", f"""WITH {PIX}
SELECT o.vec_id, (y * 4 + x2) AS i, round(avg(p.x), 6) + 0e0 AS v FROM (SELECT vec_id, y, x2 FROM frames, range(4) a(y), range(4) b(x2)) o
JOIN pix p ON p.vec_id = o.vec_id AND abs(p.r - 2 * y) <= 1 AND abs(p.c - 2 * x2) <= 1 GROUP BY 1, 2""")
def pyramid_level(spark, sf):
    f = frames(spark, sf).withColumn("p", kernels.pool2("b", *EIGHT, precision="double"))
    return pixels(f, "p", "vec_id").select("vec_id", "i", r6("v").alias("v"))


@query("padded_frames", f"""WITH {PIX}
SELECT o.vec_id, (y * 18 + x2) AS i, round(p.x, 6) + 0e0 AS v, CASE WHEN y < 8 AND x2 < 8 THEN 1 ELSE 0 END AS inside
FROM (SELECT vec_id, y, x2 FROM frames, range(18) a(y), range(18) b(x2)) o
JOIN pix p ON p.vec_id = o.vec_id AND p.r = 7 - abs(y % 14 - 7) AND p.c = 7 - abs(x2 % 14 - 7)""")
def padded_frames(spark, sf):
    """Padding far beyond the frame: reflection repeats."""
    f = frames(spark, sf).withColumn("p", px_ops.pad_reflect("b", *EIGHT, multiple=18))
    inside = ((F.col("i") % 18 < SIDE) & (F.col("i") < 18 * SIDE)).cast("bigint")
    return pixels(f, "p", "vec_id").select("vec_id", "i", r6("v").alias("v"), inside.alias("inside"))


@query("unpadded_frames", f"WITH {PIX} SELECT vec_id, i, round(x, 6) + 0e0 AS v FROM pix")
def unpadded_frames(spark, sf):
    f = frames(spark, sf).withColumn("p", px_ops.pad_reflect("b", *EIGHT, multiple=18))
    f = f.withColumn("u", px_ops.unpad("p", 18, 18, *EIGHT))
    return pixels(f, "u", "vec_id").select("vec_id", "i", r6("v").alias("v"))


@query("augmented_windows", f"""WITH {BGR},
w AS (SELECT vec_id, floor({uniform_sql("vec_id", "2", "11", "'x'")} * 4)::BIGINT AS x0, floor({uniform_sql("vec_id", "2", "11", "'y'")} * 4)::BIGINT AS y0,
  {uniform_sql("vec_id", "2", "11", "'flip'")} < 0.5e0 AS flip, {uniform_sql("vec_id", "2", "11", "'jitter'")} < 0.8e0 AS jit,
  1e0 + ({uniform_sql("vec_id", "2", "11", "'gain'")} * 2e0 - 1e0) * 0.15e0 AS gain, ({uniform_sql("vec_id", "2", "11", "'bias'")} * 2e0 - 1e0) * 15e0 AS bias FROM frames)
SELECT vec_id, ((r - y0) * 5 + CASE WHEN flip THEN 4 - (c - x0) ELSE c - x0 END) * 3 + ch AS i,
  CASE WHEN jit THEN floor(greatest(0e0, least(255e0, v * gain + bias)))::BIGINT ELSE v END AS v
FROM bgr JOIN w USING (vec_id) WHERE r >= y0 AND r < y0 + 5 AND c >= x0 AND c < x0 + 5""")
def augmented_windows(spark, sf):
    seed = (F.col("vec_id"), F.lit(2), F.lit(11))
    f = frames(spark, sf).withColumn("bgr", colour("px"))
    x, y = px_ops.window_origin(F.lit(SIDE), F.lit(SIDE), 5, *seed)
    f = f.withColumn("a", px_ops.crop("bgr", *EIGHT, x, y, 5, 5, 3, "int"))
    flip = hash_uniform(*seed, F.lit("flip")) < 0.5
    f = f.withColumn("a", px_ops.flip("a", 5, 5, 3, flip, "int"))
    f = f.withColumn("a", px_ops.jitter("a", *px_ops.jitter_terms(*seed)))
    return pixels(f, "a", "vec_id").select("vec_id", "i", F.col("v").cast("bigint").alias("v"))


@query("centre_windows", f"WITH {PIX} SELECT vec_id, (r - 1) * 5 + (c - 1) AS i, v FROM pix WHERE r BETWEEN 1 AND 5 AND c BETWEEN 1 AND 5")
def centre_windows(spark, sf):
    x, y = px_ops.window_origin(F.lit(SIDE), F.lit(SIDE), 5, train=False)
    f = frames(spark, sf).withColumn("a", px_ops.crop("px", *EIGHT, x, y, 5, 5, 1, "int"))
    return pixels(f, "a", "vec_id").select("vec_id", "i", F.col("v").cast("bigint").alias("v"))


@query("common_crop", f"""WITH {PIX}, s AS (SELECT vec_id, least(8, 4 + vec_id % 6) AS h, least(8, 5 + vec_id % 7) AS w FROM frames)
SELECT vec_id, r * w + c AS i, v FROM pix JOIN s USING (vec_id) WHERE r < h AND c < w""")
def common_crop(spark, sf):
    f = frames(spark, sf)
    cut = px_ops.common_crop("px", *EIGHT, (4 + F.col("vec_id") % 6), (5 + F.col("vec_id") % 7))
    return pixels(f.withColumn("a", cut), "a", "vec_id").select("vec_id", "i", F.col("v").cast("bigint").alias("v"))


_LIN = """lin AS (SELECT d, floor(a)::BIGINT AS lo, least(floor(a)::BIGINT + 1, 7) AS hi, a - floor(a) AS f
  FROM (SELECT d, greatest(0e0, least(7e0, (d + 0.5e0) * 8 / 12 - 0.5e0)) AS a FROM range(12) t(d))),
lw AS (SELECT d, s, sum(w) AS w FROM (SELECT d, lo AS s, 1 - f AS w FROM lin UNION ALL SELECT d, hi, f FROM lin) GROUP BY 1, 2)"""
_AREA = """aw AS (SELECT d, s, greatest(0e0, least((d + 1) * 1.6e0, s + 1e0) - greatest(d * 1.6e0, s::DOUBLE)) / 1.6e0 AS w FROM range(5) a(d), range(8) b(s))"""


def _resize_sql(w: str, n: int) -> str:
    return f"""SELECT p.vec_id, y.d * {n} + x.d AS i, round(sum(y.w * x.w * p.x), 6) + 0e0 AS v FROM pix p JOIN {w} y ON y.s = p.r JOIN {w} x ON x.s = p.c
WHERE y.w <> 0 AND x.w <> 0 GROUP BY 1, 2"""


@query("enlarged_frames", f"WITH {PIX}, {_LIN} {_resize_sql('lw', 12)}")
def enlarged_frames(spark, sf):
    f = frames(spark, sf).withColumn("e", kernels.resize("b", *EIGHT, 12, 12, "linear", precision="double"))
    return pixels(f, "e", "vec_id").select("vec_id", "i", r6("v").alias("v"))


@query("shrunk_frames", f"WITH {PIX}, {_AREA} {_resize_sql('aw', 5)}")
def shrunk_frames(spark, sf):
    f = frames(spark, sf).withColumn("e", kernels.resize("b", *EIGHT, 5, 5, "area", precision="double"))
    return pixels(f, "e", "vec_id").select("vec_id", "i", r6("v").alias("v"))


@query("target_sizes", """
WITH s AS (SELECT p_partkey, 100 + p_size * 9 AS w, 60 + p_partkey % 700 AS h FROM part)
SELECT p_partkey, greatest(1, round_even(h * 64 / w::DOUBLE, 0))::BIGINT AS h64,
  CASE WHEN 300e0 / greatest(h, w) < 1 THEN floor(h * (300e0 / greatest(h, w))) ELSE h END::BIGINT AS cap_h,
  CASE WHEN 300e0 / greatest(h, w) < 1 THEN floor(w * (300e0 / greatest(h, w))) ELSE w END::BIGINT AS cap_w,
  CASE WHEN least(h, w) < 256 THEN greatest(256, round_even(h * (256e0 / least(h, w)), 0)) ELSE h END::BIGINT AS up_h,
  CASE WHEN least(h, w) < 256 THEN greatest(256, round_even(w * (256e0 / least(h, w)), 0)) ELSE w END::BIGINT AS up_w FROM s""")
def target_sizes(spark, sf):
    s = table(spark, sf, "part").select("p_partkey", (100 + F.col("p_size") * 9).alias("w"), (60 + F.col("p_partkey") % 700).alias("h"))
    cap, up = kernels.capped_size("h", "w", 300), kernels.at_least("h", "w", 256)
    cols = {"h64": kernels.height_for_width("h", "w", 64), "cap_h": cap[0], "cap_w": cap[1], "up_h": up[0], "up_w": up[1]}
    return s.select("p_partkey", *[c.cast("bigint").alias(n) for n, c in cols.items()])


@query("warped_frames", f"""WITH {PIX},
o AS (SELECT vec_id, y, x2, (x2 - (label * 0.3e0 - 1e0)) / (1e0 + label * 0.05e0) AS sx, (y - 0.5e0) / (1e0 + label * 0.05e0) AS sy
  FROM frames, range(8) a(y), range(9) b(x2)),
q AS (SELECT vec_id, y, x2, CASE WHEN abs(sx - round_even(sx, 0)) < 1e-9 THEN round_even(sx, 0) ELSE sx END AS sx,
  CASE WHEN abs(sy - round_even(sy, 0)) < 1e-9 THEN round_even(sy, 0) ELSE sy END AS sy FROM o),
n AS (SELECT vec_id, y, x2, floor(sy) + dy AS r, floor(sx) + dx AS c,
  abs(1 - dy - (sy - floor(sy))) * abs(1 - dx - (sx - floor(sx))) AS w FROM q, range(2) a(dy), range(2) b(dx))
SELECT n.vec_id, y * 9 + x2 AS i, round(sum(w * coalesce(p.x, 0)), 6) + 0e0 AS v FROM n LEFT JOIN pix p ON p.vec_id = n.vec_id AND p.r = n.r AND p.c = n.c GROUP BY 1, 2""")
def warped_frames(spark, sf):
    s, z = F.lit(1.0) + F.col("label") * 0.05, F.lit(0.0)
    h = F.array(F.array(s, z, F.col("label") * 0.3 - 1.0), F.array(z, s, F.lit(0.5)), F.array(z, z, F.lit(1.0)))
    f = frames(spark, sf).withColumn("w", kernels.warp("b", *EIGHT, h, 8, 9, precision="double"))
    return pixels(f, "w", "vec_id").select("vec_id", "i", r6("v").alias("v"))


@query("error_map", f"""WITH {PIX}, e AS (SELECT vec_id, abs(x - ((v // 16 * 16) / 127.5e0 - 1e0)) AS d FROM pix)
SELECT vec_id, round(avg(d), 6) AS mean_error, round(max(d), 6) AS max_error FROM e GROUP BY 1""")
def error_map(spark, sf):
    coarse = REL8.normalise(F.transform("px", lambda v: F.floor(v / 16) * 16))
    f = frames(spark, sf).withColumn("e", px_ops.abs_error("b", coarse))
    return f.select("vec_id", r6(px_ops.array_mean("e")).alias("mean_error"), r6(F.array_max("e")).alias("max_error"))


# -- scores ---------------------------------------------------------------
_PAIR = PIX + """,
pq AS (SELECT vec_id, label, r, c, (v // 16 * 16) / 255e0 AS a, v / 255e0 AS b FROM pix),
prod AS (SELECT vec_id, r, c, a, b, a * a AS aa, b * b AS bb, a * b AS ab FROM pq),
""" + taps_sql("g15", "exp(-(d * d) / 4.5e0)", 5) + ",\n" + conv_sql("prod", "mu", "g15", "a b aa bb ab") + """,
ss AS (SELECT vec_id, avg(((2 * a * b + 1e-4) * (2 * (ab - a * b) + 9e-4)) / ((a * a + b * b + 1e-4) * ((aa - a * a) + (bb - b * b) + 9e-4))) AS ssim FROM mu GROUP BY 1),
per AS (SELECT vec_id, label, avg(abs(a - b)) AS l1, sqrt(avg((a - b) ** 2)) AS rmse, 10e0 * log10(1e0 / greatest(avg((a - b) ** 2), 1e-12)) AS psnr FROM pq GROUP BY 1, 2)"""


def _sides(spark, sf):
    f = with_size(frames(spark, sf)).withColumn("file", name_of())
    coarse = F.transform("px", lambda v: (F.floor(v / 16) * 16).cast("int"))
    return f.select("file", "height", "width", coarse.alias("px")), f.select("file", "height", "width", "px")


@query("scored_pairs", f"""WITH {_PAIR}
SELECT printf('%06d', vec_id) AS stem, round(l1, 6) AS l1, round(rmse, 6) AS rmse, round(psnr, 5) AS psnr, round(ssim, 6) AS ssim FROM per JOIN ss USING (vec_id)""")
def scored_pairs(spark, sf):
    s = score_pairs(*_sides(spark, sf), REL8)
    return s.select("stem", r6("l1").alias("l1"), r6("rmse").alias("rmse"), F.round("psnr", 5).alias("psnr"), r6("ssim").alias("ssim"))


@query("score_summary", f"""WITH {_PAIR}
SELECT count(*) AS n, round(avg(l1), 6) AS l1, round(avg(rmse), 6) AS rmse, round(avg(psnr), 5) AS psnr, round(avg(ssim), 6) AS ssim FROM per JOIN ss USING (vec_id)""")
def score_summary(spark, sf):
    e = evaluate(*_sides(spark, sf), REL8)
    return e.select("n", r6("L1").alias("l1"), r6("RMSE").alias("rmse"), F.round("PSNR", 5).alias("psnr"), r6("SSIM").alias("ssim"))


@query("score_summary_degrees", f"""WITH {PIX},
t AS (SELECT vec_id, greatest(-1e0, least(1e0, ((6500 + v * 8) * 0.04e0 + -273.15e0 - -20e0) / 100e0 * 2e0 - 1e0)) AS p,
  greatest(-1e0, least(1e0, ((6500 + v * 8 + vec_id % 9 * 5) * 0.04e0 + -273.15e0 - -20e0) / 100e0 * 2e0 - 1e0)) AS g FROM pix),
s AS (SELECT vec_id, avg(abs(p - g)) / 2e0 AS l1, sqrt(avg(((p - g) / 2e0) ** 2)) AS rmse FROM t GROUP BY 1)
SELECT count(*) AS n, round(avg(l1), 6) AS l1, round(avg(l1) * 100e0, 4) AS l1_deg, round(avg(rmse) * 100e0, 4) AS rmse_deg FROM s""")
def score_summary_degrees(spark, sf):
    f = with_size(frames(spark, sf)).withColumn("file", name_of())
    p = f.select("file", "height", "width", F.transform("px", lambda v: 6500 + v * 8).alias("px"))
    g = f.select("file", "height", "width", F.transform("px", lambda v: 6500 + v * 8 + F.col("vec_id") % 9 * 5).alias("px"))
    e = evaluate(p, g, ThermalNorm("abs16"), depth=16)
    return e.select("n", r6("L1").alias("l1"), F.round("L1_degC", 4).alias("l1_deg"), F.round("RMSE_degC", 4).alias("rmse_deg"))


@query("score_by_session", f"""WITH {PIX}, pq AS (SELECT vec_id, label, (v // 16 * 16) / 255e0 AS a, v / 255e0 AS b FROM pix),
per AS (SELECT vec_id, label, avg(abs(a - b)) AS l1, sqrt(avg((a - b) ** 2)) AS rmse, 10 * log10(1 / greatest(avg((a - b) ** 2), 1e-12)) AS psnr FROM pq GROUP BY 1, 2)
SELECT label, count(*) AS n, round(avg(l1), 6) AS l1, round(avg(rmse), 6) AS rmse, round(avg(psnr), 6) AS psnr FROM per GROUP BY 1""")
def score_by_session(spark, sf):
    f = frames(spark, sf).select("label", name_of().alias("file"), F.lit(8).alias("height"), F.lit(8).alias("width"), "px")
    coarse = f.withColumn("px", F.transform("px", lambda v: (F.floor(v / 16) * 16).cast("int")))
    out = evaluate(coarse.drop("label"), f, REL8, by=["label"])
    return out.select("label", "n", r6("L1").alias("l1"), r6("RMSE").alias("rmse"), r6("PSNR").alias("psnr"))


_CORR = PIX + """,
m AS (SELECT label, i, avg(x) AS y FROM pix GROUP BY 1, 2),
k AS (SELECT vec_id, p.label, covar_pop(p.x, m.y) / nullif(stddev_pop(p.x) * stddev_pop(m.y), 0) AS r FROM
  (SELECT vec_id, label, i, CASE WHEN vec_id % 10 = 0 THEN 0.25e0 ELSE x END AS x FROM pix) p JOIN m USING (label, i) GROUP BY 1, 2)"""


def _correlated(spark, sf):
    """Each frame against its session's mean frame; every tenth frame is flat."""
    f = frames(spark, sf)
    mean = pixels(f, "b", "label").groupBy("label", "i").agg(F.avg("v").alias("m"))
    # Exactly one value per pixel position.
    mean = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("m"))
    flat = F.transform("b", lambda x: F.lit(0.25))
    f = f.withColumn("x", F.when(F.col("vec_id") % 10 == 0, flat).otherwise(F.col("b")))
    return f.join(mean, "label").select("vec_id", "label", kernels.correlation("x", "m").alias("r"))


@query("frame_correlation", f"WITH {_CORR} SELECT vec_id, round(coalesce(r, -9), 6) + 0e0 AS r FROM k")
def frame_correlation(spark, sf):
    return _correlated(spark, sf).select("vec_id", r6(F.coalesce("r", F.lit(-9.0))).alias("r"))


@query("correlation_verdict", f"""WITH {_CORR}, a AS (SELECT label, avg(r * (1 + label / 4e0)) AS m FROM k GROUP BY 1)
SELECT label, round(m, 6) + 0e0 AS mean_r, CASE WHEN m > 0.75 THEN 'shortcut' WHEN m > 0.5 THEN 'partial' ELSE 'decoupled' END AS verdict FROM a""")
def correlation_verdict(spark, sf):
    a = _correlated(spark, sf).groupBy("label").agg(F.avg(F.col("r") * (1 + F.col("label") / 4.0)).alias("m"))
    return a.select("label", r6("m").alias("mean_r"), scores.verdict(F.col("m")).alias("verdict"))


# -- profiles -------------------------------------------------------------
@query("frame_profile", f"""WITH {PIX}
SELECT vec_id, round_even(avg(v), 3) AS mean, round_even(stddev_pop(v), 3) AS std, min(v) AS min, max(v) AS max FROM pix GROUP BY 1""")
def frame_profile(spark, sf):
    p = profile.frame_profile(frames(spark, sf).select("vec_id", "px"), "px")
    return p.select("vec_id", "mean", "std", F.col("min").cast("bigint").alias("min"), F.col("max").cast("bigint").alias("max"))


@query("session_profile", f"""WITH {PIX}, m AS (SELECT vec_id, label, avg(v) AS m FROM pix GROUP BY 1, 2)
SELECT label, count(*) AS frames, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS sigma FROM m GROUP BY 1""")
def session_profile(spark, sf):
    out = profile.session_profile(frames(spark, sf), "label", px_ops.array_mean("px"))
    return out.select("label", "frames", r6("mean").alias("mean"), r6("sigma").alias("sigma"))


@query("intensity_histogram", f"""WITH {PIX} SELECT v AS bin, count(*) AS n, round(count(*) / (SELECT count(*) FROM pix), 9) AS fraction FROM pix GROUP BY 1""")
def intensity_histogram(spark, sf):
    h = profile.histogram(frames(spark, sf), "px")
    return h.select(F.col("bin").cast("bigint").alias("bin"), "n", F.round("fraction", 9).alias("fraction"))


@query("intensity_quantiles", f"""WITH {PIX},
p AS (SELECT label, v * 257 AS v, row_number() OVER (PARTITION BY label ORDER BY v) AS rn, count(*) OVER (PARTITION BY label) AS n FROM pix)
SELECT label, n, {", ".join(f"max(v) FILTER (rn = greatest(1, ceil({q}e0 * n))) AS q{int(q * 100)}" for q in (0.01, 0.25, 0.5, 0.99))} FROM p GROUP BY 1, 2""")
def intensity_quantiles(spark, sf):
    """Exact quantiles of 16-bit frames by session, from the histogram."""
    f = frames(spark, sf).select("label", F.transform("px", lambda v: v * 257).alias("px"))
    q = profile.quantiles(profile.histogram(f, "px", by=["label"], depth=16), (0.01, 0.25, 0.5, 0.99), ["label"])
    at = lambda i, name: F.col("quantiles")[i].cast("bigint").alias(name)
    return q.select("label", "n", at(0, "q1"), at(1, "q25"), at(2, "q50"), at(3, "q99"))


@query("saturated_fraction", f"""WITH {PIX}, q AS (SELECT greatest(0, least(255, (v - 127) * 3 + 127)) AS v FROM pix)
SELECT round(count(*) FILTER (v = 0) / count(*), 9) AS at_min, round(count(*) FILTER (v = 255) / count(*), 9) AS at_max FROM q""")
def saturated_fraction(spark, sf):
    hard = F.transform("px", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), (v - 127) * 3 + 127)))
    s = profile.saturation(profile.histogram(frames(spark, sf).select(hard.alias("q")), "q"))
    return s.select(F.round("at_min", 9).alias("at_min"), F.round("at_max", 9).alias("at_max"))


@query("frame_to_frame_change", f"""WITH {PIX},
l AS (SELECT vec_id, label, i, abs(v - lag(v) OVER (PARTITION BY label, i ORDER BY vec_id)) AS d FROM pix)
SELECT vec_id, round(avg(d), 6) AS moved FROM l GROUP BY 1 HAVING avg(d) IS NOT NULL""")
def frame_to_frame_change(spark, sf):
    """Frames meet their neighbours in the sorted partitions."""
    moved = neighbours.change(frames(spark, sf).select("label", "vec_id", "px"), ["label"], ["vec_id"], name="moved")
    return moved.where("moved is not null").select("vec_id", r6("moved").alias("moved"))


@query("static_frames_by_pixels", f"""WITH {PIX},
l AS (SELECT vec_id, label, i, v // 64 AS q FROM pix),
d AS (SELECT vec_id, label, avg(abs(q - lag_q)) AS moved FROM (SELECT *, lag(q) OVER (PARTITION BY label, i ORDER BY vec_id) AS lag_q FROM l) GROUP BY 1, 2)
SELECT vec_id, label, coalesce(moved < 0.6e0, false) AS static FROM d""")
def static_frames_by_pixels(spark, sf):
    """The frozen-frame filter on coarse pixels."""
    f = frames(spark, sf).select("label", F.col("vec_id").alias("id"), F.transform("px", lambda v: F.floor(v / 64).cast("int")).alias("px"))
    seg = ordered.segment(f.select("label", F.col("id").alias("ir_id"), F.col("id").alias("k")), ["label"], ["k"])
    return sync.mark_static_frames(seg, ["label"], f, 0.6).select(F.col("ir_id").alias("vec_id"), "label", "static")


# A TIFF of 8 x 8 samples of 16 bits, up to its samples: header and one directory of seven tags.
_TIFF_HEAD = (
    "49492A0008000000" "0700"
    "000103000100000008000000" "010103000100000008000000" "020103000100000010000000" "030103000100000001000000"
    "110104000100000062000000" "150103000100000001000000" "170104000100000080000000" "00000000"
)


@query("read_images_tiff", f"""WITH {PIX} SELECT vec_id, 8 AS height, 8 AS width, 16 AS depth, sum((v * 257 + vec_id) % 65536 * (i + 1))::BIGINT AS pinned FROM pix GROUP BY 1""")
def read_images_tiff(spark, sf):
    """Frames written as TIFF bytes and read back at full depth."""
    f = frames(spark, sf).withColumn("deep", F.transform("px", lambda v: (v * 257 + F.col("vec_id")) % 65536))
    pair = lambda v: F.concat(F.lpad(F.hex(v.cast("bigint") % 256), 2, "0"), F.lpad(F.hex(F.floor(v / 256)), 2, "0"))
    body = F.array_join(F.transform("deep", pair), "")
    found = f.select("vec_id", images.decode_frames(F.unhex(F.concat(F.lit(_TIFF_HEAD), body))).alias("f")).select("vec_id", "f.*")
    sums = F.aggregate(F.transform("px", lambda v, i: v.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return found.select("vec_id", "height", "width", "depth", sums.alias("pinned"))
