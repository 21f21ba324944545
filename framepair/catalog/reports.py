"""Queries over stored model outputs, calibrations and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from framepair.catalog.base import ABS16, FRAMES, PIX, colour, frames, name_of, query, r6, table
from framepair.functions import kernels
from framepair.operators import calibrate, profile, scores, split
from framepair.plans import manifest

_LOGITS = """
lg AS (SELECT event_id, event_type, user_id % 2 AS scale, value / 50e0 - 1e0 AS logit,
  CASE WHEN event_type IN ('click', 'purchase') THEN 1e0 ELSE 0e0 END AS target, event_id // 500 AS batch FROM events)"""


def _logits(spark, sf):
    e = table(spark, sf, "events")
    target = F.when(F.col("event_type").isin("click", "purchase"), F.lit(1.0)).otherwise(F.lit(0.0))
    return e.select(
        "event_id", "event_type", (F.col("user_id") % 2).alias("scale"), (F.col("value") / 50.0 - 1.0).alias("logit"),
        target.alias("target"), F.floor(F.col("event_id") / 500).alias("batch"),
    )


_BCE = "greatest(logit, 0e0) - logit * target + ln(1e0 + exp(-abs(logit)))"


@query("adversarial_squared", f"WITH {_LOGITS} SELECT event_type, round(avg((logit - target) ** 2), 6) AS score FROM lg GROUP BY 1")
def adversarial_squared(spark, sf):
    return scores.adversarial(_logits(spark, sf), ["event_type"]).withColumn("score", r6("score"))


@query("adversarial_entropy", f"WITH {_LOGITS} SELECT event_type, round(avg({_BCE}), 6) AS score FROM lg GROUP BY 1")
def adversarial_entropy(spark, sf):
    return scores.adversarial(_logits(spark, sf), ["event_type"], "vanilla").withColumn("score", r6("score"))


@query("adversarial_multiscale", f"""WITH {_LOGITS}, s AS (SELECT event_type, scale, avg((logit - target) ** 2) AS m FROM lg GROUP BY 1, 2)
SELECT event_type, round(avg(m), 6) AS score FROM s GROUP BY 1""")
def adversarial_multiscale(spark, sf):
    return scores.adversarial(_logits(spark, sf), ["event_type"], scale="scale").withColumn("score", r6("score"))


@query("objective_terms", f"""WITH {_LOGITS},
t AS (SELECT batch, avg((logit - 1e0) ** 2) AS g, avg(logit ** 2) AS f, avg(abs(logit - target)) AS l1,
  -0.5e0 * avg(1e0 + (logit / 4e0 - 1e0) - (logit / 2e0) ** 2 - exp(logit / 4e0 - 1e0)) AS kl, avg(abs(logit / 2e0 - target)) AS lev FROM lg GROUP BY 1)
SELECT batch, round(kl, 6) AS kl, round(lev, 6) AS level, round(g + 100e0 * l1, 6) AS single, round(0.5e0 * (f + g), 6) AS critic,
  round(2 * g + 200e0 * l1 + 10e0 * lev + 0.01e0 * kl, 6) AS two_stage, round(2 * g + 20e0 * l1 + 10e0 * lev, 6) AS cycle FROM t""")
def objective_terms(spark, sf):
    lg = _logits(spark, sf)
    logit, target = F.col("logit"), F.col("target")
    one, zero = F.lit(1.0), F.lit(0.0)
    t = lg.groupBy("batch").agg(
        F.avg(scores.adversarial_term(logit, one)).alias("g"), F.avg(scores.adversarial_term(logit, zero)).alias("f"),
        F.avg(F.abs(logit - target)).alias("l1"), scores.kl(logit / 2.0, logit / 4.0 - 1.0).alias("kl"),
        scores.level_consistency(logit / 2.0, target).alias("lev"),
    )
    g, l1, lev = F.col("g"), F.col("l1"), F.col("lev")
    two = {"gan1": g, "gan2": g, "l1_1": l1, "l1_2": l1, "temp": lev, "kl": F.col("kl")}
    cyc = {"gan_ab": g, "gan_ba": g, "cyc_a": l1, "cyc_b": l1, "idt_a": lev, "idt_b": lev}
    return t.select(
        "batch", r6("kl").alias("kl"), r6("lev").alias("level"),
        r6(scores.generator_objective("single", {"gan": g, "l1": l1}, {})).alias("single"),
        r6(scores.discriminator_objective(F.col("f"), g)).alias("critic"),
        r6(scores.generator_objective("two_stage", two, {})).alias("two_stage"),
        r6(scores.generator_objective("cycle", cyc, {})).alias("cycle"),
    )


@query("capped_validation", f"""WITH {_LOGITS}, b AS (SELECT event_type, batch AS batch_id, avg(abs(logit - target)) AS l1, count(*) AS n FROM lg GROUP BY 1, 2)
SELECT event_type, round(sum(l1 * n) / greatest(1, sum(n)), 6) AS l1_norm, sum(n)::BIGINT AS n, round(sum(l1 * n) / greatest(1, sum(n)) * 50e0, 5) AS l1_deg
FROM b WHERE batch_id < 12 GROUP BY 1""")
def capped_validation(spark, sf):
    per = _logits(spark, sf).groupBy("event_type", F.col("batch").alias("batch_id")).agg(
        F.avg(F.abs(F.col("logit") - F.col("target"))).alias("l1"), F.count(F.lit(1)).alias("n")
    )
    out = scores.capped_validation(per, 12, ABS16, ["event_type"])
    return out.select("event_type", r6("l1_norm").alias("l1_norm"), "n", F.round("l1_degC", 5).alias("l1_deg"))


# -- calibration ----------------------------------------------------------
@query("best_calibration", """
WITH s AS (SELECT user_id, event_id AS frame, value AS h, CASE WHEN event_type = 'error' THEN NULL ELSE floor(value / 10) END AS cc FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cc DESC, frame) AS rn FROM s WHERE cc IS NOT NULL)
SELECT user_id, frame, round(h, 6) AS h, round(cc, 6) AS cc FROM r WHERE rn = 1""")
def best_calibration(spark, sf):
    e = table(spark, sf, "events")
    cc = F.when(F.col("event_type") != "error", F.floor(F.col("value") / 10).cast("double"))
    s = e.select("user_id", F.col("event_id").alias("frame"), F.array(F.array("value")).alias("H"), cc.alias("cc"))
    b = calibrate.best_calibration(s, ["user_id"])
    return b.select("user_id", "frame", r6(F.col("H")[0][0]).alias("h"), r6("cc").alias("cc"))


_POINTS = """
pts AS (SELECT c_nationkey % 5 AS rec, c_custkey AS i, (c_custkey * 37 % 640)::DOUBLE AS x, (c_custkey * 53 % 480)::DOUBLE AS y,
  0.5e0 * (c_custkey * 37 % 640) + -8e0 + CASE WHEN c_acctbal < 1000 THEN 25e0 + c_custkey % 40 ELSE 0e0 END AS u,
  0.5e0 * (c_custkey * 53 % 480) + -6e0 + CASE WHEN c_acctbal < 500 THEN 17e0 ELSE 0e0 END AS v FROM customer)"""


def _points(spark, sf):
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    x, y = (k * 37 % 640).cast("double"), (k * 53 % 480).cast("double")
    u = x * 0.5 - 8.0 + F.when(bal < 1000, F.lit(25.0) + k % 40).otherwise(F.lit(0.0))
    v = y * 0.5 - 6.0 + F.when(bal < 500, F.lit(17.0)).otherwise(F.lit(0.0))
    return table(spark, sf, "customer").select(
        (F.col("c_nationkey") % 5).alias("rec"), k.alias("i"), x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v")
    )


@query("fitted_homography", f"""WITH {_POINTS}
SELECT DISTINCT rec::BIGINT AS rec, 0.5e0 AS h00, 0e0 AS h01, -8e0 AS h02, 0e0 AS h10, 0.5e0 AS h11, -6e0 AS h12, 0e0 AS h20, 0e0 AS h21, 1e0 AS h22 FROM pts""")
def fitted_homography(spark, sf):
    """About a tenth of the points are outliers; the true matrix must come back."""
    h = calibrate.fit_homography(_points(spark, sf), ["rec"])
    cell = lambda i, j: (F.round(F.col("H")[i][j], 4) + F.lit(0.0)).alias(f"h{i}{j}")
    return h.select(F.col("rec").cast("bigint").alias("rec"), *[cell(i, j) for i in range(3) for j in range(3)])


_ERR = f"""{_POINTS},
e AS (SELECT rec, i, sqrt((0.5e0 * x - 8e0 - u) ** 2 + (0.5e0 * y - 6e0 - v) ** 2) AS err FROM pts)"""


def _true_matrices(spark, sf):
    lit = F.lit
    h = F.array(F.array(lit(0.5), lit(0.0), lit(-8.0)), F.array(lit(0.0), lit(0.5), lit(-6.0)), F.array(lit(0.0), lit(0.0), lit(1.0)))
    return _points(spark, sf).select("rec").distinct().withColumn("H", h)


@query("reprojection_report", f"""WITH {_ERR}
SELECT rec::BIGINT AS rec, count(*) AS n, count(*) FILTER (err <= 3) AS inliers, round(avg(err), 6) AS mean_err, round(max(err), 6) AS max_err FROM e GROUP BY 1""")
def reprojection_report(spark, sf):
    r = calibrate.reprojection_report(_points(spark, sf), _true_matrices(spark, sf), ["rec"])
    return r.select(F.col("rec").cast("bigint").alias("rec"), "n", "inliers", r6("mean_err").alias("mean_err"), r6("max_err").alias("max_err"))


@query("flagged_points", f"WITH {_ERR} SELECT i, round(err, 6) AS err FROM e WHERE err > 3 OR err > 5")
def flagged_points(spark, sf):
    r = calibrate.reproject(_points(spark, sf), _true_matrices(spark, sf), ["rec"])
    return r.where("flagged").select("i", r6("err").alias("err"))


@query("rejected_points", """
WITH c AS (SELECT c_mktsegment AS seg, c_nationkey AS nat, count(*) AS n, count(*) FILTER (c_acctbal > 9000) AS holes FROM customer GROUP BY 1, 2)
SELECT seg, nat::BIGINT AS nat, n, CASE WHEN holes > 0 THEN 'unequal lists' ELSE 'fewer than 4 points' END AS reason FROM c WHERE holes > 0 OR n < 4""")
def rejected_points(spark, sf):
    c = table(spark, sf, "customer")
    hole = F.when(F.col("c_acctbal") <= 9000, F.lit(1.0))
    p = c.select(F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").cast("bigint").alias("nat"), F.lit(0.0).alias("x"), hole.alias("u"))
    return calibrate.check_points(p, ["seg", "nat"]).select("seg", "nat", "n", "reason")


@query("searched_alignment", f"""WITH {FRAMES}
SELECT label, 1e0 AS scale, (label % 3 * -3)::DOUBLE AS tx, (label // 3 % 3 * -3)::DOUBLE AS ty, count(*) AS frames FROM frames GROUP BY ALL""")
def searched_alignment(spark, sf):
    """IR frames are 18 x 18 windows of a 24 x 24 RGB frame at an offset known per session."""
    f = frames(spark, sf)
    big = kernels.resize("px", 8, 8, 24, 24, "linear", precision="double")
    ox, oy = F.col("label") % 3 * 3, F.floor(F.col("label") / 3) % 3 * 3
    # Slices of a list, so that no further Python worker reads the large frames.
    window = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(17)), lambda r: F.slice("big", ((oy + r) * 24 + ox + 1).cast("int"), 18)))
    f = f.withColumn("big", big).withColumn("ir", window)
    size = {"rgb_h": 24, "rgb_w": 24, "ir_h": 18, "ir_w": 18}
    pairs = f.select(
        F.col("label").alias("rec_id"), F.col("vec_id").alias("frame"), F.col("big").alias("rgb_px"), F.col("ir").alias("ir_px"),
        *[F.lit(v).alias(k) for k, v in size.items()],
    )
    found = calibrate.search_alignment(pairs, ["rec_id"], calibrate.candidate_grid([-3, 0, 3], [24 / 18]))
    n = f.groupBy("label").agg(F.count(F.lit(1)).alias("frames"))
    out = found.join(n, found.rec_id == n.label)
    at = lambda i, j, name: (r6(F.col("H")[i][j]) + F.lit(0.0)).alias(name)
    return out.select("label", at(0, 0, "scale"), at(0, 2, "tx"), at(1, 2, "ty"), "frames")


# -- manifest -------------------------------------------------------------
def manifest_rows(spark, sf):
    f = frames(spark, sf)
    named = split.chunk_split(f.select("vec_id"), [], ["vec_id"], 0.2, 40).select("vec_id", "split")
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    pairs = f.join(named, "vec_id").select(
        name_of().alias("name"), "split", F.lit(8).alias("ir_w"), F.lit(8).alias("ir_h"), F.lit(8).alias("ir_depth"), F.col("px").alias("ir_px"),
        colour().alias("rgb_px"), text(colour()).alias("rgb_content"), text("px").alias("ir_content"),
    )
    return manifest.build(pairs)


MANIFEST_SQL = f"""{PIX},
s AS (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 40 AS ch, (count(*) OVER () + 39) // 40 AS nch FROM frames),
k AS (SELECT *, greatest(1, round_even(0.2e0 * nch, 0)::BIGINT) AS k FROM s),
sp AS (SELECT vec_id, CASE WHEN list_contains(list_transform(range(k), lambda j: CASE WHEN k = 1 THEN 0 WHEN j = k - 1 THEN nch - 1
  ELSE floor(j * ((nch - 1)::DOUBLE / nullif(k - 1, 0)))::BIGINT END), ch) THEN 'val' ELSE 'train' END AS split FROM k),
man AS (SELECT printf('%06d', vec_id) AS frame, split, 8 AS width, 8 AS height, 'uint8' AS thermal_dtype, round_even(avg(v), 3) AS thermal_mean,
  round_even(stddev_pop(v), 3) AS thermal_std, min(v) AS thermal_min, max(v) AS thermal_max,
  round_even(sum(v + 255 - v + v * 3 % 256) / 192e0, 3) AS rgb_mean,
  sha256(string_agg(v || ',' || (255 - v) || ',' || (v * 3 % 256), ',' ORDER BY i)) AS rgb_sha256, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS thermal_sha256
  FROM pix JOIN sp USING (vec_id) GROUP BY vec_id, split)"""


@query("pair_manifest", f"WITH {MANIFEST_SQL} SELECT * FROM man")
def pair_manifest(spark, sf):
    return manifest_rows(spark, sf)


@query("split_composition", f"""WITH {MANIFEST_SQL}
SELECT split, count(*) AS pairs, min(frame) AS first, max(frame) AS last, round(avg(thermal_mean), 6) AS mean_of_means, round(stddev_pop(thermal_mean), 6) AS sigma FROM man GROUP BY 1""")
def split_composition(spark, sf):
    c = profile.split_composition(manifest_rows(spark, sf).withColumnRenamed("thermal_mean", "mean"))
    return c.withColumn("mean_of_means", r6("mean_of_means")).withColumn("sigma", r6("sigma"))


@query("verified_copy", f"""WITH {MANIFEST_SQL}
SELECT frame, CASE WHEN split = 'val' THEN 'missing' WHEN frame LIKE '%7' THEN 'changed' ELSE 'ok' END AS state FROM man""")
def verified_copy(spark, sf):
    ours = manifest_rows(spark, sf)
    digest = F.when(F.col("frame").endswith("7"), F.lit("?")).otherwise(F.col("rgb_sha256"))
    theirs = ours.where("split <> 'val'").withColumn("rgb_sha256", digest)
    return manifest.verify(ours, theirs)
