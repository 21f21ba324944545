"""Whole jobs: registration, session preparation, samples, translation, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from framepair.catalog.base import (
    ABS16, BGR, FRAMES, PIX, REL8, colour, frames, name_of, pick_sql, pixels, query, r6, uniform_sql, with_size,
)
from framepair.catalog.joins import FOLDERS, TREE, _NORTH, tree
from framepair.functions import kernels
from framepair.functions import pixels as px_ops
from framepair.operators import align
from framepair.operators.ordered import dense_index
from framepair.plans import register as registration
from framepair.plans import samples, sessions, translate, unpaired
from framepair.plans.translate import LinearModel
from framepair.session import materialise, staging_path
from framepair.sources import sinks, tables


def _weighted(px: str, digits: int = 5):
    """Position-weighted sum of a frame: one number that pins every pixel in place."""
    return F.round(F.aggregate(F.arrays_zip(F.col(px).alias("v"), F.sequence(F.lit(1), F.size(px)).alias("i")), F.lit(0.0), lambda s, z: s + z.v * z.i), digits)


# -- registration ---------------------------------------------------------
def _recordings(spark, sf):
    f = with_size(frames(spark, sf)).withColumn("name", name_of()).withColumn("rec_id", F.col("label"))
    f = f.withColumn("idx", F.col("vec_id"))
    rgb = f.select("rec_id", "name", "idx", "height", "width", F.lit(3).alias("channels"), colour().alias("px"))
    ir = f.select("rec_id", "name", "idx", "height", "width", F.lit(1).alias("channels"), "px")
    return rgb, ir


_REG_SPLIT = """
ix AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, count(*) OVER (PARTITION BY label) AS n FROM frames),
ch AS (SELECT *, idx // 9 AS chunk_id, greatest(1, (n + 8) // 9) AS nch FROM ix),
sp AS (SELECT *, CASE WHEN """ + pick_sql("chunk_id", "nch", "greatest(1, round_even(0.2e0 * nch, 0)::BIGINT)") + """ THEN 'val' ELSE 'train' END AS split FROM ch)"""


@query("registered_frames", f"""WITH {BGR}, {_REG_SPLIT},
a AS (SELECT vec_id, sum(v * (((r - 2) * 5 + (c - 1)) * 3 + ch + 1)) AS rgb FROM bgr WHERE r BETWEEN 2 AND 5 AND c BETWEEN 1 AND 5 GROUP BY 1),
b AS (SELECT vec_id, sum(v * ((r - 2) * 5 + (c - 1) + 1)) AS ir FROM pix WHERE r BETWEEN 2 AND 5 AND c BETWEEN 1 AND 5 GROUP BY 1)
SELECT label AS rec_id, printf('%06d.png', vec_id) AS name, idx, chunk_id, split, round(rgb::DOUBLE, 3) AS rgb, round(ir::DOUBLE, 3) AS ir, 4 AS height, 5 AS width
FROM sp JOIN a USING (vec_id) JOIN b USING (vec_id)""")
def registered_frames(spark, sf):
    """Identity calibration with an explicit crop."""
    out = registration.register(*_recordings(spark, sf), mode="identity", val_frac=0.2, chunk=9, crop=[1, 2, 5, 4]).aligned
    return out.select("rec_id", "name", "idx", "chunk_id", "split", _weighted("rgb_px", 3).alias("rgb"), _weighted("ir_px", 3).alias("ir"), F.col("height").cast("bigint").alias("height"), F.col("width").cast("bigint").alias("width"))


@query("registered_by_points", f"""WITH {BGR},
w AS (SELECT vec_id, label, ch, r, c + label % 3 AS c, v FROM bgr WHERE c + label % 3 < 8)
SELECT label AS rec_id, printf('%06d.png', vec_id) AS name, round(sum(v * ((r * 8 + c) * 3 + ch + 1))::DOUBLE, 2) AS rgb, true AS whole FROM w GROUP BY ALL""")
def registered_by_points(spark, sf):
    """Point calibration: each recording's shift is fitted from its own correspondences."""
    rgb, ir = _recordings(spark, sf)
    x, y = (F.col("idx") * 37 % 101).cast("double"), (F.col("idx") * 53 % 97).cast("double")
    points = ir.select("rec_id", F.col("idx").alias("i"), x.alias("x"), y.alias("y"), (x + F.col("rec_id") % 3).alias("u"), y.alias("v"))
    done = registration.register(rgb, ir, mode="manual", val_frac=0.2, chunk=9, points=points, crop_auto=True)
    whole = done.records.select("rec_id", F.col("crop").isNull().alias("whole"))
    px = F.transform("rgb_px", lambda v: F.round(v, 3))
    return done.aligned.withColumn("p", px).join(whole, "rec_id").select("rec_id", "name", F.round(_weighted("p", 2), 2).alias("rgb"), "whole")


@query("registration_rejects", """
SELECT label::BIGINT AS rec_id, CASE label % 3 WHEN 0 THEN 'aligned' WHEN 1 THEN 'fewer than 4 points' ELSE 'no points' END AS outcome, count(*) AS frames
FROM embeddings GROUP BY 1, 2""")
def registration_rejects(spark, sf):
    """Every frame is aligned or rejected with its recording's reason."""
    rgb, ir = _recordings(spark, sf)
    x, y = (F.col("idx") * 37 % 101).cast("double"), (F.col("idx") * 53 % 97).cast("double")
    points = ir.select("rec_id", F.col("idx").alias("i"), x.alias("x"), y.alias("y"), x.alias("u"), y.alias("v"))
    few = points.where("rec_id % 3 = 1").join(points.groupBy("rec_id").agg(F.min("i").alias("i")), ["rec_id", "i"], "left_semi")
    done = registration.register(rgb, ir, mode="manual", val_frac=0.2, chunk=9, points=points.where("rec_id % 3 = 0").unionByName(few))
    both = done.aligned.select("rec_id", F.lit("aligned").alias("outcome")).unionByName(done.rejects.select("rec_id", F.col("reason").alias("outcome")))
    return both.groupBy("rec_id", "outcome").agg(F.count(F.lit(1)).alias("frames"))


SCENE, SEEN_H, SEEN_W = 240, 96, 128
_ZOOM = "CASE label % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 1.25e0 ELSE 0.8e0 END"


@query("registration_by_search", f"""WITH {FRAMES}
SELECT label AS rec_id, 'search' AS mode, {_ZOOM} AS scale, 63 + 24 * (label % 3 - 1) AS x, 47 + 16 * (label // 3 % 4) - 24 AS y,
  true AS square, NULL::VARCHAR AS reason, count(*) AS frames, {SEEN_W} AS width FROM frames GROUP BY ALL""")
def registration_by_search(spark, sf):
    """Frames of two cameras on one scene, which session by session differ in zoom and by up to a quarter frame in place.

    ``scale`` and where the colour frame's centre lands, in whole pixels, are read off the ``H`` that is found.
    """
    f = frames(spark, sf).withColumn("name", name_of())
    zoom = F.element_at(F.array(F.lit(1.0), F.lit(1.25), F.lit(0.8)), (F.col("label") % 3 + 1).cast("int"))
    f = f.withColumns({"side": (zoom * SCENE).cast("int"), "dx": 24 * (F.col("label") % 3 - 1), "dy": 16 * (F.floor(F.col("label") / 3) % 4) - 24})
    middle = F.col("side") / 2
    view = lambda size, at: px_ops.crop(kernels.resize("px", 8, 8, size, size, precision="double"), size, size, *at, SEEN_W, SEEN_H)
    rows = lambda f, px: f.select("label", "name", F.col("vec_id").alias("idx"), F.lit(SEEN_H).alias("height"), F.lit(SEEN_W).alias("width"), F.lit(1).alias("channels"), px.alias("px")).withColumnRenamed("label", "rec_id")
    scene = view(F.lit(SCENE), (F.lit((SCENE - SEEN_W) // 2), F.lit((SCENE - SEEN_H) // 2)))
    seen = view(F.col("side"), ((middle - SEEN_W // 2 - F.col("dx")).cast("int"), (middle - SEEN_H // 2 - F.col("dy")).cast("int")))
    sides = lambda f: (rows(f, scene), rows(f, seen))
    rgb, ir = sides(f)
    # Views are 900 times as large as what they are made from: only those of calibration frames are made.
    wanted = registration.wanted_frames(dense_index(f.select(F.col("label").alias("rec_id"), "name"), ["rec_id"], ["name"]), (0, 3, 10_000))
    chosen = f.join(wanted, (F.col("label") == wanted.rec_id) & (f["name"] == wanted["name"]), "left_semi")
    placed = align.align_recordings(registration.calibration_pairs(*sides(chosen), (0, 3, 10_000), wanted), ["rec_id"])
    rec = registration.calibration_records(rgb, ir, "search", placements=materialise(placed, "placements"))
    n = f.groupBy("label").agg(F.count(F.lit(1)).alias("frames")).withColumnRenamed("label", "rec_id")
    h = F.col("H")
    centre = lambda i: F.floor(h[i][0] * ((SEEN_W - 1) / 2) + h[i][1] * ((SEEN_H - 1) / 2) + h[i][2])
    square = (F.abs(h[0][0] - h[1][1]) < 0.02) & (F.abs(h[0][1]) < 0.02) & (F.abs(h[1][0]) < 0.02)
    out = rec.join(placed.select("rec_id", "reason"), "rec_id").join(n, "rec_id")
    return out.select(
        "rec_id", "mode", (F.round(h[0][0] * 20) / 20).alias("scale"), centre(0).alias("x"), centre(1).alias("y"), square.alias("square"), "reason", "frames",
        F.col("thermal_size")[0].cast("bigint").alias("width"),
    )


# -- session preparation --------------------------------------------------
_PLAN = f"""{TREE.format(top=_NORTH)}, {FOLDERS},
img AS (SELECT f.*, s.session, regexp_extract(path, '([^/]*)$', 1) AS file FROM fold f JOIN sess s USING (parent, suffix) WHERE path LIKE '%.png'),
ri AS (SELECT *, row_number() OVER (PARTITION BY parent, suffix ORDER BY CASE WHEN file LIKE 'x%' THEN 1 ELSE 0 END,
  CASE WHEN file LIKE 'x%' THEN 0 ELSE regexp_extract(file, '^(\\d+)', 1)::BIGINT END, file) - 1 AS idx FROM img WHERE rgb),
nm AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT session FROM sess)),
sv AS (SELECT session, CASE WHEN {pick_sql("r", "n", "greatest(1, round_even(0.15e0 * n, 0)::BIGINT)")} THEN 'val' ELSE 'train' END AS split FROM nm),
pl AS (SELECT a.session, regexp_replace(a.suffix, '^[-_]+', '') AS suffix, a.file, a.idx, sv.split, a.height AS rh, a.width AS rw, b.height AS ih, b.width AS iw,
  CASE WHEN b.path IS NULL THEN 'no IR twin' WHEN a.height IS NULL OR b.height IS NULL THEN 'unreadable'
  WHEN abs(b.height - a.height) > 4 OR abs(b.width - a.width) > 4 THEN printf('size mismatch rgb(%d, %d) ir(%d, %d)', a.height::INT, a.width::INT, b.height::INT, b.width::INT) END AS reason
  FROM ri a LEFT JOIN img b ON NOT b.rgb AND a.parent = b.parent AND a.suffix = b.suffix AND a.file = b.file JOIN sv ON sv.session = a.session)"""


def _plan(spark, sf, **kw):
    return sessions.plan_sessions(tree(spark, sf).drop("doc_id"), **kw)


@query("session_pairs", f"""WITH {_PLAN}
SELECT session, suffix, file, idx, split, session || CASE WHEN suffix <> '' THEN '_' || suffix ELSE '' END || '_' || lpad(idx::VARCHAR, 6, '0') || '.png' AS out_name FROM pl WHERE reason IS NULL""")
def session_pairs(spark, sf):
    return _plan(spark, sf).pairs.select("session", "suffix", "file", "idx", "split", "out_name")


@query("session_rejects", f"WITH {_PLAN} SELECT session, reason, session || '/' || suffix || '/' || file || ': ' || reason AS text FROM pl WHERE reason IS NOT NULL")
def session_rejects(spark, sf):
    return _plan(spark, sf).rejects.select("session", "reason", "text")


@query("session_counts", f"WITH {_PLAN} SELECT session, split, count(*) FILTER (reason IS NULL) AS pairs, count(*) FILTER (reason IS NOT NULL) AS skipped FROM pl GROUP BY 1, 2")
def session_counts(spark, sf):
    return _plan(spark, sf).counts.select("session", "split", "pairs", "skipped")


@query("session_report_texts", f"WITH {_PLAN} SELECT session || '/' || suffix || '/' || file || ': ' || reason AS text, (SELECT count(*) FROM pl WHERE reason IS NULL AND split = 'val') AS val_pairs FROM pl WHERE reason IS NOT NULL")
def session_report_texts(spark, sf):
    """The nested report and the text of every reject beside it, written and read back."""
    plan = _plan(spark, sf)
    path = staging_path(spark, "report")
    sinks.write_split_report(plan.counts, "/data", plan.rejects, path)
    report = tables.read_split_report(spark, f"{path}/report")
    return tables.read_skipped(spark, report).withColumn("val_pairs", F.lit(report.first()["counts"]["val"]))


@query("session_dry_run", f"WITH {_PLAN} SELECT split, count(DISTINCT session) AS sessions, count(*) FILTER (reason IS NULL OR reason <> 'no IR twin') AS pairs, count(*) FILTER (reason = 'no IR twin') AS skipped FROM pl GROUP BY 1")
def session_dry_run(spark, sf):
    """Counts from names alone: size and readability are not looked at."""
    return sessions.report(_plan(spark, sf, dry_run=True))


@query("converted_pairs", f"""WITH {BGR}, s AS (SELECT vec_id, least(8, 6 + vec_id % 3) AS h, least(8, 7 + vec_id % 2) AS w FROM frames),
g AS (SELECT vec_id, r, c, round_even(sum(v) / 3e0, 0)::BIGINT AS v FROM bgr GROUP BY 1, 2, 3)
SELECT g.vec_id, h AS height, w AS width, round(sum(v * (r * w + c + 1))::DOUBLE, 2) AS ir FROM g JOIN s USING (vec_id) WHERE r < h AND c < w GROUP BY ALL""")
def converted_pairs(spark, sf):
    f = frames(spark, sf).withColumn("ir_px", colour())
    f = f.withColumn("rgb_h", (6 + F.col("vec_id") % 3).cast("int")).withColumn("rgb_w", (7 + F.col("vec_id") % 2).cast("int"))
    area = F.col("rgb_h") * F.col("rgb_w") * 3
    f = f.withColumn("rgb_px", F.slice("ir_px", F.lit(1), area)).withColumn("ir_h", F.lit(8)).withColumn("ir_w", F.lit(8))
    f = f.withColumn("ir_channels", F.lit(3)).withColumn("ir_depth", F.lit(8))
    out = sessions.convert_pairs(f)
    return out.select("vec_id", F.col("height").cast("bigint").alias("height"), F.col("width").cast("bigint").alias("width"), _weighted("ir_px", 2).alias("ir"))


@query("unpaired_prepared", f"""WITH {BGR},
i AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx FROM frames),
s AS (SELECT vec_id, r // 2 AS r, c // 2 AS c, ch, round_even(avg(v), 0) AS v FROM bgr GROUP BY ALL)
SELECT label AS rec_id, printf('%06d.png', vec_id) AS name, idx, 4 AS height, 4 AS width, round(sum(v * ((r * 4 + c) * 3 + ch + 1))::DOUBLE, 2) AS px
FROM s JOIN i USING (vec_id) WHERE idx >= 3 GROUP BY ALL""")
def unpaired_prepared(spark, sf):
    rgb, ir = _recordings(spark, sf)
    small, _ = unpaired.prepare(rgb, ir, width=4, skip=3)
    size = lambda c: F.col(c).cast("bigint").alias(c)
    return small.select("rec_id", "name", "idx", size("height"), size("width"), _weighted("px", 2).alias("px"))


# -- samples --------------------------------------------------------------
def _window_sql(tag: str, *ids: str) -> str:
    u = lambda t: uniform_sql(*ids, f"'{t}'")
    return (
        f"floor({u('x')} * 4)::BIGINT AS {tag}x, floor({u('y')} * 4)::BIGINT AS {tag}y, {u('flip')} < 0.5e0 AS {tag}f, {u('jitter')} < 0.8e0 AS {tag}j, "
        f"1e0 + ({u('gain')} * 2e0 - 1e0) * 0.15e0 AS {tag}g, ({u('bias')} * 2e0 - 1e0) * 15e0 AS {tag}b"
    )


@query("paired_samples", f"""WITH {BGR}, nm AS (SELECT vec_id, printf('%06d.png', vec_id) AS name FROM frames),
w AS (SELECT vec_id, {_window_sql("w", "name", "2", "11")} FROM nm),
a AS (SELECT vec_id, sum(((CASE WHEN wj THEN floor(greatest(0e0, least(255e0, v * wg + wb))) ELSE v END) / 127.5e0 - 1e0)
  * ((2 - ch) * 25 + (r - wy) * 5 + CASE WHEN wf THEN 4 - (c - wx) ELSE c - wx END + 1)) AS a FROM bgr JOIN w USING (vec_id)
  WHERE r >= wy AND r < wy + 5 AND c >= wx AND c < wx + 5 GROUP BY 1),
b AS (SELECT vec_id, avg(v / 127.5e0 - 1e0) AS t, sum((v / 127.5e0 - 1e0) * ((r - wy) * 5 + CASE WHEN wf THEN 4 - (c - wx) ELSE c - wx END + 1)) AS b
  FROM pix JOIN w USING (vec_id) WHERE r >= wy AND r < wy + 5 AND c >= wx AND c < wx + 5 GROUP BY 1)
SELECT printf('%06d', vec_id) AS name, round(a, 5) + 0e0 AS a, round(b, 5) + 0e0 AS b, round(t, 6) + 0e0 AS t, wx AS x, wy AS y, wf AS flip FROM w JOIN a USING (vec_id) JOIN b USING (vec_id)""")
def paired_samples(spark, sf):
    f = with_size(frames(spark, sf)).select(name_of().alias("name"), "height", "width", colour().alias("rgb_px"), F.col("px").alias("ir_px"))
    s = samples.paired_samples(f, REL8, load_size=0, crop_size=5, epoch=2, seed=11)
    corner = lambda c: F.col(f"crop.{c}").cast("bigint").alias(c)
    return s.select("name", _weighted("a").alias("a"), _weighted("b").alias("b"), r6("t").alias("t"), corner("x"), corner("y"), "crop.flip")


@query("resized_samples", f"""WITH {PIX},
lw AS (SELECT d, s, sum(w) AS w FROM (
  SELECT d, floor(d * 0.8e0)::BIGINT AS s, 1e0 - p AS w FROM (SELECT d, greatest(0e0, d + 1 - (floor(d * 0.8e0) + 1) / 0.8e0) - floor(greatest(0e0, d + 1 - (floor(d * 0.8e0) + 1) / 0.8e0)) AS p FROM range(10) t(d))
  UNION ALL SELECT d, least(7, floor(d * 0.8e0)::BIGINT + 1), p FROM (SELECT d, greatest(0e0, d + 1 - (floor(d * 0.8e0) + 1) / 0.8e0) - floor(greatest(0e0, d + 1 - (floor(d * 0.8e0) + 1) / 0.8e0)) AS p FROM range(10) t(d))) GROUP BY 1, 2),
big AS (SELECT vec_id, y.d AS r, x.d AS c, sum(y.w * x.w * (p.v / 127.5e0 - 1e0)) AS v FROM pix p JOIN lw y ON y.s = p.r JOIN lw x ON x.s = p.c GROUP BY 1, 2, 3)
SELECT printf('%06d', vec_id) AS name, round(sum(v * ((r - 1) * 8 + c - 1 + 1)), 5) AS b, round(avg(v), 6) + 0e0 AS t FROM big WHERE r BETWEEN 1 AND 8 AND c BETWEEN 1 AND 8 GROUP BY 1""")
def resized_samples(spark, sf):
    """Validation samples: squash-resize to 10 x 10, then the centre 8 x 8."""
    f = with_size(frames(spark, sf)).select(name_of().alias("name"), "height", "width", colour().alias("rgb_px"), F.col("px").alias("ir_px"))
    s = samples.paired_samples(f, REL8, load_size=10, crop_size=8, train=False)
    return s.select("name", _weighted("b").alias("b"), r6("t").alias("t"))


@query("unpaired_samples", f"""WITH {BGR}, nm AS (SELECT vec_id, printf('%06d.png', vec_id) AS name, row_number() OVER (ORDER BY vec_id) - 1 AS idx, count(*) OVER () AS n FROM frames),
p AS (SELECT a.vec_id, a.name, b.vec_id AS ir_id FROM nm a JOIN nm b ON b.idx = floor({uniform_sql("a.name", "1", "3")} * a.n)::BIGINT),
w AS (SELECT vec_id, ir_id, {_window_sql("a", "name", "1", "3", "'a'")}, {_window_sql("q", "name", "1", "3", "'b'")} FROM p),
a AS (SELECT vec_id, sum(((CASE WHEN aj THEN floor(greatest(0e0, least(255e0, v * ag + ab))) ELSE v END) / 127.5e0 - 1e0)
  * ((2 - ch) * 25 + (r - ay) * 5 + CASE WHEN af THEN 4 - (c - ax) ELSE c - ax END + 1)) AS a FROM bgr JOIN w USING (vec_id)
  WHERE r >= ay AND r < ay + 5 AND c >= ax AND c < ax + 5 GROUP BY 1),
b AS (SELECT w.vec_id, sum((v / 127.5e0 - 1e0) * ((r - qy) * 5 + CASE WHEN qf THEN 4 - (c - qx) ELSE c - qx END + 1)) AS b
  FROM pix JOIN w ON pix.vec_id = w.ir_id WHERE r >= qy AND r < qy + 5 AND c >= qx AND c < qx + 5 GROUP BY 1)
SELECT printf('%06d', vec_id) AS name, printf('T%06d', ir_id) AS ir_name, round(a, 5) + 0e0 AS a, round(b, 5) + 0e0 AS b, 0e0 AS t FROM w JOIN a USING (vec_id) JOIN b USING (vec_id)""")
def unpaired_samples(spark, sf):
    f = with_size(frames(spark, sf))
    rgb = f.select(name_of().alias("name"), "height", "width", colour().alias("px"))
    ir = f.select(F.format_string("T%06d.png", "vec_id").alias("name"), "height", "width", "px")
    s = samples.unpaired_samples(rgb, ir, REL8, crop_size=5, rgb_width=8, epoch=1, seed=3)
    return s.select("name", "ir_name", _weighted("a").alias("a"), _weighted("b").alias("b"), "t")


# -- translation ----------------------------------------------------------
SINGLE = LinearModel([0.4, 0.3, 0.2], -0.1)
BASE, DETAIL = LinearModel([0.3, 0.2, 0.1, 0.5], 0.05), LinearModel([0.1, -0.2, 0.1, 0.6], 0.0)

_RGB = f"""{BGR},
rgbn AS (SELECT vec_id, label, i, max(v / 127.5e0 - 1e0) FILTER (ch = 2) AS r, max(v / 127.5e0 - 1e0) FILTER (ch = 1) AS g, max(v / 127.5e0 - 1e0) FILTER (ch = 0) AS b, max(level) AS level FROM bgr GROUP BY 1, 2, 3)"""


@query("translated_frames", f"WITH {_RGB} SELECT vec_id, i, round(0.4e0 * r + 0.3e0 * g + 0.2e0 * b - 0.1e0, 6) + 0e0 AS v FROM rgbn")
def translated_frames(spark, sf):
    f = with_size(frames(spark, sf)).select("vec_id", "height", "width", colour().alias("px"))
    made = translate.translate(f, lambda: SINGLE, REL8, multiple=16, precision="double")
    return pixels(made, "px", "vec_id").select("vec_id", "i", r6("v").alias("v"))


@query("translated_conditions", f"""WITH {_RGB}, s AS (SELECT vec_id, i, r, g, b, cond, 0.3e0 * r + 0.2e0 * g + 0.1e0 * b + 0.5e0 * ((cond - -20e0) / 100e0 * 2e0 - 1e0) + 0.05e0 AS s FROM rgbn, (VALUES (0e0), (15e0), (37.5e0)) t(cond))
SELECT vec_id, 'T' || CASE cond WHEN 0 THEN '0' WHEN 15 THEN '15' ELSE '37.5' END || 'C' AS cond_label,
  round(sum(greatest(-1e0, least(1e0, s + 0.1e0 * r - 0.2e0 * g + 0.1e0 * b + 0.6e0 * s)) * (i + 1)), 5) AS px FROM s GROUP BY 1, 2""")
def translated_conditions(spark, sf):
    """A two-stage model under a condition sweep: pixels cross to Python once per frame."""
    f = with_size(frames(spark, sf)).select("vec_id", "height", "width", colour().alias("px"))
    made = translate.translate(f, lambda: (BASE, DETAIL), ABS16, [0.0, 15.0, 37.5], precision="double")
    return made.select("vec_id", "cond_label", _weighted("px").alias("px"))


def _training(spark, sf):
    f = frames(spark, sf)
    f = f.select("vec_id", F.concat("b", F.reverse("b"), F.transform("b", lambda x: x * x)).alias("a"), (F.col("label") / 10.0).alias("t"))
    mix = F.zip_with(F.slice("a", 1, 64), F.slice("a", 65, 64), lambda x, y: x * 0.3 + y * 0.2)
    return f.withColumn("b", F.zip_with(mix, F.slice("a", 129, 64), lambda m, z: m - z * 0.25 + 0.05))


@query("fitted_translator", "SELECT count(*) * 64 AS pixels, 0.3e0 AS r, 0.2e0 AS g, -0.25e0 AS b, 0.05e0 AS bias FROM embeddings")
def fitted_translator(spark, sf):
    """The target is a known linear mix of the planes, so its weights must come back."""
    s = _training(spark, sf)
    model = translate.fit_single(s)()
    w = [round(float(x), 3) for x in (*model.weights, model.bias)]
    return translate.pixel_rows(s, "b").agg(F.count(F.lit(1)).alias("pixels")).select("pixels", *[F.lit(v).alias(n) for n, v in zip(("r", "g", "b", "bias"), w)])


@query("fitted_two_stage", "SELECT round(label / 10e0, 6) AS t, count(*) * 64 AS pixels, 0e0 AS l1 FROM embeddings GROUP BY 1")
def fitted_two_stage(spark, sf):
    """Both fits are least squares on the same planes, so together they restore the
    linear target: no error is left in any session."""
    s = _training(spark, sf)
    factory = translate.fit_two_stage(s, 1.0, 8)
    base, detail = factory()
    rows = translate.pixel_rows(s, "b")
    dot = lambda m, last: sum((F.col(c) * float(w) for c, w in zip(("r", "g", "b", last), m.weights)), F.lit(m.bias))
    rows = rows.withColumn("s", dot(base, "t")).withColumn("e", F.abs(F.col("s") + dot(detail, "s") - F.col("y")))
    return rows.groupBy(r6("t").alias("t")).agg(F.count(F.lit(1)).alias("pixels"), F.round(F.avg("e"), 3).alias("l1"))


@query("validated_translator", f"""WITH {_RGB}, e AS (SELECT vec_id, avg(abs(0.4e0 * r + 0.3e0 * g + 0.2e0 * b - 0.1e0 - (level / 127.5e0 - 1e0))) AS l1 FROM rgbn GROUP BY 1),
k AS (SELECT *, (row_number() OVER (ORDER BY vec_id) - 1) // 16 AS batch FROM e)
SELECT count(*) AS n, round(avg(l1), 5) AS l1_norm FROM k WHERE batch < 5""")
def validated_translator(spark, sf):
    """The cap on batches is the operator: a quick mid-training check."""
    f = with_size(frames(spark, sf))
    truth = f.select(name_of().alias("name"), REL8.normalise("px").alias("b"))
    rgb = f.select(name_of().alias("name"), "height", "width", colour().alias("px"))
    out = translate.validate(rgb, truth, lambda: SINGLE, REL8, batch_size=16, max_batches=5)
    return out.select("n", F.round("l1_norm", 5).alias("l1_norm"))


@query("shortcut_check", f"""WITH {_RGB}, c AS (SELECT vec_id FROM frames ORDER BY {uniform_sql("printf('%06d.png', vec_id)", "4")}, vec_id LIMIT 40),
l AS (SELECT vec_id, label, i, round_even(0.114e0 * level + 0.587e0 * (255 - level) + 0.299e0 * (level * 3 % 256), 0) AS lum, 0.4e0 * r + 0.3e0 * g + 0.2e0 * b - 0.1e0 AS gen, level FROM rgbn JOIN c USING (vec_id)),
k AS (SELECT vec_id, covar_pop(lum, gen) / nullif(stddev_pop(lum) * stddev_pop(gen), 0) AS rg,
  CASE WHEN label % 2 = 0 THEN covar_pop(lum, level) / nullif(stddev_pop(lum) * stddev_pop(level), 0) END AS rr FROM l GROUP BY vec_id, label)
SELECT count(*) AS frames, round(avg(rg), 4) AS r_gen, round(avg(rr), 4) AS r_real,
  CASE WHEN avg(rg) > 0.75 THEN 'shortcut' WHEN avg(rg) > 0.5 THEN 'partial' ELSE 'decoupled' END AS verdict FROM k""")
def shortcut_check(spark, sf):
    """The sample size is the operator's own setting; real twins exist for half of the sessions."""
    f = with_size(frames(spark, sf))
    rgb = f.select(name_of().alias("name"), "height", "width", colour().alias("px"))
    twin = F.when(F.col("label") % 2 == 0, name_of()).otherwise(F.concat(F.lit("z"), name_of()))
    real = f.select(twin.alias("name"), "height", "width", "px")
    out = translate.shortcut_check(rgb, real, lambda: SINGLE, REL8, n=40, seed=4)
    return out.select("frames", F.round("r_gen", 4).alias("r_gen"), F.round("r_real", 4).alias("r_real"), "verdict")
