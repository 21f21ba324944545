"""Queries over single values and pixels: normalisation, colour, names, geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from framepair.catalog.base import (
    ABS16, BGR, EIGHT, PIX, REL8, SIDE, colour, frames, pixels, query, r6, table, uniform_sql,
)
from framepair.functions import color, geometry, names, sql
from framepair.functions.norm import interleaved_to_planes, planes_to_interleaved, to_unit
from framepair.functions.sql import lr_at


@query("normalise_rel8", f"""
WITH {PIX}
SELECT vec_id, i, v AS level, round(greatest(-1e0, least(1e0, v / 127.5e0 - 1)), 6) + 0e0 AS norm,
  floor((greatest(-1e0, least(1e0, v / 127.5e0 - 1)) + 1) * 127.5e0)::BIGINT AS back,
  round((greatest(-1e0, least(1e0, v / 127.5e0 - 1)) + 1) / 2, 6) AS unit
FROM pix""")
def normalise_rel8(spark, sf):
    f = frames(spark, sf).withColumn("n", REL8.normalise("px"))
    z = F.arrays_zip("px", "n", REL8.to_uint8("n").alias("k"), to_unit("n").alias("u"))
    rows = pixels(f, z, "vec_id", value="z")
    return rows.select(
        "vec_id", "i", F.col("z.px").cast("bigint").alias("level"), r6("z.n").alias("norm"),
        F.col("z.k").cast("bigint").alias("back"), r6("z.u").alias("unit"),
    )


_COUNTS = "counts AS (SELECT event_id, floor(value * 40e0 + 6000e0)::BIGINT AS raw FROM events)"


def _counts(spark, sf):
    return table(spark, sf, "events").select("event_id", F.floor(F.col("value") * 40.0 + 6000.0).alias("raw"))


@query("normalise_abs16", f"""
WITH {_COUNTS},
c AS (SELECT event_id, raw, raw * 0.04e0 + -273.15e0 AS celsius FROM counts),
n AS (SELECT *, (celsius - -20e0) / 100e0 * 2e0 - 1e0 AS free,
  greatest(-1e0, least(1e0, (celsius - -20e0) / 100e0 * 2e0 - 1e0)) AS norm FROM c)
SELECT event_id, raw, round(celsius, 6) AS celsius, round(free, 6) + 0e0 AS unclipped, round(norm, 6) + 0e0 AS norm,
  round((norm + 1e0) / 2e0 * 100e0 + -20e0, 6) AS celsius_back,
  floor(greatest(0e0, least(65535e0, ((norm + 1e0) / 2e0 * 100e0 + -20e0 - -273.15e0) / 0.04e0)) + 0.1e0)::BIGINT AS counts_back
FROM n""")
def normalise_abs16(spark, sf):
    c = _counts(spark, sf).withColumn("celsius", F.col("raw") * ABS16.raw_scale + ABS16.raw_offset)
    c = c.withColumn("norm", ABS16.norm_value(F.col("raw")))
    back = ABS16.norm_to_celsius(F.col("norm"))
    # A tenth of a count keeps the comparison clear of whole-number boundaries.
    shifted = ABS16.celsius_to_norm(back + 0.1 * ABS16.raw_scale)
    return c.select(
        "event_id", "raw", r6("celsius").alias("celsius"), r6(ABS16.celsius_to_norm(F.col("celsius"))).alias("unclipped"),
        r6("norm").alias("norm"), r6(back).alias("celsius_back"), ABS16.uint16_value(shifted).cast("bigint").alias("counts_back"),
    )


@query("normalise_16_to_8", f"""
WITH {_COUNTS},
w AS (SELECT event_id, least(65535, raw * 4) AS raw FROM counts),
n AS (SELECT event_id, raw, greatest(-1e0, least(1e0, floor(raw / 257e0) / 127.5e0 - 1e0)) AS norm FROM w)
SELECT event_id, raw, round(norm, 6) + 0e0 AS norm, floor((norm + 1e0) * 32767.5e0)::BIGINT AS stretched FROM n""")
def normalise_16_to_8(spark, sf):
    c = _counts(spark, sf).select("event_id", F.least(F.lit(65535), F.col("raw") * 4).cast("bigint").alias("raw"))
    c = c.withColumn("n", REL8.norm_value(F.col("raw"), depth=16))
    return c.select("event_id", "raw", r6("n").alias("norm"), REL8.uint16_value(F.col("n")).cast("bigint").alias("stretched"))


def _pinned(value, at):
    """A value weighted by its place from 1: sums of these pin every value of a plane."""
    return F.col(value).cast("double") * (at + 1)


@query("channel_planes", f"""
WITH {BGR}
SELECT vec_id, (2 - ch)::BIGINT AS plane, round(sum((v / 127.5e0 - 1e0) * (i + 1)), 5) + 0e0 AS planes,
  round(sum(floor((greatest(-1e0, least(1e0, v / 127.5e0 - 1e0)) + 1e0) * 127.5e0) * (i + 1)), 5) + 0e0 AS rgb FROM bgr GROUP BY 1, 2""")
def channel_planes(spark, sf):
    """One row per plane of a frame, from the planes and from the pixels made of them again."""
    f = frames(spark, sf).withColumn("bgr", colour("px"))
    f = f.withColumn("chw", interleaved_to_planes("bgr", *EIGHT)).withColumn("rgb", planes_to_interleaved("chw", *EIGHT))
    rows = pixels(f, F.arrays_zip("chw", "rgb"), "vec_id", value="z").select("vec_id", "i", "z.*")
    area, none = SIDE * SIDE, F.lit(0.0)
    by_plane = rows.select("vec_id", F.floor(F.col("i") / area).alias("plane"), _pinned("chw", F.col("i") % area).alias("a"), none.alias("b"))
    by_pixel = rows.select("vec_id", (F.col("i") % 3).alias("plane"), none.alias("a"), _pinned("rgb", F.floor(F.col("i") / 3)).alias("b"))
    sums = by_plane.unionByName(by_pixel).groupBy("vec_id", "plane").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return sums.select("vec_id", "plane", (F.round("a", 5) + 0.0).alias("planes"), (F.round("b", 5) + 0.0).alias("rgb"))


@query("grey_conversions", f"""
WITH {BGR},
g AS (SELECT vec_id, i, 0.114e0 * max(v) FILTER (ch = 0) + 0.587e0 * max(v) FILTER (ch = 1) + 0.299e0 * max(v) FILTER (ch = 2) AS luma,
  sum(v)::DOUBLE / 3e0 AS m, max(level) AS level FROM bgr GROUP BY ALL),
s AS (SELECT *, min(level) OVER (PARTITION BY vec_id) AS lo, max(level) OVER (PARTITION BY vec_id) AS hi FROM g)
SELECT vec_id, i, round(luma, 4) AS luma, round_even(m, 0)::BIGINT AS mean, round(m, 6) AS channel_mean,
  coalesce(floor((level - lo) * 255e0 / nullif(hi - lo, 0)), 0)::BIGINT AS stretched FROM s""")
def grey_conversions(spark, sf):
    f = frames(spark, sf).withColumn("bgr", colour("px"))
    z = F.arrays_zip(
        color.luma("bgr").alias("l"), color.gray_mean("bgr").alias("m"),
        color.channel_mean("bgr").alias("c"), color.minmax_stretch("px", *EIGHT).alias("s"),
    )
    return pixels(f, z, "vec_id", value="z").select(
        "vec_id", "i", F.round("z.l", 4).alias("luma"), F.col("z.m").cast("bigint").alias("mean"),
        r6("z.c").alias("channel_mean"), F.col("z.s").cast("bigint").alias("stretched"),
    )


@query("condition_plane", f"""
WITH {BGR},
c AS (SELECT vec_id, (2 - ch)::BIGINT AS plane, i, v / 127.5e0 - 1e0 AS x FROM bgr),
m AS (SELECT vec_id, sum(x) / 3e0 * (i + 1) AS m FROM c GROUP BY vec_id, i),
s AS (SELECT vec_id, sum(m) AS m FROM m GROUP BY 1)
SELECT vec_id, plane, round(sum(x * (i + 1)), 5) + 0e0 AS x, round(any_value(s.m), 5) + 0e0 AS mean3 FROM c JOIN s USING (vec_id) GROUP BY 1, 2
UNION ALL SELECT vec_id, 3, round((label / 10e0 - 0.5e0) * 2080, 5) + 0e0, 0e0 FROM frames""")
def condition_plane(spark, sf):
    """One row per plane: three colour planes and the condition, beside the replicated mean."""
    f = frames(spark, sf).withColumn("chw", interleaved_to_planes(colour("px"), *EIGHT))
    f = f.withColumn("x", color.with_plane("chw", F.col("label") / 10.0 - 0.5, F.lit(SIDE * SIDE)))
    f = f.withColumn("m", color.replicate(color.plane_mean("chw", *EIGHT), 3))
    rows = pixels(f, F.arrays_zip("x", "m"), "vec_id", value="z").select("vec_id", "i", "z.*")
    area = SIDE * SIDE
    sums = rows.groupBy("vec_id", F.floor(F.col("i") / area).alias("plane")).agg(
        F.sum(_pinned("x", F.col("i") % area)).alias("x"), F.coalesce(F.sum(_pinned("m", F.col("i") % area)), F.lit(0.0)).alias("m")
    )
    return sums.select("vec_id", "plane", (F.round("x", 5) + 0.0).alias("x"), (F.round("m", 5) + 0.0).alias("mean3"))


# -- names ----------------------------------------------------------------
_EXT = [".png", ".JPG", ".txt", ".tiff", "", ".tar.bmp", "_16bit.png", ".gz"]
_FILES = (
    "files AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source || '.' END || doc_id || "
    "(['.png', '.JPG', '.txt', '.tiff', '', '.tar.bmp', '_16bit.png', '.gz'])[doc_id % 8 + 1] AS name FROM documents)"
)


def _files(spark, sf):
    ext = F.array(*[F.lit(e) for e in _EXT])
    prefix = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.concat("source", F.lit(".")))
    d = table(spark, sf, "documents")
    return d.select("doc_id", "source", F.concat(prefix, F.col("doc_id").cast("string"), ext[(F.col("doc_id") % 8).cast("int")]).alias("name"))


@query("image_listing", f"""
WITH {_FILES}
SELECT doc_id, name, CASE WHEN name LIKE '%.%' THEN regexp_replace(name, '\\.[^.]*$', '') ELSE name END AS stem,
  replace(CASE WHEN name LIKE '%.%' THEN regexp_replace(name, '\\.[^.]*$', '') ELSE name END, '_16bit', '') AS score_stem
FROM files WHERE lower(regexp_extract(name, '\\.([^.]*)$', 1)) IN ('png', 'jpg', 'jpeg', 'tif', 'tiff', 'bmp')""")
def image_listing(spark, sf):
    listed = _files(spark, sf).where(names.is_image("name"))
    return listed.select("doc_id", "name", names.stem("name").alias("stem"), names.score_stem("name").alias("score_stem"))


@query("session_names", """
WITH s AS (SELECT doc_id, source, regexp_replace(
  CASE lang WHEN 'en' THEN '' WHEN 'fr' THEN '-1' WHEN 'de' THEN '_2' ELSE '--_3' END, '^[-_]+', '') AS suffix FROM documents)
SELECT doc_id, suffix, source || CASE WHEN suffix <> '' THEN '_' || suffix ELSE '' END || '_' || lpad(doc_id::VARCHAR, 6, '0') || '.png' AS name,
  source || CASE WHEN suffix <> '' THEN '_' || suffix ELSE '' END AS session FROM s""")
def session_names(spark, sf):
    raw = F.when(F.col("lang") == "en", "").when(F.col("lang") == "fr", "-1").when(F.col("lang") == "de", "_2").otherwise("--_3")
    d = table(spark, sf, "documents").withColumn("suffix", names.clean_suffix(raw))
    d = d.withColumn("name", names.session_frame_name("source", "suffix", F.col("doc_id")))
    return d.select("doc_id", "suffix", "name", names.session_of("name").alias("session"))


@query("condition_labels", """
WITH p AS (SELECT p_partkey, p_size, p_size * 3 AS c, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size / 50e0 END AS t FROM part)
SELECT p_partkey, round(coalesce((c - -20e0) / 100e0 * 2e0 - 1e0, 0), 6) + 0e0 AS t_abs, 'T' || c || 'C' AS label_abs,
  round(coalesce(t * 2e0 - 1e0, 0), 6) + 0e0 AS t_rel,
  CASE WHEN t IS NULL THEN '' WHEN t = 1 THEN 'T1' ELSE 'T' || rtrim(rtrim(printf('%.2f', t), '0'), '.') END AS label_rel,
  (c // 2 + c)::BIGINT AS parsed_sum
FROM p""")
def condition_labels(spark, sf):
    p = table(spark, sf, "part").withColumn("c", F.col("p_size") * 3)
    p = p.withColumn("t", F.when(F.col("p_partkey") % 5 != 0, F.col("p_size") / 50.0))
    t_abs, label_abs = names.condition(ABS16, "c")
    t_rel, label_rel = names.condition(REL8, "t")
    text = F.concat_ws(",", F.floor(F.col("c") / 2).cast("string"), F.lit(" "), F.col("c").cast("string"), F.lit(""))
    total = F.aggregate(names.parse_list(text, "bigint"), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return p.select(
        "p_partkey", r6(t_abs).alias("t_abs"), label_abs.alias("label_abs"), r6(t_rel).alias("t_rel"),
        label_rel.alias("label_rel"), total.alias("parsed_sum"),
    )


# -- geometry -------------------------------------------------------------
_SIZES = (
    "sizes AS (SELECT p_partkey, (64 + p_size * 5)::DOUBLE AS rw, (48 + p_partkey % 97)::DOUBLE AS rh, "
    "(32 + p_partkey % 53)::DOUBLE AS tw, (32 + p_size)::DOUBLE AS th FROM part)"
)


def _sizes(spark, sf):
    d = lambda c: c.cast("double")
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey", d(64 + s * 5).alias("rw"), d(48 + k % 97).alias("rh"), d(32 + k % 53).alias("tw"), d(32 + s).alias("th")
    )


@query("letterbox_and_crop", f"""
WITH {_SIZES},
m AS (SELECT *, least(tw / rw, th / rh) AS s FROM sizes),
h AS (SELECT *, (tw - s * rw) / 2 AS tx, (th - s * rh) / 2 AS ty FROM m),
q AS (SELECT *, s * 10 + tx AS px, s * 20 + ty AS py,
  greatest(0, ceil(tx)::BIGINT + 2) AS x0, greatest(0, ceil(ty)::BIGINT + 2) AS y0,
  least(tw::BIGINT, floor(s * (rw - 1) + tx)::BIGINT - 2) AS x1, least(th::BIGINT, floor(s * (rh - 1) + ty)::BIGINT - 2) AS y1 FROM h)
SELECT p_partkey, round(s, 6) AS scale, round(tx, 6) + 0e0 AS tx, round(ty, 6) + 0e0 AS ty, round(px, 6) + 0e0 AS px, round(py, 6) + 0e0 AS py,
  CASE WHEN x1 - x0 < 16 OR y1 - y0 < 16 THEN 'none' ELSE x0 || ',' || y0 || ',' || (x1 - x0) || ',' || (y1 - y0) END AS crop,
  ((16 - rw::BIGINT % 16) % 16)::BIGINT AS pad_w, round(1444e0 * 0.1e0 / rw, 6) AS parallax
FROM q""")
def letterbox_and_crop(spark, sf):
    s = _sizes(spark, sf).withColumn("H", geometry.letterbox("rw", "rh", "tw", "th"))
    px, py = geometry.project(F.col("H"), 10.0, 20.0)
    box = geometry.auto_crop(F.col("H"), "rw", "rh", "tw", "th")
    return s.select(
        "p_partkey", r6(F.col("H")[0][0]).alias("scale"), r6(F.col("H")[0][2]).alias("tx"), r6(F.col("H")[1][2]).alias("ty"),
        r6(px).alias("px"), r6(py).alias("py"),
        F.coalesce(F.array_join(F.transform(box, lambda v: v.cast("string")), ","), F.lit("none")).alias("crop"),
        geometry.pad_amount(F.col("rw").cast("bigint"), 16).alias("pad_w"), r6(geometry.parallax(1444.0, 0.1, "rw")).alias("parallax"),
    )


@query("projected_points", """
WITH m AS (SELECT c_custkey, (c_custkey % 640)::DOUBLE AS x, (c_custkey * 7 % 480)::DOUBLE AS y, c_nationkey / 1000e0 AS p FROM customer)
SELECT c_custkey, round((0.5e0 * x + -8) / (p * 0.01e0 * x + 1), 6) + 0e0 AS u, round((0.5e0 * y + -6) / (p * 0.01e0 * x + 1), 6) + 0e0 AS v FROM m""")
def projected_points(spark, sf):
    c = table(spark, sf, "customer")
    lit = F.lit
    h = F.array(
        F.array(lit(0.5), lit(0.0), lit(-8.0)), F.array(lit(0.0), lit(0.5), lit(-6.0)),
        F.array(F.col("c_nationkey") / 1000.0 * 0.01, lit(0.0), lit(1.0)),
    )
    u, v = geometry.project(h, F.col("c_custkey") % 640, F.col("c_custkey") * 7 % 480)
    return c.select("c_custkey", r6(u).alias("u"), r6(v).alias("v"))


@query("learning_rate", """
WITH e AS (SELECT o_orderkey, (o_orderkey % 60)::BIGINT AS epoch FROM orders)
SELECT o_orderkey, epoch, round(greatest(0e0, 1e0 - greatest(0, epoch + 1 - 40) / 20e0) * 2e-4 * 1e6, 6) AS lr_ppm FROM e""")
def learning_rate(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 60).alias("epoch"))
    return o.select("o_orderkey", "epoch", r6(lr_at(F.col("epoch"), 40, 20, 2e-4) * 1e6).alias("lr_ppm"))


# -- the library from SQL ---------------------------------------------------
@query("sql_scalar_functions", f"""SELECT p_partkey, round((p_size - 5e0) / 40e0 * 2e0 - 1e0, 9) + 0e0 AS n, round(p_size::DOUBLE, 6) AS c,
  greatest(-1e0, least(1e0, p_size / 12e0 / 127.5e0 - 1e0)) AS r, floor((greatest(-1e0, least(1e0, p_size / 25e0 - 1e0)) + 1e0) * 127.5e0)::INT AS u,
  {uniform_sql("p_brand")} AS h FROM part""")
def sql_scalar_functions(spark, sf):
    """The registered functions, called from SQL over a table."""
    sql.register(spark)
    return spark.sql(
        """SELECT p_partkey, round(celsius_to_norm(p_size, 5D, 45D), 9) + 0D AS n, round(norm_to_celsius(celsius_to_norm(p_size, 5D, 45D), 5D, 45D), 6) AS c,
        rel8_to_norm(p_size / 12D) AS r, norm_to_uint8(p_size / 25D - 1D) AS u, hash_uniform(p_brand) AS h FROM {parts}""",
        parts=table(spark, sf, "part"),
    )


@query("sql_table_functions", """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
p AS (SELECT source, 'pick' AS kind, i::BIGINT AS i, CASE WHEN n <= 1 THEN 0 WHEN i = 6 THEN n - 1 ELSE floor(i * ((n - 1)::DOUBLE / 6))::DOUBLE END AS v FROM c, range(7) t(i)),
l AS (SELECT source, 'rate' AS kind, e::BIGINT AS i, round(greatest(0e0, 1e0 - greatest(0, e + 1 - 3) / greatest(1, n % 5)::DOUBLE) * 2e-4, 12) AS v FROM c, range(8) t(e) WHERE e < 3 + n % 5)
SELECT * FROM p UNION ALL SELECT * FROM l""")
def sql_table_functions(spark, sf):
    """The table functions beside each row of a table."""
    sql.register(spark)
    counts = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return spark.sql(
        """SELECT source, 'pick' AS kind, i, cast(pos AS DOUBLE) AS v FROM {counts}, LATERAL even_picks(n, 7L)
        UNION ALL SELECT source, 'rate', cast(epoch AS BIGINT), round(lr, 12) FROM {counts}, LATERAL learning_rates(3, cast(n % 5 AS INT), 2e-4D)""",
        counts=counts,
    )
