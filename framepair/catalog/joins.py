"""Queries over pairing joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from framepair.catalog.base import ABS16, PIX, frames, query, r6, table, uniform_sql
from framepair.functions.pixels import array_mean
from framepair.operators import pairing
from framepair.operators.lookup import lookup
from framepair.sources import images, tables


def _docs(spark, sf, *cols):
    return table(spark, sf, "documents").select("doc_id", *cols)


@query("pairs_by_name", """
SELECT d.doc_id, d.source, l.quality::BIGINT AS quality FROM documents d JOIN labels l USING (doc_id)""")
def pairs_by_name(spark, sf):
    l = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("bigint").alias("quality"))
    return pairing.pair_by_name(_docs(spark, sf, "source"), l, ["doc_id"])


@query("missing_twins", """
SELECT doc_id, source, 'no IR twin' AS reason FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def missing_twins(spark, sf):
    return pairing.without_twin(_docs(spark, sf, "source"), table(spark, sf, "labels"), ["doc_id"])


@query("common_names", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def common_names(spark, sf):
    return pairing.common_names(_docs(spark, sf), table(spark, sf, "labels"), ["doc_id"])


_PRED = (
    "pred AS (SELECT 's' || (doc_id // 2) || CASE WHEN doc_id % 2 = 1 THEN '_16bit.png' ELSE '.png' END AS file, n_chars FROM documents),"
    "gt AS (SELECT 's' || (doc_id * 2 // 3) || CASE WHEN doc_id % 3 = 0 THEN '.png' ELSE '.tif' END AS file, quality FROM labels)"
)
_STEM = "replace(regexp_replace(file, '\\.[^.]*$', ''), '_16bit', '')"


@query("matched_by_stem", f"""
WITH {_PRED},
p AS (SELECT {_STEM} AS stem, arg_max(n_chars, file) AS chars, max(file) AS pred_file FROM pred GROUP BY 1),
g AS (SELECT {_STEM} AS stem, arg_max(quality, file) AS quality, max(file) AS gt_file FROM gt GROUP BY 1)
SELECT stem, pred_file, chars AS pred_n_chars, gt_file FROM p JOIN g USING (stem)""")
def matched_by_stem(spark, sf):
    half = F.floor(F.col("doc_id") / 2).cast("string")
    pred = _docs(spark, sf, "n_chars").select(
        F.concat(F.lit("s"), half, F.when(F.col("doc_id") % 2 == 1, "_16bit.png").otherwise(".png")).alias("file"), "n_chars"
    )
    third = F.floor(F.col("doc_id") * 2 / 3).cast("string")
    gt = table(spark, sf, "labels").select(F.concat(F.lit("s"), third, F.when(F.col("doc_id") % 3 == 0, ".png").otherwise(".tif")).alias("file"))
    return pairing.match_scores(pred, gt).select("stem", "pred_file", "pred_n_chars", "gt_file")


# Half of each block of 40 documents are RGB files and half their IR twins;
# every fourth block uses folder suffixes that do not match.
TREE = """
doc AS (SELECT doc_id, source, lang, doc_id // 40 AS k, doc_id % 40 < 20 AS rgb FROM documents),
tree AS (SELECT *, '/data/' || {top} || source || '/' || CASE WHEN rgb THEN 'RGB' ELSE 'NIR' END ||
  CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN '-1' WHEN 2 THEN '_2' ELSE CASE WHEN rgb THEN '-3' ELSE '_3' END END || '/' ||
  CASE WHEN k % 5 = 4 THEN 'x' ELSE '' END || k || CASE WHEN NOT rgb AND lang = 'es' THEN '.txt' ELSE '.png' END AS path,
  CASE WHEN rgb OR lang <> 'fr' THEN 100 + k % 5 + CASE WHEN rgb THEN 0 ELSE doc_id % 9 END END AS height, 120 - doc_id % 3 AS width FROM doc)"""
_NORTH = "CASE WHEN doc_id % 20 < 10 THEN 'north/' ELSE '' END"


def tree(spark, sf, top=None):
    d = table(spark, sf, "documents")
    k, rgb = F.floor(F.col("doc_id") / 40), F.col("doc_id") % 40 < 20
    top = F.when(F.col("doc_id") % 20 < 10, F.lit("north/")).otherwise(F.lit("")) if top is None else top
    suffix = F.when(k % 4 == 0, "").when(k % 4 == 1, "-1").when(k % 4 == 2, "_2").otherwise(F.when(rgb, "-3").otherwise("_3"))
    file = F.concat(F.when(k % 5 == 4, "x").otherwise(""), k.cast("string"), F.when(~rgb & (F.col("lang") == "es"), ".txt").otherwise(".png"))
    path = F.concat(F.lit("/data/"), top, F.col("source"), F.lit("/"), F.when(rgb, "RGB").otherwise("NIR"), suffix, F.lit("/"), file)
    height = 100 + k % 5 + F.when(rgb, F.lit(0)).otherwise(F.col("doc_id") % 9)
    return d.select(
        "doc_id", path.alias("path"), F.when(rgb | (F.col("lang") != "fr"), height.cast("int")).alias("height"),
        (120 - F.col("doc_id") % 3).cast("int").alias("width"),
    )


# Folder pairs of the tree.
FOLDERS = """
fold AS (SELECT *, regexp_extract(path, '^(.*)/([^/]*)/[^/]*$', 1) AS parent, regexp_extract(path, '^(.*)/([^/]*)/[^/]*$', 2)[4:] AS suffix FROM tree),
sess AS (SELECT parent, suffix, regexp_extract(parent, '([^/]*)$', 1) AS session FROM fold WHERE path LIKE '%.png' GROUP BY ALL HAVING bool_or(rgb) AND bool_or(NOT rgb))"""


@query("session_folders", f"WITH {TREE.format(top=_NORTH)}, {FOLDERS} SELECT session, parent, suffix FROM sess")
def session_folders(spark, sf):
    return images.discover_sessions(tree(spark, sf).select("path")).select("session", "parent", "suffix")


@query("duplicate_sessions", f"""WITH {TREE.format(top="(k // 2 % 2) || '/'")}, {FOLDERS}
SELECT session FROM sess GROUP BY 1 HAVING count(DISTINCT parent) > 1""")
def duplicate_sessions(spark, sf):
    top = F.concat((F.floor(F.floor(F.col("doc_id") / 40) / 2) % 2).cast("string"), F.lit("/"))
    return images.duplicate_sessions(images.discover_sessions(tree(spark, sf, top).select("path")))


_TEMPS = """
lines AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'u' || user_id || '.png' WHEN 'signup' THEN ',' || value
  ELSE 'u' || user_id || (CASE WHEN event_id % 2 = 0 THEN '.png' ELSE '.tif' END) || ',' || value END AS line,
  event_type, user_id, value FROM events),
temps AS (SELECT 'u' || user_id AS stem, arg_max(value, event_id) AS celsius FROM lines WHERE event_type NOT IN ('error', 'signup') GROUP BY 1)"""


def _temps(spark, sf):
    u = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    v = F.concat(F.lit(","), F.col("value").cast("string"))
    ext = F.when(F.col("event_id") % 2 == 0, F.lit(".png")).otherwise(F.lit(".tif"))
    kind = F.col("event_type")
    line = F.when(kind == "error", F.concat(u, F.lit(".png"))).when(kind == "signup", v).otherwise(F.concat(u, ext, v))
    return tables.temperatures(table(spark, sf, "events").select(line.alias("value"), F.col("event_id").alias("line_no")))


@query("temperature_log", f"WITH {_TEMPS} SELECT stem, round(celsius, 6) AS celsius FROM temps")
def temperature_log(spark, sf):
    return _temps(spark, sf).withColumn("celsius", r6("celsius"))


@query("temperature_condition", f"""
WITH {PIX}, {_TEMPS}, m AS (SELECT vec_id, avg(x) AS m FROM pix GROUP BY 1)
SELECT vec_id, 'u' || vec_id AS stem, round(coalesce((celsius - -20e0) / 100e0 * 2e0 - 1e0, m), 6) + 0e0 AS t FROM m LEFT JOIN temps ON stem = 'u' || vec_id""")
def temperature_condition(spark, sf):
    f = frames(spark, sf).select("vec_id", F.concat(F.lit("u"), F.col("vec_id").cast("string")).alias("stem"), array_mean("b").alias("m"))
    out = pairing.attach_temperature(f, _temps(spark, sf), ABS16, F.col("m"))
    return out.select("vec_id", "stem", r6("t").alias("t"))


@query("condition_sweep", """
SELECT vec_id, c AS cond FROM embeddings, (VALUES (0e0), (15e0), (30e0)) t(c)""")
def condition_sweep(spark, sf):
    return pairing.sweep(frames(spark, sf).select("vec_id"), [0.0, 15.0, 30.0]).select("vec_id", "cond")


_NAMES = """
a AS (SELECT printf('%06d', doc_id) AS name, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents),
b AS (SELECT printf('L%06d', doc_id) AS name, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM labels)"""


def _named(spark, sf):
    a = _docs(spark, sf).select(F.format_string("%06d", "doc_id").alias("name"))
    return a, table(spark, sf, "labels").select(F.format_string("L%06d", "doc_id").alias("name"))


@query("decoupled_cyclic", f"WITH {_NAMES} SELECT a.name AS rgb_name, b.name AS ir_name FROM a JOIN b ON b.idx = a.idx % b.n")
def decoupled_cyclic(spark, sf):
    return pairing.decoupled(*_named(spark, sf), train=False).select("rgb_name", "ir_name")


@query("decoupled_drawn", f"""
WITH {_NAMES} SELECT a.name AS rgb_name, b.name AS ir_name FROM a JOIN b ON b.idx = floor({uniform_sql("a.name", "4", "9")} * b.n)::BIGINT""")
def decoupled_drawn(spark, sf):
    return pairing.decoupled(*_named(spark, sf), train=True, epoch=4, seed=9).select("rgb_name", "ir_name")


@query("calibration_lookup", """
WITH r AS (SELECT label, min(vec_id) AS first_id, count(*) AS n FROM embeddings GROUP BY 1)
SELECT vec_id, first_id, n FROM embeddings JOIN r USING (label)""")
def calibration_lookup(spark, sf):
    f = frames(spark, sf).select("vec_id", "label")
    r = f.groupBy("label").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return lookup(f, r, ["label"], ["vec_id"]).select("vec_id", "first_id", "n")


@query("checksum_comparison", """
WITH o AS (SELECT doc_id, sha256(text) AS d FROM documents WHERE n_chars > 200),
t AS (SELECT doc_id, sha256(CASE WHEN lang = 'fr' THEN text || '.' ELSE text END) AS d FROM documents WHERE lang <> 'de')
SELECT doc_id, CASE WHEN t.d IS NULL THEN 'missing' WHEN o.d IS NULL THEN 'extra' WHEN o.d = t.d THEN 'ok' ELSE 'changed' END AS state
FROM o FULL JOIN t USING (doc_id)""")
def checksum_comparison(spark, sf):
    d = table(spark, sf, "documents")
    ours = d.where("n_chars > 200").select("doc_id", F.sha2("text", 256).alias("d"))
    text = F.when(F.col("lang") == "fr", F.concat("text", F.lit("."))).otherwise(F.col("text"))
    theirs = d.where("lang <> 'de'").select("doc_id", F.sha2(text, 256).alias("d"))
    return pairing.compare_checksums(ours, theirs, "doc_id", "d")


@query("size_mismatches", """
WITH s AS (SELECT p_partkey, p_size AS rgb_h, 40 AS rgb_w, p_size + p_partkey % 7 AS ir_h, 40 - p_partkey % 11 AS ir_w, p_partkey % 13 = 0 AS bad FROM part)
SELECT p_partkey, CASE WHEN bad THEN 'unreadable' WHEN abs(ir_h - rgb_h) > 4 OR abs(ir_w - rgb_w) > 4
  THEN 'size mismatch rgb(' || rgb_h || ', ' || rgb_w || ') ir(' || ir_h || ', ' || ir_w || ')' ELSE 'ok' END AS reason FROM s""")
def size_mismatches(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    p = table(spark, sf, "part").select(
        "p_partkey", F.when(k % 13 != 0, s).alias("rgb_h"), F.lit(40).alias("rgb_w"), (s + k % 7).alias("ir_h"), (40 - k % 11).alias("ir_w")
    )
    return pairing.size_check(p).select("p_partkey", F.coalesce("reason", F.lit("ok")).alias("reason"))


@query("index_with_gaps", """
WITH i AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx FROM documents)
SELECT doc_id, source, idx FROM i WHERE doc_id IN (SELECT doc_id FROM labels)""")
def index_with_gaps(spark, sf):
    i = pairing.index_within(_docs(spark, sf, "source"), ["source"], ["doc_id"])
    return pairing.pair_by_name(i, table(spark, sf, "labels").select("doc_id"), ["doc_id"]).select("doc_id", "source", "idx")


@query("skip_first", """
SELECT doc_id, lang, idx FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx FROM documents) WHERE idx >= 90""")
def skip_first(spark, sf):
    return pairing.skip_first(_docs(spark, sf, "lang"), ["lang"], ["doc_id"], 90).select("doc_id", "lang", "idx")


@query("points_exploded", """
SELECT vec_id, i::BIGINT AS i, round(embedding[4 * i + 1]::DOUBLE, 6) + 0e0 AS x, round(embedding[4 * i + 2]::DOUBLE, 6) + 0e0 AS y,
  round(embedding[4 * i + 3]::DOUBLE, 6) + 0e0 AS u, round(embedding[4 * i + 4]::DOUBLE, 6) + 0e0 AS v FROM embeddings, range(16) t(i)""")
def points_exploded(spark, sf):
    e = table(spark, sf, "embeddings")
    pair = lambda off: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.array(*[F.col("embedding")[i * 4 + off + k].cast("double") for k in (0, 1)]))
    p = tables.explode_points(e.select("vec_id", pair(0).alias("rgb"), pair(2).alias("thermal")), ["vec_id"])
    return p.select("vec_id", F.col("i").cast("bigint").alias("i"), *[r6(c).alias(c) for c in "xyuv"])
