"""Queries that write through the sinks and read back through the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from framepair.catalog.base import ABS16, FRAMES, PIX, REL8, frames, micros, name_of, query, r6, table
from framepair.catalog.reports import MANIFEST_SQL, manifest_rows
from framepair.catalog.splits import _chunk_sql
from framepair.functions.geometry import letterbox
from framepair.functions.names import condition
from framepair.operators import pairing, profile, split
from framepair.plans.evaluate import evaluate
from framepair.schema import REGISTRATION
from framepair.session import staging_path
from framepair.sources import commits, sinks, tables

_CHUNKS = _chunk_sql(17, 0.1, "", "SELECT doc_id, doc_id AS name FROM documents", "doc_id")


@query("written_split", f"""SELECT doc_id, 'rgb' AS modality FROM ({_CHUNKS}) WHERE split = 'val'
UNION ALL SELECT doc_id, 'thermal' FROM ({_CHUNKS}) WHERE split = 'val'""")
def written_split(spark, sf):
    """Reading one split touches only its folders."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    placed = split.chunk_split(d, [], ["doc_id"], 0.1, 17)
    rows = sinks.both_modalities(placed.withColumn("b", F.col("n_chars") * 2), ["doc_id", "split"], "n_chars", "b")
    path = staging_path(spark, "split")
    sinks.write_split(rows, path)
    return spark.read.parquet(path).where(F.col("split") == "val").select("doc_id", "modality")


@query("written_pairs", """SELECT d.doc_id, lpad((row_number() OVER (ORDER BY d.doc_id) - 1)::VARCHAR, 6, '0') || '.png' AS name
FROM documents d JOIN labels USING (doc_id)""")
def written_pairs(spark, sf):
    pairs = pairing.pair_by_name(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"), ["doc_id"])
    indexed = pairing.index_within(pairs, [], ["doc_id"], "n")
    path = staging_path(spark, "pairs")
    sinks.write_pairs(indexed.select("doc_id", F.format_string("%06d.png", "n").alias("name")), path)
    return spark.read.parquet(path)


@query("written_conditions", f"""WITH {PIX}
SELECT vec_id, 'T' || cond || 'C' AS cond_label, bits AS bit_depth, printf('%06d', vec_id) || CASE bits WHEN 16 THEN '_16bit' ELSE '' END || '.png' AS file,
  round(avg(CASE bits WHEN 8 THEN v ELSE floor(greatest(0e0, least(65535e0, ((x + 1e0) / 2e0 * 100e0 + -20e0 - -273.15e0) / 0.04e0))) END), 4) AS mean
FROM pix, (VALUES (0), (15), (30)) t(cond), (VALUES (8), (16)) u(bits) GROUP BY ALL""")
def written_conditions(spark, sf):
    f = pairing.sweep(frames(spark, sf).select("vec_id", F.format_string("%06d", "vec_id").alias("stem"), F.col("b").alias("px")), [0.0, 15.0, 30.0])
    both = sinks.with_16bit(f.withColumn("cond_label", condition(ABS16, "cond")[1]), ABS16)
    path = staging_path(spark, "conditions")
    sinks.write_conditions(both.drop("cond"), path)
    back = spark.read.parquet(path)
    mean = F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, v: s + v) / F.size("counts")
    return back.select("vec_id", "cond_label", F.col("bit_depth").cast("bigint").alias("bit_depth"), "file", F.round(mean, 4).alias("mean"))


@query("resumed_write", "SELECT doc_id, CASE WHEN n_chars > 300 THEN 1 WHEN n_chars > 200 THEN 2 ELSE 3 END AS wave FROM documents")
def resumed_write(spark, sf):
    """A run, then two side by side of which the later one meets the other's commit."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    wave = lambda n: d.withColumn("wave", F.lit(n).cast("bigint"))
    path = staging_path(spark, "resume")
    commits.append_missing(wave(1).where("n_chars > 300"), path, ["doc_id"])
    late = commits.Append(wave(3), path, ["doc_id"])
    commits.append_missing(wave(2).where("n_chars > 200"), path, ["doc_id"])
    late.commit()
    return commits.read_committed(spark, path, late.schema).select("doc_id", "wave")


@query("registration_records", """
WITH r AS (SELECT p_brand, max(p_size) AS rw, min(p_size) + 20 AS tw FROM part GROUP BY 1)
SELECT p_brand, 'identity' AS mode, round(least(tw / rw::DOUBLE, tw / rw::DOUBLE), 6) AS h00, true AS no_score, (rw + tw)::BIGINT AS size_sum FROM r""")
def registration_records(spark, sf):
    r = table(spark, sf, "part").groupBy("p_brand").agg(F.max("p_size").alias("rw"), (F.min("p_size") + 20).alias("tw"))
    none = lambda kind: F.lit(None).cast(kind)
    record = r.select(
        "p_brand", F.lit("identity").alias("mode"), letterbox("rw", "rw", "tw", "tw").alias("H"), none("double").alias("ecc_cc"),
        none("array<int>").alias("crop"), F.array("tw", "tw").alias("thermal_size"), F.array("rw", "rw").alias("rgb_size"),
    )
    path = staging_path(spark, "registration")
    sinks.write_record(record, path)
    back = spark.read.schema(f"p_brand STRING, {REGISTRATION}").json(path)
    return back.select(
        "p_brand", "mode", r6(F.col("H")[0][0]).alias("h00"), F.col("ecc_cc").isNull().alias("no_score"),
        (F.col("thermal_size")[0] + F.col("rgb_size")[0]).cast("bigint").alias("size_sum"),
    )


_SESS = """
WITH c AS (SELECT source AS session, count(*) AS pairs FROM documents GROUP BY 1),
k AS (SELECT session, CASE WHEN session IN ('src3', 'src11') THEN 'val' ELSE 'train' END AS split, pairs FROM c)"""


@query("split_report", f"{_SESS} SELECT session, split, pairs, sum(pairs) OVER (PARTITION BY split)::BIGINT AS split_total FROM k")
def split_report(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("session"))
    counts = profile.session_counts(split.session_split(d, ["doc_id"], ["src3", "src11"]))
    path = staging_path(spark, "report")
    sinks.write_record(sinks.split_report(counts, "/data"), path)
    report = tables.read_split_report(spark, path)
    totals = report.select(F.inline(F.array(
        F.struct(F.lit("train").alias("split"), F.col("counts.train").alias("split_total")),
        F.struct(F.lit("val").alias("split"), F.col("counts.val").alias("split_total")),
    )))
    return tables.report_sessions(report).join(totals, "split").select("session", "split", "pairs", "split_total")


@query("metrics_record", f"""WITH {PIX}, per AS (SELECT vec_id, avg(abs((v // 16 * 16) - v) / 255e0) AS l1 FROM pix GROUP BY 1)
SELECT count(*) AS n, round(avg(l1), 6) AS l1 FROM per""")
def metrics_record(spark, sf):
    f = frames(spark, sf).select(name_of().alias("file"), F.lit(8).alias("height"), F.lit(8).alias("width"), "px")
    coarse = f.withColumn("px", F.transform("px", lambda v: (F.floor(v / 16) * 16).cast("int")))
    path = staging_path(spark, "metrics")
    sinks.write_record(evaluate(coarse, f, REL8), path)
    return spark.read.schema("n BIGINT, L1 DOUBLE, RMSE DOUBLE, PSNR DOUBLE, SSIM DOUBLE").json(path).select("n", r6("L1").alias("l1"))


@query("manifest_file", f"WITH {MANIFEST_SQL} SELECT frame, split, width, thermal_dtype, thermal_mean, thermal_max, rgb_mean, thermal_sha256 FROM man")
def manifest_file(spark, sf):
    path = staging_path(spark, "manifest")
    manifest_rows(spark, sf).write.option("header", "true").csv(path)
    back = tables.read_manifest(spark, path)
    return back.select("frame", "split", "width", "thermal_dtype", "thermal_mean", "thermal_max", "rgb_mean", "thermal_sha256")


@query("points_file", f"""WITH {FRAMES}
SELECT label, i::BIGINT AS i, count(*) AS n, round(sum(b[2 * i + 1]), 4) + 0e0 AS x, round(sum(b[2 * i + 2]), 4) + 0e0 AS v FROM frames, range(16) t(i) GROUP BY ALL""")
def points_file(spark, sf):
    """Correspondence records written as JSON lines and read with the declared schema."""
    pair = lambda off: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.array(*[F.get(F.col("b"), i * 2 + (k + off) % 32) for k in (0, 1)]))
    path = staging_path(spark, "points")
    frames(spark, sf).select("vec_id", "label", pair(0).alias("rgb"), pair(0).alias("thermal")).write.json(path)
    raw = spark.read.schema("vec_id BIGINT, label BIGINT, rgb ARRAY<ARRAY<DOUBLE>>, thermal ARRAY<ARRAY<DOUBLE>>").json(path)
    p = tables.explode_points(raw, ["vec_id", "label"])
    return p.groupBy("label", F.col("i").cast("bigint").alias("i")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("x"), F.round(F.sum("v"), 4).alias("v")
    )


@query("points_packed", f"""WITH {FRAMES} SELECT vec_id, 16 AS n, round(b[1], 6) + 0e0 AS x0, round(b[32], 6) + 0e0 AS v15 FROM frames""")
def points_packed(spark, sf):
    pair = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.array(F.get(F.col("b"), i * 2), F.get(F.col("b"), i * 2 + 1)))
    exploded = tables.explode_points(frames(spark, sf).select("vec_id", pair.alias("rgb"), pair.alias("thermal")), ["vec_id"])
    packed = tables.pack_points(exploded, ["vec_id"])
    return packed.select(
        "vec_id", F.size("rgb").cast("bigint").alias("n"), r6(F.col("rgb")[0][0]).alias("x0"), r6(F.col("thermal")[15][1]).alias("v15")
    )


_STREAMS = """SELECT event_type AS stream, count(*) AS frames, round(count(*) / 2592000e0, 9) AS fps, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM events GROUP BY 1"""


@query("stream_manifest", _STREAMS)
def stream_manifest(spark, sf):
    """A nested manifest document written from the events and read back."""
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("stream")).agg(F.count(F.lit(1)).alias("n"), F.min(micros("ts")).alias("a"), F.max(micros("ts")).alias("z"))
    video = F.struct(F.lit("h264").alias("codec"), F.col("n").alias("measured_frames"), (F.col("n") / 2592000.0).alias("measured_fps"))
    klv = F.struct(F.col("n").alias("packets"), F.col("a").alias("precision_timestamp_us_first"), F.col("z").alias("precision_timestamp_us_last"))
    entry = F.struct("stream", F.struct(F.concat("stream", F.lit(".ts")).alias("file"), video.alias("video"), klv.alias("klv")))
    # One entry per stream type.
    doc = e.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("streams"))).alias("value"))
    path = staging_path(spark, "streams")
    doc.write.text(path)
    s = tables.read_streams(spark, path)
    return s.select(
        "stream", F.col("video.measured_frames").alias("frames"), F.round("video.measured_fps", 9).alias("fps"),
        F.col("klv.precision_timestamp_us_first").alias("first_us"), F.col("klv.precision_timestamp_us_last").alias("last_us"),
    )


@query("packet_table", """
WITH p AS (SELECT event_type AS stream, event_id AS seq, (epoch_us(ts) // 1000 - 1704067200000) / 1000e0 AS pts, epoch_us(ts) AS klv_us FROM events)
SELECT stream, seq, round_even(pts * 1e6, 0)::BIGINT AS t_us, klv_us FROM p""")
def packet_table(spark, sf):
    e = table(spark, sf, "events")
    ms = F.floor(micros("ts") / 1000).cast("bigint") - 1_704_067_200_000
    path = staging_path(spark, "packets")
    e.select(F.col("event_type").alias("stream"), F.col("event_id").alias("seq"), (ms / 1000.0).alias("pts_s"), micros("ts").alias("klv_us")).write.option("header", "true").csv(path)
    return tables.read_packets(spark, path, "csv").select("stream", "seq", "t_us", "klv_us")


@query("temperature_file", """
SELECT 'd' || doc_id AS stem, round(n_chars / 8e0, 6) AS celsius FROM documents WHERE lang <> 'de'""")
def temperature_file(spark, sf):
    d = table(spark, sf, "documents")
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".png"))
    line = F.when(F.col("lang") == "de", name).otherwise(F.concat(name, F.lit(","), (F.col("n_chars") / 8.0).cast("string")))
    path = staging_path(spark, "temps")
    d.select(line.alias("value")).write.text(path)
    return tables.read_temperatures(spark, path).select("stem", r6("celsius").alias("celsius"))
