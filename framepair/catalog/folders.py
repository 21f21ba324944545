"""Queries on real image files: frames written from the given table, listed, read and streamed."""

from __future__ import annotations

from pyspark.sql import functions as F

from framepair.catalog.base import ABS16, BGR, FRAMES, PIX, REL8, colour, frames, name_of, query, with_size
from framepair.catalog.jobs import SINGLE, _weighted
from framepair.session import staging_path
from framepair.sources import folder, images, sinks
from framepair.streaming import runs


def _written(spark, sf, rgb=False, deep=False):
    """A folder with one PNG per frame: grey at 8 or 16 bits, or colour."""
    folder.register(spark)
    px = colour() if rgb else F.transform("px", lambda v: v * 257) if deep else F.col("px")
    f = with_size(frames(spark, sf)).select(name_of().alias("name"), "height", "width", px.alias("px"), F.lit(3 if rgb else 1).alias("channels"), F.lit(16 if deep else 8).alias("depth"))
    path = staging_path(spark, "folder")
    f.write.format("frames").mode("append").save(path)
    return path


@query("folder_listing", f"WITH {FRAMES} SELECT printf('%06d.png', vec_id) AS name, true AS filled, 8 AS height, 8 AS width, 3 AS channels, 8 AS depth FROM frames")
def folder_listing(spark, sf):
    """Names, lengths and sizes; no pixel is decoded."""
    path = _written(spark, sf, rgb=True)
    sized = spark.read.format("frames").schema("name string, height int, width int, channels int, depth int").load(path)
    listed = images.list_images(spark, path).select("name", (F.col("length") > 64).alias("filled"))
    whole = lambda c: F.col(c).cast("bigint").alias(c)
    return listed.join(sized, "name").select("name", "filled", *map(whole, ("height", "width", "channels", "depth")))


@query("folder_frames", f"""WITH {PIX}
SELECT printf('%06d.png', vec_id) AS name, 16 AS depth, 1 AS channels, round(sum(v * 257 * (i + 1))::DOUBLE, 3) AS px FROM pix GROUP BY vec_id""")
def folder_frames(spark, sf):
    """Infrared frames at full depth through the data source."""
    f = spark.read.format("frames").load(_written(spark, sf, deep=True))
    return f.select("name", F.col("depth").cast("bigint").alias("depth"), F.col("channels").cast("bigint").alias("channels"), _weighted("px", 3).alias("px"))


@query("folder_colour_frames", f"""WITH {BGR}
SELECT printf('%06d.png', vec_id) AS name, 8 AS height, 8 AS width, 3 AS channels, round(sum(v * ((r * 8 + c) * 3 + ch + 1))::DOUBLE, 3) AS px FROM bgr GROUP BY vec_id""")
def folder_colour_frames(spark, sf):
    """Colour frames through the built-in image reader."""
    f = images.read_rgb(spark, _written(spark, sf, rgb=True))
    whole = lambda c: F.col(c).cast("bigint").alias(c)
    return f.select("name", *map(whole, ("height", "width", "channels")), _weighted("px", 3).alias("px"))


@query("streamed_folder", f"""WITH {PIX}
SELECT printf('%06d.png', vec_id) AS name, round(sum(v * (i + 1))::DOUBLE, 3) AS px FROM pix GROUP BY vec_id""")
def streamed_folder(spark, sf):
    """A folder of images as a stream."""
    f = spark.readStream.format("frames").schema("name string, px array<int>").load(_written(spark, sf))
    return runs.drain(f).select("name", _weighted("px", 3).alias("px"))


@query("streamed_folder_translation", f"""WITH {BGR},
rgbn AS (SELECT vec_id, i, max(v / 127.5e0 - 1e0) FILTER (ch = 2) AS r, max(v / 127.5e0 - 1e0) FILTER (ch = 1) AS g, max(v / 127.5e0 - 1e0) FILTER (ch = 0) AS b FROM bgr GROUP BY 1, 2)
SELECT printf('%06d.png', vec_id) AS name, count(*) AS pixels, round(avg(0.4e0 * r + 0.3e0 * g + 0.2e0 * b - 0.1e0), 6) + 0e0 AS mean FROM rgbn GROUP BY vec_id""")
def streamed_folder_translation(spark, sf):
    """Images that arrive in a folder, translated."""
    source = spark.readStream.format("frames").schema("name string, height int, width int, px array<int>").load(_written(spark, sf, rgb=True))
    path = staging_path(spark, "translated")
    runs.translate_folder(source, lambda: SINGLE, REL8, f"{path}/out", f"{path}/checkpoint", precision="double")
    total = F.aggregate("px", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return spark.read.parquet(f"{path}/out").select("name", F.size("px").cast("bigint").alias("pixels"), F.round(total / F.size("px"), 6).alias("mean"))


@query("run_settings", """SELECT 'frames' AS key, count(*)::VARCHAR AS value, 'abs16' AS mode FROM embeddings
UNION ALL SELECT 'label', max(label)::VARCHAR, 'abs16' FROM embeddings UNION ALL SELECT 'cap', NULL, 'abs16'""")
def run_settings(spark, sf):
    """The record of a run, written and read back; a setting without a value is NULL."""
    n = frames(spark, sf).agg(F.count(F.lit(1)).alias("frames"), F.max("label").alias("label")).first()
    path = staging_path(spark, "settings")
    sinks.write_record(sinks.run_record(spark, {"frames": n["frames"], "label": n["label"], "cap": None}, ABS16), path)
    back = spark.read.schema("args map<string,string>, thermal_norm struct<mode:string>").json(path)
    return back.select(F.explode("args").alias("key", "value"), F.col("thermal_norm.mode").alias("mode"))
