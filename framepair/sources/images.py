"""Frame sources: folders of images as DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framepair.functions import color, names
from framepair.functions.arrow import kernel
from framepair.operators import sync

# Formats that never hold more than 8 bits a sample.
EIGHT_BIT = r"\.(jpe?g|bmp)$"
EIGHT_BIT_FILES = "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[bB][mM][pP]}"
_DECODED = "struct<height int, width int, channels int, depth int, px array<int>>"


LEAST_TASKS, GATHERED = 4, 32  # tasks a core, and partitions that one task reads if there are more


def gathered(files: DataFrame) -> DataFrame:
    """``files`` with fewer partitions. Spark counts every file as 4 MB at least, which gives a folder of small ones a task for each few."""
    n = files.rdd.getNumPartitions()
    return files.coalesce(max(1, min(n, max(LEAST_TASKS * files.sparkSession.sparkContext.defaultParallelism, n // GATHERED))))


def list_images(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """``path, name, length, modificationTime`` of image files. File bytes are never read."""
    files = spark.read.format("binaryFile")
    if recursive:
        files = files.option("recursiveFileLookup", "true")
    files = gathered(files.load(path).select("path", "length", "modificationTime"))
    return files.withColumn("name", names.base_name("path")).where(names.is_image("name"))


def read_rgb(spark: SparkSession, path: str) -> DataFrame:
    """Colour frames, always three BGR channels; undecodable files have NULL sizes."""
    raw = gathered(spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*"))
    raw = raw.withColumn("name", names.base_name("origin")).where(names.is_image("name"))
    ok = F.col("height") > 0
    px = byte_values("data")
    return raw.select(
        "name", names.stem("name").alias("stem"),
        F.when(ok, F.col("height")).alias("height"), F.when(ok, F.col("width")).alias("width"),
        F.lit(3).alias("channels"), F.when(ok, color.drop_alpha(px, F.col("nChannels"))).alias("px"),
    )


def byte_values(data: Column | str) -> Column:
    """BINARY to an array of 0..255 values, straight from the Arrow buffer."""

    def run(data: pa.Array) -> pa.Array:
        _, ends, body = data.buffers()
        offsets = np.frombuffer(ends, np.int32)[data.offset : data.offset + len(data) + 1]
        raw = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        values = raw[offsets[0] : offsets[-1]].astype(np.int32)
        mask = data.is_null() if data.null_count else None
        return pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), pa.array(values), mask=mask)

    return kernel(run, "array<int>")(data)


def decode_frames(content: Column | str) -> Column:
    """``struct(height, width, channels, depth, px)`` of PNG or TIFF bytes, NULL when unreadable."""
    from framepair.sources import png, tiff

    def decode(blob: bytes) -> np.ndarray | None:
        return png.decode(blob) if blob[:4] == png.SIGNATURE[:4] else tiff.decode(blob)

    def run(content: pa.Array) -> pa.Array:
        found = [decode(blob.as_py()) if blob.is_valid else None for blob in content]
        sizes = [(i.shape[0], i.shape[1], 1 if i.ndim == 2 else i.shape[2], i.itemsize * 8) if i is not None else (None,) * 4 for i in found]
        columns = [pa.array(list(c), pa.int32()) for c in zip(*sizes)] if sizes else [pa.array([], pa.int32())] * 4
        px = pa.array([i.ravel().astype(np.int32) if i is not None else None for i in found], pa.list_(pa.int32()))
        gone = pa.array([i is None for i in found], pa.bool_())
        return pa.StructArray.from_arrays([*columns, px], names=["height", "width", "channels", "depth", "px"], mask=gone)

    return kernel(run, _DECODED)(content)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames at full bit depth, channels as stored (BGR order).

    Formats of 8 bits only (JPG, BMP) go through Spark's own reader.
    """
    files = gathered(spark.read.format("binaryFile").load(path)).withColumn("name", names.base_name("path"))
    files = files.where(names.is_image("name") & ~F.lower("name").rlike(EIGHT_BIT)).select("name", decode_frames("content").alias("f"))
    plain = spark.read.format("image").option("dropInvalid", "false").option("pathGlobFilter", EIGHT_BIT_FILES).load(path)
    plain = gathered(plain.select("image.*")).withColumn("name", names.base_name("origin"))
    ok = F.col("height") > 0
    known = lambda c: F.when(ok, c)
    plain = plain.select(
        "name", names.stem("name").alias("stem"), known(F.col("height")).alias("height"), known(F.col("width")).alias("width"),
        known(F.col("nChannels")).alias("channels"), known(F.lit(8)).alias("depth"), known(byte_values("data")).alias("px"),
    )
    return files.select("name", names.stem("name").alias("stem"), "f.*").unionByName(plain)


def read_thermal(spark: SparkSession, path: str) -> DataFrame:
    """Single-channel frames at full bit depth; colour files become weighted grey."""
    f = read_frames(spark, path)
    bgr = F.when(F.col("channels") > 1, color.drop_alpha("px", F.col("channels")))
    grey = F.coalesce(color.luma_uint8(bgr), F.col("px"))
    return f.select("name", "stem", "height", "width", F.when(F.col("height") > 0, F.lit(1)).alias("channels"), "depth", grey.alias("px"))


def timed_frames(spark: SparkSession, path: str, fps: float) -> DataFrame:
    """A frame folder as a constant-rate recording: ``name, idx, t_us``."""
    listed = list_images(spark, path).select("name")
    return sync.frame_times(listed, [], ["name"], fps)


def session_files(paths: DataFrame, rgb_prefix: str = "RGB", ir_prefix: str = "NIR") -> DataFrame:
    """Files that lie in a modality folder: ``parent, session, modality, suffix, file``.

    ``paths`` has a ``path`` column like ``.../<session>/<prefix><suffix>/<file>``;
    its other columns pass through.
    Files under an outer modality folder belong to that folder's session, so
    they are not searched for inner sessions.
    """
    parts = F.regexp_extract("path", r"^(.*)/([^/]*)/([^/]*)$", 1), F.regexp_extract("path", r"^(.*)/([^/]*)/([^/]*)$", 2)
    df = paths.select("*", parts[0].alias("parent"), parts[1].alias("child"), names.base_name("path").alias("file"))
    is_rgb, is_ir = F.col("child").startswith(rgb_prefix), F.col("child").startswith(ir_prefix)
    cut = lambda p: F.substring("child", len(p) + 1, 1_000_000)
    # A folder may match both prefixes; then it stands on both sides.
    sides = F.array_compact(F.array(
        F.when(is_rgb, F.struct(F.lit("rgb").alias("modality"), cut(rgb_prefix).alias("suffix"))),
        F.when(is_ir, F.struct(F.lit("ir").alias("modality"), cut(ir_prefix).alias("suffix"))),
    ))
    df = df.select(*paths.columns, "parent", "file", F.inline(sides))
    return df.withColumn("session", names.base_name("parent")).where(names.is_image("file"))


def discover_sessions(paths: DataFrame, rgb_prefix: str = "RGB", ir_prefix: str = "NIR") -> DataFrame:
    """``session, parent, suffix`` of every matched folder pair.

    Folders pair by the raw suffix (``RGB-1`` with ``NIR-1``, not ``NIR_1``).
    """
    files = session_files(paths.select("path"), rgb_prefix, ir_prefix)
    sides = files.groupBy("parent", "session", "suffix").agg(
        F.bool_or(F.col("modality") == "rgb").alias("_r"), F.bool_or(F.col("modality") == "ir").alias("_i")
    )
    pairs = sides.where("_r and _i").select("session", "parent", "suffix")
    # Matched folders are not descended into: drop parents inside one.
    folder = lambda prefix: F.concat("parent", F.lit("/"), F.lit(prefix), "suffix")
    matched = pairs.select(F.explode(F.array(folder(rgb_prefix), folder(ir_prefix))).alias("_m"))
    depth = F.size(F.split("parent", "/"))
    ups = F.transform(F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice(F.split("parent", "/"), 1, n), "/"))
    inner = pairs.select("session", "parent", "suffix", F.explode(ups).alias("_m")).join(matched, "_m", "left_semi")
    return pairs.join(inner.select("parent").distinct(), "parent", "left_anti").select("session", "parent", "suffix")


def duplicate_sessions(sessions: DataFrame) -> DataFrame:
    """Session names found under more than one parent: an error for the caller."""
    per = sessions.groupBy("session").agg(F.min("parent").alias("_a"), F.max("parent").alias("_b"))
    return per.where(F.col("_a") != F.col("_b")).select("session")
