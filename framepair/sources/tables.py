"""Side-car sources: points, temperatures, logs, manifests, reports, packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framepair import schema
from framepair.functions import names

# The two line shapes of a training log.
ITERATION_LINE = r"^\[e(\d+) i(\d+)\] D=([\d.]+) G_gan=([\d.]+) G_L1=([\d.]+)"
EPOCH_LINE = r"^\[e(\d+)\] val L1 = ([\d.]+) \| ([\d.]+)s"


# -- correspondences ------------------------------------------------------
def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Correspondence files, one recording per file (its name is ``rec_id``)."""
    raw = spark.read.schema(schema.POINTS).option("multiLine", "true").json(path)
    return explode_points(raw.withColumn("rec_id", names.stem(names.base_name(F.input_file_name()))), ["rec_id"])


def explode_points(records: DataFrame, by: list[str]) -> DataFrame:
    """Two parallel point lists to ``(by, i, x, y, u, v)``; a missing partner is NULL."""
    zipped = records.select(*by, F.posexplode(F.arrays_zip("rgb", "thermal")).alias("i", "p"))
    at = lambda side, k: F.get(F.col(f"p.{side}"), F.lit(k))
    return zipped.select(
        *by, "i", at("rgb", 0).alias("x"), at("rgb", 1).alias("y"), at("thermal", 0).alias("u"), at("thermal", 1).alias("v")
    )


def pack_points(points: DataFrame, by: list[str]) -> DataFrame:
    """Back to one record per recording with two parallel lists."""
    rows = F.sort_array(F.collect_list(F.struct("i", "x", "y", "u", "v")))
    packed = points.groupBy(*by).agg(rows.alias("_p"))
    side = lambda a, b: F.transform("_p", lambda s: F.array(s[a], s[b]))
    return packed.select(*by, side("x", "y").alias("rgb"), side("u", "v").alias("thermal"))


# -- temperatures ---------------------------------------------------------
def read_temperatures(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``filename,celsius`` lines; the last line of a stem wins.

    Over several files, "last" is by file path, then by place in the file.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    # Ids rise within a block of a file, which one task reads.
    place = F.struct("file_path", "file_block_start", F.monotonically_increasing_id().alias("at"))
    return temperatures(lines.select("value", place.alias("line_no")))


def temperatures(lines: DataFrame) -> DataFrame:
    """``(stem, celsius)`` from ``(value, line_no)``.

    Lines with fewer than two fields or a blank name are ignored; a value that
    is not a number raises.
    """
    row = F.from_csv("value", F.lit(schema.TEMPERATURES))
    rows = lines.withColumn("_f", row).where(F.col("value").contains(","))
    rows = rows.withColumn("name", F.trim("_f.filename")).where(F.col("name").isNotNull() & (F.col("name") != ""))
    # A quoted name may hold the only comma; an empty second field is an error.
    rows = rows.where(F.col("_f.celsius").isNotNull() | F.col("value").rlike(r'^[^"]*,'))
    wrong = F.raise_error(F.concat(F.lit("not a temperature: "), F.col("value"))).cast("double")
    rows = rows.select("name", F.coalesce(F.trim("_f.celsius").try_cast("double"), wrong).alias("c"), "line_no")
    return rows.groupBy(names.stem("name").alias("stem")).agg(F.max_by("c", "line_no").alias("celsius"))


# -- training log ---------------------------------------------------------
def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def log_iterations(lines: DataFrame, col: str = "value") -> DataFrame:
    at = lambda i: F.regexp_extract(col, ITERATION_LINE, i)
    return lines.where(F.col(col).rlike(ITERATION_LINE)).select(
        at(1).cast("int").alias("epoch"), at(2).cast("int").alias("it"), at(3).cast("double").alias("D"),
        at(4).cast("double").alias("G_gan"), at(5).cast("double").alias("G_L1"),
    )


def log_epochs(lines: DataFrame, col: str = "value") -> DataFrame:
    at = lambda i: F.regexp_extract(col, EPOCH_LINE, i)
    return lines.where(F.col(col).rlike(EPOCH_LINE)).select(
        at(1).cast("int").alias("epoch"), at(2).cast("double").alias("val_l1"), at(3).cast("double").alias("seconds")
    )


# -- manifests and reports ------------------------------------------------
def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.MANIFEST).option("header", "true").csv(path)


def read_streams(spark: SparkSession, path: str) -> DataFrame:
    """One row per stream of a stream manifest."""
    raw = spark.read.schema(f"streams MAP<STRING, {schema.STREAM}>").option("multiLine", "true").json(path)
    return raw.select(F.explode("streams").alias("stream", "s")).select("stream", "s.*")


def read_sync(spark: SparkSession, path: str) -> DataFrame:
    """The recorded clock offset of a stream manifest, in milliseconds."""
    raw = spark.read.schema(f"sync {schema.SYNC}").option("multiLine", "true").json(path)
    offset = F.col("sync.extract_frames_offset_ms")
    return raw.select(
        offset["value"].alias("offset_ms"), offset["at_end_of_recording"].alias("end_offset_ms"),
        offset["drift_ms_over_recording"].alias("drift_ms"), offset["status"].alias("status"),
    )


def read_split_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.SPLIT_REPORT).option("multiLine", "true").json(path)


def read_skipped(spark: SparkSession, reports: DataFrame) -> DataFrame:
    """``text`` of every reject of ``reports``: those inside the records and those kept beside them."""
    inside = reports.select(F.explode("skipped").alias("text"))
    # As many paths as reports.
    for r in reports.where(F.col("skipped_path").isNotNull()).select("skipped_path").distinct().collect():
        inside = inside.unionByName(spark.read.schema("text string").json(r["skipped_path"]))
    return inside


def report_sessions(reports: DataFrame) -> DataFrame:
    return reports.select(F.explode("sessions").alias("session", "s")).select("session", "s.split", "s.pairs")


def read_packets(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Packet timestamps, with presentation time in whole microseconds."""
    reader = spark.read.schema(schema.PACKETS)
    raw = reader.option("header", "true").csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    return raw.withColumn("t_us", F.rint(F.col("pts_s") * 1e6).cast("bigint")).withColumn("id", F.col("seq"))


