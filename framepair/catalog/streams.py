"""Structured Streaming queries, each held to its batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from framepair.catalog.base import BGR, REL8, colour, frames, micros, query, r6, table, with_size
from framepair.catalog.jobs import SINGLE
from framepair.catalog.timing import _EXTRACT, HOUR, QUOTA, SPEC, _sync_sql, stream
from framepair.session import materialise, staging_path
from framepair.streaming import pairing, runs


DAY = 24 * HOUR


def _staged(spark, df, tag):
    """Write a table as a stream source folder and open it as a stream."""
    path = staging_path(spark, tag)
    df.write.parquet(path)
    return runs.frame_stream(spark, path, df.schema)


def _with_end(df, *levels):
    """A closing row far ahead moves the watermark past every open sample."""
    end = df.agg((F.max("t_us") + 90 * 24 * HOUR).alias("t_us"))
    closing = end.select(F.lit(None).cast("bigint").alias("user_id"), F.lit(-1).cast("bigint").alias("id"), "t_us", *[F.lit(0.0).alias(c) for c in levels])
    return df.unionByName(closing)


@query("streamed_pairs", f"WITH {_sync_sql(SPEC)} SELECT user_id, k, t, rgb_id, rgb_t, ir_id, ir_t FROM acc")
def streamed_pairs(spark, sf):
    sides = [_staged(spark, _with_end(stream(spark, sf, k).drop("value")), k) for k in ("view", "click")]
    out = runs.drain(pairing.pair_streams(*sides, ["user_id"], SPEC, "8 hours"))
    return out.where("user_id is not null")


@query("streamed_resampling", f"""WITH fr AS (SELECT user_id, event_id AS id, epoch_us(ts) AS t FROM events),
s AS (SELECT user_id, id, t, unnest([x for x in range(greatest(0, ceil((t - {SPEC.start_us} - {4 * HOUR}) / {HOUR}e0)::BIGINT), floor((t - {SPEC.start_us} + {4 * HOUR}) / {HOUR}e0)::BIGINT + 1)]) AS k FROM fr),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY abs(t - ({SPEC.start_us} + k * {HOUR})), t, CASE WHEN t < {SPEC.start_us} + k * {HOUR} THEN -id ELSE id END) AS rn FROM s)
SELECT user_id, k, id, t AS frame_t FROM n WHERE rn = 1""")
def streamed_resampling(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("id"), micros("ts").alias("t_us"))
    out = runs.drain(pairing.resample(_staged(spark, _with_end(e), "events"), ["user_id"], SPEC, "8 hours", 2 * DAY))
    return out.where("user_id is not null").select("user_id", "k", "id", "frame_t")


@query("streamed_static_frames", """
WITH s AS (SELECT user_id, event_id AS id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events)
SELECT user_id, id, round(value, 6) AS level, coalesce(abs(d) < 5e0, false) AS static FROM s""")
def streamed_static_frames(spark, sf):
    """Frames arrive by id and not by time; they are compared in the order of their times."""
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("id"), micros("ts").alias("t_us"), F.col("value").alias("level"))
    end = e.agg((F.max("t_us") + 90 * DAY).alias("t_us")).select(F.lit(None).cast("bigint").alias("user_id"), F.lit(-1).cast("bigint").alias("id"), "t_us", F.lit(0.0).alias("level"))
    shuffled = e.unionByName(end).orderBy(F.xxhash64("id"))
    out = runs.drain(pairing.mark_static_stream(_staged(spark, shuffled, "levels"), ["user_id"], 5.0, "8 hours", 2 * DAY))
    return out.where("user_id is not null").select("user_id", "id", r6("level").alias("level"), "static")


@query("streamed_extraction", f"""WITH {_EXTRACT}
SELECT user_id, n, lpad(n::VARCHAR, 6, '0') || '.png' AS name, k, t, rgb_id, rgb_t, ir_id, ir_t FROM num WHERE n < {QUOTA.max_pairs}""")
def streamed_extraction(spark, sf):
    """Quota, frozen frames and names on a stream: the rows of the batch job."""
    view, click = (stream(spark, sf, k) for k in ("view", "click"))
    sides = [_staged(spark, _with_end(view.drop("value")), "view"), _staged(spark, _with_end(click, "value"), "click")]
    out = runs.drain(pairing.extract_stream(*sides, ["user_id"], QUOTA, "8 hours", level="value", cell_us=2 * DAY))
    return out.where("user_id is not null")


@query("streamed_translation", f"""WITH {BGR},
rgbn AS (SELECT vec_id, i, max(v / 127.5e0 - 1e0) FILTER (ch = 2) AS r, max(v / 127.5e0 - 1e0) FILTER (ch = 1) AS g, max(v / 127.5e0 - 1e0) FILTER (ch = 0) AS b FROM bgr GROUP BY 1, 2)
SELECT vec_id, count(*) AS pixels, round(avg(0.4e0 * r + 0.3e0 * g + 0.2e0 * b - 0.1e0), 6) + 0e0 AS mean FROM rgbn GROUP BY 1""")
def streamed_translation(spark, sf):
    f = materialise(with_size(frames(spark, sf)).select("vec_id", "height", "width", colour().alias("px")), "frames")
    path = staging_path(spark, "translated")
    source = runs.frame_stream(spark, f.inputFiles()[0].rsplit("/", 1)[0], f.schema)
    runs.translate_folder(source, lambda: SINGLE, REL8, f"{path}/out", f"{path}/checkpoint", precision="double")
    back = spark.read.parquet(f"{path}/out")
    total = F.aggregate("px", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return back.select("vec_id", F.size("px").cast("bigint").alias("pixels"), F.round(total / F.size("px"), 6).alias("mean"))
