"""Queries over event times: synchronisation, windows, stream timing."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from framepair.catalog.base import micros, query, r6, table
from framepair.operators import ordered, pairing, profile, sync
from framepair.operators.sync import SyncSpec
from framepair.plans.extract import extract_pairs
from framepair.sources.tables import log_epochs, log_iterations
from framepair.functions.sql import lr_at

HOUR = 3_600_000_000
DAY0 = 1_704_067_200_000_000  # 2024-01-01 in microseconds
SPEC = SyncSpec(period_us=HOUR, tol_us=4 * HOUR, offset_us=90_000_000, start_us=DAY0)
QUOTA = SyncSpec(
    period_us=HOUR // 2, tol_us=4 * HOUR, offset_us=90_000_000, start_us=DAY0 + 12 * HOUR, duration_us=20 * 24 * HOUR, max_pairs=8,
    static_below=3.0,
)


def stream(spark, sf, kind):
    e = table(spark, sf, "events").where(F.col("event_type") == kind)
    return e.select("user_id", F.col("event_id").alias("id"), micros("ts").alias("t_us"), "value")


def _sync_sql(spec: SyncSpec) -> str:
    """Grid pairing by brute force: every frame against every sample in reach."""
    p, tol, s, off = spec.period_us, spec.tolerance, spec.start_us, spec.offset_us
    stop = f"least(max(t) FILTER (m = 0), max(t) FILTER (m = 1)) + {tol}"
    if spec.duration_us is not None:
        stop = f"least({stop}, {s + spec.duration_us})"
    return f"""
fr AS (SELECT user_id, event_id AS id, epoch_us(ts) - CASE WHEN event_type = 'click' THEN {off} ELSE 0 END AS t,
  CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS m, value FROM events WHERE event_type IN ('view', 'click')),
bounds AS (SELECT user_id, floor(({stop} - {s}) / {p}e0)::BIGINT AS last FROM fr GROUP BY 1
  HAVING count(*) FILTER (m = 0) > 0 AND count(*) FILTER (m = 1) > 0),
grid AS (SELECT user_id, unnest(range(last + 1)) AS k FROM bounds),
near AS (SELECT g.user_id, g.k, f.m, f.id, f.t, f.value, row_number() OVER (PARTITION BY g.user_id, g.k, f.m
    ORDER BY abs(f.t - ({s} + g.k * {p})), f.t, f.id) AS rn
  FROM grid g JOIN fr f ON f.user_id = g.user_id AND abs(f.t - ({s} + g.k * {p})) <= {tol}),
acc AS (SELECT user_id, k, {s} + k * {p} AS t, max(id) FILTER (m = 0) AS rgb_id, max(t) FILTER (m = 0) AS rgb_t,
  max(id) FILTER (m = 1) AS ir_id, max(t) FILTER (m = 1) AS ir_t, max(value) FILTER (m = 1) AS value
  FROM near WHERE rn = 1 GROUP BY user_id, k HAVING count(*) = 2)"""


@query("nearest_on_grid", f"WITH {_sync_sql(SPEC)} SELECT user_id, k, t, rgb_id, rgb_t, ir_id, ir_t FROM acc")
def nearest_on_grid(spark, sf):
    return sync.nearest_on_grid(stream(spark, sf, "view"), stream(spark, sf, "click"), ["user_id"], SPEC)


_EXTRACT = _sync_sql(QUOTA) + f""",
lagged AS (SELECT *, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY k)) < {QUOTA.static_below}, false) AS static FROM acc),
num AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS n FROM lagged WHERE NOT static),
ends AS (SELECT user_id, k AS e FROM num WHERE n = {QUOTA.max_pairs} - 1)"""


@query("extract_pairs", f"""WITH {_EXTRACT}
SELECT user_id, n, lpad(n::VARCHAR, 6, '0') || '.png' AS name, k, t, rgb_id, rgb_t, ir_id, ir_t FROM num WHERE n < {QUOTA.max_pairs}""")
def extract(spark, sf):
    return extract_pairs(stream(spark, sf, "view"), stream(spark, sf, "click"), ["user_id"], QUOTA, level="value").pairs


@query("extract_counters", f"""WITH {_EXTRACT},
c AS (SELECT b.user_id, coalesce(e + 1, greatest(last + 1, 0)) AS n_grid, count(l.k) FILTER (NOT static) AS kept, count(l.k) FILTER (static) AS dropped_static
  FROM bounds b LEFT JOIN ends USING (user_id) LEFT JOIN lagged l ON l.user_id = b.user_id AND (e IS NULL OR l.k <= e)
  GROUP BY b.user_id, e, last)
SELECT user_id, kept, dropped_static, n_grid - kept - dropped_static AS dropped_tol FROM c""")
def extract_counters(spark, sf):
    return extract_pairs(stream(spark, sf, "view"), stream(spark, sf, "click"), ["user_id"], QUOTA, level="value").counters


# The same job without the caps: whole recordings, every pair.
WHOLE = replace(QUOTA, duration_us=None, max_pairs=0)
_WHOLE = _sync_sql(WHOLE) + f""",
lagged AS (SELECT *, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY k)) < {WHOLE.static_below}, false) AS static FROM acc),
num AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS n FROM lagged WHERE NOT static)"""


@query("extract_all_pairs", f"""WITH {_WHOLE}
SELECT user_id, n, lpad(n::VARCHAR, 6, '0') || '.png' AS name, k, t, rgb_id, rgb_t, ir_id, ir_t FROM num""")
def extract_all(spark, sf):
    return extract_pairs(stream(spark, sf, "view"), stream(spark, sf, "click"), ["user_id"], WHOLE, level="value").pairs


@query("extract_all_counters", f"""WITH {_WHOLE},
c AS (SELECT b.user_id, greatest(last + 1, 0) AS n_grid, count(l.k) FILTER (NOT static) AS kept, count(l.k) FILTER (static) AS dropped_static
  FROM bounds b LEFT JOIN lagged l ON l.user_id = b.user_id GROUP BY b.user_id, last)
SELECT user_id, kept, dropped_static, n_grid - kept - dropped_static AS dropped_tol FROM c""")
def extract_all_counters(spark, sf):
    return extract_pairs(stream(spark, sf, "view"), stream(spark, sf, "click"), ["user_id"], WHOLE, level="value").counters


@query("nearest_irregular", """
WITH l AS (SELECT user_id, event_id AS id, epoch_us(ts) AS t FROM events WHERE event_type = 'view'),
r AS (SELECT user_id, event_id AS id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'),
m AS (SELECT l.*, r.id AS match_id, r.t AS match_t, abs(l.t - r.t) AS dt_us,
  row_number() OVER (PARTITION BY l.id ORDER BY abs(l.t - r.t), r.t, r.id) AS rn
  FROM l JOIN r ON l.user_id = r.user_id AND abs(l.t - r.t) <= 14400000000)
SELECT user_id, id, t AS t_us, match_id, match_t, dt_us FROM m WHERE rn = 1""")
def nearest_irregular(spark, sf):
    view, click = (stream(spark, sf, k).drop("value") for k in ("view", "click"))
    return sync.nearest(view, click, ["user_id"], 4 * HOUR).select("user_id", "id", "t_us", "match_id", "match_t", "dt_us")


@query("nearest_all_events", """
WITH l AS (SELECT event_id AS id, epoch_us(ts) AS t FROM events WHERE event_type = 'view'),
r AS (SELECT event_id AS id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'),
p AS (SELECT l.*, r.id AS bid, r.t AS bt FROM l ASOF LEFT JOIN r ON l.t > r.t),
n AS (SELECT p.*, r.id AS aid, r.t AS aft FROM p ASOF LEFT JOIN r ON p.t <= r.t)
SELECT id, t AS t_us, CASE WHEN aft IS NULL OR t - bt <= aft - t THEN bid ELSE aid END AS match_id,
  coalesce(least(t - bt, aft - t), t - bt, aft - t) AS dt_us FROM n
WHERE coalesce(least(t - bt, aft - t), t - bt, aft - t) <= 1800000000""")
def nearest_all_events(spark, sf):
    """One single key: every event belongs to the same recording."""
    view, click = (stream(spark, sf, k).select("id", "t_us") for k in ("view", "click"))
    return sync.nearest(view, click, [], HOUR // 2).select("id", "t_us", "match_id", "dt_us")


@query("bracketing_frames", """
WITH l AS (SELECT user_id, event_id AS id, epoch_us(ts) AS t FROM events WHERE event_type = 'view'),
r AS (SELECT user_id, event_id AS id, epoch_us(ts) AS t FROM events WHERE event_type = 'click')
SELECT l.user_id, l.id, coalesce(max(r.t) FILTER (r.t < l.t), -1) AS before_t, coalesce(min(r.t) FILTER (r.t >= l.t), -1) AS after_t
FROM l LEFT JOIN r ON l.user_id = r.user_id GROUP BY l.user_id, l.id""")
def bracketing_frames(spark, sf):
    view, click = (stream(spark, sf, k).drop("value") for k in ("view", "click"))
    at = lambda c: F.coalesce(F.col(f"{c}.t_us"), F.lit(-1)).alias(f"{c}_t")
    return sync.bracket(view, click, ["user_id"]).select("user_id", "id", at("before"), at("after"))


@query("static_frames", """
WITH s AS (SELECT event_id, event_type, value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS d FROM events)
SELECT event_id, event_type, round(coalesce(abs(d), -1), 6) AS moved, coalesce(abs(d) < 1e0, false) AS static FROM s""")
def static_frames(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", micros("ts").alias("t_us"), "value")
    seg = ordered.segment(e, ["event_type"], ["t_us", "event_id"])
    marked = sync.mark_static(seg, ["event_type"], "value", 1.0)
    moved = ordered.previous(marked, ["event_type"], ["value"])
    gap = F.coalesce(F.abs(F.col("value") - F.col("prev_value")), F.lit(-1.0))
    return moved.select("event_id", "event_type", r6(gap).alias("moved"), "static")


@query("frame_deltas", """
WITH s AS (SELECT event_type, event_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER w AS p, lead(epoch_us(ts)) OVER w AS n
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
SELECT event_type, event_id, coalesce(t - p, -1) AS delta_us, coalesce(n - t, -1) AS next_us FROM s""")
def frame_deltas(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id", micros("ts").alias("t_us"))
    seg = ordered.segment(e, ["event_type"], ["t_us", "event_id"])
    both = ordered.following(ordered.previous(seg, ["event_type"], ["t_us"]), ["event_type"], ["t_us"])
    gap = lambda a, b: F.coalesce(F.col(a) - F.col(b), F.lit(-1))
    return both.select("event_type", "event_id", gap("t_us", "prev_t_us").alias("delta_us"), gap("next_t_us", "t_us").alias("next_us"))


@query("stream_timing", """
WITH s AS (SELECT event_type, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS d FROM events)
SELECT event_type, count(*) AS frames, max(t) - min(t) AS span_us, min(d) AS delta_min_us, max(d) AS delta_max_us,
  round(avg(d), 3) AS delta_mean_us, count(*) FILTER (d > 3600000000) AS gaps, round((count(*) - 1) * 1e6 / (max(t) - min(t)), 9) AS fps
FROM s GROUP BY 1""")
def stream_timing(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.col("event_id").alias("id"), micros("ts").alias("t_us"))
    out = profile.stream_timing(e, ["event_type"], HOUR)
    return out.withColumn("delta_mean_us", F.round("delta_mean_us", 3)).withColumn("fps", F.round("fps", 9))


@query("clock_offset", """
WITH s AS (SELECT user_id, event_type, epoch_us(ts) AS t FROM events WHERE event_type IN ('view', 'click')),
f AS (SELECT user_id, min(t) FILTER (event_type = 'view') - min(t) FILTER (event_type = 'click') AS o,
  max(t) FILTER (event_type = 'view') - max(t) FILTER (event_type = 'click') AS e FROM s GROUP BY 1)
SELECT user_id, o AS offset_us, e AS end_offset_us, e - o AS drift_us FROM f WHERE o IS NOT NULL""")
def clock_offset(spark, sf):
    e = table(spark, sf, "events").where(F.col("event_type").isin("view", "click")).select("user_id", "event_type", micros("ts").alias("t_us"))
    return profile.clock_offset(e, "event_type", "click", "view", ["user_id"]).where("offset_us is not null")


@query("frame_times", """
SELECT doc_id, source, row_number() OVER w - 1 AS idx, round_even((row_number() OVER w - 1) * (1e6 / 29.97e0), 0)::BIGINT AS t_us
FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)""")
def frame_times(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return sync.frame_times(d, ["source"], ["doc_id"], 29.97).select("doc_id", "source", "idx", "t_us")


@query("size_at_first", """
SELECT conv_id, arg_min(length(text), turn)::BIGINT AS height, arg_min(length(role), turn)::BIGINT AS width FROM conversations GROUP BY 1""")
def size_at_first(spark, sf):
    c = table(spark, sf, "conversations")
    f = c.select("conv_id", F.col("turn").alias("idx"), F.length("text").cast("bigint").alias("height"), F.length("role").cast("bigint").alias("width"))
    return pairing.size_at_first(f, ["conv_id"])


# -- training log ---------------------------------------------------------
def _log_lines(spark, sf):
    """Log text derived from orders: iteration lines, epoch lines and noise."""
    o = table(spark, sf, "orders")
    e, it = F.col("o_orderkey") % 60, F.floor(F.col("o_orderkey") / 60)
    price = F.col("o_totalprice")
    num = lambda c: F.format_string("%.3f", c)
    # Padding to a width, not lpad, which cuts off longer numbers.
    step = F.concat(
        F.format_string("[e%03d i%05d] D=", e, it), num(F.floor(price % 1000) / 1000.0),
        F.lit(" G_gan="), num(F.floor(price % 777) / 1000.0), F.lit(" G_L1="), num(F.floor(price % 50000) / 1000.0),
    )
    epoch = F.concat(F.format_string("[e%03d] val L1 = ", e), num(F.floor(price % 300) / 1000.0), F.lit(" | "), num(F.floor(price % 999) / 4.0), F.lit("s"))
    status = F.col("o_orderstatus")
    line = F.when(status == "P", F.lit("saved checkpoint")).when((status == "F") & (it == 0), epoch).otherwise(step)
    return o.select("o_orderkey", line.alias("value"))


_LOG = """
o AS (SELECT o_orderkey % 60 AS epoch, o_orderkey // 60 AS it, o_orderstatus AS s, o_totalprice AS p FROM orders),
its AS (SELECT epoch, it, floor(p % 1000) / 1000e0 AS d, floor(p % 777) / 1000e0 AS g, floor(p % 50000) / 1000e0 AS l1 FROM o
  WHERE s <> 'P' AND NOT (s = 'F' AND it = 0)),
eps AS (SELECT epoch, floor(p % 300) / 1000e0 AS val_l1, floor(p % 999) / 4e0 AS seconds FROM o WHERE s = 'F' AND it = 0)"""


@query("training_curves", f"""WITH {_LOG},
per AS (SELECT epoch, count(*) AS rows, max(epoch * 916 + it) AS last_step, avg(d) AS d, avg(g) AS g_gan, avg(l1) / 100e0 AS l1 FROM its GROUP BY 1)
SELECT epoch::BIGINT AS epoch, coalesce(rows, 0) AS rows, coalesce(last_step, -1)::BIGINT AS last_step, round(d, 6) AS d, round(g_gan, 6) AS g_gan, round(l1, 6) AS l1,
  round(coalesce(val_l1, -1), 6) AS val_l1, round(coalesce(round_even(seconds * 1000, 0) / 1000, -1), 2) AS seconds,
  round(greatest(0e0, 1e0 - greatest(0, epoch + 1 - 40) / 20e0), 6) AS lr
FROM per FULL JOIN eps USING (epoch)""")
def training_curves(spark, sf):
    lines = _log_lines(spark, sf)
    c = profile.training_curves(log_iterations(lines), log_epochs(lines), 916)
    return c.select(
        F.col("epoch").cast("bigint").alias("epoch"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("last_step", F.lit(-1)).cast("bigint").alias("last_step"),
        r6("d").alias("d"), r6("g_gan").alias("g_gan"), r6("l1").alias("l1"), r6(F.coalesce("val_l1", F.lit(-1.0))).alias("val_l1"),
        F.round(F.coalesce("seconds", F.lit(-1.0)), 2).alias("seconds"), r6(lr_at(F.col("epoch"), 40, 20, 1.0)).alias("lr"),
    )
