import random
from dataclasses import replace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from framepair.operators import profile, sync
from framepair.operators.sync import SyncSpec
from framepair.plans.extract import extract_pairs


def sweep(rgb, ir, spec):
    """The rule by hand: walk the samples and take the nearest frame of each stream."""
    ir = [(t - spec.offset_us, i, v) for t, i, v in ir]
    kept, tol, static, prev, k = [], 0, 0, None, 0
    stop = min(max(t for t, *_ in rgb), max(t for t, *_ in ir)) + spec.tolerance
    while True:
        s = spec.start_us + k * spec.period_us
        if s > stop or (spec.duration_us is not None and s > spec.start_us + spec.duration_us):
            break
        best = lambda fs: min(fs, key=lambda f: (abs(f[0] - s), f[0], f[1]))
        a, b = best(rgb), best(ir)
        if max(abs(a[0] - s), abs(b[0] - s)) > spec.tolerance:
            tol += 1
        else:
            if spec.static_below is not None and prev is not None and abs(b[2] - prev) < spec.static_below:
                static += 1
            else:
                kept.append((len(kept), k, a[1], b[1]))
            prev = b[2]
            if spec.max_pairs and len(kept) == spec.max_pairs:
                break
        k += 1
    return kept, tol, static


def streams(seed, n=120, span=3000):
    rng = random.Random(seed)
    make = lambda: [(t, i, rng.choice([1.0, 1.01, 2.0, 5.0])) for i, t in enumerate(sorted(rng.sample(range(span), n)))]
    return make(), make()


def frame_tables(spark, per_rec):
    cols = "rec long, t_us long, id long, level double"
    side = lambda k: spark.createDataFrame([(rec, t, i, v) for rec, s in per_rec.items() for t, i, v in s[k]], cols)
    return side(0), side(1)


@pytest.mark.parametrize("spec", [
    SyncSpec(period_us=40, tol_us=20),
    SyncSpec(period_us=40, tol_us=11, offset_us=7, start_us=100, duration_us=1500),
    SyncSpec(period_us=50, tol_us=130, static_below=0.05),
    SyncSpec(period_us=30, tol_us=15, static_below=0.05, max_pairs=9),
    SyncSpec(period_us=2, tol_us=90, start_us=500, duration_us=400),
])
def test_extraction_follows_the_rule(spark, spec):
    per_rec = {r: streams(r) for r in range(3)}
    rgb, ir = frame_tables(spark, per_rec)
    out = extract_pairs(rgb.drop("level"), ir, ["rec"], spec, level="level")
    pairs, counters = rows(out.pairs, "rec", "n", "k", "rgb_id", "ir_id"), rows(out.counters, "rec", "kept", "dropped_tol", "dropped_static")
    for r, (a, b) in per_rec.items():
        kept, tol, static = sweep(a, b, spec)
        assert [p[1:] for p in pairs if p[0] == r] == kept
        assert counters[r] == (r, len(kept), tol, static)


@pytest.mark.parametrize("tol", [0.5, 60, 400])
def test_both_routes_agree(spark, tol):
    rgb, ir = frame_tables(spark, {0: streams(5), 1: streams(6)})
    spec = SyncSpec(period_us=25, tol_us=int(tol * 2), offset_us=-3)
    near = [rows(sync.nearest_on_grid(rgb, ir, ["rec"], replace(spec, reach=reach))) for reach in (0, 10**6)]
    assert near[0] == near[1] and (len(near[0]) > 50 or tol < 1)


def test_ties_take_the_earlier_frame(spark):
    rgb = spark.createDataFrame([(0, 90, 1), (0, 110, 2)], "rec long, t_us long, id long")
    spec = SyncSpec(period_us=100, tol_us=10, start_us=100)
    assert rows(sync.nearest_on_grid(rgb, rgb, ["rec"], spec), "rgb_id", "rgb_t", "ir_id") == [(1, 90, 1)]


def test_smoke_recording(spark):
    listing = spark.createDataFrame([(f"{i:06d}.png",) for i in range(90)], "name string")
    frames = sync.frame_times(listing, [], ["name"], 15.0).withColumn("id", F.col("idx"))
    spec = SyncSpec(period_us=200_000, ir_fps=15.0)
    assert spec.tolerance == 33333
    out = extract_pairs(frames, frames, [], spec)
    assert out.pairs.count() == 30
    assert [r.name for r in out.pairs.orderBy("n").limit(2).collect()] == ["000000.png", "000001.png"]


def test_slow_drift_is_dropped(spark):
    """Each level is compared with the previous sample, not with the last kept one."""
    level = lambda i: float(f"{i * 0.04:.2f}")
    ir = spark.createDataFrame([(0, i * 10, i, level(i)) for i in range(10)], "rec long, t_us long, id long, level double")
    out = extract_pairs(ir.drop("level"), ir, ["rec"], SyncSpec(period_us=10, tol_us=1, static_below=0.05), level="level")
    assert out.pairs.count() == 1


def test_static_by_pixels(spark):
    px = lambda i: [float(i // 2), 1.0]
    ir = spark.createDataFrame([(0, i * 10, i) for i in range(6)], "rec long, t_us long, id long")
    pixels = spark.createDataFrame([(0, i, px(i)) for i in range(6)], "rec long, id long, px array<double>")
    out = extract_pairs(ir, ir, ["rec"], SyncSpec(period_us=10, tol_us=1, static_below=0.05), pixels=pixels)
    assert rows(out.pairs, "n", "ir_id") == [(0, 0), (1, 2), (2, 4)]
    assert rows(out.counters, "dropped_static") == [(3,)]


def test_tolerance_is_required():
    with pytest.raises(ValueError):
        SyncSpec(period_us=10).tolerance


def test_irregular_nearest(spark):
    a, b = streams(8)
    left = spark.createDataFrame([(0, t, i) for t, i, _ in a], "rec long, t_us long, id long")
    right = spark.createDataFrame([(0, t, i) for t, i, _ in b], "rec long, t_us long, id long")
    got = {r.id: r.match_id for r in sync.nearest(left, right, ["rec"], 12).collect()}
    for t, i, _ in a:
        m = min(b, key=lambda f: (abs(f[0] - t), f[0]))
        assert got.get(i) == (m[1] if abs(m[0] - t) <= 12 else None)


def test_clock_offset(spark):
    p = spark.createDataFrame([("day", 583255841), ("day", 1294760045), ("ir", 582362509), ("ir", 1294769600)], "stream string, t_us long")
    r = profile.clock_offset(p, "stream", "ir", "day").first()
    assert r.offset_us == 893332 and r.end_offset_us == -9555


def test_stream_timing(spark):
    p = spark.createDataFrame([("a", t, i) for i, t in enumerate([0, 10, 20, 100])], "s string, t_us long, id long")
    r = profile.stream_timing(p, ["s"], 50).first()
    assert (r.frames, r.span_us, r.delta_min_us, r.delta_max_us, r.gaps) == (4, 100, 10, 80, 1) and r.fps == pytest.approx(30000)
