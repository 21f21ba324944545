import random
import time

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from framepair.operators import sync
from framepair.operators.sync import SyncSpec
from framepair.plans.extract import extract_pairs
from framepair.plans.translate import LinearModel
from framepair.functions.norm import ThermalNorm
from framepair.streaming import inorder, pairing, runs

from test_sync import streams

SECOND = 1_000_000


def write_in_slices(spark, path, data, schema, slices):
    """Append time slices one after another, so that each is its own micro-batch."""
    step = len(data) // slices + 1
    for i in range(0, len(data), step):
        spark.createDataFrame(data[i : i + step], schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # file sources order by modification time


@pytest.fixture(scope="module")
def sliced(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("streams"))
    a, b = streams(2, n=80, span=2000)
    schema = "rec long, t_us long, id long"
    for name, s in (("rgb", a), ("ir", b)):
        data = [(0, t * SECOND, i) for t, i, _ in s] + [(1, 100_000 * SECOND, -1)]
        write_in_slices(spark, f"{root}/{name}", data, schema, 3)
    return root, schema, a, b


def test_paired_streams_equal_batch(spark, sliced):
    root, schema, a, b = sliced
    spec = SyncSpec(period_us=40 * SECOND, tol_us=30 * SECOND, offset_us=2 * SECOND)
    side = lambda n: runs.frame_stream(spark, f"{root}/{n}", schema, 1)
    got = runs.drain(pairing.pair_streams(side("rgb"), side("ir"), ["rec"], spec, "10 minutes")).where("rec = 0")
    batch = lambda s: spark.createDataFrame([(0, t * SECOND, i) for t, i, _ in s], schema)
    want = sync.nearest_on_grid(batch(a), batch(b), ["rec"], spec)
    assert rows(got) == rows(want.select(*got.columns)) and got.count() > 20


def test_equal_times_and_duration_equal_batch(spark, tmp_path):
    schema = "rec long, t_us long, id long"
    times = [5, 5, 5, 20, 20, 38, 38, 40, 40, 62, 79, 81, 81, 120, 121, 121, 160]
    base = 1_000_000
    data = [(0, (base + t) * SECOND, i) for i, t in enumerate(times)]
    spec = SyncSpec(period_us=40 * SECOND, tol_us=15 * SECOND, duration_us=130 * SECOND, start_us=base * SECOND)
    spark.createDataFrame([*data, (1, (base + 100_000) * SECOND, -1)], schema).coalesce(1).write.parquet(str(tmp_path / "s"))
    side = lambda: runs.frame_stream(spark, str(tmp_path / "s"), schema, 1)
    got = runs.drain(pairing.pair_streams(side(), side(), ["rec"], spec, "1 minute")).where("rec = 0")
    batch = spark.createDataFrame(data, schema)
    want = sync.nearest_on_grid(batch, batch, ["rec"], spec)
    assert rows(got) == rows(want.select(*got.columns)) and got.count() == 4


LEVELS = [1.0, 1.01, 1.02, 9.0, 9.01, 3.0, 3.01, 3.02, 8.0]
STATIC = [False, True, True, False, True, False, True, True, False]


def test_frozen_frames_are_found_in_event_time(spark, tmp_path):
    """Rows of two recordings in any order, over several triggers, cells of a few rows."""
    r = random.Random(1)
    data = [(rec, k, (1000 + k) * SECOND, v + (rec or 0)) for k, v in enumerate(LEVELS) for rec in (1, 2, None)]
    r.shuffle(data)
    data.append((3, 0, 100_000 * SECOND, 0.0))
    schema = "rec long, id long, t_us long, level double"
    write_in_slices(spark, str(tmp_path / "in"), data, schema, 3)
    s = runs.frame_stream(spark, str(tmp_path / "in"), schema, 1)
    got = runs.drain(pairing.mark_static_stream(s, ["rec"], 0.05, "30 seconds", 2 * SECOND))
    for rec in (1, 2, None):
        assert [x.static for x in got.where(F.col("rec").eqNullSafe(rec)).orderBy("id").collect()] == STATIC
    assert got.count() == 27  # the closing row's cell stays open


def test_equal_times_and_missing_levels(spark, tmp_path):
    schema = "rec long, id long, t_us long, level double"
    data = [(1, 2, 5 * SECOND, 1.0), (1, 1, 5 * SECOND, 4.0), (1, 3, 6 * SECOND, None), (1, 4, 7 * SECOND, 1.0), (1, 5, 8 * SECOND, 1.0), (2, 0, 10**6 * SECOND, 0.0)]
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = runs.drain(pairing.mark_static_stream(runs.frame_stream(spark, str(tmp_path / "in"), schema), ["rec"], 0.5, "1 second", 3 * SECOND))
    assert rows(got, "id", "static") == [(1, False), (2, False), (3, False), (4, False), (5, True)]


def test_recordings_of_a_bucket_are_folded_together(spark, tmp_path):
    """One fold for many recordings, whose keys stay exact beside recordings without one."""
    schema, big = "rec long, id long, t_us long", (1 << 60) + 1
    data = [(None if r == 99 else big + r, i, (10 * i + r % 10 + 1) * SECOND) for i in range(6) for r in range(100)] + [(None, -1, 10**10 * SECOND // 1000)]
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "in"))

    def fold(found, rec, state):
        n = state["n"].fillna(0).to_numpy(int)
        first, last = inorder.ends(rec)
        upto = np.arange(len(rec)) - np.flatnonzero(first)[rec] + 1 + n[rec]
        return found.assign(at=upto, together=len(state)), pd.DataFrame({"n": upto[last]})

    stream = inorder.with_watermark(runs.frame_stream(spark, str(tmp_path / "in"), schema), "t_us", "1 second")
    got = runs.drain(inorder.fold_in_order(stream, ["rec"], ["t_us", "id"], fold, "n bigint", f"{schema}, at bigint, together bigint", 20 * SECOND, buckets=4))
    kept = [r for r in got.collect() if r.id >= 0]
    assert sorted(((r.rec or 0), r.id, r.at) for r in kept) == sorted((k or 0, i, i + 1) for k, i, _ in data if i >= 0)
    assert max(r.together for r in kept) > 10


def test_quota_names_and_static_filter_equal_batch(spark, sliced):
    root, schema, a, b = sliced
    spec = SyncSpec(period_us=40 * SECOND, tol_us=30 * SECOND, offset_us=2 * SECOND, max_pairs=7, static_below=0.5)
    level = (F.col("id") % 3).cast("double")
    side = lambda n: runs.frame_stream(spark, f"{root}/{n}", schema, 1)
    got = runs.drain(pairing.extract_stream(side("rgb"), side("ir").withColumn("level", level), ["rec"], spec, "10 minutes", "level", 100 * SECOND)).where("rec = 0")
    batch = lambda s: spark.createDataFrame([(0, t * SECOND, i) for t, i, _ in s], schema)
    want = extract_pairs(batch(a), batch(b).withColumn("level", level), ["rec"], spec, level="level").pairs
    assert rows(got) == rows(want.select(*got.columns)) and got.count() == 7
    with pytest.raises(ValueError):
        pairing.pair_streams(side("rgb"), side("ir"), ["rec"], spec, "10 minutes")


def test_a_restarted_run_goes_on_counting(spark, tmp_path):
    """State, numbers and open cells are in the checkpoint."""
    schema = "rec long, t_us long, id long"
    spec = SyncSpec(period_us=10 * SECOND, tol_us=4 * SECOND, max_pairs=5, start_us=1000 * SECOND)
    path = {n: str(tmp_path / n) for n in ("rgb", "ir", "out", "ckpt")}
    for lo, hi in ((0, 4), (4, 9), (9, 40)):
        for n in ("rgb", "ir"):
            spark.createDataFrame([(0, (1000 + 10 * t) * SECOND, t) for t in range(lo, hi)], schema).coalesce(1).write.mode("append").parquet(path[n])
        side = lambda n: runs.frame_stream(spark, path[n], schema)
        runs.catch_up(pairing.extract_stream(side("rgb"), side("ir"), ["rec"], spec, "1 second", cell_us=30 * SECOND), path["out"], path["ckpt"])
    assert rows(spark.read.parquet(path["out"]), "n", "name", "rgb_id") == [(i, f"{i:06d}.png", i) for i in range(5)]


def test_folder_translation_resumes(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "name string, height int, width int, px array<int>"
    frame = lambda n: (n, 1, 2, [10, 20, 30, 40, 50, 60])
    model = LinearModel([1.0, 0.0, 0.0], 0.0)
    run = lambda: runs.translate_folder(
        runs.frame_stream(spark, path, schema), lambda: model, ThermalNorm(), str(tmp_path / "out"), str(tmp_path / "ckpt")
    )
    spark.createDataFrame([frame("a"), frame("b")], schema).write.parquet(path)
    run()
    spark.createDataFrame([frame("c")], schema).write.mode("append").parquet(path)
    run()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert rows(out, "name") == [("a",), ("b",), ("c",)]
    assert out.first().px == [pytest.approx(30 / 127.5 - 1), pytest.approx(60 / 127.5 - 1)]


@pytest.mark.parametrize("period, tol, cell, duration", [(7, 15, 20, None), (7, 15, 9, 200), (3, 20, 1000, None), (30, 4, 10, None)])
def test_resampling_keeps_frames_and_equals_every_pair(spark, tmp_path, period, tol, cell, duration):
    """Frames in any order, over several triggers, with equal times, distances and missing ids; cells shorter and longer than the tolerance."""
    r = random.Random(period)
    data = [(rec, (1000 + r.randrange(0, 300)) * SECOND + r.choice([0, 0, 1]), r.choice([i, i, None])) for i in range(60) for rec in (1, 2, None)]
    data = list({(rec, t, i) for rec, t, i in data})
    r.shuffle(data)
    spec = SyncSpec(period_us=period * SECOND, tol_us=tol * SECOND, start_us=1010 * SECOND, duration_us=duration and duration * SECOND)
    want = {}
    for rec, t, i in data:
        for k in range(400 // period):
            gap = t - spec.start_us - k * spec.period_us
            if abs(gap) <= spec.tolerance and (duration is None or k * period <= duration):
                first = (-1 if i is None else i) * (1 if gap >= 0 else -1)
                want.setdefault((rec, k), []).append((abs(gap), t, first, i))
    schema, path = "rec long, t_us long, id long", str(tmp_path / "in")
    write_in_slices(spark, path, [*data, (3, (1010 + 999_600) * SECOND, 0)], schema, 3)
    got = runs.drain(pairing.resample(runs.frame_stream(spark, path, schema, 1), ["rec"], spec, "1000 seconds", cell * SECOND)).collect()
    assert len(got) == len(want) > 20
    assert {(x.rec, x.k): (x.frame_t, x.id) for x in got} == {at: (min(c)[1], min(c)[3]) for at, c in want.items()}
    assert all(x.t == spec.start_us + x.k * spec.period_us for x in got)


def test_a_frame_waits_once_in_a_cell_however_many_samples_it_serves(spark):
    spec = SyncSpec(period_us=SECOND, tol_us=100 * SECOND)
    frames = spark.range(5000).select(F.lit(1).alias("rec"), F.col("id"), (F.col("id") * SECOND).alias("t_us"))
    assert pairing._in_cells(frames, ["rec"], spec, "1 second", 2000 * SECOND).count() < 1.2 * 5000


def test_a_restarted_resampling_goes_on(spark, tmp_path):
    schema, path = "rec long, t_us long, id long", {n: str(tmp_path / n) for n in ("in", "out", "ckpt")}
    spec = SyncSpec(period_us=10 * SECOND, tol_us=25 * SECOND)
    for lo, hi in ((0, 4), (4, 9), (9, 40), (5000, 5001)):
        spark.createDataFrame([(int(t == 5000), 10 * t * SECOND, t) for t in range(lo, hi)], schema).coalesce(1).write.mode("append").parquet(path["in"])
        runs.catch_up(pairing.resample(runs.frame_stream(spark, path["in"], schema), ["rec"], spec, "1 second", 30 * SECOND), path["out"], path["ckpt"])
    assert rows(spark.read.parquet(path["out"]).where("rec = 0"), "k", "id") == [(k, min(k, 39)) for k in range(42)]
