"""Automatic alignment of frames that two cameras take of one scene."""

import numpy as np
import pytest
from conftest import SF

from framepair.catalog import QUERIES
from framepair.functions import alignment
from framepair.operators import align
from framepair.plans import register

PAIRS = "rec_id string, frame long, rgb_px array<double>, rgb_h int, rgb_w int, ir_px array<double>, ir_h int, ir_w int"


def scene(seed, h=240, w=320):
    r = np.random.default_rng(seed)
    return [(r.uniform(-w, 2 * w), r.uniform(-h, 2 * h), r.uniform(w / 30, w / 6), r.uniform(h / 30, h / 6), r.uniform(0, 255), r.random() < 0.5) for _ in range(160)]


def seen(shapes, h, w, back=np.eye(3)):
    """What a camera sees whose pixels lie at ``back @ (x, y, 1)`` of the scene."""
    v, u = np.mgrid[0:h, 0:w].astype(float)
    x, y = back[0, 0] * u + back[0, 1] * v + back[0, 2], back[1, 0] * u + back[1, 1] * v + back[1, 2]
    soft, image = 0.7 * np.sqrt(np.linalg.det(back[:2, :2])), 60 + 0.4 * y
    for cx, cy, a, b, value, box in shapes:
        far = np.maximum(abs(x - cx) - a, abs(y - cy) - b) if box else (np.hypot((x - cx) / a, (y - cy) / b) - 1) * min(a, b)
        k = 1 / (1 + np.exp(np.clip(far / soft, -30, 30)))
        image = image * (1 - k) + value * k
    return image


def pair(rec, frame, true, seed, hw=(240, 320), ir_hw=(120, 160)):
    shapes, r = scene(seed), np.random.default_rng(seed)
    ir = 255 - 0.6 * seen(shapes, *ir_hw, np.linalg.inv(true)) + r.normal(0, 2, ir_hw)
    return (rec, frame, seen(shapes, *hw).ravel().tolist(), *hw, ir.ravel().tolist(), *ir_hw)


def error(found, true, hw=(240, 320), ir_hw=(120, 160)):
    """Mean distance over the part of the colour frame that the infrared one shows, in infrared pixels."""
    v, u = np.mgrid[0 : hw[0] : 9j, 0 : hw[1] : 9j]
    p = np.stack([u.ravel(), v.ravel(), np.ones(81)])
    q = true @ p
    inside = (q[0] >= 0) & (q[1] >= 0) & (q[0] < ir_hw[1]) & (q[1] < ir_hw[0])
    return np.hypot(*(np.array(found) @ p - q)[:2, inside]).mean()


def turned(scale, angle, dx, dy):
    return alignment.about_centres((240, 320), (120, 160), scale, angle, (dx * 160, dy * 120))


TRUE = {
    "offset": np.array([[0.5, 0, -8], [0, 0.5, -6], [0, 0, 1]]),  # the misalignment of a real rig
    "quarter": turned(1, 0, 0.25, -0.25),
    "wide": turned(0.6, 3, 0.1, 0.1),
    "near": turned(1.9, -5, 0.05, -0.1),
    "turned": turned(1, 7, 0.2, 0.1),
}


def test_placements_are_recovered(spark):
    data = [pair(rec, frame, true, seed + 10 * frame) for seed, (rec, true) in enumerate(TRUE.items()) for frame in (0, 1)]
    # A recording whose frame is off by more than is searched, one without any structure, one with tiny frames.
    data += [pair("beyond", 0, turned(1, 0, 0.55, 0), 3), ("flat", 0, [7.0] * 4800, 60, 80, [7.0] * 4800, 60, 80), ("tiny", 0, [1.0] * 16, 4, 4, [1.0] * 16, 4, 4)]
    found = {r.rec_id: r for r in align.align_recordings(spark.createDataFrame(data, PAIRS), ["rec_id"]).collect()}
    assert set(found) == {*TRUE, "beyond", "flat", "tiny"}
    for rec, true in TRUE.items():
        assert found[rec].reason is None and error(found[rec].H, true) < 0.5 and found[rec].cc > 0.9, rec
    assert found["beyond"].H is None and found["beyond"].reason == align.EDGE
    for rec in ("flat", "tiny"):
        assert found[rec].H is None and found[rec].reason == align.NOTHING


def test_the_best_frame_of_a_recording_wins(spark):
    good, bad = pair("a", 4, TRUE["offset"], 1), list(pair("a", 2, TRUE["offset"], 1))
    bad[5] = np.random.default_rng(0).uniform(0, 255, 120 * 160).tolist()
    r = align.align_recordings(spark.createDataFrame([good, tuple(bad), ("b", 0, None, None, None, None, None, None)], PAIRS), ["rec_id"])
    got = {x.rec_id: x for x in r.collect()}
    assert got["a"].frame == 4 and error(got["a"].H, TRUE["offset"]) < 0.5
    assert got["b"].reason == align.NOTHING


def test_registration_writes_no_wrong_placement(spark):
    cols = "rec_id string, name string, idx long, height int, width int, channels int, px array<double>"
    make = lambda take: spark.createDataFrame([(p[0], f"{i:06d}.png", i, *take(p)) for p in (pair("far", 0, turned(1, 0, 0.55, 0), 3), pair("fit", 0, TRUE["offset"], 2)) for i in range(2)], cols)
    rgb, ir = make(lambda p: (240, 320, 1, p[2])), make(lambda p: (120, 160, 1, p[5]))
    out = register.register(rgb, ir, mode="search", val_frac=0.5, chunk=1)
    assert {r.rec_id for r in out.aligned.collect()} == {"fit"}
    record = out.records.collect()
    assert [r.rec_id for r in record] == ["fit"] and error(record[0].H, TRUE["offset"]) < 0.5 and record[0].ecc_cc > 0.9
    assert {(r.rec_id, r.reason) for r in out.rejects.collect()} == {("far", align.EDGE)}


def test_an_empty_table_has_no_placements(spark):
    assert align.align_recordings(spark.createDataFrame([], PAIRS), ["rec_id"]).collect() == []


@pytest.mark.parametrize("back", [np.eye(3), np.array([[1, 0, 0.5], [0, 1, -0.25], [0, 0, 1.0]])])
def test_samples_between_pixels_are_linear(back):
    v, u = np.mgrid[0:12, 0:14].astype(float)
    got, inside = alignment.sampled((3 * u + 2 * v)[None], back, 12, 14)
    want = 3 * (u + back[0, 2]) + 2 * (v + back[1, 2])
    assert inside.sum() > 30 and np.allclose(got[0][inside], want[inside])


def test_only_views_of_calibration_frames_are_made(spark, monkeypatch):
    met = []
    monkeypatch.setattr(align, "align_recordings", lambda pairs, *a: met.append(pairs) or _stop())
    with pytest.raises(InterruptedError):
        QUERIES["registration_by_search"](spark, SF)
    plan = met[0]._jdf.queryExecution().executedPlan().toString()
    # Below the last kernel the frames have met the names of calibration frames.
    assert "LeftSemi" in plan.rsplit("ArrowEvalPython", 1)[1]


def _stop():
    raise InterruptedError
