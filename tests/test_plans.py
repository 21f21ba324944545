import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from framepair.functions.norm import ThermalNorm
from framepair.operators import calibrate
from framepair.plans import evaluate, manifest, register, samples, sessions, translate, unpaired
from framepair.plans.translate import LinearModel
from framepair.sources import commits

REL8 = ThermalNorm()
RNG = np.random.default_rng(9)
FRAME = "name string, height int, width int, px array<int>"


# -- sessions -------------------------------------------------------------
def listing(spark, entries):
    return spark.createDataFrame([("/r/" + p, h, w) for p, h, w in entries], "path string, height int, width int")


def test_session_plan(spark):
    e = [(f"s1/RGB-1/{i}.png", 10, 10) for i in (2, 10, 1, 3, 4, 5)]
    e += [("s1/NIR-1/1.png", 14, 10), ("s1/NIR-1/2.png", 15, 10), ("s1/NIR-1/10.png", 10, 10), ("s1/NIR-1/4.png", None, None), ("s1/NIR-1/5.png", 8, 9)]
    e += [("s2/RGB/a.png", 10, 10), ("s2/NIR/a.png", 10, 10)]
    p = sessions.plan_sessions(listing(spark, e), val_sessions=["s2"])
    assert rows(p.pairs, "out_name", "file", "split") == [
        ("s1_1_000000.png", "1.png", "train"), ("s1_1_000004.png", "5.png", "train"), ("s1_1_000005.png", "10.png", "train"), ("s2_000000.png", "a.png", "val"),
    ]
    assert rows(p.rejects, "text") == [
        ("s1/1/2.png: size mismatch rgb(10, 10) ir(15, 10)",), ("s1/1/3.png: no IR twin",), ("s1/1/4.png: unreadable",),
    ]
    assert rows(p.counts, "session", "split", "pairs", "skipped") == [("s1", "train", 3, 3), ("s2", "val", 1, 0)]
    dry = sessions.plan_sessions(listing(spark, e).select("path"), val_sessions=["s2"])
    assert rows(dry.counts, "session", "pairs") == [("s1", 5), ("s2", 1)]


def test_duplicate_session_is_an_error(spark):
    e = [(f"{t}/s/{m}/1.png", 1, 1) for t in "xy" for m in ("RGB", "NIR")]
    with pytest.raises(ValueError, match="duplicate"):
        sessions.plan_sessions(listing(spark, e))


def test_converted_depths(spark):
    """Deep IR is stretched before cropping; colour IR, with or without alpha, is averaged."""
    cols = "id int, rgb_h int, rgb_w int, rgb_px array<int>, ir_h int, ir_w int, ir_channels int, ir_depth int, ir_px array<int>"
    rgb = list(range(12))
    df = spark.createDataFrame([
        (0, 2, 2, rgb, 2, 3, 1, 16, [1000, 1500, 9000, 2000, 3000, 5000]), (1, 2, 2, rgb, 2, 2, 3, 8, [1, 2, 6] * 4), (2, 2, 2, rgb, 2, 2, 4, 8, [1, 2, 6, 255] * 4),
    ], cols)
    got = {r.id: r for r in sessions.convert_pairs(df).collect()}
    assert got[0].ir_px == [0, 15, 31, 63] and got[0].rgb_px == rgb and (got[0].height, got[0].width) == (2, 2)
    assert got[1].ir_px == [3] * 4 and got[2].ir_px == [66] * 4


# -- scoring --------------------------------------------------------------
def score_frame(name, value, side=12):
    return (name, side, side, [int(value)] * side * side)


def test_evaluation(spark):
    schema = "file string, height int, width int, px array<int>"
    pred = spark.createDataFrame([score_frame("x.png", 9), score_frame("x_16bit.png", 51), score_frame("y.png", 102), score_frame("only.png", 1)], schema)
    truth = spark.createDataFrame([score_frame("x.png", 51), score_frame("y.png", 76.5 + 0.5, 16)], schema)
    r = evaluate.evaluate(pred, truth, REL8).first()
    assert r.n == 2 and r.L1 == pytest.approx(25 / 255 / 2) and r.RMSE == pytest.approx(25 / 255 / 2)
    per = {x.stem: x for x in evaluate.score_pairs(pred, truth, REL8).collect()}
    assert per["x"].psnr == pytest.approx(120) and per["x"].ssim == pytest.approx(1)
    deep = spark.createDataFrame([("x_16bit.png", 12, 12, 16, [51 * 257 + 200] * 144)], "file string, height int, width int, depth int, px array<int>")
    assert evaluate.evaluate(deep, truth, REL8).first().L1 == pytest.approx(0)
    with pytest.raises(Exception, match="no matching names"):
        evaluate.evaluate(pred, truth.where("false"), REL8).collect()


def test_evaluation_by_group(spark):
    pred = spark.createDataFrame([score_frame("x.png", 51), score_frame("y.png", 0), score_frame("z.png", 51)], "file string, height int, width int, px array<int>")
    truth = spark.createDataFrame([("a", *score_frame("x.png", 51)), ("a", *score_frame("y.png", 51)), (None, *score_frame("z.png", 51))], "session string, file string, height int, width int, px array<int>")
    got = {r.session: (r.n, round(r.L1, 6)) for r in evaluate.evaluate(pred, truth, REL8, by=["session"]).collect()}
    assert got == {"a": (2, 0.1), None: (1, 0.0)}


# -- calibration and registration ----------------------------------------
def test_four_points_are_enough(spark):
    pts = [(20, 20, 2, 4), (300, 20, 142, 4), (300, 220, 142, 104), (20, 220, 2, 104)]
    df = spark.createDataFrame([("a", i, *map(float, p)) for i, p in enumerate(pts)] + [("b", i, *map(float, p)) for i, p in enumerate(pts[:3])], "rec_id string, i int, x double, y double, u double, v double")
    h = calibrate.fit_homography(df, ["rec_id"], first=8).collect()
    assert [r.rec_id for r in h] == ["a"]
    assert np.allclose(h[0].H, [[0.5, 0, -8], [0, 0.5, -6], [0, 0, 1]], atol=1e-6)
    assert rows(calibrate.check_points(df, ["rec_id"]), "rec_id", "reason") == [("b", "fewer than 4 points")]


def test_perspective_with_outliers(spark):
    true = np.array([[0.5, 0.02, -8], [0.01, 0.45, -6], [1e-4, 5e-5, 1]])
    data = []
    for i in range(60):
        x, y = RNG.uniform(0, 640), RNG.uniform(0, 480)
        q = true @ [x, y, 1]
        off = RNG.uniform(20, 90, 2) if i % 3 == 0 else (0, 0)
        data.append(("a", i, *map(float, (x, y, q[0] / q[2] + off[0], q[1] / q[2] + off[1]))))
    df = spark.createDataFrame(data, "rec_id string, i int, x double, y double, u double, v double")
    h = calibrate.fit_homography(df, ["rec_id"])
    assert np.allclose(h.first().H, true, rtol=1e-4, atol=1e-6)
    r = calibrate.reprojection_report(df, h, ["rec_id"]).first()
    assert (r.n, r.inliers) == (60, 40)


def test_draws_follow_the_share_of_outliers(spark):
    """Seven of ten points of one recording are wrong, none of another, all of a third lie on a line."""
    r = np.random.default_rng(8)
    true = np.array([[0.5, 0.02, -8], [0.01, 0.45, -6], [1e-4, 5e-5, 1]])
    data = []
    for rec, bad in (("hard", 7), ("easy", 0)):
        for i in range(200):
            x, y = r.uniform(0, 640), r.uniform(0, 480)
            q = true @ [x, y, 1]
            u, v = r.uniform(0, 320, 2) if i % 10 < bad else q[:2] / q[2]
            data.append((rec, i, *map(float, (x, y, u, v))))
    data += [("line", i, float(i), float(i), float(i), float(i)) for i in range(20)]
    df = spark.createDataFrame(data, "rec_id string, i int, x double, y double, u double, v double")
    found = {h.rec_id: h.H for h in calibrate.fit_homography(df, ["rec_id"]).collect()}
    assert set(found) == {"hard", "easy"} and all(np.allclose(h, true, rtol=1e-3, atol=1e-5) for h in found.values())
    need = spark.range(1).select(*[calibrate.draws_needed(calibrate.F.lit(s)).alias(f"n{i}") for i, s in enumerate((1.0, 0.5, 0.3, 0.0))]).first()
    assert tuple(need) == (1, 108, 850, calibrate.MOST_DRAWS)


def scene(h, w, y0=0, x0=0):
    y, x = np.mgrid[y0 : y0 + h, x0 : x0 + w]
    return (127 + 60 * np.sin(x / 5.0) + 60 * np.cos(y / 7.0 + x / 11.0)).astype(int)


def test_registration_with_points(spark):
    """IR is the RGB scene at half size; the calibration must land pixels on pixels."""
    big = scene(80, 120)
    cols = "rec_id string, name string, idx long, height int, width int, channels int, px array<int>"
    rgb = spark.createDataFrame([("a", f"{i:06d}.png", i, 80, 120, 1, big.ravel().tolist()) for i in range(30)], cols)
    ir = spark.createDataFrame([("a", f"{i:06d}.png", i, 40, 60, 1, big[::2, ::2].ravel().tolist()) for i in range(1, 31)], cols)
    pts = [(x, y, x / 2, y / 2) for x, y in ((0, 0), (100, 4), (90, 70), (6, 60), (50, 30))]
    points = spark.createDataFrame([("a", i, *map(float, p)) for i, p in enumerate(pts)], "rec_id string, i int, x double, y double, u double, v double")
    out = register.register(rgb, ir, mode="manual", points=points, crop_auto=True, val_frac=0.2, chunk=10)
    record = out.records.first()
    assert np.allclose(record.H, [[0.5, 0, 0], [0, 0.5, 0], [0, 0, 1]], atol=1e-6) and record.ecc_cc is None
    # A corner a hair beyond a whole pixel rounds one further in.
    assert np.abs(np.array(record.crop) - [2, 2, 55, 35]).max() <= 1 and record.thermal_size == [60, 40]
    aligned = out.aligned.collect()
    assert len(aligned) == 29 and {r.split for r in aligned} == {"train", "val"}
    r = aligned[0]
    assert [r.width, r.height] == record.crop[2:] and np.allclose(r.rgb_px, r.ir_px, atol=1e-3)


def test_search_finds_a_shift(spark):
    cols = "rec_id string, name string, idx long, height int, width int, channels int, px array<int>"
    make = lambda y0, x0: spark.createDataFrame([("a", f"{i:06d}.png", i, 40, 48, 1, scene(40, 48, y0 + i, x0).ravel().tolist()) for i in range(3)], cols)
    grid = calibrate.candidate_grid([-2, -1, 0, 1, 2], [1.0])
    rec = register.calibration_records(make(10, 10), make(11, 8), "search", calib_frames=(0, 99), candidates=grid).first()
    assert np.allclose(rec.H, [[1, 0, 2], [0, 1, -1], [0, 0, 1]]) and rec.ecc_cc > 0.9


def test_best_calibration_ignores_failures(spark):
    df = spark.createDataFrame([("a", 0, None, 1.0), ("a", 1, 0.5, 2.0), ("a", 2, 0.5, 3.0), ("b", 0, None, 4.0)], "rec string, frame int, cc double, H double")
    assert rows(calibrate.best_calibration(df, ["rec"]), "rec", "H") == [("a", 2.0)]


# -- samples and translation ---------------------------------------------
def test_samples_are_reproducible(spark):
    px = lambda s: RNG.integers(0, 256, s).tolist()
    pairs = spark.createDataFrame([(f"{i:06d}.png", 9, 7, px(189), px(63)) for i in range(12)], "name string, height int, width int, rgb_px array<int>, ir_px array<int>")
    temps = spark.createDataFrame([("000003", 15.0)], "stem string, celsius double")
    make = lambda df, **kw: rows(samples.paired_samples(df, REL8, load_size=0, crop_size=8, temps=temps, **kw), "name", "a", "b", "t", "crop")
    first = make(pairs)
    assert first == make(pairs.repartition(5)) and first != make(pairs, epoch=1)
    assert all(len(r[1]) == 192 and len(r[2]) == 64 for r in first)
    assert dict((r[0], r[3]) for r in first)["000003"] == pytest.approx(-0.3)
    val = samples.paired_samples(pairs, REL8, load_size=0, crop_size=6, train=False).first()
    assert (val.crop.x, val.crop.y, val.crop.flip) == (0, 1, False)


def test_unpaired_width_defaults_to_ir(spark):
    rgb = spark.createDataFrame([(f"{i}.png", 6, 12, [i] * 216) for i in range(5)], FRAME)
    ir = spark.createDataFrame([(f"{i}.png", 4, 6, [i] * 24) for i in range(2)], FRAME)
    got = rows(samples.unpaired_samples(rgb, ir, REL8, crop_size=3, train=False), "name", "ir_name")
    assert got == [("0", "0"), ("1", "1"), ("2", "0"), ("3", "1"), ("4", "0")]
    train = samples.unpaired_samples(rgb, ir, REL8, crop_size=9)
    assert {(len(r.a), len(r.b), r.t) for r in train.collect()} == {(243, 81, 0.0)}


def test_translation_keeps_geometry(spark):
    frames = spark.createDataFrame([("a", 5, 7, RNG.integers(0, 256, 105).tolist()), ("b", 4, 4, [0] * 48)], FRAME)

    def factory():
        def model(a, t):
            assert a.shape[2] % 8 == 0 and a.shape[3] % 8 == 0
            return a[:, 0] * 0.5

        return model

    out = {r.name: r for r in translate.translate(frames, factory, REL8, multiple=8).collect()}
    px = np.array(frames.where("name = 'a'").first().px).reshape(5, 7, 3)
    assert np.allclose(out["a"].px, (px[..., 2].ravel() / 127.5 - 1) / 2, atol=1e-6) and (out["a"].height, out["a"].width) == (5, 7)
    small = translate.translate(frames, factory, REL8, multiple=8, max_size=5).where("name = 'a'").first()
    assert (small.height, small.width, len(small.px)) == (3, 5, 15)


def test_two_stage_regression(spark):
    def row(i):
        a = RNG.uniform(-1, 1, (3, 64))
        return (f"{i}", a.ravel().tolist(), (0.3 * a[0] - 0.2 * a[1] + 0.1 * a[2]).tolist(), float(RNG.uniform(-1, 1)))

    s = spark.createDataFrame([row(i) for i in range(20)], "name string, a array<double>, b array<double>, t double")
    base, detail = translate.fit_two_stage(s, 1.0, 8)()
    r = s.first()
    a, t = np.array(r.a).reshape(1, 3, 8, 8), np.array([r.t])
    made = base(a, t)
    assert np.allclose((made + detail(a, made)).ravel(), r.b, atol=1e-3)


def test_shortcut_verdicts(spark):
    frames = spark.createDataFrame([(f"{i}.png", 8, 8, RNG.integers(0, 256, 192).tolist()) for i in range(6)], FRAME)
    lum = lambda: LinearModel([0.299, 0.587, 0.114], 0.0)
    r = translate.shortcut_check(frames, None, lum, REL8, n=4).first()
    assert (r.frames, r.verdict, r.r_real) == (4, "shortcut", None) and r.r_gen > 0.99
    flat = translate.shortcut_check(frames, None, lambda: LinearModel([0.0, 0.0, 0.0], 0.1), REL8, n=4).first()
    assert (flat.r_gen, flat.verdict) == (None, "decoupled")


def test_unpaired_preparation(spark, tmp_path):
    cols = "rec_id string, " + FRAME
    rgb = spark.createDataFrame([("a", f"{i}.png", 6, 12, [i] * 216) for i in range(5)] + [("a", "9.png", None, None, None)], cols)
    ir = spark.createDataFrame([("a", f"{i}.png", 4, 5, [i] * 20) for i in range(5)], cols)
    small, kept = unpaired.prepare(rgb, ir, skip=2)
    assert rows(small, "name", "height", "width") == [("2.png", 2, 5), ("3.png", 2, 5), ("4.png", 2, 5)]
    assert small.where("name = '3.png'").first().px == [3] * 30 and kept.count() == 3
    for _ in range(2):
        unpaired.write_resumable(small, kept, str(tmp_path))
    assert commits.read_committed(spark, f"{tmp_path}/rgb", small.schema).count() == 3


def test_manifest_rounds_half_to_even(spark):
    pairs = spark.createDataFrame([("000001.png", "val", 4, 4, 8, [1] + [0] * 15, [3] * 48, "r", "i")], "name string, split string, ir_w int, ir_h int, ir_depth int, ir_px array<int>, rgb_px array<int>, rgb_content string, ir_content string")
    m = manifest.build(pairs).first()
    assert (m.frame, m.thermal_mean, m.thermal_max, m.rgb_mean, m.thermal_dtype) == ("000001", 0.062, 1, 3.0, "uint8")
    same = manifest.verify(manifest.build(pairs), manifest.build(pairs))
    assert rows(same) == [("000001", "ok")]
