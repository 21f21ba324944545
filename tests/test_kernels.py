import numpy as np
import pytest
from pyspark.sql import functions as F

from framepair.functions import kernels, pixels
from framepair.functions.kernels import resize_stack
from framepair.operators import calibrate

RNG = np.random.default_rng(4)
SHAPES = [(8, 8), (12, 9), (7, 15), (12, 9)]


@pytest.fixture(scope="module")
def frames(spark):
    """Frames of several shapes in one batch, and one missing frame."""
    data = [(i, h, w, RNG.random((h, w)).ravel().tolist(), RNG.random((h, w)).ravel().tolist()) for i, (h, w) in enumerate(SHAPES)]
    df = spark.createDataFrame([*data, (9, None, None, None, None)], "id int, h int, w int, px array<double>, q array<double>")
    return {d[0]: np.array(d[3]).reshape(d[1], d[2]) for d in data}, df


def made(df, col):
    return {r.id: r.v for r in df.select("id", col.alias("v")).collect()}


def reflect(x, r):
    return np.pad(x, r, mode="reflect")


def test_blur_matches_direct_sum(frames):
    imgs, df = frames
    got = made(df, kernels.gaussian_blur("px", "h", "w", 0.9, precision="double"))
    r = 3
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * 0.9**2))
    k2 = np.outer(k, k) / k.sum() ** 2
    for i, x in imgs.items():
        p = reflect(x, r)
        want = [[(p[y : y + 7, c : c + 7] * k2).sum() for c in range(x.shape[1])] for y in range(x.shape[0])]
        assert np.allclose(np.reshape(got[i], x.shape), want)
    assert got[9] is None


def test_blur_radius_and_identity(frames):
    imgs, df = frames
    assert len(kernels.bell(8.0, 24)) == 49 and kernels.bell(8.0, 24).sum() == pytest.approx(1)
    same = made(df, kernels.gaussian_blur("px", "h", "w", 0.0, precision="double"))
    assert np.allclose(same[0], imgs[0].ravel())


def test_two_bands_sum_to_the_frame(frames):
    imgs, df = frames
    df = df.withColumn("s", kernels.gaussian_blur("px", "h", "w", 1.0, precision="double"))
    back = made(df, pixels.recombine("s", pixels.subtract("px", "s")))
    assert np.allclose(back[1], imgs[1].ravel())


def test_ssim(frames):
    _, df = frames
    one = made(df, kernels.ssim("px", "px", "h", "w"))
    assert one[0] == pytest.approx(1) and one[9] is None
    assert made(df, kernels.ssim("px", "q", "h", "w"))[1] < 0.6


def test_score_of_constant_offset(spark):
    a = [0.2] * 64
    df = spark.createDataFrame([(0, a, [x + 0.1 for x in a], a)], "id int, p array<double>, q array<double>, g array<double>")
    s = df.select(kernels.score_frames("p", F.lit(8), F.lit(8), "q", F.lit(8), F.lit(8)).alias("s"), kernels.score_frames("p", F.lit(8), F.lit(8), "g", F.lit(8), F.lit(8)).alias("z")).first()
    assert (s.s.l1, s.s.rmse, s.s.psnr) == (pytest.approx(0.1), pytest.approx(0.1), pytest.approx(20))
    assert (s.z.l1, s.z.psnr, s.z.ssim) == (0, pytest.approx(120), pytest.approx(1))


def test_area_resize_is_a_box_mean(frames):
    imgs, df = frames
    got = made(df.where("id = 1"), kernels.resize("px", "h", "w", F.lit(4), F.lit(3), "area", precision="double"))
    assert np.allclose(np.reshape(got[1], (4, 3)), imgs[1].reshape(4, 3, 3, 3).mean(axis=(1, 3)))


def test_resizes_keep_constants_and_ramps():
    flat = np.full((1, 5, 7, 3), 3.5)
    for h, w, m in ((10, 14, "linear"), (3, 4, "area"), (9, 4, "area"), (8, 8, "area")):
        assert np.allclose(resize_stack(flat, h, w, m), 3.5)
    ramp = np.arange(8.0).reshape(1, 1, 8, 1)
    assert np.allclose(resize_stack(ramp, 1, 16, "linear")[0, 0, 1:-1, 0], np.arange(0.25, 7, 0.5))


def test_warp(frames, spark):
    imgs, df = frames
    shift = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in ((1, 0, 2), (0, 1, -1), (0, 0, 1))])
    got = made(df, kernels.warp("px", "h", "w", shift, "h", "w", precision="double"))
    for i, x in imgs.items():
        want = np.zeros_like(x)
        want[:-1, 2:] = x[1:, :-2]
        assert np.allclose(np.reshape(got[i], x.shape), want)
    assert got[9] is None


def test_pool_borders(frames):
    imgs, df = frames
    got = made(df, kernels.pool2("px", "h", "w", precision="double"))
    for i, x in imgs.items():
        h, w = x.shape
        want = [[x[max(0, 2 * y - 1) : 2 * y + 2, max(0, 2 * c - 1) : 2 * c + 2].mean() for c in range((w + 1) // 2)] for y in range((h + 1) // 2)]
        assert np.allclose(got[i], np.ravel(want))


def test_edges(frames, spark):
    _, df = frames
    e = made(df, kernels.edge_map("px", "h", "w", precision="double"))
    assert min(e[0]) == 0 and max(e[0]) == pytest.approx(1)
    flat = spark.createDataFrame([(0, [4.0] * 30)], "id int, px array<double>")
    assert made(flat, kernels.edge_map("px", F.lit(5), F.lit(6)))[0] == [0.0] * 30


@pytest.mark.parametrize("multiple", [5, 16, 40])
def test_pad_and_unpad(frames, multiple):
    imgs, df = frames
    up = lambda c: (F.ceil(F.col(c) / multiple) * multiple).cast("int")
    df = df.withColumn("p", pixels.pad_reflect("px", "h", "w", multiple))
    for i, v in made(df, F.col("p")).items():
        if i in imgs:
            h, w = imgs[i].shape
            ph, pw = -(-h // multiple) * multiple, -(-w // multiple) * multiple
            x = imgs[i]
            while x.shape != (ph, pw):
                x = np.pad(x, ((0, min(ph - x.shape[0], x.shape[0] - 1)), (0, min(pw - x.shape[1], x.shape[1] - 1))), mode="reflect")
            assert np.allclose(np.reshape(v, (ph, pw)), x)
    back = made(df, pixels.unpad("p", up("h"), up("w"), "h", "w"))
    assert all(np.allclose(back[i], x.ravel()) for i, x in imgs.items())


def test_flip_twice_is_identity(frames):
    imgs, df = frames
    once = df.withColumn("f", pixels.flip("px", "h", "w", when=F.col("id") != 1))
    one, two = made(once, F.col("f")), made(once, pixels.flip("f", "h", "w", when=F.col("id") != 1))
    assert np.allclose(one[0], imgs[0][:, ::-1].ravel()) and np.allclose(one[1], imgs[1].ravel())
    assert all(np.allclose(two[i], x.ravel()) for i, x in imgs.items())


def test_crop_with_row_windows(frames):
    imgs, df = frames
    got = made(df, pixels.crop("px", "h", "w", F.col("id"), F.col("id") + 1, 4, 3))
    for i, x in imgs.items():
        assert np.allclose(got[i], x[i + 1 : i + 4, i : i + 4].ravel())


def test_jitter(spark):
    df = spark.createDataFrame([(0, [0, 100, 250], True), (1, [0, 100, 250], False)], "id int, px array<int>, on boolean")
    got = made(df, pixels.jitter("px", F.col("on"), F.lit(1.1), F.lit(-5.5)))
    assert got == {0: [0, 104, 255], 1: [0, 100, 250]}


def test_statistics_and_correlation(frames):
    imgs, df = frames
    s = made(df, pixels.statistics("px"))
    assert s[1].std == pytest.approx(imgs[1].std()) and s[1].max == imgs[1].max()
    r = made(df.withColumn("m", F.transform("px", lambda x: -x)), kernels.correlation("px", "m"))
    assert r[0] == pytest.approx(-1)
    assert made(df, kernels.correlation("px", F.transform("px", lambda x: F.lit(1.0))))[0] is None


def test_target_sizes(spark):
    r = spark.range(1).select(
        kernels.height_for_width(F.lit(2160), F.lit(3840), F.lit(640)).alias("a"), *[c.alias(n) for n, c in zip("bc", kernels.capped_size(F.lit(798), F.lit(1098), 640))],
        *[c.alias(n) for n, c in zip("de", kernels.at_least(F.lit(100), F.lit(333), 256))],
    ).first()
    assert tuple(r) == (360, 465, 640, 256, 852)


def test_jitter_keeps_missing_frames_missing(spark):
    df = spark.createDataFrame([(0, None, True), (1, [], True), (2, [10, 20], True), (3, None, False)], "id int, px array<int>, on boolean")
    got = {r.id: r.o for r in df.select("id", pixels.jitter("px", F.col("on"), F.lit(2.0), F.lit(0.0)).alias("o")).collect()}
    assert got == {0: None, 1: [], 2: [20, 40], 3: None}


def test_batches_past_32_bit_offsets_raise():
    from framepair.functions.arrow import offsets32

    assert offsets32(np.array([0, (1 << 31) - 1])).to_pylist() == [0, (1 << 31) - 1]
    with pytest.raises(ValueError, match="maxRecordsPerBatch"):
        offsets32(np.array([0, 1 << 31]))


def test_ssim_equals_its_definition():
    rng = np.random.default_rng(5)
    a, b = rng.random((2, 13, 15, 1)), rng.random((2, 13, 15, 1))
    w = np.exp(-((np.arange(11) - 5) ** 2) / (2 * 1.5**2))
    w = np.outer(w, w) / w.sum() ** 2
    pad = lambda x: np.pad(x[..., 0], [(0, 0), (5, 5), (5, 5)], mode="reflect")
    want = []
    for x, y in zip(pad(a), pad(b), strict=True):
        at = []
        for r in range(13):
            for c in range(15):
                p, q = x[r : r + 11, c : c + 11], y[r : r + 11, c : c + 11]
                m, n = (w * p).sum(), (w * q).sum()
                vp, vq, cov = (w * (p - m) ** 2).sum(), (w * (q - n) ** 2).sum(), (w * (p - m) * (q - n)).sum()
                at.append((2 * m * n + 1e-4) * (2 * cov + 9e-4) / ((m * m + n * n + 1e-4) * (vp + vq + 9e-4)))
        want.append(np.mean(at))
    assert np.allclose(kernels.ssim_stack(a, b), want)


def test_alignment_scores_read_frames_in_one_worker(spark):
    """Edge maps are no column between Python workers; those of single precision are what is compared."""
    size = lambda m, h, w: {f"{m}_h": F.lit(h), f"{m}_w": F.lit(w)}
    frame = lambda seed, n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (F.pmod(F.xxhash64("frame", i, F.lit(seed)), F.lit(256))).cast("double"))
    pairs = spark.range(0, 40, 1, 2).select((F.col("id") % 3).alias("rec"), F.col("id").alias("frame")).withColumns(size("rgb", 24, 20) | size("ir", 18, 16))
    pairs = pairs.withColumns({"rgb_px": frame(1, 480), "ir_px": F.when(F.col("frame") != 5, frame(2, 288))})
    grid = calibrate.candidate_grid([-3, 0, 3], [1.0, 24 / 18])
    found = calibrate.search_alignment(pairs, ["rec"], grid)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    best = {}
    for r in pairs.collect():
        if r.ir_px is None:
            continue
        a, b = (kernels.edge_stack(np.reshape(p, (1, h, w, 1))).astype(np.float32).astype(float) for p, h, w in ((r.rgb_px, 24, 20), (r.ir_px, 18, 16)))
        for n, c in enumerate(grid):
            cc = kernels._edge_agreement(a, b[..., 0], kernels.placement_matrix((24, 20), (18, 16), *c))[0]
            if not np.isnan(cc):
                best[r.rec] = max(best.get(r.rec, (-2,)), (cc, -r.frame, -n))
    got = {r.rec: (r.cc, -r.frame) for r in found.collect()}
    assert got.keys() == best.keys() and all(got[k] == (pytest.approx(v[0]), v[1]) for k, v in best.items())
