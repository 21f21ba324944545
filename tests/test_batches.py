"""Work done where batches are read: neighbours, histograms and moments."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framepair.functions import arrow, kernels, pixels
from framepair.operators import neighbours, profile
from framepair.plans import translate

RNG = np.random.default_rng(4)


def test_change_meets_across_task_borders(spark):
    data = [(rec, k, RNG.integers(0, 50, 6).tolist()) for rec in ("a", None, "c") for k in range(40)]
    data[10] = ("a", 10, None)
    data[50] = (None, 10, [1, 2])
    df = spark.createDataFrame(data, "rec string, k long, px array<int>")
    want = {}
    for rec in ("a", None, "c"):
        mine = [(k, p) for r, k, p in data if r == rec]
        for (_, p), (k, q) in zip([(None, None), *mine], mine):
            want[rec, k] = float(np.abs(np.array(p) - q).mean()) if p and q and len(p) == len(q) else None
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        done = neighbours.change(df, ["rec"], ["k"])
        assert done.columns == ["rec", "k", "change"]
        got = {(r.rec, r.k): r.change for r in done.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.keys() == want.keys() and all(got[k] == (None if v is None else pytest.approx(v)) for k, v in want.items())
    assert neighbours.change(df.limit(0), ["rec"], ["k"]).collect() == []
    assert neighbours.change(df.where("rec = 'c'").drop("rec"), [], ["k"]).where("change is null").count() == 1


def test_pixels_are_shuffled_once(spark):
    df = spark.range(30).selectExpr("id % 3 as rec", "id", "array(int(id), 1) as px")
    seen = []
    materialise = neighbours.materialise
    neighbours.materialise = lambda d, tag: seen.append(d._jdf.queryExecution().executedPlan().toString()) or materialise(d, tag)
    try:
        neighbours.change(df, ["rec"], ["id"])
    finally:
        neighbours.materialise = materialise
    assert len(seen) == 1 and seen[0].count("Exchange ") == 1


def test_histogram_and_quantiles(spark):
    data = [("a", [0, 1, 1, 255]), ("a", [300, -1, None, 7]), (None, [5]), ("b", None), ("c", []), ("d", [9.9, 2.0])]
    df = spark.createDataFrame([(g, None if p is None else [None if v is None else float(v) for v in p]) for g, p in data], "g string, px array<double>").repartition(3)
    hist = profile.histogram(df, "px", by=["g"])
    got = {(r.g, r.bin, r.n) for r in hist.collect()}
    assert got == {("a", 0, 1), ("a", 1, 2), ("a", 255, 1), ("a", None, 3), ("a", 7, 1), (None, 5, 1), ("d", 9, 1), ("d", 2, 1)}
    q = {r.g: (r.n, r.quantiles) for r in profile.quantiles(hist, (0.0, 0.5, 1.0), ["g"]).collect()}
    assert q == {"a": (5, [0, 1, 255]), None: (1, [5, 5, 5]), "d": (2, [2, 2, 9])}
    assert "Generate" not in hist._jdf.queryExecution().executedPlan().toString()
    values = RNG.integers(0, 1 << 16, 5000)
    deep = spark.createDataFrame([(values[i : i + 500].tolist(),) for i in range(0, 5000, 500)], "px array<int>")
    found = profile.quantiles(profile.histogram(deep, "px", depth=16), (0.1, 0.5, 0.9)).first().quantiles
    assert found == [int(np.sort(values)[int(np.ceil(5000 * s)) - 1]) for s in (0.1, 0.5, 0.9)]


def samples(spark, n=20, size=8):
    made = []
    for i in range(n):
        a = RNG.uniform(-1, 1, (3, size * size))
        made.append((a.ravel().tolist(), (0.3 * a[0] - 0.2 * a[1] + 0.1 * a[2] + 0.05).tolist(), float(i)))
    return made, "a array<double>, b array<double>, t double"


def test_moments_equal_a_dense_product(spark):
    made, schema = samples(spark)
    bad = [([0.0] * 192, [float("nan")] * 64, 1.0), ([0.0] * 192, None, 1.0), ([0.0] * 10, [0.0] * 64, 1.0), ([0.0] * 192, [0.0] * 64, None)]
    df = spark.createDataFrame(made + bad, schema).repartition(3)
    a, b, t = (np.array([m[i] for m in made]) for i in range(3))
    base = kernels.blur_stack(b.reshape(-1, 8, 8, 1), 1.0).reshape(b.shape)
    z = np.stack([*a.reshape(-1, 3, 64).transpose(1, 0, 2), np.broadcast_to(t[:, None], b.shape), np.ones_like(b), base, b - base]).reshape(7, -1)
    assert np.allclose(translate.moments(df, 1.0, 8), z @ z.T)
    assert translate.moments(df.limit(0)).sum() == 0


def test_fits_by_moments(spark):
    made, schema = samples(spark)
    df = spark.createDataFrame(made, schema).withColumn("t", translate.F.when(translate.F.col("t") > 3, translate.F.col("t")))
    model = translate.fit_single(df)()
    assert np.allclose([*model.weights, model.bias], [0.3, -0.2, 0.1, 0.05], atol=1e-5)
    base, detail = translate.fit_two_stage(spark.createDataFrame(made, schema), 1.0, 8)()
    a, b, t = (np.array([m[i] for m in made]) for i in range(3))
    planes = a.reshape(-1, 3, 8, 8)
    guess = base(planes, t)
    assert np.allclose((guess + detail(planes, guess)).reshape(b.shape), b, atol=1e-3)


def test_kernels_work_on_pieces_of_a_batch(spark):
    """Temporaries follow the piece, not the batch."""
    seen = arrow.kernel(lambda px, n: pa.array([len(px)] * len(px), pa.int64()), "bigint")
    f = spark.range(0, 3000, 1, 1).select("id", F.array_repeat(F.col("id").cast("double"), 2000).alias("px"))
    most = f.select(seen("px", "id").alias("n")).agg(F.max("n")).first()[0]
    assert 1 <= most <= arrow.PIECE // 16_000 + 1


def test_growing_kernels_give_results_in_bounded_batches(spark):
    sizes = arrow.kernel(lambda px, n: pa.array([b"x" * (1 << 20)] * len(px), pa.binary()), "binary", grows=True)
    grown = arrow._growing(lambda px, n: pa.array([b"x" * (1 << 20)] * len(px), pa.binary()))
    batch = pa.array([1] * 100), pa.array([2] * 100)
    out = list(grown(iter([batch, batch])))
    assert sum(map(len, out)) == 200 and max(o.nbytes for o in out) <= arrow.GROWN + (1 << 20)
    f = spark.range(0, 60, 1, 1).select(F.length(sizes("id", "id")).alias("n"))
    assert f.agg(F.sum("n")).first()[0] == 60 << 20


def test_pieces_of_frames_with_gaps_equal_the_whole(spark):
    f = spark.range(0, 900, 1, 1).select("id", F.when(F.col("id") % 7 > 0, F.transform(F.sequence(F.lit(1), F.lit(1200)), lambda i: F.when((i + F.col("id")) % 911 > 0, (i * F.col("id") % 251).cast("double")))).alias("px"))
    f = f.withColumns({"h": F.lit(30), "w": F.lit(40)})
    got = f.select("id", pixels.crop("px", "h", "w", 2, 3, 5, 4).alias("c"), kernels.resize("px", "h", "w", 60, 80, precision="double").alias("r")).collect()
    for i, c, r in got:
        if i % 7 == 0:
            assert c is None and r is None
            continue
        x = np.array([float(k * i % 251) if (k + i) % 911 else np.nan for k in range(1, 1201)]).reshape(30, 40)
        np.testing.assert_array_equal(np.array(c, float), x[3:7, 2:7].ravel())
        assert len(r) == 4800
