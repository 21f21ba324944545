import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from framepair.functions import color, geometry, names
from framepair.functions.norm import ThermalNorm, interleaved_to_planes, planes_to_interleaved
from framepair.functions.picks import even_pick, is_even_pick, val_count
from framepair.functions.sql import lr_schedule, norm_from_json, register

REL8, ABS16 = ThermalNorm(), ThermalNorm("abs16")


def test_uint8_round_trip_truncates(spark):
    back = REL8.uint8_value(REL8.norm_value(F.col("id")))
    low = spark.range(256).select((F.col("id") - back).alias("d")).groupBy("d").count()
    assert rows(low) == [(0, 236), (1, 20)]


def test_radiometric_value(spark):
    r = spark.range(1).select(
        (F.lit(7079) * 0.04 - 273.15).alias("c"), ABS16.norm_value(F.lit(7079)).alias("n"),
        ABS16.celsius_to_norm(F.lit(200.0)).alias("unclipped"), ABS16.norm_value(F.lit(65535)).alias("clipped"),
    ).first()
    assert r.c == pytest.approx(10.01) and r.n == pytest.approx(-0.3998)
    assert r.unclipped == pytest.approx(3.4) and r.clipped == 1.0


def test_settings_round_trip():
    assert ThermalNorm.from_dict(ABS16.to_dict()) == ABS16
    assert norm_from_json('{"mode": "abs16", "tmin": -10}').celsius_span == 90
    with pytest.raises(ValueError):
        ThermalNorm("rel16")


def test_stems(spark):
    cases = {"a.png": "a", "a.b.png": "a.b", ".png": ".png", "a..png": "a.", "noext": "noext", "..x": "..x", "a.": "a"}
    df = spark.createDataFrame([(k,) for k in cases], "n string").select("n", names.stem("n").alias("s"))
    assert {r.n: r.s for r in df.collect()} == cases
    sixteen = spark.range(1).select(names.score_stem(F.lit("x_16bit_1.png"))).first()[0]
    assert sixteen == "x_1"


def test_image_extensions(spark):
    df = spark.createDataFrame([("a.PNG",), ("b.jpeg",), ("c.txt",), ("png",), (".png",), ("d.Tif",)], "n string")
    assert rows(df.where(names.is_image("n"))) == [("a.PNG",), ("b.jpeg",), ("d.Tif",)]


def test_numeric_order(spark):
    df = spark.createDataFrame([("10.png",), ("2.png",), ("b.png",), ("a1.png",), ("1" * 25 + ".png",)], "n string")
    got = [r.n for r in df.orderBy(*names.numeric_order("n")).collect()]
    assert got == ["2.png", "10.png", "1" * 25 + ".png", "a1.png", "b.png"]


def test_condition_labels(spark):
    df = spark.createDataFrame([(15.0,), (0.0,), (-2.5,), (None,), (1234567.0,)], "t double")
    got = [tuple(r) for r in df.select(*names.condition(ABS16, "t")).collect()]
    assert got[0] == (pytest.approx(-0.3), "T15C") and got[1][1] == "T0C" and got[2][1] == "T-2.5C"
    assert got[3] == (0.0, "")
    half = spark.createDataFrame([(0.5,)], "t double").select(*names.condition(REL8, "t")).first()
    assert tuple(half) == (0.0, "T0.5")


def test_parse_list(spark):
    one = lambda text, kind: spark.range(1).select(names.parse_list(F.lit(text), kind)).first()[0]
    assert one(" 1, ,2,", "int") == [1, 2] and one("a, b", "string") == ["a", "b"] and one("", "string") == []


def test_even_picks_match_linspace(spark):
    df = spark.range(1, 70).withColumnRenamed("id", "n").join(spark.range(1, 40).withColumnRenamed("id", "k"))
    df = df.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
    got = {}
    for r in df.select("n", "k", "i", even_pick(F.col("i"), F.col("n"), F.col("k")).alias("p")).collect():
        got.setdefault((r.n, r.k), {})[r.i] = r.p
    for (n, k), picks in got.items():
        assert [picks[i] for i in range(k)] == list(np.linspace(0, n - 1, k, dtype=int)), (n, k)


def test_pick_membership(spark):
    df = spark.range(1, 60).withColumnRenamed("id", "n").join(spark.range(0, 35).withColumnRenamed("id", "k"))
    df = df.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    got = {}
    for r in df.where(is_even_pick(F.col("pos"), F.col("n"), F.col("k"))).collect():
        got.setdefault((r.n, r.k), set()).add(r.pos)
    for n in range(1, 60):
        for k in range(35):
            want = set(np.linspace(0, n - 1, k, dtype=int)) if k else set()
            assert got.get((n, k), set()) == want, (n, k)


@pytest.mark.parametrize("frac,n,want", [(0.25, 10, 2), (0.25, 14, 4), (0.01, 10, 1), (0.0, 10, 0), (0.1, 2, 1)])
def test_val_count_is_half_even(spark, frac, n, want):
    assert spark.range(1).select(val_count(frac, F.lit(n))).first()[0] == want


def test_learning_rate(spark):
    lr = {r.epoch: r.lr for r in lr_schedule(spark, 40, 20).collect()}
    assert len(lr) == 60 and lr[39] == pytest.approx(2e-4) and lr[49] == pytest.approx(1e-4) and lr[59] == 0


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT norm_to_uint8(rel8_to_norm(200))").first()[0] in (199, 200)
    assert spark.sql("SELECT celsius_to_norm(15, -20, 80)").first()[0] == pytest.approx(-0.3)
    assert 0 <= spark.sql("SELECT hash_uniform('a|1')").first()[0] < 1
    assert [r.pos for r in spark.sql("SELECT * FROM even_picks(31, 23)").collect()] == list(np.linspace(0, 30, 23, dtype=int))
    assert [r.lr for r in spark.sql("SELECT * FROM learning_rates(40, 20, 2e-4D)").collect()][59] == 0


def test_colour_helpers(spark):
    df = spark.createDataFrame([([10, 20, 30, 1, 2, 2], [5, 5], [9, 1, 2, 3, 8, 4, 5, 6])], "px array<int>, mono array<int>, rgba array<int>")
    r = df.select(
        color.luma("px").alias("l"), color.gray_mean("px").alias("m"), color.drop_alpha("mono", F.lit(1)).alias("three"),
        color.drop_alpha("rgba", F.lit(4)).alias("rgb"), color.minmax_stretch("mono", 1, 2).alias("flat"),
        planes_to_interleaved(interleaved_to_planes("px", 1, 2), 1, 2).alias("back"),
    ).first()
    assert r.l[0] == pytest.approx(0.114 * 10 + 0.587 * 20 + 0.299 * 30)
    assert r.m == [20, 2] and r.three == [5, 5, 5, 5, 5, 5] and r.rgb == [9, 1, 2, 8, 4, 5] and r.flat == [0, 0]
    assert [abs(a - b) <= 1 for a, b in zip(r.back, [30, 20, 10, 2, 2, 1])] == [True] * 6


def test_auto_crop(spark):
    h = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in ((0.5, 0, -8), (0, 0.5, -6), (0, 0, 1))])
    crop = lambda tw, th: spark.range(1).select(geometry.auto_crop(h, 320.0, 240.0, float(tw), float(th))).first()[0]
    assert crop(160, 120) == [0, 0, 149, 111]
    assert crop(15, 120) is None


def test_letterbox_and_pads(spark):
    r = spark.range(1).select(
        geometry.letterbox(3840, 2160, 640, 512).alias("h"), geometry.pad_amount(F.lit(798), 256).alias("a"), geometry.pad_amount(F.lit(1024), 256).alias("b")
    ).first()
    assert r.h[0][0] == pytest.approx(1 / 6) and r.h[1][2] == pytest.approx(76) and (r.a, r.b) == (226, 0)
