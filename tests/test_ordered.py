import random

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from framepair.operators import ordered, pairing, sampling, split
from framepair.operators.lookup import lookup


@pytest.fixture(scope="module")
def skewed(spark):
    """One recording holds two thirds of the rows, and its keys repeat."""
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.66 else f"r{rng.randrange(5)}", rng.randrange(400), i, rng.choice([None, i])) for i in range(3000)]
    return pd.DataFrame(data, columns=["rec", "t", "id", "v"]), spark.createDataFrame(data, "rec string, t bigint, id bigint, v bigint").repartition(7)


def test_dense_index(skewed):
    pdf, df = skewed
    got = {r.id: (r.i, r.n) for r in ordered.dense_index(df, ["rec"], ["t", "id"], "i", total="n").collect()}
    want = pdf.sort_values(["rec", "t", "id"])
    for i, n, k in zip(want.groupby("rec").cumcount(), want.groupby("rec").id.transform("size"), want.id):
        assert got[k] == (i, n)


def test_segments_split_a_hot_key(skewed):
    _, df = skewed
    sizes = ordered.segment(df, ["rec"], ["t", "id"], 8).groupBy("_part").count().collect()
    assert len(sizes) >= 6 and max(r["count"] for r in sizes) < 3000 * 0.35


def test_lag_lead_and_renumber(skewed):
    pdf, df = skewed
    seg = ordered.segment(df, ["rec"], ["t", "id"], 5)
    both = ordered.following(ordered.previous(seg, ["rec"], ["id"]), ["rec"], ["id"])
    got = {r.id: (r.prev_id, r.next_id) for r in both.collect()}
    want = pdf.sort_values(["rec", "t", "id"])
    g = want.groupby("rec").id
    for k, p, n in zip(want.id, g.shift(1), g.shift(-1)):
        assert got[k] == (None if pd.isna(p) else p, None if pd.isna(n) else n)
    odd = ordered.renumber(seg.where("id % 2 = 1"), ["rec"], "i")
    kept = want[want.id % 2 == 1]
    assert {r.id: r.i for r in odd.collect()} == dict(zip(kept.id, kept.groupby("rec").cumcount()))


def test_fill_around(skewed):
    pdf, df = skewed
    seg = ordered.segment(df, ["rec"], ["t", "id"], 6)
    got = {r.id: (r.b, r.a) for r in ordered.fill_around(seg, ["rec"], F.col("v"), "b", "a").collect()}
    want = pdf.sort_values(["rec", "t", "id"])
    g = want.groupby("rec").v
    for k, b, a in zip(want.id, g.ffill(), g.bfill()):
        assert got[k] == (None if pd.isna(b) else b, None if pd.isna(a) else a)


def test_without_groups(skewed):
    pdf, df = skewed
    got = {r.id: r.idx for r in ordered.dense_index(df, [], ["t", "id"]).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda kv: kv[1])] == list(pdf.sort_values(["t", "id"]).id)


@pytest.mark.parametrize("n,chunk,train,val,held", [(316, 200, 116, 200, {0}), (3997, 200, 3600, 397, {0, 19}), (30, 10, 20, 10, {0})])
def test_chunk_split_golden(spark, n, chunk, train, val, held):
    frac = 0.2 if n == 30 else 0.1
    s = split.chunk_split(spark.range(n), [], ["id"], frac, chunk)
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"train": train, "val": val}
    assert {r.chunk_id for r in s.where("split = 'val'").select("chunk_id").distinct().collect()} == held


def test_no_validation(spark):
    assert split.chunk_split(spark.range(50), [], ["id"], 0.0, 10).where("split = 'val'").count() == 0


def test_session_choice(spark):
    df = spark.createDataFrame([(f"s{i:02d}", j) for i in range(15) for j in range(3)], "session string, j int")
    picked = split.choose_sessions(df, None, 0.25).where("split = 'val'")
    assert rows(picked, "session") == [("s00",), ("s04",), ("s09",), ("s14",)]
    with pytest.raises(ValueError, match="nowhere"):
        split.choose_sessions(df, ["s01", "nowhere"])


def test_batches_drop_last(spark):
    b = split.batches(spark.range(7331), [], ["id"], 8, drop_last=True)
    assert b.select("batch_id").distinct().count() == 916
    assert split.batches(spark.range(10), [], ["id"], 4, drop_last=False).select("batch_id").distinct().count() == 3


def test_pick_index_clamps(spark):
    assert rows(split.pick_index(spark.range(5), [], ["id"], 99), "id") == [(4,)]


def test_pick_table(spark):
    t = split.pick_table(spark.createDataFrame([(100,)], "n bigint"), 25)
    assert [r.pos for r in t.orderBy("pos").collect()][:10] == [0, 4, 8, 12, 16, 20, 24, 28, 33, 37]


def test_lookup_keeps_every_row(skewed, spark):
    pdf, df = skewed
    names = spark.createDataFrame([(r, len(r)) for r in pdf.rec.unique() if r != "r1"], "rec string, size int")
    assert lookup(df, names, ["rec"], ["id"]).count() == (pdf.rec != "r1").sum()
    left = lookup(df, names, ["rec"], ["id"], how="left")
    assert left.count() == 3000 and left.where("size is null").count() == (pdf.rec == "r1").sum()


def test_random_take_is_stable(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"))
    a = rows(sampling.take_random(df.repartition(3), "k", 20, 1))
    assert a == rows(sampling.take_random(df.repartition(9), "k", 20, 1)) and len(a) == 20
    assert a != rows(sampling.take_random(df, "k", 20, 2))


def test_stem_dedup_keeps_last(spark):
    f = spark.createDataFrame([("x.png", 1), ("x_16bit.png", 2), ("y.png", 3)], "file string, v int")
    assert rows(pairing.by_score_stem(f), "stem", "v") == [("x", 2), ("y", 3)]


def test_size_reasons(spark):
    p = spark.createDataFrame([(10, 10, 14, 10), (10, 10, 15, 10), (10, 10, None, 4)], "rgb_h int, rgb_w int, ir_h int, ir_w int")
    got = [r.reason for r in pairing.size_check(p).orderBy(F.col("ir_h").asc_nulls_last()).collect()]
    assert got == [None, "size mismatch rgb(10, 10) ir(15, 10)", "unreadable"]


def test_checksum_states(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "z")], "f string, d string")
    b = spark.createDataFrame([("1", "x"), ("2", "Y"), ("4", "w")], "f string, d string")
    assert rows(pairing.compare_checksums(a, b, "f", "d")) == [("1", "ok"), ("2", "changed"), ("3", "missing"), ("4", "extra")]


def test_rows_without_a_group_keep_their_places(spark):
    df = spark.createDataFrame([(None, 3, 30), ("a", 1, 10), (None, 1, 11), ("a", 2, 20), (None, 2, 22)], "g string, k int, v int")
    seg = ordered.number(ordered.segment(df, ["g"], ["k"], parts=3), ["g"], total="n")
    seg = ordered.fill_around(ordered.following(ordered.previous(seg, ["g"], ["v"]), ["g"], ["v"]), ["g"], F.when(F.col("k") == 2, F.col("v")), "b", "a")
    got = rows(seg.select(F.coalesce("g", F.lit("")), "k", "idx", "n", "prev_v", "next_v", "b", "a"))
    assert got == [
        ("", 1, 0, 3, None, 22, None, 22), ("", 2, 1, 3, 11, 30, 22, 22), ("", 3, 2, 3, 22, None, 22, None),
        ("a", 1, 0, 2, None, 20, None, 20), ("a", 2, 1, 2, 10, None, 20, 20),
    ]
