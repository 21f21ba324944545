"""Frame folders: what is listed, read, streamed and written."""

import os

import numpy as np
import pytest
from conftest import rows

from framepair.sources import folder, images, png
from framepair.streaming import runs

RNG = np.random.default_rng(0)
FRAME = "name string, height int, width int, px array<int>"


@pytest.fixture(scope="module")
def frames(spark):
    folder.register(spark)
    return spark.createDataFrame([(f"{i:03d}.png", 5, 7, RNG.integers(0, 256, 35 if i % 2 else 105).tolist()) for i in range(12)], FRAME)


def test_round_trip_through_both_readers(spark, frames, tmp_path):
    path = str(tmp_path / "f")
    frames.repartition(3).write.format("frames").mode("append").save(path)
    frames.limit(4).write.format("frames").mode("append").save(path)  # the same frames again
    assert sorted(os.listdir(path)) == [f"{i:03d}.png" for i in range(12)]
    back = spark.read.format("frames").load(path)
    assert rows(back, "name", "height", "width", "px") == rows(frames)
    assert rows(images.read_frames(spark, path), "name", "height", "width", "px") == rows(frames)
    assert {(r.channels, r.depth) for r in back.collect()} == {(1, 8), (3, 8)}


@pytest.mark.parametrize("channels", [1, 3])
@pytest.mark.parametrize("depth", [8, 16])
def test_encoded_frames_decode(channels, depth):
    image = RNG.integers(0, 1 << depth, (6, 9, channels))
    blob = folder.encode(image, depth)
    assert (png.decode(blob).reshape(image.shape) == image).all() and folder.sizes_of(blob) == (6, 9, channels, depth)
    with pytest.raises(ValueError):
        folder.encode(np.zeros((2, 2, 2)), depth)


def test_only_what_the_schema_asks_for_is_read(spark, tmp_path, monkeypatch):
    good = folder.encode(RNG.integers(0, 256, (4, 4, 1)))
    (tmp_path / "a.png").write_bytes(good)
    (tmp_path / "cut.png").write_bytes(good[:40])  # sizes can be read, pixels cannot
    (tmp_path / "none.tif").write_bytes(b"nothing")
    (tmp_path / f"{folder.HIDDEN}x.png").write_bytes(good)
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.PNG").write_bytes(good)
    folder.register(spark)
    read = lambda schema, **o: rows(spark.read.format("frames").options(**o).schema(schema).load(str(tmp_path)))
    assert read("name string, length long") == [("a.png", len(good)), ("cut.png", 40), ("none.tif", 7)]
    assert rows(spark.read.format("frames").schema("name string, height int").load(str(tmp_path)).where("height is not null")) == [("a.png", 4), ("cut.png", 4)]
    assert [r[1] for r in read("name string, px array<int>") if r[0] != "a.png"] == [None, None]
    assert [r[0] for r in read("name string", recursive="true")] == ["a.png", "b.PNG", "cut.png", "none.tif"]
    with pytest.raises(Exception, match="no such columns"):
        read("name string, colour int")


def test_sizes_of_other_formats():
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x10\x00\x20\x03"
    bmp = b"BM" + bytes(16) + (7).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"\x01\x00\x18\x00"
    assert folder.sizes_of(jpeg) == (16, 32, 3, 8) and folder.sizes_of(bmp) == (5, 7, 3, 8)
    assert folder.sizes_of(b"") is None and folder.sizes_of(b"\xff\xd8\xff") is None


def test_files_are_grouped_by_size():
    files = [(f"{i}", size, 0) for i, size in enumerate([10 << 20, 70 << 20, 1, 1, 1, 30 << 20])]
    parts = folder.grouped(files, 64 << 20)
    assert sorted(f for p in parts for f in p.files) == sorted(files)
    assert all(len(p.files) == 1 or sum(f[1] + folder.OPEN_COST for f in p.files) <= 64 << 20 for p in parts) and len(parts) == 3


def test_a_stream_takes_each_file_once(spark, frames, tmp_path):
    path, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    for lo in (0, 5, 12):
        frames.where(f"int(substr(name, 1, 3)) between {lo} and {lo + 4}").write.format("frames").mode("append").save(path)
        stream = spark.readStream.format("frames").schema(FRAME).load(path)
        runs.catch_up(stream, out, ckpt)
    assert rows(spark.read.parquet(out), "name", "px") == [r[::3] for r in rows(frames) if r[0] < "010.png"]


def test_faulty_frames_are_not_written(spark, tmp_path):
    folder.register(spark)
    for name, schema in (("a/b.png", FRAME), ("x.png", "name string, height int, px array<int>")):
        row = (name, 1, 1, [0]) if schema == FRAME else (name, 1, [0])
        with pytest.raises(Exception, match="not a file name|a frame needs"):
            spark.createDataFrame([row], schema).write.format("frames").mode("append").save(str(tmp_path / "bad"))


def test_many_small_files_are_read_by_few_tasks(spark, tmp_path):
    folder.register(spark)
    path, n = str(tmp_path / "many"), 400
    spark.createDataFrame([(f"{i:03d}.png", 1, 2, [i % 256, 7]) for i in range(n)], FRAME).coalesce(2).write.format("frames").mode("append").save(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        for f in (images.read_rgb(spark, path), images.list_images(spark, path)):
            assert f.rdd.getNumPartitions() <= images.LEAST_TASKS * spark.sparkContext.defaultParallelism < n
            assert rows(f, "name") == [(f"{i:03d}.png",) for i in range(n)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
