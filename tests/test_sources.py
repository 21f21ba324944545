import json
import os
import struct
import zlib

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from framepair.functions.norm import ThermalNorm
from framepair.sources import commits, images, png, sinks, tables


def write_png(path, image, filters=(0, 1, 2, 3, 4)):
    """Minimal PNG writer cycling through the row filters; colour input is BGR(A)."""
    depth = image.itemsize
    x = image if image.ndim == 3 else image[..., None]
    h, w, c = x.shape
    if c >= 3:
        x = np.concatenate([x[..., 2::-1], x[..., 3:]], axis=2)
    raw = np.ascontiguousarray(x).astype(">u2" if depth == 2 else np.uint8).tobytes()
    stride, step = w * c * depth, c * depth
    out, above = b"", bytes(stride)
    for y in range(h):
        row = raw[y * stride : (y + 1) * stride]
        kind = filters[y % len(filters)]
        line = bytearray()
        for i, v in enumerate(row):
            a = row[i - step] if i >= step else 0
            b, d = above[i], above[i - step] if i >= step else 0
            p = a + b - d
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
            line.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        out += bytes([kind]) + bytes(line)
        above = row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", w, h, depth * 8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(png.SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b""))


RNG = np.random.default_rng(1)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("images"))
    made = {
        "grey8.png": RNG.integers(0, 256, (7, 5), np.uint8),
        "grey16.png": RNG.integers(0, 65536, (6, 9), np.uint16),
        "bgr.png": RNG.integers(0, 256, (5, 6, 3), np.uint8),
        "bgra.png": RNG.integers(0, 256, (5, 4, 4), np.uint8),
        "flat.PNG": np.full((3, 3), 77, np.uint8),
    }
    for name, image in made.items():
        write_png(f"{root}/{name}", image)
    with open(f"{root}/broken.png", "wb") as f:
        f.write(png.SIGNATURE + b"junk")
    with open(f"{root}/notes.txt", "w") as f:
        f.write("x")
    return root, made


def test_listing(spark, folder):
    root, made = folder
    assert rows(images.list_images(spark, root), "name") == sorted((n,) for n in [*made, "broken.png"])


def test_full_depth_frames(spark, folder):
    root, made = folder
    got = {r.name: r for r in images.read_frames(spark, root).collect()}
    for name, image in made.items():
        r = got[name]
        assert (r.height, r.width, r.depth) == (*image.shape[:2], image.itemsize * 8)
        assert r.px == image.ravel().tolist()
    assert got["broken.png"].px is None and got["broken.png"].height is None


def test_thermal_reader(spark, folder):
    root, made = folder
    got = {r.name: r for r in images.read_thermal(spark, root).collect()}
    assert got["grey16.png"].px == made["grey16.png"].ravel().tolist() and got["grey16.png"].channels == 1
    want = np.rint(made["bgr.png"] @ np.array([0.114, 0.587, 0.299])).ravel()
    assert got["bgr.png"].px == want.astype(int).tolist()


def test_colour_reader(spark, folder):
    root, made = folder
    got = {r.name: r for r in images.read_rgb(spark, root).collect()}
    assert got["bgr.png"].px == made["bgr.png"].ravel().tolist() and got["bgr.png"].channels == 3
    assert got["flat.PNG"].px == [77] * 27
    assert got["bgra.png"].px == made["bgra.png"][..., :3].ravel().tolist()
    assert got["broken.png"].height is None


def write_tiff(path, image, order="<", deflate=False, predictor=1, rows_each=3):
    x = image if image.ndim == 3 else image[..., None]
    h, w, c = x.shape
    if c >= 3:
        x = np.concatenate([x[..., 2::-1], x[..., 3:]], axis=2)
    if predictor == 2:
        x = np.concatenate([x[:, :1], np.diff(x, axis=1)], axis=1)
    kind = f"{order}u{x.itemsize}"
    strips = [x[i : i + rows_each].astype(kind).tobytes() for i in range(0, h, rows_each)]
    strips = [zlib.compress(s) for s in strips] if deflate else strips
    at = [8 + sum(map(len, strips[:i])) for i in range(len(strips))]
    tags = [(256, 3, [w]), (257, 4, [h]), (258, 3, [x.itemsize * 8] * c), (259, 3, [8 if deflate else 1]), (273, 4, at), (277, 3, [c]), (279, 4, [len(s) for s in strips]), (317, 3, [predictor]), (306, 2, [0])]
    start = 8 + sum(map(len, strips))
    extra, entries = b"", b""
    for tag, k, v in tags:
        body = struct.pack(f"{order}{len(v)}{ {2: 'B', 3: 'H', 4: 'I'}[k] }", *v)
        if len(body) > 4:
            body, extra = struct.pack(f"{order}I", start + 2 + 12 * len(tags) + 4 + len(extra)), extra + body
        entries += struct.pack(f"{order}HHI", tag, k, len(v)) + body.ljust(4, b"\0")
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(f"{order}I", start)
    with open(path, "wb") as f:
        f.write(head + b"".join(strips) + struct.pack(f"{order}H", len(tags)) + entries + bytes(4) + extra)


def test_tiff_and_bmp_frames(spark, tmp_path):
    deep, colour, grey = RNG.integers(0, 65536, (8, 5), np.uint16), RNG.integers(0, 256, (7, 4, 3), np.uint8), RNG.integers(0, 256, (4, 6), np.uint8)
    write_tiff(tmp_path / "a.tiff", deep)
    write_tiff(tmp_path / "b.tif", deep, ">", True, 2)
    write_tiff(tmp_path / "c.TIF", colour, "<", True)
    (tmp_path / "broken.tif").write_bytes(b"II*\0" + bytes(40))
    # A 24-bit bitmap: rows from the bottom, padded to four bytes.
    h, w = grey.shape
    body = b"".join(np.repeat(r, 3).tobytes() + bytes(-3 * w % 4) for r in grey[::-1])
    (tmp_path / "d.bmp").write_bytes(b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body)
    got = {r.name: r for r in images.read_frames(spark, str(tmp_path)).collect()}
    for name in ("a.tiff", "b.tif"):
        assert (got[name].height, got[name].width, got[name].channels, got[name].depth) == (8, 5, 1, 16) and got[name].px == deep.ravel().tolist()
    assert got["c.TIF"].px == colour.ravel().tolist() and got["c.TIF"].depth == 8
    assert got["d.bmp"].px == np.repeat(grey.ravel(), 3).tolist() and got["d.bmp"].channels == 3
    assert got["broken.tif"].px is None and len(got) == 5


def test_timed_frames(spark, folder):
    t = images.timed_frames(spark, folder[0], 25.0)
    assert rows(t, "idx", "t_us")[:3] == [(0, 0), (1, 40000), (2, 80000)]
    with pytest.raises(ValueError):
        images.timed_frames(spark, folder[0], 0)


def test_sessions_in_a_tree(spark):
    paths = ["a/s1/RGB/1.png", "a/s1/NIR/1.png", "a/s1/RGB-1/1.png", "a/s1/NIR_1/1.png", "a/s2/RGB-2/1.png", "a/s2/NIR-2/1.png",
             "a/s1/RGB/deep/RGB/1.png", "a/s1/RGB/deep/NIR/1.png", "b/s3/RGB/1.png"]
    df = spark.createDataFrame([("/r/" + p,) for p in paths], "path string")
    assert rows(images.discover_sessions(df)) == [("s1", "/r/a/s1", ""), ("s2", "/r/a/s2", "-2")]


def test_last_line_wins_by_file_and_place(spark, tmp_path):
    for name, value in (("a.csv", "x.png,1\nx.png,2\n"), ("b.csv", "x.png,7\ny.png,3\n"), ("c.csv", "y.png,4\n")):
        (tmp_path / name).write_text(value)
    t = tables.read_temperatures(spark, str(tmp_path)).repartition(3)
    assert {r.stem: r.celsius for r in t.collect()} == {"x": 7.0, "y": 4.0}


def test_temperatures(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a.png,1.5\n,9\nb.png\nc.tif, 2 ,x\na.jpg,3\n\n")
    t = tables.read_temperatures(spark, str(tmp_path / "t.csv"))
    assert rows(t) == [("a", 3.0), ("c", 2.0)]
    (tmp_path / "h.csv").write_text("filename,celsius\na.png,1\n")
    with pytest.raises(Exception, match="not a temperature"):
        tables.read_temperatures(spark, str(tmp_path / "h.csv")).collect()


def test_points(spark, tmp_path):
    record = {"rgb": [[20, 20], [300, 20], [300, 220]], "thermal": [[2, 4], [142, 4]], "_frame": "000000.png", "_rgb_size": [320, 240]}
    (tmp_path / "flight.json").write_text(json.dumps(record, indent=2))
    got = rows(tables.read_points(spark, str(tmp_path)), "rec_id", "i", "x", "y")
    assert got[1] == ("flight", 1, 300.0, 20.0)
    assert tables.read_points(spark, str(tmp_path)).where("u is null").count() == 1


def test_log_lines(spark):
    lines = ["[e000 i00200] D=0.332 G_gan=0.323 G_L1=12.450", "[e000] val L1 = 0.1434 | 212.3s", "  [e001 i00200] D=1 G_gan=1 G_L1=1", "saved"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert rows(tables.log_iterations(df)) == [(0, 200, 0.332, 0.323, 12.45)]
    assert rows(tables.log_epochs(df)) == [(0, 0.1434, 212.3)]


def test_stream_manifest_and_report(spark, tmp_path):
    day = {"file": "day.ts", "bytes": 5, "video": {"width": 3840, "measured_frames": 21348, "pts_delta_ms": {"min": 18.8, "note": "x"}}, "klv": {"packets": 3}}
    clock = {"extract_frames_offset_ms": {"value": 893, "at_end_of_recording": 897, "drift_ms_over_recording": 4, "status": "derived"}}
    (tmp_path / "m.json").write_text(json.dumps({"_comment": "c", "sync": clock, "streams": {"day": day, "ir": {"file": "ir.ts"}}}, indent=1))
    s = tables.read_streams(spark, str(tmp_path / "m.json"))
    assert rows(s, "stream", "video.measured_frames", "video.pts_delta_ms.min") == [("day", 21348, 18.8), ("ir", None, None)]
    assert rows(tables.read_sync(spark, str(tmp_path / "m.json"))) == [(893.0, 897.0, 4.0, "derived")]
    report = {"root": "/d", "sessions": {"a": {"split": "val", "pairs": 3}}, "val_sessions": ["a"], "skipped": ["t"], "counts": {"train": 0, "val": 3}}
    (tmp_path / "r.json").write_text(json.dumps(report))
    assert rows(tables.report_sessions(tables.read_split_report(spark, str(tmp_path / "r.json")))) == [("a", "val", 3)]
    assert rows(tables.read_skipped(spark, tables.read_split_report(spark, str(tmp_path / "r.json")))) == [("t",)]


def test_reject_texts_are_kept_beside_the_report(spark, tmp_path):
    sessions = spark.createDataFrame([("a", "val", 3), ("b", "train", 4)], "session string, split string, pairs long")
    for n in (0, 500):
        rejects = spark.range(n).selectExpr("concat('a/', lpad(id, 4, '0'), '.png: unreadable') as text", "id")
        path = str(tmp_path / str(n))
        sinks.write_split_report(sessions, "/d", rejects, path)
        report = tables.read_split_report(spark, f"{path}/report")
        r = report.first()
        assert (r.n_skipped, r.skipped, r.counts.val, r.counts.train) == (n, [], 3, 4)
        assert rows(tables.read_skipped(spark, report)) == rows(rejects, "text")


def test_resumable_append(spark, tmp_path):
    path = str(tmp_path / "out")
    assert commits.append_missing(spark.range(5), path, ["id"]) == 0
    assert commits.append_missing(spark.range(8), path, ["id"]) == 1
    assert rows(commits.read_committed(spark, path, "id long")) == [(i,) for i in range(8)]


def test_interleaved_and_lost_runs_leave_each_key_once(spark, tmp_path):
    path = str(tmp_path / "out")
    wave = lambda lo, hi, w: spark.range(lo, hi).selectExpr("id", f"{w} as wave")
    assert commits.read_committed(spark, path, "id long").count() == 0
    one, two, lost = commits.Append(wave(0, 6, 1), path, ["id"]), commits.Append(wave(3, 9, 2), path, ["id"]), commits.Append(wave(0, 99, 3), path, ["id"])
    assert (two.commit(), one.commit()) == (0, 1)
    # A run that never commits leaves no rows; one that runs again goes on from the list.
    assert rows(commits.read_committed(spark, path, lost.schema)) == [*((i, 1) for i in range(3)), *((i, 2) for i in range(3, 9))]
    assert commits.append_missing(wave(0, 10, 4), path, ["id"]) == 2
    assert rows(commits.read_committed(spark, path, lost.schema).where("wave = 4")) == [(9, 4)]
    assert sorted(p.name for p in (tmp_path / "out" / "_commits").iterdir() if not p.name.startswith(".")) == [f"{i:012d}" for i in range(3)]


def test_sixteen_bit_copies(spark):
    df = spark.createDataFrame([("a", [-1.0, 0.0, 1.0])], "stem string, px array<double>")
    assert rows(sinks.with_16bit(df, ThermalNorm()), "bit_depth", "file", "counts") == [(8, "a.png", [0, 127, 255]), (16, "a_16bit.png", [0, 32767, 65535])]


def test_run_record(spark, tmp_path):
    sinks.write_record(sinks.run_record(spark, {"mode": "single", "cap": None}, ThermalNorm("abs16")), str(tmp_path / "c"))
    r = spark.read.schema("args map<string,string>, thermal_norm struct<mode: string, tmax: double>").json(str(tmp_path / "c")).first()
    assert r.args == {"mode": "single", "cap": None} and r.thermal_norm.tmax == 80 and r.thermal_norm.mode == "abs16"
