"""Frame folders as a Spark data source: ``spark.read``, ``readStream`` and ``write`` with format ``frames``.

    register(spark)
    spark.read.format("frames").schema("name string, height int, width int").load(path)
    spark.readStream.format("frames").load(path)
    table.write.format("frames").mode("append").save(path)

* Files are listed once and grouped into partitions by size. A reader does what its schema
  asks for: names and lengths open no file, sizes read the first bytes of each, only ``px`` decodes.
* The stream's offset is the time and path of the last file, so a trigger lists the folder and
  takes the files behind it; files must arrive in the order of their times. ``settleSeconds`` leaves out files that
  are still too young.
* A writer's task writes each frame as PNG under another name and renames it, so a reader
  never sees half a frame and a task that runs again replaces its own files.

A file that cannot be decoded is a row with NULL sizes and pixels. Paths are those of
``pyarrow.fs`` (local or mounted folders, hdfs://, s3://, gs://), seen alike by all executors.
"""

from __future__ import annotations

import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import Row, StructType

from framepair.functions.names import IMAGE_EXTENSIONS
from framepair.sources import png, tiff

SCHEMA = "path string, name string, length bigint, modified timestamp, height int, width int, channels int, depth int, px array<int>"
SIZES, PIXELS = ("height", "width", "channels", "depth"), "px"
HEAD = 1 << 16  # bytes that hold the sizes of most files
PARTITION, OPEN_COST, BATCH = 64 << 20, 1 << 20, 16 << 20
HIDDEN = ".framepair-"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameFolder)


@dataclass
class Files(InputPartition):
    """Files of one task: path, length and time in nanoseconds."""

    files: list[tuple[str, int, int]]

    def __init__(self, files: list[tuple[str, int, int]]) -> None:
        self.files = files


def file_system(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def listed(path: str, recursive: bool) -> list[tuple[str, int, int]]:
    """Image files of a folder by time, then path."""
    from pyarrow import fs

    system, root = file_system(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=False, recursive=recursive))
    keep = [f for f in found if f.is_file and f.extension.lower() in IMAGE_EXTENSIONS and not f.base_name.startswith(HIDDEN)]
    return sorted(((f.path, f.size, f.mtime_ns or 0) for f in keep), key=lambda f: (f[2], f[0]))


def grouped(files: list[tuple[str, int, int]], limit: int) -> list[Files]:
    """Partitions of about ``limit`` bytes; opening a file counts as some of them."""
    out: list[Files] = []
    room = 0
    for f in sorted(files):
        cost = f[1] + OPEN_COST
        if not out or cost > room:
            out.append(Files([]))
            room = limit
        out[-1].files.append(f)
        room -= cost
    return out


def sizes_of(head: bytes) -> tuple[int, int, int, int] | None:
    """Height, width, channels and bits a sample from a file's first bytes, where the format allows it."""
    try:
        if head[:8] == png.SIGNATURE:
            width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
            return height, width, {0: 1, 2: 3, 3: 3, 4: 1, 6: 4}[colour], max(8, depth)
        if head[:2] == b"BM":
            width, height, _, bits = struct.unpack("<iiHH", head[18:30])
            return abs(height), width, max(1, bits // 8), 8
        if head[:2] == b"\xff\xd8":
            at = 2
            while head[at] == 0xFF:
                kind, size = head[at + 1], struct.unpack(">H", head[at + 2 : at + 4])[0]
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    bits, height, width, channels = struct.unpack(">BHHB", head[at + 4 : at + 10])
                    return height, width, channels, bits
                at += 2 + size
    except (struct.error, KeyError, IndexError):
        pass
    return None


def decoded(blob: bytes) -> np.ndarray | None:
    return png.decode(blob) if blob[:8] == png.SIGNATURE else tiff.decode(blob)


class FrameFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("frames are appended: write to a new folder instead of overwriting one")
        return _Writer(schema, self.options)


class _Files:
    """What both readers share."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.names, self.arrow = schema.names, to_arrow_schema(schema)
        unknown = set(self.names) - {c.split()[0] for c in SCHEMA.split(", ")}
        if unknown:
            raise ValueError(f"no such columns in a frame folder: {sorted(unknown)}")
        self.path, self.recursive = options["path"], options.get("recursive", "false").lower() == "true"
        self.limit = int(options.get("partitionBytes", PARTITION))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        rows: list[dict] = []
        held = 0
        for path, length, modified in partition.files:
            row = {"path": path, "name": path.rsplit("/", 1)[-1], "length": length, "modified": modified // 1000}
            row |= self.content(system, path)
            rows.append(row)
            held += 4 * len(row.get(PIXELS) if row.get(PIXELS) is not None else ()) + 256
            if held >= BATCH:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def content(self, system, path: str) -> dict:
        wants_pixels = PIXELS in self.names
        if not wants_pixels and not set(SIZES) & set(self.names):
            return {}
        with system.open_input_file(path) as f:
            head = f.read(HEAD)
            found = sizes_of(head)
            if wants_pixels or found is None:
                image = decoded(head + f.read())
                if image is not None:
                    found = (image.shape[0], image.shape[1], 1 if image.ndim == 2 else image.shape[2], image.itemsize * 8)
                elif wants_pixels:
                    found = None
                pixels = image.ravel().astype(np.int32) if image is not None else None
            else:
                pixels = None
        return dict(zip(SIZES, found or (None,) * 4, strict=True)) | {PIXELS: pixels}

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], self.arrow.field(n).type) for n in self.names], schema=self.arrow)


class _Reader(_Files, DataSourceReader):
    def partitions(self) -> list[Files]:
        return grouped(listed(self.path, self.recursive), self.limit)


class _Stream(_Files, DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        super().__init__(schema, options)
        self.settle = float(options.get("settleSeconds", 0))

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        old = time.time_ns() - int(self.settle * 1e9)
        files = [f for f in listed(self.path, self.recursive) if not self.settle or f[2] <= old]
        return {"time": files[-1][2], "path": files[-1][0]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        key = lambda o: (o["time"], o["path"])
        return grouped([f for f in listed(self.path, self.recursive) if key(start) < (f[2], f[0]) <= key(end)], self.limit)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    files: int

    def __init__(self, files: int) -> None:
        self.files = files


class _Writer(DataSourceWriter):
    """Rows of ``name, height, width, px`` and optionally ``channels`` (1 or 3, BGR) and ``depth`` (8 or 16)."""

    def __init__(self, schema: StructType, options: dict) -> None:
        missing = {"name", "height", "width", "px"} - set(schema.names)
        if missing:
            raise ValueError(f"a frame needs {sorted(missing)}")
        self.path, self.names = options["path"], set(schema.names)

    def write(self, rows: Iterator[Row]) -> Written:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        n = 0
        for r in rows:
            if "/" in r["name"] or not r["name"]:
                raise ValueError(f"not a file name: {r['name']!r}")
            channels = r["channels"] if "channels" in self.names else len(r["px"]) // (r["height"] * r["width"])
            depth = r["depth"] if "depth" in self.names and r["depth"] else 8
            blob = encode(np.asarray(r["px"]).reshape(r["height"], r["width"], channels), depth)
            hidden = f"{root}/{HIDDEN}{uuid.uuid4().hex}"
            with system.open_output_stream(hidden) as f:
                f.write(blob)
            system.move(hidden, f"{root}/{r['name']}")
            n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        pass

    def abort(self, messages: list[Written | None]) -> None:
        """Whole frames that were written stay: a run after it replaces them."""


def encode(image: np.ndarray, depth: int = 8) -> bytes:
    """PNG bytes of ``[h, w, 1]`` or BGR ``[h, w, 3]`` values."""
    h, w, c = image.shape
    if c not in (1, 3) or depth not in (8, 16):
        raise ValueError(f"cannot write {c} channels of {depth} bits")
    plain = image[..., ::-1] if c == 3 else image
    lines = np.ascontiguousarray(plain).astype(">u2" if depth == 16 else np.uint8).reshape(h, -1).view(np.uint8)
    body = zlib.compress(np.concatenate([np.zeros((h, 1), np.uint8), lines], axis=1).tobytes())
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, depth, 2 if c == 3 else 0, 0, 0, 0)
    return png.SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")
