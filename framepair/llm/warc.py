"""WARC archives with revisit records, and capture histories by an external index merge.

``write_warc`` streams each task's rows into gzip-per-record files of bounded
size under a shared folder and returns the manifest; a file counts only if a
finished task lists it, so a task that dies or runs twice leaves no double
records. ``read_warc`` reads the listed files record by record, checks every payload
against its digest and gives each file's captures sorted by URL key, time
and page: one *run* per file. ``merge_runs`` range-partitions the runs by that order
(a URL with very many captures spreads over ranges, since time and page are part of
the key) and merges the k runs that meet in a range with a loser tree.

Of equal payloads of at least ``least_bytes`` bytes the smallest page id is the
response and the others revisit it. A null payload is empty. A null page id is never the
response unless all ids of its payload are null. Rows that repeat a page id and payload
are all responses, or all revisits. A null URL has an empty key.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framepair.llm.common import materialise, query, splittable, staging_path, table

FILE_BYTES = 16 << 20  # payload bytes after which a new file is begun
RANGE_ROWS = 20_000  # captures a merge task holds
LEAST_RANGES = 8
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def capture_date(page_id: int | None) -> str:
    """Pages carry no time; a page's id in seconds stands for one."""
    return (EPOCH + timedelta(seconds=(page_id or 0) % 100_000_000)).strftime("%Y-%m-%dT%H:%M:%SZ")


def header_safe(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url)


def url_key(url: str | None) -> str:
    """Host labels reversed, then the rest: ``com,example)/path?query``."""
    rest = (url or "").partition("://")[2]
    if not rest:
        return ""
    host, tail = re.match(r"([^/?#]*)([^#]*)", rest, re.S).groups()
    labels = host.lower().removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + ")" + tail


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {capture_date(page_id)}", f"WARC-Payload-Digest: sha1:{base32(sha1)}", "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {header_safe(url)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def place(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root)


# -- which records revisit ---------------------------------------------------
def assign(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, sha1, refers_to``: null for responses."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    seen = pages.select("page_id", "url", "html", F.unhex(F.sha1(payload)).alias("sha1"))
    light = seen.select("page_id", "sha1", F.octet_length(payload).alias("size"))
    first = light.groupBy("sha1").agg(F.min("page_id").alias("first"))
    known = light.join(splittable(first, "sha1", F.col("first").isNotNull()), "sha1")
    later = known.where((F.col("size") >= least_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    later = later.select(F.col("page_id").alias("_p"), F.col("sha1").alias("_s"), F.col("first").alias("refers_to")).distinct()
    return seen.join(later, seen["page_id"].eqNullSafe(F.col("_p")) & (seen["sha1"] == F.col("_s")), "left").drop("_p", "_s")


# -- writing and reading ------------------------------------------------------
def write_warc(assigned: DataFrame, root: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives under ``root`` and returns ``(path, records)`` of every file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = place(root)
        out, path, size, n = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [n]})

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                page_id, url, html, sha1, refers_to = row
                if out is None:
                    fs.create_dir(folder, recursive=True)
                    path, size, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                payload = (html or "").encode("utf-8", "surrogatepass")
                out.write(member(record(page_id, url, payload, sha1, refers_to)))
                size, n = size + len(payload), n + 1
                if size >= file_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return assigned.select("page_id", "url", "html", "sha1", "refers_to").mapInArrow(run, "path string, records long")


class Members:
    """The gzip members of a stream, each with where it starts; one is held at a time."""

    def __init__(self, stream: pa.NativeFile) -> None:
        self.stream, self.rest, self.at = stream, b"", 0

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        while self.rest or (more := self.stream.read(1 << 18)):
            if not self.rest:
                self.rest = more
            z, out, start, fed = zlib.decompressobj(31), [], self.at, 0
            while not z.eof:
                if not self.rest and not (data := self.stream.read(1 << 18)):
                    raise ValueError("archive ends within a record")
                self.rest, data = b"", self.rest or data
                out.append(z.decompress(data))
                fed += len(data)
            self.rest = z.unused_data
            self.at = start + fed - len(self.rest)
            yield start, b"".join(out)


def parse(data: bytes) -> dict:
    """Page, URL key, time and payload facts of one record; a wrong digest raises."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda s: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", s)) else None
    if fields["WARC-Type"] == "response" and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return {
        "url_key": url_key(fields.get("WARC-Target-URI")), "capture_time": fields["WARC-Date"], "page_id": number(fields["WARC-Record-ID"]),
        "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To", "")),
    }


def order_of(c: dict) -> tuple:
    return c["url_key"], c["capture_time"], c["page_id"] if c["page_id"] is not None else -(1 << 63)


CAPTURE = pa.schema(
    [("url_key", pa.string()), ("capture_time", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("record_type", pa.string()), ("refers_to", pa.int64()), ("run", pa.string()), ("offset", pa.int64())]
)
CAPTURE_DDL = "url_key string, capture_time string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, run string, offset long"


def read_warc(manifest: DataFrame, root: str) -> DataFrame:
    """The captures of all listed files; each file's are a sorted run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = place(root)
        for batch in batches:
            for path, records in zip(*[batch.column(c).to_pylist() for c in ("path", "records")], strict=True):
                with fs.open_input_stream(path, compression=None) as stream:
                    found = [parse(data) | {"run": path.rsplit("/", 1)[-1], "offset": at} for at, data in Members(stream)]
                if len(found) != records:
                    raise ValueError(f"{path} holds {len(found)} of {records} records")
                yield pa.RecordBatch.from_pylist(sorted(found, key=order_of), CAPTURE)

    return manifest.select("path", "records").mapInArrow(run, CAPTURE_DDL)


# -- merging ------------------------------------------------------------------
class LoserTree:
    """Merges sorted iterables: each step replays one leaf's path, one comparison a level."""

    def __init__(self, runs: list[Iterable], key) -> None:
        self.runs, self.key, self.k = [iter(r) for r in runs], key, len(runs)
        self.items = [next(r, None) for r in self.runs]
        self.losers = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self.replay(leaf)

    def less(self, a: int, b: int) -> bool:
        """An exhausted run loses; ties go to the earlier run. -1 wins while the tree is built."""
        if a < 0 or b < 0:
            return a < b
        x, y = self.items[a], self.items[b]
        if x is None or y is None:
            return x is not None
        return (self.key(x), a) < (self.key(y), b)

    def replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            if self.less(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and (item := self.items[leaf := self.losers[0]]) is not None:
            yield item
            self.items[leaf] = next(self.runs[leaf], None)
            self.replay(leaf)


def merge_runs(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in one order: by ``(merge_range, merge_position)``."""
    total = captures.count()
    ranges = max(LEAST_RANGES, -(-total // range_rows))
    dealt = captures.repartitionByRange(ranges, "url_key", "capture_time", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                runs.setdefault(row["run"], []).append(row)
        # Blocks of a run may arrive in any order, so its share is put in order again.
        merged = LoserTree([sorted(runs[r], key=order_of) for r in sorted(runs)], order_of)
        at, held = 0, []
        number = TaskContext.get().partitionId() if TaskContext.get() else 0
        for row in merged:
            held.append(row | {"merge_range": number, "merge_position": at})
            at += 1
            if len(held) == 4096:
                yield pa.RecordBatch.from_pylist(held, MERGED)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, MERGED)

    return dealt.mapInArrow(run, f"{CAPTURE_DDL}, merge_range long, merge_position long")


MERGED = pa.schema([*CAPTURE, ("merge_range", pa.int64()), ("merge_position", pa.int64())])


@query("op4_warc_captures")
def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = staging_path(spark, "warc")
    manifest = materialise(write_warc(assign(table(spark, sf_dir, "pages")), root), "manifest")
    # One file, one task: as many tasks as files, within reason for the scheduler.
    files = max(1, manifest.count())
    captures = materialise(read_warc(manifest.repartition(min(files, 10_000)), root), "captures")
    return merge_runs(captures).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_time", "merge_range", "merge_position"
    )
