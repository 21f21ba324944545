import base64
import gzip
import hashlib
import random

import pyarrow.fs as pafs
import pytest

from framepair.llm import warc
from framepair.llm.common import staging_path

PAGES = [
    (5, "http://a.example.com/x", "same"), (2, "http://www.b.example.com/?q=1", "same"), (9, "HTTP://A.Example.com/x", "same"), (1, None, None), (3, "http://a.example.com/x\r\ny", ""),
    (4, "no scheme", "é" * 10), (4, "no scheme", "é" * 10), (None, "http://c.org/", "same"), (None, "http://c.org/", "other\r\n\r\nWARC/1.1\r\n\r\n"), (7, "http://c.org/", "big" * 50000), (6, "http://c.org/", "é" * 10),
]


def run(spark, pages, least=0):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    root = staging_path(spark, "warc")
    manifest = warc.materialise(warc.write_warc(warc.assign(df, least), root, 5), "manifest")
    return manifest, root, warc.merge_runs(warc.read_warc(manifest, root), 4)


def expected(pages, least=0):
    first = {}
    for i, _, h in pages:
        p = (h or "").encode()
        first[p] = min((x for x in (first.get(p), i) if x is not None), default=None)
    out = []
    for i, _, h in pages:
        p = (h or "").encode()
        later = len(p) >= least and first[p] is not None and i != first[p]
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if later else "response", first[p] if later else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    manifest, root, merged = run(spark, PAGES, least)
    got = merged.collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == expected(PAGES, least)
    order = [warc.order_of(r.asDict()) for r in sorted(got, key=lambda r: (r["merge_range"], r["merge_position"]))]
    assert order == sorted(order)
    assert manifest.count() > 1


def test_files_are_plain_archives(spark):
    manifest, root, _ = run(spark, PAGES)
    fs, _ = warc.place(root)
    whole = b"".join(gzip.decompress(fs.open_input_file(r["path"]).read()) for r in manifest.collect())
    assert isinstance(fs, pafs.FileSystem) and whole.count(b"WARC/1.1\r\nWARC-Type: ") == len(PAGES)


def test_a_changed_payload_is_found():
    good = warc.record(1, "http://a/", b"abc", hashlib.sha1(b"abc").digest(), None)
    assert warc.parse(good)["payload_bytes"] == 3
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"abc", b"abd"))


def test_empty_table(spark):
    _, _, merged = run(spark, [])
    assert merged.collect() == []


def test_loser_tree_merges_any_number_of_runs():
    r = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16, 33):
        runs = [sorted(r.randrange(20) for _ in range(r.randrange(30))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(sum(runs, []))


def test_url_keys():
    assert warc.url_key("http://www.Ab.example.com/P?q#f") == "com,example,ab)/P?q"
    assert warc.url_key(None) == warc.url_key("none") == ""
