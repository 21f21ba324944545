"""Passages of ``WORDS`` words that are met more than once, as word spans of every text.

A word goes if ``WORDS`` words in a row over it also start anywhere else. Words are runs
of bytes other than white space and are compared by their bytes, so line breaks do not matter.

The buckets and contexts are those of ``substrings.py`` with words in place of bytes: the bucket
of a window is its least-hashed run of ``RUN`` words, windows with the same such run form
a context, and a bucket met once cannot hold a repeat. A bucket whose contexts are all one
repeats as a whole. Of the others the windows of each different context are counted by 128-bit
fingerprints, combined before the shuffle. Nothing is gathered by bucket, so none is too hot.

A text is held whole by one task. Texts are known by two 64-bit hashes of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framepair.llm.common import Staging, materialise, splittable
from framepair.llm.textnum import BASE, INVERSE, NOT_SPACE, PIECE, U64, Texts, mix, pieces, powers, tidy, window_hashes

WORDS, RUN = 51, 16
SHARE = 1 << 18  # words that are looked at together
PLACE = U64(24)  # low bits that hold a position while minima are sought


def words_of(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, their rows, and the number of each row's first word."""
    starts, ends, row = t.runs(NOT_SPACE[t.data])
    return starts, ends, row, np.searchsorted(row, np.arange(t.n))


def series_hashes(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the series ``h[lo:hi]``, wherever they stand."""
    room = max(PIECE, 1 << max(0, len(h) - 1).bit_length())
    sums = np.zeros(len(h) + 1, U64)
    np.cumsum(h * powers(room, BASE)[: len(h)], out=sums[1:])
    return mix((sums[hi] - sums[lo]) * powers(room + 1, INVERSE)[lo] + (hi - lo).astype(U64))


def leftmost_least(h: np.ndarray, wide: int) -> np.ndarray:
    """Where the least of each ``wide`` neighbours stands, by the upper bits; the first of equal ones."""
    m = len(h)
    padded = np.full(-(-m // wide) * wide, np.iinfo(np.uint64).max, U64)
    padded[:m] = (h >> PLACE << PLACE) | np.arange(m, dtype=U64)
    grid = padded.reshape(-1, wide)
    left = np.minimum.accumulate(grid, 1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    q = m - wide + 1
    return (np.minimum(right[:q], left[wide - 1 : wide - 1 + q]) & U64((1 << int(PLACE)) - 1)).astype(np.int64)


def word_contexts(h: np.ndarray, row: np.ndarray, words: int, run: int) -> tuple[np.ndarray, ...]:
    """First word, windows, bucket and fingerprint of every context; ``row`` rises over the words."""
    found = []
    for base in range(0, max(1, len(h) - words + 1), SHARE):
        # A window belongs to the share it starts in; a context cut at a share's end is two contexts of one bucket.
        hs, rows = h[base : base + SHARE + words - 1], row[base : base + SHARE + words - 1]
        if len(hs) < words:
            continue
        grams = window_hashes(hs, np.arange(len(hs) - run + 1), run)
        least = leftmost_least(grams, words - run + 1)
        at = np.flatnonzero(rows[: len(hs) - words + 1] == rows[words - 1 :])
        if not len(at):
            continue
        least, of = least[at], rows[at]
        new = np.ones(len(at), bool)
        new[1:] = (least[1:] != least[:-1]) | (of[1:] != of[:-1])
        first = np.flatnonzero(new)
        lo, hi, place = at[first], at[np.append(first[1:], len(at)) - 1], least[first]
        prints = mix(series_hashes(hs, lo, hi + words) ^ mix((place - lo).astype(U64)))
        found.append((lo + base, hi - lo + 1, grams[place], prints))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(U64), none.astype(U64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def find_contexts(texts: DataFrame, words: int, run: int) -> DataFrame:
    """``(k1, k2, bucket, print, start, windows)`` of texts given as ``_k1, _k2, text``; starts are word numbers."""
    names = ["k1", "k2", "bucket", "print", "start", "windows"]

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in pieces(batch, "text"):
                starts, ends, row, first = words_of(t)
                lo, windows, bucket, prints = word_contexts(t.span_hashes(starts, ends), row, words, run)
                of = row[lo]
                keys = [part.column(c).take(pa.array(of)) for c in ("_k1", "_k2")]
                made = [bucket.view(np.int64), prints.view(np.int64), lo - first[of], windows]
                yield pa.RecordBatch.from_arrays([*keys, *[pa.array(x.astype(np.int64)) for x in made]], names=names)

    return texts.mapInArrow(tidy(contexts), ", ".join(f"{n} long" for n in names))


def window_prints(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``(bucket, print, n, windows)`` with two fingerprints of each window of the contexts ``wanted``."""
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("bucket", "print", "n", "start", "windows")).alias("wanted"))
    lists = splittable(lists, "k1", F.size("wanted") > 0)
    joined = texts.join(lists.hint("shuffle_hash"), (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2"))).select("text", "wanted")
    kind = pa.list_(pa.struct([("one", pa.int64()), ("two", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in pieces(batch, "text"):
                starts, ends, _, first = words_of(t)
                h = t.span_hashes(starts, ends)
                rows = [(w, int(first[i]) + w["start"]) for i, wants in enumerate(part.column("wanted").to_pylist()) for w in wants]
                if not rows:
                    continue
                n = np.array([w["windows"] for w, _ in rows])
                off = np.concatenate([[0], np.cumsum(n)])
                at = np.arange(off[-1]) + np.repeat(np.array([lo for _, lo in rows]) - off[:-1], n)
                one, two = series_hashes(h, at, at + words), series_hashes(mix(h ^ U64(1 << 60)), at, at + words)
                pairs = pa.StructArray.from_arrays([pa.array(x.view(np.int64)) for x in (one, two)], ["one", "two"])
                columns = [pa.array([w[c] for w, _ in rows], pa.int64()) for c in ("bucket", "print", "n")]
                windows = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pairs).cast(kind)
                yield pa.RecordBatch.from_arrays([*columns, windows], names=["bucket", "print", "n", "windows"])

    # Equal texts give the same rows; one of each is kept.
    made = joined.mapInArrow(tidy(run), "bucket long, print long, n long, windows array<struct<one:long,two:long>>")
    return made.dropDuplicates(["bucket", "print"])


def passage_spans(texts: DataFrame, words: int = WORDS, run: int = RUN) -> DataFrame:
    """``(k1, k2, passages)``: word spans to remove of every text ``_k1, _k2, text`` that has any."""
    first, staged = Staging(texts.sparkSession), Staging(texts.sparkSession)
    all_contexts = first.keep(find_contexts(texts, words, run), "word_contexts")
    buckets = all_contexts.groupBy("bucket").agg(F.count(F.lit(1)).alias("met"), (F.min("print") != F.max("print")).alias("mixed"))
    often = splittable(buckets.where(F.col("met") > 1), "bucket", F.col("met") > 1).drop("met")
    live = staged.keep(all_contexts.join(often, "bucket"), "word_live")
    first.clear()

    mixed = live.where("mixed").groupBy("bucket", "print").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "start", "windows")).alias("one"))
    found = window_prints(texts, mixed.select("bucket", "print", "n", "one.*"), words)
    windows = staged.keep(found.select("bucket", "print", "n", F.posexplode("windows").alias("w", "p")).select("bucket", "print", "n", "w", "p.*"), "word_windows")
    times = windows.groupBy("one", "two").agg(F.sum("n").alias("times")).where(F.col("times") > 1)
    hits = windows.join(splittable(times, "one", F.col("times") > 1), ["one", "two"], "left_semi")
    hits = hits.groupBy("bucket", "print").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    edge = lambda step: F.filter("ws", lambda w: ~F.array_contains("ws", w + step))
    runs = hits.select("bucket", "print", F.arrays_zip(edge(-1).alias("a"), edge(1).alias("b")).alias("runs"))

    sure = live.where("not mixed").select("k1", "k2", "start", F.lit(0).alias("a"), (F.col("windows") - 1).alias("b"))
    some = live.where("mixed").join(splittable(runs, "bucket", F.size("runs") > 0), ["bucket", "print"])
    some = some.select("k1", "k2", "start", F.inline("runs").alias("a", "b"))
    spans = sure.unionByName(some).select("k1", "k2", (F.col("start") + F.col("a")).alias("lo"), (F.col("start") + F.col("b") + words).alias("hi")).distinct()
    spans = materialise(spans.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("passages")), "passages")
    staged.clear()
    return spans
