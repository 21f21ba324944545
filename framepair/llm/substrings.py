"""Removal of repeated byte strings with a suffix array, one bucket of suffixes at a time.

A byte goes if a string of ``LENGTH`` bytes over it also starts anywhere else.

1. *Buckets.* The bucket of a window (``LENGTH`` bytes) is its least-hashed run of
   ``GRAM`` bytes, the leftmost if several are least. This depends on the window's bytes alone,
   so equal windows share a bucket. Neighbouring windows with the same such run form one
   *context*: the bytes from the first window's start to the last one's end. One map over the
   texts gives the contexts' fingerprints; a bucket met once needs nothing more.
   A bucket whose contexts are all one text is a single tie: all its windows repeat.
2. *Blocks.* The distinct contexts of the other buckets, each with its count, are
   fetched and dealt to blocks of about ``BLOCK`` bytes by bucket. A block's cover sample
   is ranked first; then its suffixes are sorted, long ties resolved by those ranks
   (``suffixes.py``). A window repeats if its neighbour in the order agrees in ``LENGTH``
   bytes, or if its context was met more than once.
3. *Hot buckets*, with more than ``HOT`` distinct contexts, would not fit a block:
   their windows are counted by 128-bit fingerprints instead, combined before the shuffle.
4. The repeated runs go back to all texts that hold the context, and each text is cut once.

Null and empty texts have no bytes; a text shorter than ``LENGTH`` keeps all.
Texts are known by two 64-bit hashes of their bytes, so repeated rows and equal
ids do no harm; equal texts share one answer and are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framepair.llm.common import Staging, materialise, query, splittable, table, unused
from framepair.llm.passages import WORDS, passage_spans, words_of
from framepair.llm.rules import ddl
from framepair.llm.suffixes import cover_ranks, laid_out, leading_words, sort_suffixes
from framepair.llm.textnum import BASE, INVERSE, PIECE, U64, Texts, byte_codes, give_back, mix, pieces, powers, tidy

LENGTH, GRAM = 400, 160
BLOCK = 1 << 20
SHARE = 1 << 20  # bytes of a very long text that are looked at together
HOT = 10_000
PLACE = U64(24)  # low bits that hold a position while minima are sought


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes."""
    n = len(data)
    room = max(PIECE, 1 << max(0, n - 1).bit_length())
    sums = np.zeros(n + 1, U64)
    np.cumsum(byte_codes()[data] * powers(room, BASE)[:n], out=sums[1:])
    return mix((sums[size:] - sums[: n - size + 1]) * powers(room + 1, INVERSE)[: n - size + 1])


def contexts(t: Texts, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, bucket, fingerprint, start, windows and offset of the bucket's run, for every context."""
    none = np.zeros(0, np.int64)
    wide, n = length - gram + 1, len(t.data)
    if n < length:
        return none, none.astype(U64), none.astype(U64), none, none, none
    if n >= 1 << int(PLACE):
        raise ValueError("a text of 16 MB or more must be read in shares")
    h = rolling(t.data, gram)
    m = len(h)
    value = (h >> PLACE << PLACE) | np.arange(m, dtype=U64)
    blocks = -(-m // wide)
    padded = np.full(blocks * wide, np.iinfo(np.uint64).max, U64)
    padded[:m] = value
    grid = padded.reshape(blocks, wide)
    left = np.minimum.accumulate(grid, 1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    q = m - wide + 1
    least = (np.minimum(right[:q], left[wide - 1 : wide - 1 + q]) & U64((1 << int(PLACE)) - 1)).astype(np.int64)
    row = np.repeat(np.arange(t.n), np.diff(t.off))[:q]
    at = np.flatnonzero(np.arange(q) + length <= t.off[row + 1])
    least, row = least[at], row[at]
    if not len(at):
        return none, none.astype(U64), none.astype(U64), none, none, none
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    lo, hi = at[first], at[np.append(first[1:], len(at)) - 1]
    run, row = least[first], row[first]
    prints = mix(t.span_hashes(lo, hi + length) ^ mix((run - lo).astype(U64)))
    return row, h[run], prints, lo - t.off[row], hi - lo + 1, run - lo


def spread(t: Texts, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``contexts`` of a piece; a very long text is read in overlapping shares."""
    share = SHARE
    if len(t.data) < share + length:
        yield contexts(t, length, gram)
        return
    for i in range(t.n):
        size = int(t.off[i + 1] - t.off[i])
        # A window belongs to the share it starts in, so a context may be cut at a
        # share's end: two contexts of one bucket, which changes nothing.
        for lo in range(0, max(1, size - length + 1), share):
            hi = min(size, lo + share + length - 1)
            part = Texts(t.data[t.off[i] + lo : t.off[i] + hi], np.array([0, hi - lo]))
            row, bucket, prints, start, windows, left = contexts(part, length, gram)
            yield row + i, bucket, prints, start + lo, windows, left


def with_identity(docs: DataFrame, text: str, names: tuple[str, str] = ("_k1", "_k2")) -> DataFrame:
    c = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({names[0]: F.xxhash64(c), names[1]: F.xxhash64(F.lit(LENGTH), c, F.length(c))})


def find_contexts(docs: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    names = ["k1", "k2", "bucket", "print", "start", "windows", "left"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in pieces(batch, "text"):
                for row, bucket, prints, start, windows, left in spread(t, length, gram):
                    keys = [part.column(c).take(pa.array(row)) for c in ("_k1", "_k2")]
                    made = [x.astype(np.int64) for x in (bucket.view(np.int64), prints.view(np.int64), start, windows, left)]
                    yield pa.RecordBatch.from_arrays([*keys, *[pa.array(x) for x in made]], names=names)

    return with_identity(docs.select(F.col(text).alias("text")), "text").mapInArrow(tidy(run), ", ".join(f"{n} long" for n in names))


RUNS = "array<struct<a:int,b:int>>"
RUNS_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def runs_of(flags: np.ndarray) -> list[dict[str, int]]:
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return [{"a": int(a), "b": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def repeated_windows(parts: list[bytes], counts: np.ndarray, length: int) -> list[np.ndarray]:
    """For every context of a block, which of its windows repeat."""
    data, starts, ends = laid_out(parts)
    words = leading_words(data)
    ranks = cover_ranks(words, starts, ends, length)
    windows = ends - starts - length + 1
    of = np.repeat(np.arange(len(parts)), windows)
    at = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows) + starts[of]
    order = sort_suffixes(words, ranks, at)
    # Equal windows are neighbours; fingerprints rule most others out, the bytes decide.
    whole = rolling(data, length)[at[order]]
    near = np.flatnonzero(whole[1:] == whole[:-1])
    one, two = at[order[near]], at[order[near + 1]]
    alike = np.ones(len(near), bool)
    for j in [*range(0, length - 8, 8), max(0, length - 8)]:
        alike &= words[one + j] == words[two + j]
    same = np.zeros(max(0, len(at) - 1), bool)
    same[near[alike]] = True
    hit = np.zeros(len(at), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    hit |= counts[of] > 1
    return np.split(hit, np.cumsum(windows)[:-1])


def sort_blocks(found: DataFrame, length: int) -> DataFrame:
    """``(bucket, print, runs)`` of contexts given with their bytes, block by block."""

    def run(part: pa.Table) -> pa.Table:
        parts = part.column("bytes").to_pylist()
        hits = repeated_windows(parts, part.column("n").to_numpy(), length)
        give_back()
        return pa.table({"bucket": part.column("bucket"), "print": part.column("print"), "runs": pa.array([runs_of(h) for h in hits], RUNS_TYPE)})

    return found.groupBy("block").applyInArrow(run, f"bucket long, print long, runs {RUNS}")


def count_windows(found: DataFrame, length: int, staged: Staging) -> DataFrame:
    """The same for hot buckets, by counting the fingerprints of single windows."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                for i, (b, bucket, prints, n) in enumerate(zip(*[part.column(c).to_pylist() for c in ("bytes", "bucket", "print", "n")], strict=True)):
                    data = np.frombuffer(b, np.uint8)
                    one, two = rolling(data, length), rolling(data[::-1], length)[::-1]
                    k = len(one)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (one.view(np.int64), two.copy().view(np.int64), np.full(k, bucket), np.full(k, prints), np.arange(k, dtype=np.int32), np.full(k, n))],
                        names=["one", "two", "bucket", "print", "w", "n"],
                    )

    windows = staged.keep(found.select("bytes", "bucket", "print", "n").mapInArrow(explode, "one long, two long, bucket long, print long, w int, n long"), "windows")
    often = windows.groupBy("one", "two").agg(F.sum("n").alias("times")).where(F.col("times") > 1)
    hits = windows.join(often, ["one", "two"], "left_semi")
    runs = F.transform(F.array_sort(F.collect_list("w")), lambda w: F.struct(w.alias("a"), (w + 1).cast("int").alias("b")))
    return hits.groupBy("bucket", "print").agg(runs.alias("runs"))


def fetch(docs: DataFrame, wanted: DataFrame, text: str, length: int) -> DataFrame:
    """The bytes of one example of every wanted context."""
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("bucket", "print", "n", "start", "windows")).alias("wanted"))
    texts = with_identity(docs.select(F.col(text).alias("text")), "text")
    lists = splittable(lists, "k1", F.size("wanted") > 0)
    joined = texts.join(lists.hint("shuffle_hash"), (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2"))).select("text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in pieces(batch, "text"):
                rows = []
                for i, wants in enumerate(part.column("wanted").to_pylist()):
                    lo = int(t.off[i])
                    rows += [(w["bucket"], w["print"], w["n"], t.data[lo + w["start"] : lo + w["start"] + w["windows"] - 1 + length].tobytes()) for w in wants]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                columns = list(zip(*rows, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "print", "n", "bytes"])

    # Equal texts give the same rows; one of each is kept.
    return joined.mapInArrow(tidy(run), "bucket long, print long, n long, bytes binary").dropDuplicates(["bucket", "print"])


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``(k1, k2, spans)``: byte spans to remove of every text that has any."""
    first, staged = Staging(docs.sparkSession), Staging(docs.sparkSession)
    all_contexts = first.keep(find_contexts(docs, text, length, gram), "contexts")
    buckets = all_contexts.groupBy("bucket").agg(F.count(F.lit(1)).alias("met"), (F.min("print") != F.max("print")).alias("mixed"))
    live = staged.keep(all_contexts.join(splittable(buckets.where(F.col("met") > 1), "bucket", F.col("met") > 1).drop("met"), "bucket"), "live")
    first.clear()

    mixed = live.where("mixed").groupBy("bucket", "print").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "start", "windows")).alias("one"))
    mixed = mixed.select("bucket", "print", "n", "one.*")
    found = staged.keep(fetch(docs, mixed, text, length), "fetched")
    sizes = found.groupBy("bucket").agg(F.count(F.lit(1)).alias("distinct"))
    too_many = sizes.where(F.col("distinct") > hot).select("bucket")
    cold = found.join(too_many, "bucket", "left_anti")
    total = found.agg(F.sum(F.length("bytes"))).first()[0] or 0
    # Blocks cost much more time than their bytes suggest, so they are dealt out here and not by size.
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (8 * BLOCK))
    cold = cold.withColumn("block", F.pmod(F.xxhash64("bucket"), F.lit(total // BLOCK + 1))).repartition(tasks, "block")
    runs = sort_blocks(cold, length)
    if not too_many.isEmpty():
        runs = runs.unionByName(count_windows(found.join(too_many, "bucket", "left_semi"), length, staged))

    # Contexts of unmixed buckets repeat as a whole.
    sure = live.where("not mixed").select("k1", "k2", "start", F.array(F.struct(F.lit(0).alias("a"), F.col("windows").cast("int").alias("b"))).alias("runs"))
    some = live.where("mixed").join(runs.where(F.size("runs") > 0), ["bucket", "print"]).select("k1", "k2", "start", "runs")
    each = sure.unionByName(some).select("k1", "k2", "start", F.explode("runs").alias("run"))
    spans = each.select("k1", "k2", (F.col("start") + F.col("run.a")).alias("lo"), (F.col("start") + F.col("run.b") - 1 + length).alias("hi")).distinct()
    spans = materialise(spans.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans")), "spans")
    staged.clear()
    return spans


def merged(spans: list[dict[str, int]] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans or []:
        if out and s["lo"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["hi"]))
        else:
            out.append((s["lo"], s["hi"]))
    return out


def in_bytes(t: Texts, passages: list[list[dict[str, int]] | None]) -> list[list[dict[str, int]]]:
    """The byte spans of each text's word spans."""
    if not any(passages):
        return [[]] * t.n
    starts, ends, _, first = words_of(t)
    return [[{"lo": int(starts[first[i] + s["lo"]] - t.off[i]), "hi": int(ends[first[i] + s["hi"] - 1] - t.off[i])} for s in some or []] for i, some in enumerate(passages)]


def remove_repeats(
    docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, as_text: bool = False, words: int | None = None, mark: bool = False
) -> DataFrame:
    """``docs`` with ``removed_spans`` (maximal byte runs), ``n_bytes, n_removed`` and ``kept_bytes``.

    With ``words``, passages of that many words that are met more than once go as well, however short (``passages.py``).
    With ``mark`` they stay and ``passage_spans`` lists their maximal byte runs.

    With ``as_text`` the text itself is replaced by what is kept (a character of
    which only some bytes are left goes) and only ``n_bytes, n_removed`` are added.
    """
    spans = repeated_spans(docs, text, length, gram, hot)
    if words:
        more = passage_spans(with_identity(docs.select(F.col(text).alias("text")), "text"), words)
        spans = spans.join(more, ["k1", "k2"], "full")
    else:
        spans = spans.withColumn("passages", F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>"))
    names = unused(docs, "removed_spans", "n_bytes", "n_removed", "kept_bytes", "passage_spans")
    old = docs.columns
    k1, k2, s1, s2, found_spans, found_passages = unused(docs, "_k1", "_k2", "_s1", "_s2", "_spans", "_passages")
    texts = with_identity(docs, text, (k1, k2))
    spans = splittable(spans, "k1", F.size(F.coalesce("spans", "passages")) > 0)
    renamed = spans.withColumnsRenamed({"k1": s1, "k2": s2, "spans": found_spans, "passages": found_passages})
    joined = texts.join(renamed, (F.col(k1) == F.col(s1)) & (F.col(k2) == F.col(s2)), "left")
    joined = joined.select(*[F.col(f"`{c}`") for c in old], found_spans, found_passages)
    spans_type = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in pieces(batch, text):
                cuts, size, gone, kept = [], np.diff(t.off), [], []
                also = in_bytes(t, part.column(found_passages).to_pylist())
                marked, also = (also, [[]] * t.n) if mark else ([], also)
                for i, found in enumerate(part.column(found_spans).to_pylist()):
                    runs = merged(sorted([*(found or []), *also[i]], key=lambda s: s["lo"]))
                    raw = t.data[t.off[i] : t.off[i + 1]].tobytes()
                    bounds = [0, *[x for r in runs for x in r], len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)))
                    gone.append(len(raw) - len(kept[-1]))
                    cuts.append([{"lo": a, "hi": b} for a, b in runs])
                sizes = [pa.array(size.astype(np.int64)), pa.array(gone, pa.int64())]
                if as_text:
                    left = [None if none else k.decode("utf-8", "ignore") for k, none in zip(kept, part.column(text).is_null().to_pylist(), strict=True)]
                    columns = [pa.array(left, pa.string()) if c == text else part.column(c) for c in old]
                    yield pa.RecordBatch.from_arrays([*columns, *sizes], names=[*old, *names[1:3]])
                else:
                    made = [pa.array(cuts, spans_type), *sizes, pa.array(kept, pa.binary())]
                    if mark:
                        made.append(pa.array([[{"lo": a, "hi": b} for a, b in merged(m)] for m in marked], spans_type))
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in old], *made], names=[*old, *names[: len(made)]])

    if as_text:
        return joined.mapInArrow(tidy(run), f"{ddl(docs)}, `{names[1]}` long, `{names[2]}` long")
    kinds = ["array<struct<lo:bigint,hi:bigint>>", "long", "long", "binary", "array<struct<lo:bigint,hi:bigint>>"][: 5 if mark else 4]
    return joined.mapInArrow(tidy(run), f"{ddl(docs)}, " + ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=False)))


@query("op6_suffix_dedup")
def substrings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_passage_bytes`` are those of passages of over 50 words met more than once, 400 bytes long or not; they are not removed."""
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), words=WORDS, mark=True)
    marked = F.aggregate("passage_spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    return done.select(
        "doc_id", "n_bytes", "n_removed", F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"), marked.alias("n_passage_bytes")
    )
