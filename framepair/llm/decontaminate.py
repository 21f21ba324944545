"""Benchmark decontamination with one Aho-Corasick automaton over normalised test texts.

Normalising lower-cases A-Z and turns every run of bytes outside
``[0-9a-z\x80-\xFF]`` into one space, so words are what stands between spaces.
Each item gives its windows of 10 consecutive words (an item of fewer words
gives one window). All distinct windows, with a space on both sides, are the
patterns of one automaton; a text is scanned once in its normalised form, and
match ends are mapped back to words and to character offsets of the original.

The automaton holds test items only, whose number does not follow the corpus.
It is still bounded: items are taken in shards of at most ``SHARD_WORDS`` words,
one broadcast automaton each, and a text's hits are united over the shards, so
a large item table costs more scans, not more memory. The corpus is never
shuffled: the job is one map.

Null and empty texts have no words and no hits; items without words are
skipped; an item whose id is null can hit but is not listed; repeated items
count once per id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framepair.llm.common import query, table, unused
from framepair.llm.rules import ddl
from framepair.llm.textnum import Texts, pieces

WINDOW = 10
SHARD_WORDS = 2_000_000

NORMAL = bytearray(b" " * 256)
for _b in range(256):
    if 0x30 <= _b <= 0x39 or 0x61 <= _b <= 0x7A or _b >= 0x80:
        NORMAL[_b] = _b
    elif 0x41 <= _b <= 0x5A:
        NORMAL[_b] = _b + 32
NORMAL = bytes(NORMAL)
IN_WORD = np.frombuffer(NORMAL, np.uint8) != 0x20


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()


def windows_of(words: list[bytes], k: int = WINDOW) -> list[list[bytes]]:
    return [words[i : i + k] for i in range(max(1, len(words) - k + 1))] if words else []


def shards(items: Iterable[tuple[str | None, list[bytes]]], most: int = SHARD_WORDS) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    held, n = [], 0
    for item in items:
        if held and n + len(item[1]) > most:
            yield held
            held, n = [], 0
        held.append(item)
        n += len(item[1])
    if held:
        yield held


class Windows:
    """The automaton of one shard: pattern -> (number of words, ids of its items)."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], k: int = WINDOW) -> None:
        found: dict[str, tuple[int, set[str]]] = {}
        for item_id, words in items:
            for w in windows_of(words, k):
                # Latin-1 keeps one character per byte, so match ends are byte offsets.
                ids = found.setdefault(f" {b' '.join(w).decode('latin-1')} ", (len(w), set()))[1]
                if item_id is not None:
                    ids.add(item_id)
        self.automaton = ahocorasick.Automaton()
        for pattern, (n, ids) in found.items():
            self.automaton.add_word(pattern, (n, tuple(sorted(ids))))
        if found:
            self.automaton.make_automaton()

    def hits(self, normal: bytes) -> tuple[list[tuple[int, int]], set[str]]:
        """``(first word, words)`` of every occurrence in a normalised text, and the items."""
        if not len(self.automaton):
            return [], set()
        ends, ids = [], set()
        for end, (n, found) in self.automaton.iter(f" {normal.decode('latin-1')} "):
            ends.append((end, n))
            ids.update(found)
        if not ends:
            return [], ids
        spaces = np.flatnonzero(np.frombuffer(normal, np.uint8) == 0x20)
        # A match ends at the space behind its last word; the padded text is one character ahead.
        last = np.searchsorted(spaces, np.array([e for e, _ in ends]) - 1)
        return [(int(w) - n + 1, n) for w, (_, n) in zip(last, ends, strict=True)], ids




def spans(first: list[tuple[int, int]], n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of hit words: first word, one past the last."""
    level = np.zeros(n_words + 1, np.int64)
    for at, n in first:
        level[at] += 1
        level[at + n] -= 1
    hit = np.cumsum(level)[:-1] > 0
    edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``n_words, n_hit, item_ids, hit_spans, contaminated``.

    ``item_ids`` are the ids (as strings, sorted) of items with a window in the
    text; ``hit_spans`` are ``(start, end)`` character offsets in the original of
    the maximal runs of hit words.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(item_id).cast("string"), F.col(item_text)).toLocalIterator()
    read = ((r[0], words) for r in rows if (words := words_of(r[1])))
    held = [spark.sparkContext.broadcast(shard) for shard in shards(read)]
    names = unused(docs, "n_words", "n_hit", "item_ids", "hit_spans", "contaminated")
    kinds = ["long", "long", "array<string>", "array<struct<start:bigint,end:bigint>>", "boolean"]
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [Windows(b.value) for b in held]
        for batch in batches:
            for part, t in pieces(batch, text):
                starts, ends, row = t.runs(IN_WORD[t.data])
                n_words = np.bincount(row, minlength=t.n)
                first_word = np.concatenate([[0], np.cumsum(n_words)])
                raw = t.data.tobytes()
                n_hit, ids, marked = np.zeros(t.n, np.int64), [[]] * t.n, [[]] * t.n
                for i in range(t.n):
                    normal = b" ".join(raw[t.off[i] : t.off[i + 1]].translate(NORMAL).split())
                    occurrences, found = [], set()
                    for a in automata:
                        o, f = a.hits(normal)
                        occurrences += o
                        found |= f
                    if occurrences:
                        lo, hi = spans(occurrences, int(n_words[i]))
                        n_hit[i] = int((hi - lo).sum())
                        ids[i] = sorted(found)
                        at = character_offsets(t, i, starts[first_word[i] + lo], ends[first_word[i] + hi - 1])
                        marked[i] = [{"start": a, "end": b} for a, b in at]
                made = [pa.array(n_words.astype(np.int64)), pa.array(n_hit), pa.array(ids, pa.list_(pa.string())), pa.array(marked, spans_type), pa.array(n_hit > 0)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *names])

    fields = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))
    return docs.select([F.col(f"`{c}`") for c in docs.columns]).mapInArrow(run, f"{ddl(docs)}, {fields}")


def character_offsets(t: Texts, i: int, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    lo = t.off[i]
    chars = np.concatenate([[0], np.cumsum((t.data[lo : t.off[i + 1]] & 0xC0) != 0x80)])
    return [(int(chars[a - lo]), int(chars[b - lo])) for a, b in zip(starts, ends, strict=True)]


def strip_hits(df: DataFrame, text: str = "text", spans_column: str = "hit_spans") -> DataFrame:
    """``text`` without its hit spans; everything else of it stays."""
    n = F.size(spans_column)
    at = lambda i, end: F.element_at(F.col(spans_column), i)[end]
    keep = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.substr(
            F.col(text),
            (F.when(i == 0, F.lit(0)).otherwise(at(F.greatest(i, F.lit(1)), "end")) + 1).cast("int"),
            (F.when(i == n, F.length(text)).otherwise(at(F.least(i + 1, F.greatest(n, F.lit(1))), "start")) - F.when(i == 0, F.lit(0)).otherwise(at(F.greatest(i, F.lit(1)), "end"))).cast("int"),
        ),
    )
    return df.withColumn(text, F.when(n > 0, F.array_join(keep, "")).otherwise(F.col(text)))


@query("op2_decontaminate")
def decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated", "hit_spans",
    )
