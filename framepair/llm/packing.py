"""Vector bin packing of token pieces into training sequences.

A piece has three sizes: tokens, segments (one) and loss-bearing tokens; a
sequence has a limit for each. Each task packs the texts it reads, in bounded
windows: texts longer than a sequence first give whole sequences, what is left
goes to a window of waiting pieces. A bin is filled by the dot-product
heuristic: of the waiting pieces that fit, take the one whose demand vector has
the largest dot product with what the bin has left, both as shares of the
limits and weighted by how scarce each resource is in the window. Pieces are
kept by (tokens, loss), so one choice looks at each kind once, not at each
piece. If texts may be cut, the last gap of a bin is filled by cutting a piece.

What is left when a task ends is cut into bins whose length is a power of two,
which need no padding. Nothing is shuffled and no task sees another's texts;
numbers are ``task << 33 | n``, so they do not depend on other tasks and a task
that runs again gives the same ones.

Null and empty texts still have their end token. Repeated rows are separate
texts. Tokenizing keeps a bounded store of word -> ids per task: text may be
cut before a space that a non-space follows without changing any id.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framepair.llm.common import query, table, unused
from framepair.llm.textnum import pieces, tidy

END = 0
STORE = 200_000  # words whose ids a task keeps
WINDOW = 64  # pieces that wait for a bin


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 32
    loss: int = 1024


# A space that a space-like character or the end follows.
DOUBLE_SPACE = re.compile(r" (?:\s|\Z)")


class Encoder:
    """Byte-level BPE by the ranks file; ids equal those of the JSON file of the same vocabulary.

    ``added`` are the strings with an id of their own that the JSON file lists; they are cut out first.
    """

    def __init__(self, path: str, pattern: str, added: Sequence[tuple[str, int]] = ()) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("piece", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.store: dict[str, bytes] = {}  # word -> ids of a space and the word
        self.added = {s: packed([i]) for s, i in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.cut is None or not self.cut.search(text):
            return self.plain(text)
        return b"".join(self.added[s] if s in self.added else self.plain(s) for s in self.cut.split(text) if s)

    def plain(self, text: str) -> bytes:
        if not DOUBLE_SPACE.search(text):
            first, *words = text.split(" ")
        else:
            first, *rest = chunks(text)
            words = [c[1:] for c in rest]
        found, word = self.store.get, self.word
        return b"".join([packed(self.core.encode_ordinary(first)), *[found(w) or word(w) for w in words]])

    def word(self, word: str) -> bytes:
        ids = packed(self.core.encode_ordinary(" " + word))
        if len(word) <= 64:
            if len(self.store) >= STORE:
                self.store.clear()
            self.store[word] = ids
        return ids


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def chunks(text: str) -> list[str]:
    """``text`` cut before every space that a non-space follows; joined they give ``text``."""
    parts = text.split(" ")
    out = parts[:1]
    for p in parts[1:]:
        if p and not p[0].isspace():
            out.append(" " + p)
        else:
            out[-1] += " " + p
    return out


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()) -> Encoder:
    """One per worker process."""
    return Encoder(path, pattern, added)


@dataclass
class Piece:
    row: int  # which text of the task
    start: int
    tokens: int
    loss: int


class Waiting:
    """Pieces by (tokens, loss-bearing tokens); the latest of a kind is taken first."""

    def __init__(self) -> None:
        self.by: dict[tuple[int, int], list[Piece]] = {}
        self.n = self.tokens = self.loss = 0

    def add(self, p: Piece) -> None:
        self.by.setdefault((p.tokens, p.loss), []).append(p)
        self.n, self.tokens, self.loss = self.n + 1, self.tokens + p.tokens, self.loss + p.loss

    def pop(self, kind: tuple[int, int]) -> Piece:
        held = self.by[kind]
        p = held.pop()
        if not held:
            del self.by[kind]
        self.n, self.tokens, self.loss = self.n - 1, self.tokens - p.tokens, self.loss - p.loss
        return p

    def choose(self, left: Sequence[int], limits: Limits) -> tuple[int, int] | None:
        """The fitting kind with the largest weighted dot product; of equal ones the longest, then the one with most loss."""
        n = max(1, self.n)
        weight = (self.tokens / n / limits.tokens, 1 / limits.segments, self.loss / n / limits.loss)
        share = (left[0] / limits.tokens, left[1] / limits.segments, left[2] / limits.loss)
        per_token, per_loss = weight[0] * share[0] / limits.tokens, weight[2] * share[2] / limits.loss
        segment = weight[1] * share[1] / limits.segments
        best, top = None, (-1.0, 0, 0)
        for tokens, loss in self.by:
            if tokens <= left[0] and loss <= left[2] and left[1] > 0:
                rank = (per_token * tokens + segment + per_loss * loss, tokens, loss)
                if rank > top:
                    best, top = (tokens, loss), rank
        return best


def cut(p: Piece, tokens: int) -> tuple[Piece, Piece]:
    # A text's loss-bearing tokens are its last ones.
    rest = p.tokens - tokens
    behind = min(p.loss, rest)
    return Piece(p.row, p.start, tokens, p.loss - behind), Piece(p.row, p.start + tokens, rest, behind)


def fill(waiting: Waiting, limits: Limits, may_cut: bool) -> list[Piece]:
    """One bin out of the waiting pieces."""
    left, made = [limits.tokens, limits.segments, limits.loss], []
    while left[0] and left[1] and waiting.n:
        # The last segment should close the gap.
        kind = waiting.choose(left, limits) if left[1] > 1 or not may_cut else None
        if kind is not None and not (may_cut and left[1] == 1 and kind[0] < left[0]):
            p = waiting.pop(kind)
        elif may_cut and (longer := [k for k in waiting.by if k[0] >= left[0] and k[1] - max(0, k[0] - left[0]) <= left[2]]):
            # Of a cut piece the first tokens go in here; its loss-bearing ones are its last.
            p = waiting.pop(min(longer))
            if p.tokens > left[0]:
                p, rest = cut(p, left[0])
                waiting.add(rest)
        else:
            kind = waiting.choose(left, limits)
            if kind is None:
                break
            p = waiting.pop(kind)
        made.append(p)
        left = [left[0] - p.tokens, left[1] - 1, left[2] - p.loss]
    return made


def powers_of_two(made: list[Piece]) -> list[list[Piece]]:
    """A partly filled bin as bins whose lengths are powers of two, largest first."""
    out, total, at = [], sum(p.tokens for p in made), 0
    queue = list(made)
    while total:
        size = 1 << (total.bit_length() - 1)
        one, left = [], size
        while left:
            p = queue[at]
            if p.tokens > left:
                p, queue[at] = cut(p, left)
            else:
                at += 1
            one.append(p)
            left -= p.tokens
        out.append(one)
        total -= size
    return out


def pack(texts: Iterator[tuple[int, int, int]], limits: Limits = Limits(), may_cut: bool = True, window: int = WINDOW) -> Iterator[list[Piece]]:
    """Bins for ``(row, tokens, loss tokens)`` in reading order.

    Without cutting, a text longer than a limit raises. With cutting, every bin
    but the last few is full up to the segment and loss limits.
    """
    waiting = Waiting()

    def ready(least: int) -> Iterator[list[Piece]]:
        while waiting.n > least:
            made = fill(waiting, limits, may_cut)
            total = sum(p.tokens for p in made)
            if may_cut and total < limits.tokens and (total & (total - 1)):
                yield from powers_of_two(made)
            else:
                yield made

    for row, tokens, loss in texts:
        p = Piece(row, 0, tokens, loss)
        if not may_cut and (tokens > limits.tokens or loss > limits.loss):
            raise ValueError(f"text {row} is longer than a sequence and may not be cut")
        while p.tokens >= limits.tokens or p.loss > limits.loss:
            size = min(limits.tokens, p.tokens, limits.loss if p.loss > limits.loss else p.tokens)
            whole, p = cut(p, size)
            if whole.loss > limits.loss:
                raise ValueError("loss limit below what one cut can hold")
            if whole.tokens == limits.tokens:
                yield [whole]
            else:
                waiting.add(whole)
            if not p.tokens:
                break
        if p.tokens:
            waiting.add(p)
        yield from ready(window)
    yield from ready(0)


PIECES = ("start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset", "seq_tokens")


def pack_texts(
    docs: DataFrame, ranks: str, pattern: str, added: Sequence[tuple[str, int]] = (), keep: Sequence[str] = ("doc_id",), text: str = "text",
    limits: Limits = Limits(), loss: str | None = None
) -> DataFrame:
    """One row per piece: the columns ``keep`` of its text and where it stands.

    ``loss`` names a column with the number of loss-bearing tokens of each text, its last ones (the answers of
    instruction data), at most all but the first; null is none. Without it every token
    but a text's first bears loss, and a loss limit of the token limit never binds. Ids of a task's waiting texts are
    held until their last piece is placed: at most ``WINDOW`` pieces.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    made = unused(docs.select(*keep), *PIECES)
    schema = ", ".join([fields, *[f"`{n}` long" for n in made]])
    names = [*keep, *made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks, pattern, tuple(added))
        task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        held: dict[int, list] = {}  # row -> [ids, kept values, tokens not yet placed]
        kinds: list[pa.DataType] = []
        sequence, last = 0, packed([END])

        def read() -> Iterator[tuple[int, int, int]]:
            row = 0
            for batch in batches:
                kinds[:] = [batch.schema.field(c).type for c in keep]
                for part, _ in pieces(batch, text, 1 << 20):
                    kept = [part.column(c).to_pylist() for c in keep]
                    masks = part.column(bears).to_pylist() if loss else None
                    for i, t in enumerate(part.column(text).to_pylist()):
                        ids = np.frombuffer(enc.encode(t or "") + last, "<u4")
                        held[row] = [ids, [k[i] for k in kept], len(ids)]
                        yield row, len(ids), min(len(ids) - 1, max(0, masks[i] or 0)) if masks else len(ids) - 1
                        row += 1

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            types = [*kinds, *[pa.int64()] * 8]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=names)

        out: list[tuple] = []
        for one in pack(read(), limits):
            offset, total = 0, sum(p.tokens for p in one)
            for p in one:
                entry = held[p.row]
                ids = entry[0][p.start : p.start + p.tokens]
                out.append((*entry[1], p.start, p.tokens, zlib.crc32(ids.tobytes()), len(entry[0]), p.loss, task | sequence, offset, total))
                offset += p.tokens
                entry[2] -= p.tokens
                if not entry[2]:
                    del held[p.row]
            sequence += 1
            if len(out) >= 4096:
                yield flush(out)
                out = []
        if out:
            yield flush(out)
        enc.store.clear()

    (bears,) = unused(docs.select(*keep, text), "loss_bearing")
    more = [F.col(loss).cast("long").alias(bears)] if loss else []
    return docs.select(*keep, text, *more).mapInArrow(tidy(run), schema)


def public_vocabulary() -> tuple[str, str, tuple[tuple[str, int], ...]]:
    """Ranks file, pattern, and the added tokens of the JSON file of the same vocabulary."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, tuple((t["content"], t["id"]) for t in added)


@query("op8_pack_sequences")
def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), *public_vocabulary())
