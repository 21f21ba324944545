"""SentencePiece encoding and decoding by a table of last tokens.

A merge-type (BPE) model joins the best-scored neighbouring pair until none is left. So every
prefix of a text has one encoding, and the last token of that encoding is
unique: it is the one piece that ends there and is *compatible* with the last token of
the prefix in front of it. Two tokens are compatible if no merge across their seam would have come
first while they were built; that is read off by undoing their merges from the last to the
first (``Pieces.agree``). An automaton over all pieces gives the candidates of each
place; the ids are recovered from the end of the text backwards. Time is linear in
the text, also for texts without spaces.

No piece has a space mark behind another character, so nothing is merged across the front of a
space mark, nor across a character that no piece holds, nor between a letter and another character if no piece has
both: the table of a text falls into *units* there, and units met again in a task are looked up. Characters without a piece become byte pieces.

Only models as the one given are accepted: merge type, byte fallback, no normalisation but the space mark in front
and for spaces, no piece with an inner space mark. Null and empty texts have the begin
and end ids alone; decoding them gives empty text. A text is held whole by one task.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framepair.llm.common import query, table, unused
from framepair.llm.rules import ddl

MARK = "▁"
LATE = 1 << 60
# Looked-up units and pairs of a task: bounds of memory that change no answer.
UNITS, UNIT_CHARS, PAIRS = 150_000, 32, 300_000


class Pieces:
    """The pieces of a model with their ranks (0 is merged first) and the last merge of each."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        kinds = [(model.is_byte(i), model.is_control(i), model.is_unknown(i), model.is_unused(i)) for i in range(n)]
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        self.byte = [0] * 256
        for i in range(n):
            if kinds[i][0]:
                self.byte[int(self.text[i][1:-1], 16)] = i
        self.control = {i for i in range(n) if kinds[i][1]}
        self.of_text = {self.text[i]: i for i in range(n) if not any(kinds[i])}
        chars = {c for p in self.of_text for c in p}
        probe = " a  ﬁÅ\n\u0000b "
        if (
            sum(k[0] for k in kinds) != 256 or any(k[3] for k in kinds) or model.normalize(probe) != MARK + probe.replace(" ", MARK)
            or any(MARK in p.lstrip(MARK) for p in self.of_text) or not chars <= self.of_text.keys()
        ):
            raise ValueError("not a merge-type model with byte fallback and plain spaces")
        scores = sorted({model.get_score(i) for i in self.of_text.values()}, reverse=True)
        place = {s: r for r, s in enumerate(scores)}
        # Single characters are there from the start; equal scores are merged from the left.
        self.rank = {i: place[model.get_score(i)] if len(p) > 1 else -1 for p, i in self.of_text.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.size = {i: len(p) for p, i in self.of_text.items()}
        self.find_merges()
        self.automaton = ahocorasick.Automaton()
        for p, i in self.of_text.items():
            if len(p) == 1 or i in self.left:
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.units = self.unit_pattern(chars)
        self.bytes = [p.replace(MARK, " ").encode() for p in self.text]
        for b, i in enumerate(self.byte):
            self.bytes[i] = bytes([b])
        for i in self.control:
            self.bytes[i] = b""
        self.bytes[self.unk] = " ⁇ ".encode()
        self.is_byte = frozenset(self.byte)

    def unit_pattern(self, chars: set[str]) -> re.Pattern:
        """What the text is cut into: space marks with the letters, or with the other characters, behind them.

        Only for models without a piece that holds a letter next to another character; else any characters follow the marks.
        """
        breaks = "".join(re.escape(chr(c)) for c in range(32) if chr(c) not in chars)
        odd = "".join(re.escape(c) for c in sorted(chars) if re.fullmatch(r"[^\W\d_]", c) and not c.isalpha())
        letters, others = rf"[^\W\d_{odd}]", rf"[\W\d_{odd}]"
        fine = re.compile(rf"{MARK}*{letters}+|{MARK}*(?:(?![{MARK}{breaks}]){others})+|{MARK}+|[{breaks}\0]+")
        if all(fine.fullmatch(p) for p in self.of_text):
            return fine
        return re.compile(rf"{MARK}*[^{MARK}{breaks}\0]+|{MARK}+|[{breaks}\0]+")

    def find_merges(self) -> None:
        """The last merge of every piece: its one split whose halves agree before the piece's own rank.

        Pieces are seen by rank, so their halves are known. One without such a
        split is never built by merges and takes no part.
        """
        for i in sorted((i for i in self.rank if self.size[i] > 1), key=lambda i: (self.rank[i], self.size[i])):
            p = self.text[i]
            for at in range(1, len(p)):
                a, b = self.of_text.get(p[:at]), self.of_text.get(p[at:])
                if a is None or b is None or not all(self.size[x] == 1 or x in self.left for x in (a, b)):
                    continue
                if max(self.rank[a], self.rank[b]) <= self.rank[i] and self.agree(a, b, self.rank[i]):
                    self.left[i], self.right[i] = a, b
                    break

    def agree(self, a: int, b: int, limit: int = LATE) -> bool:
        """Whether tokens ``a`` and ``b`` stand side by side with no earlier merge across their seam.

        Their merges are undone, the later one first (of equal ranks the right
        one, as merging goes from the left). ``limit`` is the time that has been undone to.
        """
        rank, of_text, text = self.rank, self.of_text, self.text
        while True:
            joined = of_text.get(text[a] + text[b])
            if joined is not None and rank[joined] < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                # A merge of a's rank at the seam lies to the right of a's own, so it came later.
                a, limit = self.right[a], ra
            else:
                b, limit = self.left[b], rb + 1

    def split(self, text: str) -> list[str]:
        return self.units.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode_unit(self, unit: str, pairs: dict[int, bool]) -> list[int]:
        whole = self.of_text.get(unit)
        if whole is not None and (whole in self.left or len(unit) == 1):
            return [whole]
        last: list[int | None] = [None] * (len(unit) + 1)
        size, agree = self.size, self.agree
        for end, t in self.automaton.iter(unit):
            end += 1
            if last[end] is None:
                # A place without a token is the start or follows a character that no piece holds.
                before = last[end - size[t]]
                if before is not None:
                    ok = pairs.get(pair := before << 32 | t)
                    if ok is None:
                        ok = pairs[pair] = agree(before, t)
                    if not ok:
                        continue
                last[end] = t
        ids, at = [], len(unit)
        while at:
            t = last[at]
            if t is None:
                ids += [self.byte[x] for x in reversed(unit[at - 1].encode())]
                at -= 1
            else:
                ids.append(t)
                at -= size[t]
        return ids[::-1]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; one space in front goes, and a byte that is no part of a character is U+FFFD."""
        raw = b"".join(map(self.bytes.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self.decode_runs(ids)
        first = next((i for i in ids if i not in self.control), None)
        return text[1:] if first is not None and self.text[first].startswith(MARK) else text

    def decode_runs(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i in self.is_byte:
                run += self.bytes[i]
                continue
            at = 0
            while at < len(run):
                for n in range(1, 5):
                    try:
                        out.append(run[at : at + n].decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()
            if i is not None:
                out.append(self.bytes[i].decode())
        return "".join(out)


@lru_cache(maxsize=1)
def load(path: str) -> Pieces:
    return Pieces(path)


class Encoder:
    """Texts to little-endian 32-bit ids, with begin and end ids; remembers the units of a task.

    Units are remembered in two generations: when the younger is full it becomes the
    older, and units of the older that are met again become young.
    """

    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.seen, self.old, self.pairs = pieces, {}, {}, {}
        self.head, self.tail = packed([pieces.bos]), packed([pieces.eos])

    def unit(self, unit: str) -> bytes:
        ids = self.old.get(unit) or packed(self.pieces.encode_unit(unit, self.pairs))
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        if len(unit) <= UNIT_CHARS:
            if len(self.seen) >= UNITS:
                self.old, self.seen = self.seen, {}
            self.seen[unit] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        seen, out = self.seen, [self.head]
        for u in self.pieces.split(text or ""):
            ids = seen.get(u)
            if ids is None:
                ids, seen = self.unit(u), self.seen
            out.append(ids)
        out.append(self.tail)
        return b"".join(out)


def packed(ids: list[int]) -> bytes:
    raw = array("I", ids)
    if sys.byteorder == "big":
        raw.byteswap()
    return raw.tobytes()


def encode_texts(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian unsigned 32-bit, begin and end ids included)."""
    old, (name,) = docs.columns, unused(docs, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(load(model))
        for batch in batches:
            ids = [encoder.encode(t.as_py()) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=[*old, name])

    return docs.mapInArrow(run, f"{ddl(docs)}, `{name}` binary")


def decode_ids(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of each row's ids; null ids give empty text."""
    old, (name,) = encoded.columns, unused(encoded, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            texts = [pieces.decode(np.frombuffer(x.as_py() or b"", "<u4").tolist()) for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*old, name])

    return encoded.mapInArrow(run, f"{ddl(encoded)}, `{name}` string")


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op12_piece_codec")
def pieces_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_model()
    encoded = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), model).select("doc_id", "ids")
    return decode_ids(encoded, model).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
