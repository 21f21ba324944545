"""Quality rules as a short-circuit cascade.

Base counts (words, symbols, repeated lines and words) are measured for every
text. The rules behind them then run one after another, each only on the texts
that all earlier rules kept. Their order is not fixed: each rule's cost per text
and its share of rejections are measured on a random sample, on the executors,
and rules run by rejections per second, highest first. The order changes the
time taken and which rule is named for a text that several reject, never
whether a text is kept.

Null and empty texts have no words and fail the base rule. Repeated rows are
judged one by one. Words are runs of bytes other than space and 0x09-0x0D.
The job is one map over the table, without a shuffle; a task holds one Arrow
batch and works on ``textnum.PIECE`` bytes at a time.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framepair.llm.common import query, table, unused
from framepair.llm.textnum import NOT_SPACE, U64, Texts, first_of_windows, mix, pieces, string_buffers, table_of, window_hashes

SYMBOLS = table_of(b"#*$%&|<>")
UPPER = table_of(bytes(range(65, 91)))
LOWER = table_of(bytes(range(97, 123)))
LETTER = UPPER | LOWER | np.arange(256).__ge__(0x80)
MIN_WORDS, REPEATED_PERCENT = 50, 50
# Insults that mark a text as abusive.
INSULTS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "disgusting", "worthless", "clown", "garbage")


class Facts:
    """What the rules look at: the texts of some rows and the counts made so far."""

    def __init__(self, column: pa.Array, counts: dict[str, np.ndarray] | None = None) -> None:
        self.column = column
        self.texts = Texts(*string_buffers(column))
        self.counts = counts if counts is not None else {}

    def take(self, rows: np.ndarray) -> Facts:
        return Facts(self.column.take(pa.array(rows)), {k: v[rows] for k, v in self.counts.items()})

    def __getitem__(self, name: str) -> np.ndarray:
        return self.counts[name]


def base_counts(t: Texts) -> dict[str, np.ndarray]:
    """``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` of every text."""
    inside = NOT_SPACE[t.data]
    starts, ends, row = t.runs(inside)
    n_words = np.bincount(row, minlength=t.n)
    word_hash = t.span_hashes(starts, ends)
    at = first_of_windows(row, 3)
    keyed = mix(window_hashes(word_hash, at, 3) ^ mix(row[at].astype(U64)))
    _, which, times = np.unique(keyed, return_inverse=True, return_counts=True)
    again = at[times[which] > 1]
    covered = np.zeros(len(row), bool)
    for i in range(3):
        covered[again + i] = True
    a, b, line_row = t.lines()
    has_word = np.searchsorted(starts, b) > np.searchsorted(starts, a)
    a, b, line_row = a[has_word], b[has_word], line_row[has_word]
    lines = mix(t.span_hashes(a, b) ^ mix(line_row.astype(U64)))
    _, first = np.unique(lines, return_index=True)
    n_lines = np.bincount(line_row, minlength=t.n)
    return {
        "n_words": n_words,
        "word_chars": t.per_row(inside & t.starts_characters()),
        "n_symbols": t.per_row(SYMBOLS[t.data]),
        "n_lines": n_lines,
        "n_dup_lines": n_lines - np.bincount(line_row[first], minlength=t.n),
        "n_repeat_words": np.bincount(row[covered], minlength=t.n),
    }


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > REPEATED_PERCENT * counts["n_words"])


# -- the rules: True rejects -------------------------------------------------
def many_symbols(f: Facts) -> np.ndarray:
    """More than one symbol in ten words."""
    return 10 * f["n_symbols"] > f["n_words"]


def same_lines(f: Facts) -> np.ndarray:
    """More than six lines in ten repeat an earlier one."""
    return 10 * f["n_dup_lines"] > 6 * f["n_lines"]


def odd_word_length(f: Facts) -> np.ndarray:
    """Words shorter than 2 or longer than 20 characters on average."""
    return (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 20 * f["n_words"])


def shouting(f: Facts) -> np.ndarray:
    """More capital than small letters."""
    t = f.texts
    return t.per_row(UPPER[t.data]) > t.per_row(LOWER[t.data])


def few_letters(f: Facts) -> np.ndarray:
    """Fewer than six in ten of a text's word characters are letters."""
    t = f.texts
    return 10 * t.per_row(LETTER[t.data] & t.starts_characters()) < 6 * f["word_chars"]


def one_word(f: Facts) -> np.ndarray:
    """One word makes up more than three words in ten."""
    t = f.texts
    starts, ends, row = t.runs(NOT_SPACE[t.data])
    keyed = mix(t.span_hashes(starts, ends) ^ mix(row.astype(U64)))
    _, first, times = np.unique(keyed, return_index=True, return_counts=True)
    most = np.zeros(t.n, np.int64)
    np.maximum.at(most, row[first], times)
    return 10 * most > 3 * f["n_words"]


def abusive(f: Facts) -> np.ndarray:
    """Insults: at least two, and more than one in 500 words."""
    t = f.texts
    starts, ends, row = t.runs(LETTER[t.data])
    sizes = ends - starts
    fits = np.isin(sizes, [len(w) for w in INSULTS])
    starts, ends, row = starts[fits], ends[fits], row[fits]
    small = np.where(UPPER[t.data], t.data + 32, t.data).astype(np.uint8)
    listed = Texts(np.frombuffer("".join(INSULTS).encode(), np.uint8), np.cumsum([0, *map(len, INSULTS)]))
    bad = np.isin(t.span_hashes(starts, ends, small), listed.span_hashes(listed.off[:-1], listed.off[1:]))
    n = np.bincount(row[bad], minlength=t.n)
    return (n >= 2) & (500 * n > f["n_words"])


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Facts], np.ndarray]


RULES = tuple(Rule(f.__name__, f) for f in (many_symbols, same_lines, odd_word_length, shouting, few_letters, one_word, abusive))
SAMPLE_ROWS = 2000


def measure(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", rows: int = SAMPLE_ROWS, seed: int = 11) -> list[tuple[str, float, float]]:
    """``(rule, seconds per text, share rejected)`` on about ``rows`` random texts that pass the base rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        took, hit, seen = dict.fromkeys((r.name for r in rules), 0.0), dict.fromkeys((r.name for r in rules), 0), 0
        for batch in batches:
            for part, t in pieces(batch, text):
                counts = base_counts(t)
                facts = Facts(part.column(text), counts).take(np.flatnonzero(~base_failed(counts)))
                seen += facts.texts.n
                for r in rules:
                    start = time.perf_counter()
                    hit[r.name] += int(r.rejects(facts).sum())
                    took[r.name] += time.perf_counter() - start
        names = [r.name for r in rules]
        yield pa.RecordBatch.from_pydict({"rule": names, "s": [took[n] for n in names], "hit": [hit[n] for n in names], "n": [seen] * len(names)})

    total = docs.count()
    some = docs.select(text).sample(min(1.0, rows / max(1, total)), seed)
    found = some.mapInArrow(run, "rule string, s double, hit long, n long").groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("s", "hit", "n")])
    return [(r["rule"], r["s"] / max(1, r["n"]), r["hit"] / max(1, r["n"])) for r in found.collect()]


def order_rules(measured: list[tuple[str, float, float]], rules: Sequence[Rule] = RULES) -> list[Rule]:
    """Highest rejections per second first; a rule that was not measured goes last."""
    worth = {name: share / max(cost, 1e-9) for name, cost, share in measured}
    return sorted(rules, key=lambda r: (-worth.get(r.name, -1.0), r.name))


def judge(docs: DataFrame, order: Sequence[Rule], text: str = "text") -> DataFrame:
    """``docs`` with its counts, ``base_failed``, ``rejected_by`` (null if kept) and ``kept``.

    New columns get leading underscores where ``docs`` has a column of that name.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept")
    names = unused(docs, *names)
    kinds = ["long"] * 5 + ["boolean", "string", "boolean"]
    fields = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))
    order = list(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in pieces(batch, text):
                counts = base_counts(t)
                failed = base_failed(counts)
                by = np.full(t.n, None, object)
                by[failed] = "base"
                alive = np.flatnonzero(~failed)
                facts = Facts(part.column(text), counts).take(alive)
                for rule in order:
                    bad = rule.rejects(facts)
                    if bad.any():
                        by[alive[bad]] = rule.name
                        alive = alive[~bad]
                        facts = facts.take(np.flatnonzero(~bad))
                kept = np.zeros(t.n, bool)
                kept[alive] = True
                made = [pa.array(counts[n].astype(np.int64)) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                made += [pa.array(failed), pa.array(by, pa.string()), pa.array(kept)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *names])

    old = docs.select([F.col(f"`{c}`") for c in docs.columns])
    return old.mapInArrow(run, f"{ddl(docs)}, {fields}")


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    return judge(docs, order_rules(measure(docs, rules, text, sample_rows), rules), text)


@query("op5_quality_rules")
def rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cascade(docs).drop("text")
