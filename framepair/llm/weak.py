"""Quality classifier from weak labels.

Several overlapping heuristics vote good, bad or nothing on every text. The
votes' joint counts (at most 3 to the number of labellers, whatever the table's size)
are what expectation-maximisation needs to estimate the share of good texts and how
each labeller votes on good and on bad ones. A text's posterior is its pattern's.

A linear scorer on hashed features then learns the posteriors of a bounded sample
(``SAMPLE_ROWS`` texts by a hash of their id) and scores every text. It sees
words, their shapes and repetition as hashed features, and no vote.

Counting and scoring are one map each over whole texts; only the vote counts
are shuffled. Null and empty texts get the posterior of their votes like any other.
Repeated rows get equal answers. An empty table gives no rows. A null id is never sampled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framepair.llm.common import chosen, query, table, unused
from framepair.llm.rules import LETTER, LOWER, SYMBOLS, UPPER, base_counts, ddl
from framepair.llm.textnum import NOT_SPACE, U64, Texts, mix, pieces, table_of

GOOD, NONE, BAD = 2, 1, 0
BITS = 16
SAMPLE_ROWS = 4000
SHAPE_WEIGHT = 4.0
ENDS = table_of(b".!?")


SHORT = 60  # words; a text with fewer gives no ground to doubt it unless a vote is bad


def most_common_word(t: Texts) -> np.ndarray:
    starts, ends, row = t.runs(NOT_SPACE[t.data])
    _, first, times = np.unique(mix(t.span_hashes(starts, ends) ^ mix(row.astype(U64))), return_index=True, return_counts=True)
    most = np.zeros(t.n, np.int64)
    np.maximum.at(most, row[first], times)
    return most


LABELLERS = ("length", "repeats", "symbols", "same_lines", "case", "one_word", "word_length", "letters", "sentences")


def votes(t: Texts) -> np.ndarray:
    """``(rows, labellers)`` of GOOD, NONE or BAD."""
    c = base_counts(t)
    n, lines = c["n_words"], c["n_lines"]
    upper, lower = t.per_row(UPPER[t.data]), t.per_row(LOWER[t.data])
    letters = t.per_row(LETTER[t.data] & t.starts_characters())
    most, ends = most_common_word(t), t.per_row(ENDS[t.data])

    def vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        return np.where(bad, BAD, np.where(good | (n < SHORT), GOOD, NONE)).astype(np.int64)

    return np.stack(
        [
            vote(n >= 50, n == 0),
            vote(10 * c["n_repeat_words"] <= n, 10 * c["n_repeat_words"] > 3 * n),
            vote(50 * c["n_symbols"] < n, 10 * c["n_symbols"] > n),
            vote(lines > 2 * c["n_dup_lines"] + 2, 10 * c["n_dup_lines"] > 6 * lines),
            vote(5 * upper < lower, upper > lower),
            vote(8 * most < n, (10 * most > 3 * n) & (n >= 10)),
            vote((c["word_chars"] > 3 * n) & (c["word_chars"] < 9 * n), (c["word_chars"] < 2 * n) | (c["word_chars"] > 15 * n)),
            vote(10 * letters > 8 * c["word_chars"], (10 * letters < 6 * c["word_chars"]) & (n >= SHORT)),
            vote((40 * ends > n) & (3 * ends < n), (2 * ends > n) & (n >= 10)),
        ],
        1,
    )


def codes(v: np.ndarray) -> np.ndarray:
    return (v * 3 ** np.arange(v.shape[1])).sum(1)


@dataclass
class LabelModel:
    good: float  # share of good texts
    table: np.ndarray  # (labellers, class, vote) probabilities, class 1 being good

    def posterior(self, code: np.ndarray) -> np.ndarray:
        """Probability of good for vote patterns."""
        m = len(self.table)
        v = (code[:, None] // 3 ** np.arange(m)) % 3
        log = np.log(self.table)[np.arange(m), :, v].sum(1) + np.log([1 - self.good, self.good])
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))

    def accuracies(self) -> dict[str, float]:
        """Share of right votes among the votes each labeller casts."""
        right = (1 - self.good) * self.table[:, 0, BAD] + self.good * self.table[:, 1, GOOD]
        cast = (1 - self.good) * (1 - self.table[:, 0, NONE]) + self.good * (1 - self.table[:, 1, NONE])
        return dict(zip(LABELLERS, (right / cast).tolist(), strict=True))


def expectation_maximisation(code: np.ndarray, count: np.ndarray, m: int, rounds: int = 200, tolerance: float = 1e-8) -> LabelModel:
    """Fits class share and vote tables to pattern counts, starting from the bad votes alone.

    Bad texts are bad in different ways, so most labellers miss most of them: a
    majority vote would start the bad class at one kind only.
    """
    v = (code[:, None] // 3 ** np.arange(m)) % 3
    hot = np.stack([v == k for k in range(3)], 2).astype(float)  # (patterns, labellers, votes)
    p = np.array([0.95, 0.3, 0.02])[np.minimum(2, (v == BAD).sum(1))]
    before = -np.inf
    for _ in range(rounds):
        weight = np.stack([(1 - p) * count, p * count])
        counts = np.einsum("cp,pmv->mcv", weight, hot) + 0.5
        model = LabelModel(float((weight[1].sum() + 1) / (count.sum() + 2)), counts / counts.sum(2, keepdims=True))
        log = np.einsum("pmv,mcv->pc", hot, np.log(model.table)) + np.log([1 - model.good, model.good])
        top = log.max(1)
        now = float((count * (top + np.log(np.exp(log - top[:, None]).sum(1)))).sum())
        p = model.posterior(code)
        if now - before < tolerance * max(1.0, abs(now)):
            break
        before = now
    return model


# -- hashed features -----------------------------------------------------------
def features(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and value of the hashed features of every text."""
    small = np.where(UPPER[t.data], t.data + 32, t.data).astype(np.uint8)
    starts, ends, row = t.runs(NOT_SPACE[t.data])
    words = t.span_hashes(starts, ends, small)
    n = np.maximum(1, np.bincount(row, minlength=t.n))
    total = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    inside = lambda flags: (s := total(flags))[ends] - s[starts]
    capital, letter, symbol, stop = inside(UPPER[t.data]), inside(LETTER[t.data]), inside(SYMBOLS[t.data]), inside(ENDS[t.data])
    size = ends - starts
    again = np.zeros(len(row), bool)
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    _, which = np.unique(mix(words ^ mix(row.astype(U64))), return_inverse=True)
    often = np.bincount(which)[which] * 20 > n[row] + 40
    shape = np.minimum(capital, 2) + 3 * (letter == 0) + 6 * (symbol > 0) + 12 * np.minimum(stop, 2) + 36 * np.minimum(size // 6, 4) + 180 * again + 360 * often
    kinds = [(mix(words), row), (mix(shape.astype(U64) + U64(1 << 40)), row)]
    scale = [1.0, SHAPE_WEIGHT]
    rows, slots, values = [], [], []
    for (h, r), weight in zip(kinds, scale, strict=True):
        slot = (h >> U64(64 - BITS)).astype(np.int64)
        key, times = np.unique(r * (1 << BITS) + slot, return_counts=True)
        rr = key >> BITS
        value = times / n[rr] * weight if weight != 1.0 else np.log1p(times) / np.sqrt(n[rr])
        rows.append(rr)
        slots.append(key & ((1 << BITS) - 1))
        values.append(value)
    return np.concatenate(rows), np.concatenate(slots), np.concatenate(values)


def fit_scorer(row: np.ndarray, slot: np.ndarray, value: np.ndarray, target: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.3, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adagrad; both classes weigh the same."""
    n = len(target)
    order = np.argsort(row, kind="stable")
    row, slot, value = row[order], slot[order], value[order]
    bounds = np.searchsorted(row, np.arange(n + 1))
    good = target.mean() if n else 0.5
    weight = target / max(good, 1e-3) / 2 + (1 - target) / max(1 - good, 1e-3) / 2
    w, b, seen, seen_b = np.zeros(1 << BITS), 0.0, np.full(1 << BITS, 1e-2), 1e-2
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        mixed = rng.permutation(n)
        for lo in range(0, n, batch):
            some = mixed[lo : lo + batch]
            size = bounds[some + 1] - bounds[some]
            at = np.repeat(bounds[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            of = np.repeat(np.arange(len(some)), size)
            z = np.bincount(of, weights=w[slot[at]] * value[at], minlength=len(some)) + b
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[some]) * weight[some] / len(some)
            slots, which = np.unique(slot[at], return_inverse=True)
            g = np.bincount(which, weights=d[of] * value[at]) + decay * w[slots]
            seen[slots] += g * g
            w[slots] -= rate * g / np.sqrt(seen[slots])
            seen_b += d.sum() ** 2
            b -= rate * d.sum() / np.sqrt(seen_b)
    return w, float(b)


@dataclass
class Quality:
    labels: LabelModel
    weights: np.ndarray
    bias: float


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> Quality | None:
    """The label model of all rows and a scorer fitted on a sample; None for an empty table."""

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, t in pieces(batch, text):
                code, n = np.unique(codes(votes(t)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

    counted = docs.select(text).mapInArrow(patterns, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas().sort_values("code")
    if not len(counted):
        return None
    labels = expectation_maximisation(counted["code"].to_numpy(), counted["n"].to_numpy(float), len(LABELLERS))
    some = chosen(docs.where(F.col(key).isNotNull()), rows, int(counted["n"].sum()), "quality", key, text)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in pieces(batch, text):
                r, slot, value = features(t)
                cut = np.searchsorted(np.sort(r), np.arange(t.n + 1))
                order = np.argsort(r, kind="stable")
                yield pa.RecordBatch.from_pydict(
                    {
                        "code": codes(votes(t)),
                        "slots": [slot[order[a:b]].astype(np.int32) for a, b in zip(cut, cut[1:], strict=False)],
                        "features": [value[order[a:b]].astype(np.float32) for a, b in zip(cut, cut[1:], strict=False)],
                    },
                    pa.schema([("code", pa.int64()), ("slots", pa.list_(pa.int32())), ("features", pa.list_(pa.float32()))]),
                )

    # Twice the sample is reached by repeated rows alone, of which fewer serve as well.
    found = some.select(text).mapInArrow(sampled, "code long, slots array<int>, features array<float>").limit(2 * rows).toArrow()
    size = np.array([len(x) for x in found.column("slots")], np.int64)
    row = np.repeat(np.arange(len(size)), size)
    flat = lambda c: np.concatenate([np.asarray(x.values) for x in found.column(c) if len(x)] or [np.zeros(0)])
    weights, bias = fit_scorer(row, flat("slots").astype(np.int64), flat("features").astype(float), labels.posterior(found.column("code").to_numpy()))
    return Quality(labels, weights.astype(np.float32), bias)


def classify(docs: DataFrame, model: Quality | None, text: str = "text") -> DataFrame:
    """``docs`` with ``weak_good`` (posterior of the votes), ``score`` and ``kept`` (score of 0.5 or more)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = unused(docs, "weak_good", "score", "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = held.value
        for batch in batches:
            for part, t in pieces(batch, text):
                if q is None:
                    raise ValueError("no model: the table it was trained on was empty")
                row, slot, value = features(t)
                z = np.bincount(row, weights=q.weights[slot] * value, minlength=t.n) + q.bias
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                made = [pa.array(q.labels.posterior(codes(votes(t)))), pa.array(score), pa.array(score >= 0.5)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *names])

    kinds = ["double", "double", "boolean"]
    return docs.mapInArrow(run, f"{ddl(docs)}, " + ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))


@query("op3_quality_classifier")
def weak_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, train(docs)).drop("text")
