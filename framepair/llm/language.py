"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

The network reads runs of letters (A-Z lower-cased; every byte from 0x80 up
counts as a letter), the state starting anew at each run; runs longer than
``LONGEST`` bytes are read in pieces. Each direction keeps ``HIDDEN`` states;
both together label every byte position with language probabilities, and a
text's probabilities are the mean over all its positions. Because the state
starts anew, equal words have equal labels, so a task labels each distinct word
of a piece of text once and weighs it by its count.

Training: backpropagation through time with Adam, on the driver, over a bounded
sample: about ``SAMPLE_ROWS`` texts chosen by a hash of their id, at most
``WORDS_PER_TEXT`` words of each. Scoring is one map over all rows and whole
texts; the weights (about 100 kB) are broadcast.

Null texts and texts without a letter are ``und`` with score 0; so is every
text if there is nothing to learn from. Repeated rows get equal answers. A null
id is never held out and never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framepair.llm.common import chosen, query, table, unused
from framepair.llm.rules import LETTER, UPPER, ddl
from framepair.llm.textnum import U64, Texts, mix, pieces

HIDDEN, LONGEST = 16, 24
SAMPLE_ROWS, WORDS_PER_TEXT = 3000, 60
STEPS, BATCH, RATE = 1500, 256, 0.01
STORE = 400_000  # words whose labels a task keeps
BLOCK = 2048  # words that run in lock-step
UNKNOWN = "und"

Weights = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def start_weights(n_out: int, hidden: int = HIDDEN, seed: int = 3) -> Weights:
    rng = np.random.default_rng(seed)
    w: Weights = {}
    for d in "fb":  # forward, backward
        w[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        w[f"h{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
        w[f"o{d}"] = rng.normal(0, 0.3, (hidden, n_out)).astype(np.float32)
    w["bias"] = np.zeros(n_out, np.float32)
    return w


def one_way(w: Weights, d: str, seen: np.ndarray) -> tuple[np.ndarray, list]:
    """States ``(length, batch, hidden)`` over byte rows ``seen (length, batch)``, and what the way back needs."""
    wx, wh = w[f"x{d}"], w[f"h{d}"]
    n = wh.shape[0]
    h = np.zeros((seen.shape[1], n), np.float32)
    states, kept = np.empty((*seen.shape, n), np.float32), []
    for t in range(len(seen)):
        x = wx[seen[t]]
        zr = sigmoid(x[:, : 2 * n] + h @ wh[:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        c = np.tanh(x[:, 2 * n :] + (r * h) @ wh[:, 2 * n :])
        kept.append((h, z, r, c))
        h = h + z * (c - h)
        states[t] = h
    return states, kept


def one_way_back(w: Weights, d: str, seen: np.ndarray, kept: list, grad: np.ndarray, out: Weights) -> None:
    """Backpropagation through time: adds to ``out`` the gradients for ``grad`` on the states."""
    wh = w[f"h{d}"]
    n = wh.shape[0]
    flow = np.zeros_like(grad[0])
    for t in reversed(range(len(seen))):
        h, z, r, c = kept[t]
        flow = flow + grad[t]
        dc = flow * z * (1 - c * c)
        dz = flow * (c - h) * z * (1 - z)
        drh = dc @ wh[:, 2 * n :].T
        dr = drh * h * r * (1 - r)
        gates = np.concatenate([dz, dr], 1)
        out[f"h{d}"][:, : 2 * n] += h.T @ gates
        out[f"h{d}"][:, 2 * n :] += (r * h).T @ dc
        np.add.at(out[f"x{d}"], seen[t], np.concatenate([gates, dc], 1))
        flow = flow * (1 - z) + drh * r + gates @ wh[:, : 2 * n].T


def label(w: Weights, words: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Probabilities ``(length, batch, languages)`` of every position of equally long words."""
    ahead, behind = words.T, words.T[::-1]
    f, kf = one_way(w, "f", ahead)
    b, kb = one_way(w, "b", behind)
    b = b[::-1]
    logits = f @ w["of"] + b @ w["ob"] + w["bias"]
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True), (ahead, behind, f, b, kf, kb)


def gradients(w: Weights, words: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, Weights]:
    """Weighted cross-entropy of all positions, each having its word's language."""
    p, (ahead, behind, f, b, kf, kb) = label(w, words)
    length, batch, _ = p.shape
    share = (weight / (weight.sum() * length)).astype(np.float32)
    at = (slice(None), np.arange(batch), target)
    loss = float(-(np.log(p[at] + 1e-9) * share).sum())
    d = p.copy()
    d[at] -= 1
    d *= share[None, :, None]
    out = {k: np.zeros_like(v) for k, v in w.items()}
    out["bias"] += d.sum((0, 1))
    out["of"] += np.einsum("lbh,lbo->ho", f, d)
    out["ob"] += np.einsum("lbh,lbo->ho", b, d)
    one_way_back(w, "f", ahead, kf, d @ w["of"].T, out)
    one_way_back(w, "b", behind, kb, (d @ w["ob"].T)[::-1], out)
    return loss, out


def fit(words: Sequence[bytes], target: np.ndarray, n_out: int, steps: int = STEPS, seed: int = 5) -> Weights:
    """Adam over batches of equally long words; languages weigh the same however rare."""
    rng = np.random.default_rng(seed)
    w = start_weights(n_out)
    size = np.array([len(x) for x in words])
    lengths = np.unique(size)
    by_length = [np.flatnonzero(size == n) for n in lengths]
    grids = [np.frombuffer(b"".join(words[i] for i in at), np.uint8).reshape(len(at), n) for at, n in zip(by_length, lengths, strict=True)]
    share = np.array([len(at) * n for at, n in zip(by_length, lengths, strict=True)], float)
    share /= share.sum()
    rarity = len(target) / (n_out * np.maximum(1, np.bincount(target, minlength=n_out)))
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        g = rng.choice(len(lengths), p=share)
        take = rng.integers(0, len(by_length[g]), BATCH)
        t = target[by_length[g][take]]
        _, grad = gradients(w, grids[g][take], t, rarity[t])
        rate = RATE * min(1.0, step / 50) * (1.0 if step < 0.7 * steps else 0.2)
        for k in w:
            m[k] += 0.1 * (grad[k] - m[k])
            v[k] += 0.01 * (grad[k] ** 2 - v[k])
            w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


# -- words of a piece of text ------------------------------------------------
def letter_runs(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes and the letter runs of at most ``LONGEST`` bytes: starts, ends, row."""
    data = np.where(UPPER[t.data], t.data + 32, t.data).astype(np.uint8)
    starts, ends, row = t.runs(LETTER[t.data])
    if len(starts) and (ends - starts).max() > LONGEST:
        n = -(-(ends - starts) // LONGEST)
        which = np.repeat(np.arange(len(starts)), n)
        part = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        starts, ends, row = starts[which] + part * LONGEST, ends[which], row[which]
        ends = np.minimum(ends, starts + LONGEST)
    return data, starts, ends, row


class Store:
    """Summed probabilities of the words a task has met, by their hash; it starts anew at ``STORE`` words."""

    def __init__(self, n_out: int) -> None:
        self.hashes, self.sums = np.zeros(0, U64), np.zeros((0, n_out), np.float32)

    def missing(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.ones(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] != hashes

    def add(self, hashes: np.ndarray, sums: np.ndarray) -> None:
        hashes, sums = np.concatenate([self.hashes, hashes]), np.concatenate([self.sums, sums])
        order = np.argsort(hashes)
        self.hashes, self.sums = hashes[order], sums[order]

    def get(self, hashes: np.ndarray) -> np.ndarray:
        return self.sums[np.searchsorted(self.hashes, hashes)]


def pooled(w: Weights, t: Texts, store: Store | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Summed position probabilities ``(rows, languages)`` and the number of positions."""
    data, starts, ends, row = letter_runs(t)
    n_out = len(w["bias"])
    sums = np.zeros((t.n, n_out), np.float64)
    if not len(starts):
        return sums, np.zeros(t.n, np.int64)
    hashes, first, which = np.unique(t.span_hashes(starts, ends, data), return_index=True, return_inverse=True)
    store = store if store is not None else Store(n_out)
    if len(store.hashes) > STORE:
        store.__init__(n_out)
    new = np.flatnonzero(store.missing(hashes))
    a, size = starts[first[new]], (ends - starts)[first[new]]
    found = np.empty((len(new), n_out), np.float32)
    for n in np.unique(size):
        same = np.flatnonzero(size == n)
        for lo in range(0, len(same), BLOCK):
            at = same[lo : lo + BLOCK]
            p, _ = label(w, data[a[at][:, None] + np.arange(n)])
            found[at] = p.sum(0)
    store.add(hashes[new], found)
    found = store.get(hashes)
    for k in range(n_out):
        sums[:, k] = np.bincount(row, weights=found[which, k], minlength=t.n)
    return sums, np.bincount(row, weights=ends - starts, minlength=t.n).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, text: str, lang: str, key: str, rows: int = SAMPLE_ROWS) -> tuple[Weights, list[str]] | None:
    """Weights and language names from ``(key, text, lang)``, or None without examples."""
    usable = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull())
    some = chosen(usable, rows, usable.count(), "language", key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in pieces(batch, text):
                data, starts, ends, row = letter_runs(t)
                # A text's words by the order of their mixed positions: a random choice that stays the same.
                order = np.lexsort((mix(np.arange(len(row)).astype(U64)), row))
                place = np.arange(len(row)) - np.searchsorted(row[order], row[order])
                take = order[place < WORDS_PER_TEXT]
                names = part.column(lang).to_pylist()
                words = [data[starts[i] : ends[i]].tobytes() for i in take]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([names[row[i]] for i in take], pa.string())], names=["word", "lang"])

    # Twice the sample is reached by repeated rows alone, of which fewer serve as well.
    found = some.select(text, lang).mapInArrow(run, "word binary, lang string").limit(2 * rows * WORDS_PER_TEXT).toPandas()
    if not len(found):
        return None
    found = found.sort_values(["lang", "word"], kind="stable")
    names = sorted(found["lang"].unique())
    target = found["lang"].map({n: i for i, n in enumerate(names)}).to_numpy()
    return fit([bytes(x) for x in found["word"]], target, len(names)), names


def predict(docs: DataFrame, model: tuple[Weights, list[str]] | None, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``lang_pred`` and ``score``."""
    rest = [c for c in docs.columns if c != text]
    made = unused(docs.select(*rest), "lang_pred", "score")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(len(held.value[1])) if held.value else None
        for batch in batches:
            for part, t in pieces(batch, text, 4 << 20):
                names, score = np.full(t.n, UNKNOWN, object), np.zeros(t.n)
                if held.value:
                    weights, langs = held.value
                    sums, n = pooled(weights, t, store)
                    plain = t.per_row(LETTER[t.data] & (t.data < 0x80)) > 0
                    for i in np.flatnonzero((n > 0) & ~plain):
                        plain[i] = any(c.isalpha() for c in t.data[t.off[i] : t.off[i + 1]].tobytes().decode("utf-8", "ignore"))
                    at = np.flatnonzero(plain & (n > 0))
                    best = sums[at].argmax(1)
                    names[at] = np.array(langs, object)[best]
                    score[at] = np.clip(sums[at, best] / n[at], 0, 1)
                kept = [part.column(c) for c in rest]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(score)], names=[*rest, *made])

    return docs.mapInArrow(run, ", ".join(x for x in (ddl(docs.select(*rest)), f"`{made[0]}` string, `{made[1]}` double") if x))


@query("op9_language_id")
def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"))
    model = learn(docs.where(~out).select("doc_id", "text", "lang"), "text", "lang", "doc_id")
    return predict(docs.select("doc_id", out.alias("held_out"), "text"), model)
