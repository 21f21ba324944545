import random
import re

import numpy as np
import pytest

import corpus_pipeline as p
from framepair.llm import passages
from framepair.llm import substrings as s
from framepair.llm.common import table

SF = "/root/testdata/sf0.001"


def brute(texts, words, length):
    """What is left of every text, one window after the other."""
    raw = [(t or "").encode() for t in texts]
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in raw]
    series = [tuple(b[lo:hi] for lo, hi in at) for b, at in zip(raw, spans, strict=True)]
    met = {}
    for b, w in zip(raw, series, strict=True):
        for key in [b[i : i + length] for i in range(len(b) - length + 1)] + [w[i : i + words] for i in range(len(w) - words + 1)]:
            met[key] = met.get(key, 0) + 1
    out = []
    for t, b, at, w in zip(texts, raw, spans, series, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            gone[i : i + length] |= met[b[i : i + length]] > 1
        for i in range(len(w) - words + 1):
            gone[at[i][0] : at[i + words - 1][1]] |= met[w[i : i + words]] > 1
        out.append(None if t is None else bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore"))
    return out


def corpus(words):
    """Passages of ``words`` - 1, ``words`` and more words in different surroundings, and cases of their own."""
    r = random.Random(7)
    some = lambda n: [r.choice("ab") * r.randrange(1, 4) + str(r.randrange(10**6)) for _ in range(n)]
    short, just, long = some(words - 1), some(words), some(3 * words)
    texts = []
    for i in range(12):
        texts += [" ".join(some(9 + i) + just + some(5)), " ".join(some(words) + short + some(4 + i))]
        at = r.randrange(words)
        texts.append(" ".join(some(i) + long[at : at + 2 * words] + some(i)))
    half, other = some(words // 2 + 2), some(words // 2 + 2)
    # Two stock phrases side by side make no passage.
    texts += [" ".join(some(8) + half + other + some(8)), " ".join(some(8) + half + some(8)), " ".join(some(8) + other + some(8))]
    texts += ["\n\t".join(just), " ".join(["é"] * (words + 3)), " ".join(["x"] * (words - 1)), "语" * 500 + "a", "b" + "语" * 500]
    return [*texts, None, "", " \n", texts[0], texts[0], " ".join(just[1:])]


@pytest.mark.parametrize("words", [51, 20])
def test_matches_brute_force(frame, words):
    texts = corpus(words)
    done = s.remove_repeats(frame(list(enumerate(texts))), words=words, as_text=True).collect()
    assert [r["text"] for r in sorted(done, key=lambda r: r["doc_id"])] == brute(texts, words, s.LENGTH)


def test_confusable_words_make_no_passage(frame, twins):
    a, b = twins
    tail = " ".join(f"w{i}" for i in range(50))
    texts = [f"{a} {tail}", f"{b} {tail}"]
    done = s.remove_repeats(frame(list(enumerate(texts))), words=51, mark=True).collect()
    assert all(r["passage_spans"] == [] for r in done)
    done = s.remove_repeats(frame(list(enumerate([texts[0], texts[0][:-1] + "x " + texts[0]]))), words=51, mark=True).collect()
    assert all(len(r["passage_spans"]) == 1 for r in done)


@pytest.mark.parametrize("share", [1 << 22, 37])
def test_shares_cut_no_window(monkeypatch, share):
    monkeypatch.setattr(passages, "SHARE", share)
    r = random.Random(3)
    h = np.array([r.randrange(1 << 64) for _ in range(400)], np.uint64)
    row = np.sort(np.array([r.randrange(5) for _ in range(400)]))
    lo, windows, *_ = passages.word_contexts(h, row, 20, 8)
    met = [int(a) + i for a, n in zip(lo, windows, strict=True) for i in range(n)]
    assert met == [i for i in range(381) if row[i] == row[i + 19]]


def test_stage_removes_planted_passages_of_51_words(spark):
    docs = table(spark, SF, "documents").limit(40).collect()
    r = random.Random(5)
    word = lambda: "".join(r.choice("aeinrst") for _ in range(5))
    just, under = [" ".join(word() for _ in range(n)) for n in (51, 50)]
    assert len(just) < s.LENGTH
    planted = []
    for i, d in enumerate(docs):
        passage = just if i % 4 == 0 else under if i % 4 == 1 else ""
        text = f"{d['text']} {i} {passage} {i} end" if passage else d["text"]
        planted.append((d["doc_id"], text, d["lang"], d["source"], len(text)))
    done = p.repeated_strings(spark, spark.createDataFrame(planted, table(spark, SF, "documents").schema), SF).collect()
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in done}
    want = dict(zip([x[0] for x in planted], brute([x[1] for x in planted], 51, 400), strict=True))
    assert got == {i: (t, len(t)) for i, t in want.items()}
    assert not any(just in t for t, _ in got.values()) and sum(under in t for t, _ in got.values()) == 10
