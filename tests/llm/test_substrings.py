import hashlib
import random

import numpy as np
import pytest

from framepair.llm import substrings as s
from framepair.llm import suffixes

LENGTH, GRAM = 40, 16


def brute(texts, length=LENGTH):
    raw = [(k, (t or "").encode()) for k, t in texts]
    met = {}
    for _, b in raw:
        for p in range(len(b) - length + 1):
            met[b[p : p + length]] = met.get(b[p : p + length], 0) + 1
    out = []
    for k, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if met[b[p : p + length]] > 1:
                gone[p : p + length] = True
        edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((k, len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    r = random.Random(4)
    line = lambda n, a="abcdefgh é": "".join(r.choice(a) for _ in range(n))
    base, passage = line(400), line(55)
    texts = [(1, base), (2, base), (2, base), (3, None), (4, ""), (5, "short"), (6, line(39)), (7, "ab" * 200), (8, "xyz" * 50 + line(30)), (9, base[:39] + "!")]
    for i in range(10, 40):
        near = list(base[r.randrange(100) : 300 + r.randrange(100)])
        near[r.randrange(len(near))] = "Q"
        texts.append((i, "".join(near) if i % 3 else line(100) + passage + line(r.randrange(90))))
    return [*texts, (None, base[:60]), (50, "é" * 45), (51, "\0" * 60)]


@pytest.mark.parametrize("hot", [10_000, 1])
def test_matches_brute_force(frame, hot):
    texts = corpus()
    done = s.remove_repeats(frame(texts), length=LENGTH, gram=GRAM, hot=hot)
    assert done.columns[:3] == ["doc_id", "text", "kept"]
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["removed_spans"]), hashlib.sha256(r["kept_bytes"]).hexdigest()) for r in done.collect()]
    assert sorted(got, key=str) == brute(texts)


def test_kept_text_and_empty_table(frame):
    same = "é" * 30 + "abc"
    done = s.remove_repeats(frame([(1, same + "x"), (2, "y" + same), (3, None)]), length=LENGTH, gram=GRAM, as_text=True)
    assert {r["doc_id"]: r["text"] for r in done.collect()} == {1: "x", 2: "y", 3: None}
    assert s.remove_repeats(frame([]).limit(0)).collect() == []


def test_suffix_order_is_lexicographic():
    r = random.Random(2)
    for _ in range(20):
        base = bytes(r.choice(b"ab") for _ in range(600))
        parts = [base[(a := r.randrange(150)) : a + r.randrange(420, 450)] for _ in range(8)] + [(b"xyz" * 200)[:430], b"\0" * 410, b"a" * 401]
        data, starts, ends = suffixes.laid_out(parts)
        words = suffixes.leading_words(data)
        ranks = suffixes.cover_ranks(words, starts, ends, 400)
        at = np.concatenate([np.arange(a, b - 400 + 1) for a, b in zip(starts, ends, strict=True)])
        order = at[suffixes.sort_suffixes(words, ranks, at)]
        found = [data[p : p + 400].tobytes() for p in order]
        assert found == sorted(found)


def test_cover_meets_for_all_residues():
    for a in range(suffixes.V):
        for b in range(suffixes.V):
            d = suffixes.MEET[a, b]
            assert suffixes.IN_COVER[(a + d) % suffixes.V] and suffixes.IN_COVER[(b + d) % suffixes.V]


def test_long_texts_are_read_in_shares(monkeypatch):
    from framepair.llm.textnum import Texts

    data = np.frombuffer(random.Random(1).randbytes(3000), np.uint8)
    t = Texts(data, np.array([0, 3000]))
    whole = s.contexts(t, LENGTH, GRAM)
    windows = {(int(b), int(st + i), int(left - i)) for _, b, _, st, n, left in zip(*whole, strict=True) for i in range(n)}
    row, *_ = whole
    assert len(windows) == 3000 - LENGTH + 1
    parts = set()
    for lo in range(0, 3000 - LENGTH + 1, 700):
        part = Texts(data[lo : lo + 700 + LENGTH - 1], np.array([0, len(data[lo : lo + 700 + LENGTH - 1])]))
        parts |= {(int(b), int(lo + st + i), int(left - i)) for _, b, _, st, n, left in zip(*s.contexts(part, LENGTH, GRAM), strict=True) for i in range(n)}
    assert parts == windows
