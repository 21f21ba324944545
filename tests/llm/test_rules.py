import re
from collections import Counter

import numpy as np
import pyarrow as pa

from framepair.llm import rules
from framepair.llm.textnum import Texts, string_buffers

TEXTS = [None, "", " \t\n", "one", "a b c a b c a b c d", "x\n\nx\n \nx y\nx", "# 5% é|é <ü>", "  a　b", "same line\n" * 5, "w " * 3000, "café naïve " * 40]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    hit = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_base_counts_match_brute_force():
    c = rules.base_counts(Texts(*string_buffers(pa.array(TEXTS))))
    got = list(zip(*[c[n].tolist() for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], strict=True))
    assert got == [brute(t) for t in TEXTS]


def test_words_that_polynomials_confuse_are_different(twins):
    a, b = twins
    texts = [f"{a} x y z {b} x y q", f"{a} x y z {a} x y q", f"{a}\n{b}", f"{a}\n{a}"]
    c = rules.base_counts(Texts(*string_buffers(pa.array(texts))))
    got = list(zip(*[c[n].tolist() for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], strict=True))
    assert got == [brute(t) for t in texts]


def test_order_changes_no_verdict(frame, prose):
    docs = frame([(i, t) for i, t in enumerate([*TEXTS, prose(80, 1), prose(80, 2).upper(), prose(300, 3) + " idiot scum moron", prose(80, 1)])])
    order = rules.order_rules(rules.measure(docs))
    assert {r.name for r in order} == {r.name for r in rules.RULES}
    runs = [{(r["doc_id"], r["_kept"]) for r in rules.judge(docs, o).collect()} for o in (order, order[::-1], rules.RULES)]
    assert runs[0] == runs[1] == runs[2]
    kept = {i for i, k in runs[0] if k}
    assert kept == {len(TEXTS), len(TEXTS) + 3}


def test_rules_run_by_rejections_per_cost():
    found = rules.order_rules([("shouting", 1.0, 0.5), ("abusive", 0.1, 0.2), ("same_lines", 1.0, 0.0)])
    assert [r.name for r in found][:3] == ["abusive", "shouting", "same_lines"]


def test_a_rejected_text_is_not_looked_at_again(frame, prose):
    seen = []

    def spy(f):
        seen.append(f.texts.n)
        return np.zeros(f.texts.n, bool)

    facts = rules.Facts(pa.array([prose(60, 1), prose(60, 2)]))
    spy(facts.take(np.array([1])))
    assert seen == [1]


def test_empty_table_and_extra_columns(frame, spark):
    assert rules.cascade(frame([]).limit(0)).collect() == []
    assert rules.cascade(frame([(1, None)])).columns[:3] == ["doc_id", "text", "kept"]
