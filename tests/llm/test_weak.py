import numpy as np
import pytest

from framepair.llm import weak
from framepair.llm.common import table


def test_em_finds_planted_accuracies():
    rng = np.random.default_rng(1)
    m, n = 5, 40_000
    good = rng.random(n) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.75])
    v = np.where((rng.random((n, m)) < right) == good[:, None], weak.GOOD, weak.BAD)
    v[rng.random((n, m)) < 0.2] = weak.NONE
    code, count = np.unique(weak.codes(v), return_counts=True)
    model = weak.expectation_maximisation(code, count.astype(float), m)
    assert abs(model.good - 0.8) < 0.02
    cast = 1 - model.table[:, :, weak.NONE]
    assert np.abs(model.table[:, 1, weak.GOOD] / cast[:, 1] - right).max() < 0.03
    assert ((model.posterior(weak.codes(v)) >= 0.5) == good).mean() > 0.95


def test_agrees_with_the_labels(spark):
    sf = "/root/testdata/sf0.01"
    done = weak.weak_query(spark, sf).join(table(spark, sf, "labels").dropDuplicates(["doc_id"]), "doc_id")
    assert done.where("quality = 0 AND kept").count() <= 0.1 * done.where("quality = 0").count()
    assert done.where("quality = 1 AND NOT kept").count() <= 0.03 * done.where("quality = 1").count()


def test_edge_cases(frame, prose):
    texts = [(i, prose(120, i)) for i in range(40)] + [(100 + i, f"spam{i} " * 90) for i in range(20)] + [(200, None), (201, ""), (202, "word"), (None, prose(60, 1)), (7, prose(120, 7)), (203, prose(20000, 4))]
    docs = frame(texts)
    model = weak.train(docs)
    done = weak.classify(docs, model)
    assert done.columns == ["doc_id", "text", "kept", "weak_good", "score", "_kept"] and done.count() == len(texts)
    got = {r["doc_id"]: r["_kept"] for r in done.collect()}
    assert all(got[i] for i in range(40)) and not any(got[100 + i] for i in range(20))
    assert weak.train(docs.limit(0)) is None
    assert weak.classify(docs.limit(0), None).collect() == []


def test_scorer_needs_both_words_and_shapes():
    row, slot, value = np.arange(200), np.arange(200) % 2 + 5, np.ones(200)
    w, b = weak.fit_scorer(row, slot, value, (np.arange(200) % 2).astype(float))
    assert w[6] + b > 0 > w[5] + b
    with pytest.raises(IndexError):
        w[1 << weak.BITS]
