import zlib

import numpy as np
from pyspark.sql import functions as F

from framepair.llm import language as g
from framepair.llm.common import table

SF = "/root/testdata/sf0.001"


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in g.start_weights(3, 4).items()}
    words = rng.integers(97, 103, (5, 4)).astype(np.uint8)
    target, weight = np.array([0, 1, 2, 1, 0]), np.ones(5)
    _, grad = g.gradients(w, words, target, weight)
    for k in w:
        for _ in range(6):
            at = tuple(int(rng.integers(0, s)) for s in w[k].shape)
            at = (int(words[0, 0]), at[1]) if k[0] == "x" else at
            old = w[k][at]
            w[k][at] = old + 1e-4
            up = g.gradients(w, words, target, weight)[0]
            w[k][at] = old - 1e-4
            down = g.gradients(w, words, target, weight)[0]
            w[k][at] = old
            assert abs((up - down) / 2e-4 - grad[k][at]) < 1e-4


def test_both_directions_reach_every_position():
    w = g.start_weights(2, 4)
    a, _ = g.label(w, np.frombuffer(b"abcdef", np.uint8)[None])
    first, _ = g.label(w, np.frombuffer(b"xbcdef", np.uint8)[None])
    last, _ = g.label(w, np.frombuffer(b"abcdex", np.uint8)[None])
    assert (np.abs(first - a).max((1, 2)) > 0).all() and (np.abs(last - a).max((1, 2)) > 0).all()
    assert np.allclose(a.sum(-1), 1)


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    done = g.language_query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    assert done.where("held_out AND lang_pred = lang").count() >= 0.95 * done.where("held_out AND lang IS NOT NULL").count()
    for r in done.where("score < 0 OR score > 1 OR lang_pred IS NULL").take(1):
        raise AssertionError(r)


def test_edge_cases(spark, frame):
    texts = [(1, None), (2, ""), (3, "123 -- 5"), (4, "the thing of the"), (4, "the thing of the"), (5, "é"), (6, "！２"), (7, "the" * 5000), (None, "the")]
    words = [b"the", b"thing", b"of", b"une", b"de", b"elle"] * 20
    model = g.fit(words, np.array([0, 0, 0, 1, 1, 1] * 20), 2, steps=150), ["en", "fr"]
    done = g.predict(frame(texts), model)
    assert done.columns == ["doc_id", "kept", "lang_pred", "score"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in done.collect()}
    assert [got[i] for i in (1, 2, 3, 6)] == [("und", 0.0)] * 4
    assert got[4][0] == got[7][0] == got[None][0] == "en" and got[5][0] in ("en", "fr")
    assert {r["lang_pred"] for r in g.predict(frame(texts), None).collect()} == {"und"}
    assert g.predict(frame([]).limit(0), model).collect() == []
    empty = table(spark, SF, "documents").limit(0)
    assert g.learn(empty, "text", "lang", "doc_id") is None


def test_held_out_follows_the_checksum(spark):
    got = {r["id"]: r["h"] for r in spark.range(50).select("id", g.held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


def test_the_store_changes_no_answer():
    from framepair.llm.textnum import Texts

    w = g.start_weights(3)
    raw = b"one two three two one " * 30 + b"x" * 100
    t = Texts(np.frombuffer(raw, np.uint8), np.array([0, 50, len(raw)]))
    store = g.Store(3)
    a, n = g.pooled(w, t)
    for _ in range(2):
        b, m = g.pooled(w, t, store)
        assert np.allclose(a, b, rtol=1e-5) and (n == m).all()
