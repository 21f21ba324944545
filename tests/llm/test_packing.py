import random
import zlib

import numpy as np
import pytest

from framepair.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("limits", [packing.Limits(64, 4, 64), packing.Limits(64, 3, 20), packing.Limits(1024, 32, 1024)])
def test_every_token_is_placed_once_within_all_limits(limits):
    r = random.Random(3)
    texts = [(i, n, r.randrange(n + 1)) for i, n in enumerate(r.choice([1, 2, 5, 30, 64, 200, 1]) for _ in range(500))]
    bins = list(packing.pack(iter(texts), limits))
    placed = {}
    for one in bins:
        total = sum(p.tokens for p in one)
        assert 0 < total <= limits.tokens and len(one) <= limits.segments and sum(p.loss for p in one) <= limits.loss
        assert total == limits.tokens or total & (total - 1) == 0
        for p in one:
            placed.setdefault(p.row, []).append((p.start, p.tokens, p.loss))
    for row, n, loss in texts:
        at = 0
        for start, tokens, _ in sorted(placed[row]):
            assert start == at
            at += tokens
        assert at == n and sum(x[2] for x in placed[row]) == loss


def test_uncut_texts_stay_whole_and_too_long_ones_raise():
    bins = list(packing.pack(iter([(i, n, n) for i, n in enumerate([10, 60, 4, 50, 64, 1])]), packing.Limits(64, 8, 64), may_cut=False))
    assert sorted(p.tokens for b in bins for p in b) == [1, 4, 10, 50, 60, 64] and len(bins) == 3
    with pytest.raises(ValueError):
        list(packing.pack(iter([(0, 65, 0)]), packing.Limits(64, 8, 64), may_cut=False))


def test_dot_product_prefers_what_fits_the_rest():
    waiting = packing.Waiting()
    for i, (n, loss) in enumerate([(50, 5), (60, 60), (8, 1)]):
        waiting.add(packing.Piece(i, 0, n, loss))
    assert waiting.choose([64, 4, 10], packing.Limits(64, 4, 64)) == (50, 5)
    assert waiting.choose([9, 4, 64], packing.Limits(64, 4, 64)) == (8, 1)
    assert waiting.choose([64, 0, 64], packing.Limits(64, 4, 64)) is None


HARD = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x <|endoftext|", "", " ", "a  b \n c\t d  ", "　x　 y  z\n\n k", "it's 5 o'clock  <|endoftext|> \x1c w \x85 v", "x" * 5000, " lead", "trail ", "é ü  ñ"]


def test_ids_equal_those_of_the_json_file():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    e = packing.Encoder(*packing.public_vocabulary())
    for text in HARD:
        assert "".join(packing.chunks(text)) == text
        ids = [np.frombuffer(e.encode(text), "<u4").tolist() for _ in range(2)]
        assert ids == 2 * [t.encode(text, add_special_tokens=False).ids]


def test_pieces_carry_their_ids(frame, prose):
    texts = [(i, t) for i, t in enumerate([*HARD, None, prose(2000, 1), prose(30, 2), prose(30, 2)])]
    e = packing.Encoder(*packing.public_vocabulary())
    done = packing.pack_texts(frame(texts), *packing.public_vocabulary()).collect()
    for key, text in texts:
        ids = np.array([*np.frombuffer(e.encode(text or ""), "<u4"), 0], "<u4")
        mine = sorted((r for r in done if r["doc_id"] == key), key=lambda r: r["start"])
        assert [r["start"] for r in mine] == [0, *np.cumsum([r["length"] for r in mine])[:-1].tolist()]
        assert sum(r["length"] for r in mine) == len(ids) == mine[0]["doc_tokens"]
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine)
    for seq in {r["sequence_id"] for r in done}:
        mine = sorted((r for r in done if r["sequence_id"] == seq), key=lambda r: r["offset"])
        assert [r["offset"] for r in mine] == [0, *np.cumsum([r["length"] for r in mine])[:-1].tolist()]
    assert packing.pack_texts(frame([]).limit(0), *packing.public_vocabulary()).collect() == []


def test_the_loss_limit_shapes_a_table_with_masked_prompts(frame, prose):
    from pyspark.sql import functions as F

    texts = [(i, prose(20 + i % 50, i)) for i in range(60)]
    docs = frame(texts).withColumn("answer", F.when(F.col("doc_id") % 3 == 0, 5).when(F.col("doc_id") % 3 == 1, 10_000)).coalesce(1)
    limits = packing.Limits(1024, 32, 300)
    done = packing.pack_texts(docs, *packing.public_vocabulary(), limits=limits, loss="answer").collect()
    loss, tokens = {}, {}
    for r in done:
        loss[r["sequence_id"]] = loss.get(r["sequence_id"], 0) + r["loss_tokens"]
        tokens[r["sequence_id"]] = tokens.get(r["sequence_id"], 0) + r["length"]
    assert max(loss.values()) <= 300 and max(tokens.values()) <= 1024
    of = {}
    for r in done:
        of[r["doc_id"]] = of.get(r["doc_id"], 0) + r["loss_tokens"]
        size = r["doc_tokens"]
        of[r["doc_id"], "want"] = [5, size - 1, 0][r["doc_id"] % 3] if r["doc_id"] % 3 else min(5, size - 1)
    assert all(of[i] == of[i, "want"] for i, _ in texts)
    # Loss-heavy pieces are mixed with masked ones, not put side by side until the limit closes a bin early.
    free = packing.pack_texts(docs, *packing.public_vocabulary(), limits=packing.Limits(1024, 32, 1024), loss="answer").collect()
    assert {(r["sequence_id"], r["doc_id"], r["start"]) for r in free} != {(r["sequence_id"], r["doc_id"], r["start"]) for r in done}
