"""The prefix trie against one that is built sequence by sequence."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from framepair.llm import trie

TURNS = T.StructType([T.StructField(n, t) for n, t in (("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("KEY", T.StringType()))])


def in_order(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}


def brute(convs):
    nodes = defaultdict(lambda: {"members": [], "ends": []})
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])]["members"].append(c)
        nodes[tuple(turns)]["ends"].append(c)
    below = {path: [p for p in nodes if len(p) > len(path) and p[: len(path)] == path] for path in nodes}
    out = set()
    for path, n in nodes.items():
        subtree = [path, *below[path]]
        saved = sum((len(nodes[p]["members"]) - 1) * len(p[-1][1]) for p in subtree if p)
        leaves = sum(not below[p] for p in subtree)
        ends = hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest()
        parent = min(nodes[path[:-1]]["members"]) if path else None
        children = sum(len(p) == len(path) + 1 for p in below[path])
        out.add((min(n["members"]), len(path), parent, len(n["members"]), children, leaves, saved, ends))
    return out


def found(df):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256")
    rows = [tuple(r) for r in df.select(*columns).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], TURNS)


def test_random_conversations(spark):
    r = random.Random(5)
    rows = []
    for c in range(60):
        for turn in range(r.choice([0, 1, 2, 3, 5])):
            rows.append((c, r.choice([None, turn, turn]), r.choice(["user", None]), r.choice(["a", "ééé", "", None])))
    rows += [(None, 0, "user", "a"), (3, 0, "user", "a"), (3, 0, "user", "a")]
    assert found(trie.prefix_trie(trie.sequences(made(spark, rows)))) == brute(in_order(rows))


def test_long_conversations_are_stripped_over_silent_depths(spark):
    tail = lambda c, lo, hi, mark: [(c, t, "user", f"{mark}{t}") for t in range(lo, hi)]
    rows = [
        *tail(1, 0, 40, "s"),  # shared by 1, 2 and 3 up to different depths
        *tail(2, 0, 23, "s"), *tail(2, 23, 40, "two"),
        *tail(3, 0, 9, "s"), *tail(3, 9, 60, "three"),
        *tail(4, 0, 60, "four"), *tail(5, 0, 60, "four"),
        *tail(6, 0, 2, "s"),
    ]
    assert found(trie.prefix_trie(trie.sequences(made(spark, rows)))) == brute(in_order(rows))


def test_copies_end_at_one_node(spark):
    rows = [(c, t, "user", "same") for c in range(-3, 120) for t in range(2)]
    assert found(trie.prefix_trie(trie.sequences(made(spark, rows)))) == brute(in_order(rows))


def test_rebuilt_conversations(spark):
    r = random.Random(6)
    rows = [(c, t, "user", r.choice("ab")) for c in [*range(30), *range(200, 215), 331, 399] for t in range(r.randint(1, 8))]
    own = in_order(rows)
    want = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    assert any(not t for t in want.values())  # a block without its first conversation has turnless ones
    assert found(trie.prefix_trie(trie.rebuilt(trie.sequences(made(spark, rows))))) == brute(want)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "a")]])
def test_no_conversations(spark, rows):
    done = trie.prefix_trie(trie.sequences(made(spark, rows)))
    assert done.count() == 0 and "saved" in done.columns


def test_roles_and_texts_do_not_run_together(spark):
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, "", "abc")]
    assert found(trie.prefix_trie(trie.sequences(made(spark, rows)))) == brute(in_order(rows))
