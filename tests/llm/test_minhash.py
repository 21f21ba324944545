import re

from framepair.llm import components, minhash


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def brute(texts, k):
    sets = []
    for key, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append((key, frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()))
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for i, (key, _) in enumerate(sets):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((key, len(s), least.get(find(i)) if s else key) for i, (key, s) in enumerate(sets)), key=str)


def corpus(prose):
    base = prose(120, 1).split()
    # A chain: each differs from the one before by a few words, the ends are unlike.
    chain = [" ".join(base[:i] + [f"new{j}" for j in range(i)] + base[i:]) for i in range(0, 40, 4)]
    texts = [(100 + i, t) for i, t in enumerate(chain)]
    texts += [(5, None), (6, ""), (7, " \n"), (8, "one two"), (9, "ONE two"), (10, "two one"), (11, chain[0].upper()), (11, chain[0].upper()), (None, chain[0]), (12, prose(4000, 3))]
    for j in range(30):
        near = list(base)
        near[j * 3] = f"edit{j}"
        texts.append((200 + j, " ".join(near)))
    return texts


def test_matches_brute_force(frame, prose):
    texts = corpus(prose)
    for k in (4, 5):
        done = minhash.near_duplicates(frame(texts), shingle=k).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in done), key=str) == brute(texts, k)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in done)


def test_small_cells_lose_no_link(frame, prose, monkeypatch):
    monkeypatch.setattr(minhash, "CELL", 3)
    texts = corpus(prose)
    done = minhash.near_duplicates(frame(texts), shingle=4).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in done), key=str) == brute(texts, 4)


def test_words_that_polynomials_confuse_are_different(frame, twins):
    a, b = twins
    texts = [(1, f"{a} x y"), (2, f"{b} x y"), (3, f"{a} x y"), (4, f"x {a} y z {b} t u v w {a}"), (5, f"x {b} y z {a} t u v w {b}")]
    done = minhash.near_duplicates(frame(texts), shingle=4).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in done), key=str) == brute(texts, 4)


def test_empty_table(frame):
    assert minhash.near_duplicates(frame([]).limit(0)).collect() == []


def test_components_of_a_path_a_star_and_a_ring(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 50)]
    ring = [(200 + i, 200 + (i + 1) % 17) for i in range(17)]
    edges = spark.createDataFrame([*path, *star, *ring, (300, 300), (5, 4)], "u long, v long")
    found = {r["u"]: r["v"] for r in components.components(edges).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 50)} | {200 + i: 200 for i in range(1, 17)}
