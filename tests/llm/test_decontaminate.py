import re

from framepair.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def brute(texts, items):
    windows = {}
    for i, t in items:
        w = WORD.findall(low(t))
        for j in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[j : j + 10]), set()).add(i)
    out = []
    for key, t in texts:
        w, hit, ids = WORD.findall(low(t)), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[j : j + n]))) is not None:
                    hit |= set(range(j, j + n))
                    ids |= {str(x) for x in found if x is not None}
        out.append((key, len(w), len(hit), sorted(ids), bool(hit)))
    return sorted(out, key=str)


def test_matches_brute_force(spark, frame, prose):
    item = prose(25, 5)
    items = [(1, item), (2, "Short One"), (3, None), (4, "..."), (1, item), (None, prose(12, 6)), (20, prose(10, 7)), (5, "é ü ñ")]
    texts = [
        (1, None), (2, ""), (3, f"x, {item.upper().replace(' ', ' -- ')}! y"), (4, "a short-ONE b"), (5, "shortone short oneé"), (6, prose(12, 6)),
        (7, prose(9, 7)), (8, f"{prose(10, 7)} short one {' '.join(item.split()[3:15])}"), (8, "short one"), (9, "É É é ü ñ é ü\nñ"), (10, prose(30000, 8) + " short one"),
    ]
    table = spark.createDataFrame(items, "item_id long, text string")
    done = d.decontaminate(frame(texts), table)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in done.collect()), key=str)
    assert got == brute(texts, items)


def test_spans_point_into_the_original(spark, frame):
    text = "é!! One, TWO;three ü"
    done = d.decontaminate(frame([(1, text), (2, "one two"), (3, None)]), spark.createDataFrame([(1, "one two three")], "item_id long, text string"))
    spans = {r["doc_id"]: [text[a:b] for a, b in r["hit_spans"]] for r in done.collect()}
    assert spans == {1: ["One, TWO;three"], 2: [], 3: []}
    left = {r["doc_id"]: r["text"] for r in d.strip_hits(done).collect()}
    assert left == {1: "é!!  ü", 2: "one two", 3: None}


def test_shards_give_the_same_hits(prose):
    items = [(str(i), d.words_of(prose(14, i))) for i in range(6)]
    parts = list(d.shards(iter(items), 20))
    assert len(parts) == 6 and sum(parts, []) == items
    text = b" ".join(d.words_of(" ".join(prose(14, i) for i in (1, 4))))
    whole, ids = d.Windows(items).hits(text)
    split = [d.Windows(p).hits(text) for p in parts]
    assert sorted(whole) == sorted(sum((h for h, _ in split), [])) and ids == set().union(*(i for _, i in split)) == {"1", "4"}


def test_empty_tables(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in d.decontaminate(frame([(1, "a")]), none).collect()] == [False]
    assert d.decontaminate(frame([]).limit(0), none).collect() == []
