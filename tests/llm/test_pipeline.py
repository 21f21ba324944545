import corpus_pipeline as p
from framepair.llm.common import materialise, table

from .test_decontaminate import brute as leaks
from .test_minhash import brute as groups
from .test_rules import brute as counts
from .test_substrings import brute as repeats

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    for name, stage in p.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SF), name)
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        texts = list(before.items())
        if name == "quality_rules":
            failed = {i for i, t in texts for n, _, _, _, again in [counts(t)] if n < 50 or 2 * again > n}
            assert not failed & set(after) and len(after) > 0.5 * len(before)
        elif name == "near_duplicates":
            assert set(after) == {least for _, _, least in groups(texts, 5)}
        elif name == "repeated_strings":
            assert {i: len((t or "").encode()) for i, t in after.items()} == {i: n - gone for i, n, gone, _, _ in repeats(texts, 400)} or all(
                len(t.encode()) <= n - gone for i, n, gone, _, _ in repeats(texts, 400) for t in [after[i]]
            )
        else:
            assert set(after) == {i for i, *_, hit in leaks(texts, items) if not hit}
        before = after
    packed = p.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == set(before)


def test_run_and_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert p.run(spark, str(tmp_path)).collect() == []


def kept_of(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], table(spark, SF, "documents").schema)
    return sorted(((r["doc_id"], r["text"]) for r in p.near_duplicates(spark, docs, SF).collect()), key=str)


def test_one_row_of_each_group_stays(spark, prose):
    a, b, c, d, e = (prose(120, i) for i in range(5))
    near = lambda t: t + " end"
    # (a) the least id stands in two equal rows and in a near copy
    assert kept_of(spark, [(1, a), (1, a), (2, near(a)), (3, b)]) == [(1, a), (3, b)]
    # (b) copies without an id go, and do not displace one that has an id
    assert kept_of(spark, [(5, a), (None, a), (None, a), (None, near(a)), (6, b)]) == [(5, a), (6, b)]
    (only,) = kept_of(spark, [(None, a), (None, a), (None, near(a))])
    assert only in [(None, a), (None, near(a))]
    # (c) an id shared by different texts: only the copy among them goes
    assert kept_of(spark, [(1, a), (2, near(a)), (2, b), (7, c), (7, d), (8, d)]) == sorted([(1, a), (2, b), (7, c), (7, d)], key=str)
    # least id twice, with two texts of one group: one of the two
    (only,) = kept_of(spark, [(1, e), (1, near(e)), (1, e)])
    assert only in [(1, e), (1, near(e))]
    # no text: linked with nothing
    assert kept_of(spark, [(1, None), (1, None), (2, "")]) == [(1, None), (1, None), (2, "")]


def test_repeated_rows_keep_their_text_through_the_next_stage(spark, prose):
    rows = [(i, t, "en", "web", len(t)) for i, t in [(1, prose(120, 1)), (1, prose(120, 1)), (None, prose(120, 1)), (2, prose(120, 2))]]
    docs = materialise(spark.createDataFrame(rows, table(spark, SF, "documents").schema), "rows")
    docs = materialise(p.near_duplicates(spark, docs, SF), "near")
    assert sorted(tuple(r) for r in p.repeated_strings(spark, docs, SF).collect()) == [rows[0], rows[3]]
