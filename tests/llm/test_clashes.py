from pyspark.sql import functions as F

from framepair.llm import decontaminate, language, minhash, packing, rules, substrings, urls, weak


def wide(frame, rows, *names):
    return frame(rows).withColumns({n: F.lit("mine") for n in names})


def test_columns_of_the_input_stay_as_they_are(spark, frame, prose):
    rows = [(i, prose(60, i % 5)) for i in range(12)]
    for made, names in (
        (lambda d: substrings.remove_repeats(d), ("_k1", "_s1", "_spans", "n_bytes", "removed_spans")),
        (lambda d: rules.cascade(d), ("n_words", "rejected_by", "base_failed")),
        (lambda d: decontaminate.decontaminate(d, spark.createDataFrame([(1, "x")], "item_id long, text string")), ("n_hit", "hit_spans")),
        (lambda d: weak.classify(d, weak.train(d)), ("score", "weak_good")),
        (lambda d: language.predict(d, None), ("lang_pred", "score")),
        (lambda d: packing.pack_texts(d, *packing.public_vocabulary(), keep=("doc_id", "start", "offset")), ("start", "offset")),
    ):
        done = made(wide(frame, rows, *names))
        assert len(set(done.columns)) == len(done.columns)
        assert done.where(" OR ".join(f"`{n}` <> 'mine'" for n in names)).isEmpty() and done.count() >= 12
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string").withColumns({n: F.lit("mine") for n in ("_url", "_block", "_w3", "verdict", "host")})
    done = urls.filter_urls(pages, spark.createDataFrame([("a.com/x",)], "u string"))
    assert done.select("_url", "_block", "_w3", "verdict", "host").first() == ("mine",) * 5 and done.first()["_verdict"] == "block"
    assert minhash.near_duplicates(wide(frame, rows, "node", "bucket", "n_shingles")).count() == 12
