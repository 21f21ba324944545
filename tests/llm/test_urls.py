from framepair.llm import urls


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, host string")


def test_rules_hosts_and_list(spark):
    rows = [
        (1, "https://WWW.Example.com/en/a", "x"), (2, "http://example.com/en/a", "x"), (3, "http://a.example.com/de", "x"), (4, "http://notexample.com/en/", "x"),
        (5, "http://b.net/es/1", "x"), (6, None, "x"), (7, "no scheme", "x"), (8, "http://com", "x"), (9, "http://org.example.org/p/?utm_source=f&a=1#top", "x"),
        (9, "http://org.example.org/p/?utm_source=f&a=1#top", "x"), (10, "http://net?x=://y", "x"), (11, "http://org.example.org/q", "x"),
    ]
    listed = spark.createDataFrame([("org.example.org/p?a=1",), (None,), ("org.example.org/p?a=1",)], "u string")
    done = urls.filter_urls(frame(spark, rows), listed, urls.RULES)
    got = {(r["page_id"], r["_host"], r["path"], r["rule"], r["verdict"]) for r in done.collect()}
    assert done.count() == len(rows)
    assert got == {
        (1, "www.example.com", "/en/a", "www.example.com/en/", "allow"), (2, "example.com", "/en/a", "example.com/en/", "block"),
        (3, "a.example.com", "/de", "com/", "allow"), (4, "notexample.com", "/en/", "com/", "allow"), (5, "b.net", "/es/1", "net/es/", "block"),
        (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "com", "", None, "allow"), (9, "org.example.org", "/p/", None, "block"),
        (10, "net", "", None, "allow"), (11, "org.example.org", "/q", None, "allow"),
    }


def test_no_listed_key_is_missed_and_few_others_pass(spark):
    keys = spark.range(4000).selectExpr("concat('h', id) AS k")
    blocks = urls.blocks_for(2000)
    bloom = urls.build_filter(keys.where("substring(k, 2) < 2000 AND length(k) < 6").limit(2000), "k", blocks)
    listed = keys.where("cast(substring(k, 2) as int) < 2000")
    bloom = urls.build_filter(listed, "k", blocks)
    found = urls.may_be_listed(keys, "k", bloom, blocks, "maybe").selectExpr("cast(substring(k, 2) as int) < 2000 AS inside", "maybe").groupBy("inside", "maybe").count()
    counts = {(r["inside"], r["maybe"]): r["count"] for r in found.collect()}
    assert counts[True, True] == 2000 and (True, False) not in counts
    assert counts.get((False, True), 0) < 100


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], "u string")
    assert urls.filter_urls(frame(spark, []), nothing, urls.RULES).collect() == []
    assert urls.filter_urls(frame(spark, [(1, "http://a.org/", "x")]), nothing).first()["verdict"] == "allow"


def test_blocks_are_bounded():
    assert urls.blocks_for(10**12) == urls.MAX_BLOCKS and urls.blocks_for(0) == 1
