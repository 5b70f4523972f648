from pyspark.sql import functions as F

from changegraph.llm.url_rules import host, judge_urls, mine_rules, path, url_tokens

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/")]


def test_host_path_and_fixed_rules(spark):
    urls = ["http://a.Example.COM/en/71?x#y", "https://b.com/en/1", "https://net/de/", "ftp://xnet/de/9", "no scheme", None, "http://h.net?q=/de/", "x://é.com/en/://z", "http://a.com/EN/1"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, key int")
    labels = spark.createDataFrame([], "id long, blocked boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, labels, RULES).collect()}
    assert got == {
        0: ("a.example.com", "/en/71", "example.com/en/7", "allow"), 1: ("b.com", "/en/1", "com/en/", "block"), 2: ("net", "/de/", "net/de/", "block"),
        3: ("xnet", "/de/9", None, "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("h.net", "", None, "allow"),
        7: ("é.com", "/en/://z", "com/en/", "block"), 8: ("a.com", "/EN/1", None, "allow"),
    }


def test_mined_rules_equal_brute_force(spark):
    urls = [f"http://www.{'bad' if i % 4 == 0 else 'good'}.org/{'x' if i % 3 else 'y'}/{i}.html" for i in range(120)]
    marks = [i % 4 == 0 and i % 3 != 0 for i in range(120)]
    df = spark.createDataFrame(list(zip(urls, marks)), "url string, blocked boolean")
    labelled = df.select(url_tokens(F.col("url")).alias("tokens"), "blocked")
    mined = {tuple(r.tokens): r.confidence for r in mine_rules(labelled, min_count=5, min_confidence=0.9).collect()}
    data = [(set(r.tokens), r.blocked) for r in labelled.collect()]
    assert mined
    for tokens, confidence in mined.items():
        own = [b for t, b in data if set(tokens) <= t]
        assert sum(own) >= 5 and abs(sum(own) / len(own) - confidence) < 1e-9
        for other, c in mined.items():
            assert not (set(other) < set(tokens) and c >= confidence)
    pages = df.withColumn("page_id", F.monotonically_increasing_id())
    labels = pages.select(F.col("page_id").alias("id"), "blocked")
    out = judge_urls(pages, labels, [], min_count=5, min_confidence=0.9).collect()
    where = {r.page_id: r.url for r in pages.collect()}
    tokens_of = {u: t for u, (t, _) in zip(urls, data)}
    for r in out:
        assert (r.verdict == "block") == any(set(t) <= tokens_of[where[r.page_id]] for t in mined)


def test_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(pages, spark.createDataFrame([], "id long, blocked boolean"), RULES).count() == 0
    df = spark.createDataFrame([("http://a.b/c",)], "url string")
    assert df.select(host(F.col("url")), path(F.col("url"))).first() == ("a.b", "/c")


def test_rules_of_late_segments_and_rare_blocked_pages(spark):
    urls = [f"http://h{i % 50}.org/a/b/c/d/e/{'bad' if i < 12 else 'good'}" for i in range(3000)]
    df = spark.createDataFrame([(u, i < 12 or i % 9 == 0) for i, u in enumerate(urls)], "url string, blocked boolean")
    labelled = df.select(url_tokens(F.col("url")).alias("tokens"), "blocked")
    mined = {tuple(r.tokens): (r.key, r.confidence, round(r.support * 3000)) for r in mine_rules(labelled, min_confidence=0.9).collect()}
    assert mined[(next(t for r in mined for t in r if t.endswith("=bad")),)][1:] == (1.0, 12)


def test_support_does_not_grow_with_the_table(spark):
    data = [([f"x{i % 7}", "seldom"] if i < 10 else [f"x{i % 7}"], i < 10) for i in range(2500)]
    mined = mine_rules(spark.createDataFrame(data, "tokens array<string>, blocked boolean")).collect()
    assert [(r.tokens, r.key, r.confidence) for r in mined] == [(["seldom"], "seldom", 1.0)]


def test_query_follows_the_rules_of_its_contract(spark, tmp_path):
    from changegraph.llm.queries import op8_url_rules

    urls = {
        "http://a.com/en/1": ("com/en/", "block"), "http://www.example.com/en/71": ("example.com/en/7", "allow"), "https://example.com/en/8": ("com/en/", "block"),
        "http://b.net/de/": ("net/de/", "allow"), "http://net/de/x": ("net/de/", "allow"), "http://example.net/de/7": ("net/de/", "allow"),
        "http://w.example.net/de/81": ("example.net/de/8", "block"), "http://c.org/es/": ("org/es/", "block"), "http://c.org/en/": (None, "allow"),
    }
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in op8_url_rules(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(urls.values()))
