from retailspark.llm import urls as U

CASES = {
    "https://www.example.com/en/1?x=/es/": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
    "https://m.Example.COM/en/1#t": ("m.example.com", "/en/1", "example.com/en/", "block"),
    "http://x.www.example.com/en/": ("x.www.example.com", "/en/", "www.example.com/en/", "allow"),
    "http://example.com/fr/": ("example.com", "/fr/", "com/", "allow"),
    "http://a.net/es/9": ("a.net", "/es/9", "net/es/", "block"),
    "net://net/fr/": ("net", "/fr/", "net/fr/", "block"),
    "http://a.com": ("a.com", "", None, None),
    "http://a.com?q=/": ("a.com", "", None, None),
    "http://anet/es/": ("anet", "/es/", None, None),
    "x://a.net://b/es/": ("a.net:", "//b/es/", None, None),
    "no scheme": ("", "", None, None),
    "": ("", "", None, None),
    "http://É.NET/es/1\n2": ("É.net", "/es/1\n2", "net/es/", "block"),
}


def model(spark, rows):
    return U.train(spark.createDataFrame(rows, "url string, blocked int"))


def test_rules_host_and_path(spark):
    pages = spark.createDataFrame([(i, u, "h", "s", 1.0) for i, u in enumerate([*CASES, None])], "page_id long, url string, host string, suffix string, score double")
    got = {r.page_id: r for r in U.judge_urls(pages, model(spark, [])).collect()}
    for i, want in enumerate([*CASES.values(), ("", "", None, None)]):
        r = got[i]
        assert (r.host, r.path, r.rule) == want[:3], r
        assert r.verdict == (want[3] or "allow")


def labelled(n):
    good = [(f"https://www.site{i % 9}.org/news/{i}", 0) for i in range(n)]
    bad = [(f"http://win-{i * 7919 % 99991}-cash-{i}.biz/x/y/z/{i * 31}?a={i}&b=1&c=2&id={i * 77}", 1) for i in range(n)]
    return good + bad


def test_trees_learn_lexical_features(spark):
    rows = labelled(300)
    train, test = [r for i, r in enumerate(rows) if i % 4], [r for i, r in enumerate(rows) if not i % 4]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(test)] + [(9999, None), (9999, None)], "page_id long, url string")
    fitted = model(spark, train + train[:50])
    got = U.judge_urls(pages, fitted, rules=()).collect()
    right = sum((r.verdict == "block") == bool(test[r.page_id][1]) for r in got if r.page_id != 9999)
    assert right >= 0.97 * len(test) and len(got) == len(test) + 2
    again = {r.page_id: r.score for r in U.judge_urls(pages.repartition(3), model(spark, list(reversed(train + train[:50]))), rules=()).collect()}
    assert again == {r.page_id: r.score for r in got}


def test_one_label_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://q.org/"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in U.judge_urls(pages, model(spark, [("http://a.org", 1)] * 3), rules=()).collect()} == {"block"}
    assert {r.verdict for r in U.judge_urls(pages, model(spark, []), rules=()).collect()} == {"allow"}
    assert U.judge_urls(pages.limit(0), model(spark, [])).collect() == []


def test_entropy(spark):
    rows = spark.createDataFrame([("",), ("aaaa",), ("abab",), ("abcd",)], "u string")
    assert [round(r[0], 9) for r in rows.select(U.entropy(U.F.col("u"))).collect()] == [0.0, 0.0, 1.0, 2.0]
