from groundq.llm.urls import filter_urls

RULES = "action string, host string, path string"


def judged(spark, urls, rules, **more):
    rows = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    out = filter_urls(rows, spark.createDataFrame(rules, RULES), url="url", keys=["page_id"], **more)
    return {r.page_id: r for r in out.collect()}


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
        host, rest = rest[:cut].lower(), rest[cut:]
        path = rest[: min([i for i, c in enumerate(rest) if c in "?#"], default=len(rest))]
    fit = [(len(h) + len(p), len(h), a == "block", h + (p or "/"), a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, 0, None, default))
    return host, path, best[3], best[4]


def test_against_brute_force(spark):
    rules = [
        ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
        ("block", "b.org", "/x/ab"), ("block", "b.org", ""), ("allow", "b.org", "/x/"), ("block", "org", "/same"), ("allow", "org", "/same"),
    ]
    urls = [
        None, "", "no scheme", "http://", "http://COM", "https://Example.COM/en/1?x#y", "http://www.example.com/en/", "http://a.www.example.com/en/x",
        "http://notexample.com/en/", "http://n.net/es/1", "http://n.net/es", "http://b.org/x/abc", "http://b.org/x/b", "http://b.org?x/abc",
        "http://c.org/samething", "x://y://com/en/", "http://a.com" + "/d" * 3000, "http://" + "a." * 2000 + "example.com/en/", "http://a.com:80/",
    ]
    got = judged(spark, urls, rules)
    for i, url in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == brute(url, rules), url


def test_empty_tables_and_repeated_rows(spark):
    assert judged(spark, [], [("allow", "com", "/")]) == {}
    assert judged(spark, ["http://a.com/"], [], default="block")[0].verdict == "block"
    rows = spark.createDataFrame([(None, "http://a.com/")] * 3 + [(1, None)], "page_id long, url string")
    out = filter_urls(rows, spark.createDataFrame([("block", "a.com", "/")], RULES), url="url", keys=["page_id"]).collect()
    assert sorted((r.page_id or 0, r.verdict) for r in out) == [(0, "block")] * 3 + [(1, "allow")]
