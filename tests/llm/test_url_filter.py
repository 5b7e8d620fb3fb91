import re

from civicsift.llm import url_filter

RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
URLS = [None, "", "no scheme", "https://", "https://Example.COM/en/x", "https://www.example.com/en/x", "http://a.example.com/en/",
        "http://a.example.com/en", "https://notexample.com/en/", "https://x.net/es/1?u=http://y.com/", "https://x.net/fr/",
        "https://x.net?a/es/", "https://x.net#/es/", "https://com/", "https://com", "ftp://x.org/en/1.html", "a://b://c/d",
        "https://ÀÉ.org/" + "p" * 20_000, "https://x.net/es/1", "https://x.net/es/1"]


def expected(url):
    match = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), match[1]), match[2]) if match else ("", "")
    fits = [rule for rule in RULES for name, slash, rest in [rule.partition("/")]
            if (host == name or host.endswith("." + name)) and path.startswith(slash + rest)]
    return host, path, max(fits, key=len, default=None)


def judged(spark, urls):
    pages = spark.createDataFrame([(n, u, "kept", 0.5) for n, u in enumerate(urls)], "page_id long, url string, host string, score double")
    parts = url_filter.split_urls(pages, RULES)
    model = url_filter.train(url_filter.label_by_rules(parts, RULES))
    return pages, model, url_filter.judge(parts, RULES, model)


def test_hosts_paths_and_rules(spark):
    rows = judged(spark, URLS)[2].collect()
    assert len(rows) == len(URLS)
    for row in rows:
        host, path, rule = expected(URLS[row.row.page_id])
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == RULES[rule] if rule else row.verdict in ("allow", "block")


def test_the_model_learns_what_the_labels_share(spark):
    good = [f"https://news{n}.example.com/article/{n}" for n in range(60)]
    bad = [f"https://pills{n}.example.net/es/buy-cheap-{n}" for n in range(60)]
    new = ["https://news.site.org/article/7", "https://pills.site.org/es/buy-cheap-7"]
    pages, model, rows = judged(spark, good + bad + new)
    verdicts = {row.row.url: row.verdict for row in rows.collect()}
    assert [verdicts[url] for url in new] == ["allow", "block"]
    kept = url_filter.filter_urls(pages, RULES, model)
    assert kept.columns == pages.columns and {row.url for row in kept.collect()} == {*good, new[0]}


def test_one_verdict_or_none_to_learn_from(spark):
    assert {r.verdict for r in judged(spark, ["https://x.org/", "https://a.net/es/"])[2].collect()} == {"block"}
    assert judged(spark, ["https://x.org/", None])[2].first().verdict == "allow"
    assert judged(spark, [])[2].collect() == []


def test_labelled_table_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "LABELLED_PER_VERDICT", 5)
    pages = spark.range(100).selectExpr("concat('https://h', id, '.com/') AS url").union(
        spark.range(3).selectExpr("concat('https://h', id, '.net/es/') AS url"))
    labelled = url_filter.label_by_rules(url_filter.split_urls(pages, RULES), RULES)
    assert {r.verdict: r["count"] for r in labelled.groupBy("verdict").count().collect()} == {"allow": 5, "block": 3}


def test_held_out_urls_are_judged_right_for_both_verdicts(spark):
    """Three times as many blocked urls as allowed ones, of which a third look alike but for their hosts."""
    good = [f"https://{'news' if n % 3 else 'blog'}{n}.example{n % 7}.com/article/{n}" for n in range(120)]
    bad = [f"https://{'pills' if n % 3 else 'news'}{n}.site{n % 9}.net/{'es' if n % 2 else 'fr'}/item-{n}" for n in range(360)]
    pages = spark.createDataFrame([(u,) for u in good + bad], "url string")
    labelled = url_filter.label_by_rules(url_filter.split_urls(pages, RULES), RULES)
    shares = url_filter.held_out_accuracy(labelled)
    assert shares.keys() == {"allow", "block"} and min(shares.values()) > 0.95
