"""URL rules against a loop over all rules."""

from dunlake.llm.queries import URL_RULES
from dunlake.llm.urls import filter_urls, rules_table

SCHEMA = "page_id long, url string, host string, rule string, path int"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = rest[:cut].translate({c: c + 32 for c in range(65, 91)})
    tail = rest[cut:]
    return host, tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def judge(url, rules):
    host, path = parts(url)
    fitting = [(len(h) + len(p), len(h), h, p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fitting:
        return host, path, None, "allow"
    _, _, h, p, verdict = max(fitting)
    return host, path, h + p, verdict


def check(spark, urls, rules):
    df = spark.createDataFrame([(i, u, "h", "r", i) for i, u in enumerate(urls)], SCHEMA).repartition(3)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, rules_table(spark, rules)).collect()}
    assert got == {i: judge(u, rules) for i, u in enumerate(urls)}


ODD = [None, "", "no scheme", "http://", "HTTP://Example.ORG/es/x?q#f", "a://b://c/fr/", "http://x.example.org?es/", "http://example.org", "http://org/",
       "http://notexample.org/es/", "http://a.b.c.example.org/en/12/3", "http://É.com/fr/", "http://com/de/", "http://x.com/DE/", "http://.com/fr/", "http://com./fr/",
       "http://user@x.com:80/fr/a\nb", "x://example.org/es", "x://example.org/es/\uffff", "http://" + "a." * 300 + "org/" + "p" * 5000]


def test_given_rules(spark):
    check(spark, ODD * 2, URL_RULES)


def test_nested_rules(spark, rng):
    labels, paths = ["com", "a", "b", "a-b", "x"], ["", "/", "/a", "/a/", "/a/b", "/ab", "/b/c/d"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(), rng.choice(paths)) for _ in range(60))}.values())
    urls = [f"http://{host()}{rng.choice(paths)}{rng.choice(['', 'b', '/z', '?q'])}" for _ in range(400)]
    check(spark, urls + ODD, rules)


def test_hot_address_and_no_rules(spark):
    check(spark, ["http://x.example.org/es/1"] * 300 + ["http://y.com/fr/"] * 10, URL_RULES)
    check(spark, ["http://x.org/", None], [])


def test_rules_with_nulls_and_repeats(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "", "", 1)], SCHEMA)
    rules = rules_table(spark, [("org", "/", "block"), ("org", "/", "allow"), (None, "/", "block"), ("org", "/x", None), ("org", "/", "block")])
    assert [tuple(r) for r in filter_urls(pages, rules).collect()] == [(1, "a.org", "/x", "org/", "allow")]
    assert filter_urls(spark.createDataFrame([], SCHEMA), rules).collect() == []


def test_control_characters_are_text(spark):
    rules = [("com", "", "block"), ("x.com", "\x01", "allow"), ("org\x01", "", "block"), ("", "/a", "block"), (".com", "/a", "allow")]
    urls = ["http://com\x01", "http://a.com\x01/", "http://com", "http://x.com\x01", "http://x.com/\x01", "http://org", "http://org\x01", "http://a.org\x01/p\x01",
            "http://.com\x01", "http://.com/a", "http://com/a", "http:///a", "http://com./a", "http://\x01.com/a", "http://..com/a"]
    check(spark, urls, rules)


def test_rules_under_one_top_label(spark, rng):
    rules = [(f"h{i % 40}.com", f"/p{i // 40}", rng.choice(["allow", "block"])) for i in range(400)] + [("com", "/", "allow")]
    urls = [f"http://{rng.choice(['', 'w.'])}h{rng.randrange(45)}.com/p{rng.randrange(12)}{rng.choice(['', '/x'])}" for _ in range(300)]
    check(spark, urls, rules)
