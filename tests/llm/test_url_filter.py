from pyspark.sql import functions as F

from lodestone.llm.url_filter import canonical, expressions, filter_urls, rules_from

RULES = [("bad.com/", "block"), ("ok.bad.com/", "allow"), ("ok.bad.com/x/", "block"), ("ok.bad.com/x/y.html", "allow"), ("ok.bad.com/x/y.html?q=1", "block"), ("both.org/", "block"), ("both.org/", "allow"), ("1.2.3.4/a/", "block"), (None, "block"), ("none.org/", None)]
URLS = {
    "http://bad.com": "block", "https://user:pw@WWW.Bad.com:8080/p?x#f": "block", "ok.bad.com/": "allow", "http://ok.bad.com/x/z": "block", "http://ok.bad.com/x//y.html": "allow",
    "http://ok.bad.com/x/y.html?q=1": "block", "http://both.org/z": "allow", "http://1.2.3.4/a/b": "block", "http://9.1.2.3.4/a/b": "allow", "http://notbad.com/": "allow", "": "allow",
    "http://": "allow", "http://bad.com./": "block", "http://a.b.c.d.e.f.bad.com/" + "d/" * 3000: "block", "http://none.org/": "allow", "bad.com?a=/": "block",
}


def brute(url, rules):
    """The rule that holds, by trying every rule on the canonical URL."""
    host, path, query = url
    best = None
    for expr, action in rules:
        h, _, p = expr.partition("/")
        p = "/" + p
        address = all(x.isdigit() for x in host.split("."))
        host_ok = host == h or (not address and host.endswith("." + h) and "." in h)
        path_ok = p in (path + query, path) or (p.endswith("/") and path.startswith(p))
        if host_ok and path_ok:
            best = max(best or (), (len(h.split(".")), len(p), action == "allow"))
    return "allow" if best is None or best[2] else "block"


def test_precedence(spark):
    pages = spark.createDataFrame([*enumerate(URLS), (99, None), (None, "http://bad.com")], "page_id long, url string").selectExpr("*", "'x' as rule", "'y' as action", "'z' as prefix")
    rules = spark.createDataFrame(RULES, "expr string, action string")
    rows = filter_urls(pages, rules).collect()
    assert {r.url: r.action for r in rows if r.page_id not in (99, None)} == URLS
    assert [r.action for r in rows if r.page_id == 99] == ["allow"] and [r.action for r in rows if r.page_id is None] == ["block"]
    assert filter_urls(pages.limit(0), rules).count() == 0
    assert {r.action for r in filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_made_rules_against_brute_force(spark):
    urls = [f"https://{s}.site{i % 9}.example.com/{lang}/{i}{end}" for i in range(60) for s, lang, end in (("www", "en", "?a=1"), ("m", "de", ".html"), ("b.c", "x/y", "/"))]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string")
    rules = rules_from(pages)
    known = {}
    for r in rules.collect():
        known[r.expr] = min(r.action, known.get(r.expr, "z"))
    canon = {r.url: tuple(r.u) for r in pages.select("url", canonical(F.col("url")).alias("u")).collect()}
    got = filter_urls(pages, rules).collect()
    assert len(got) == len(urls) + 1 and {r.action for r in got} == {"allow", "block"}
    assert all(r.action == brute(canon[r.url], known.items()) for r in got)


def test_expressions(spark):
    row = spark.createDataFrame([("http://a.b.c/1/2.html?p=q",)], "url string").select(expressions(canonical(F.col("url"))).alias("e")).first()
    assert {x.expr for x in row.e} == {h + p for h in ("a.b.c", "b.c") for p in ("/1/2.html?p=q", "/1/2.html", "/1/", "/")}


def test_rules_are_canonical(spark):
    """Rules match however their host is written."""
    pages = spark.createDataFrame([(1, "http://example.com/a/b"), (2, "https://u@EXAMPLE.com:80/x//y"), (3, "http://other.org/")], "page_id long, url string")
    rules = spark.createDataFrame([("Example.com", "block"), ("HTTP://example.com/x//", "allow"), ("", "block"), (None, "block"), ("/only/path", "block")], "expr string, action string")
    got = {r.page_id: (r.action, r.rule) for r in filter_urls(pages, rules).collect()}
    assert got == {1: ("block", "example.com/"), 2: ("allow", "example.com/x/"), 3: ("allow", None)}
