import re

from platewise.llm import url_filter as U
from platewise.llm import registry
from tests_llm_helpers import SF001

URLS = [None, "", "no scheme/en/", "http://Example.COM/en/x?y#z", "https://www.example.com/en/1", "http://a.www.example.com/en/",
        "http://notexample.com/en/", "http://x.net/es/", "http://x.net/es", "http://net/fr/a", "http://x.org/en/", "://",
        "http://x.net?q=/es/", "a://b://c.com/", "http://X.NET/ES/", "http://com", "http://com/", "http://.com/x",
        "https://m.casino-win.example.org/en/1", "https://casino.win/", "http://x.org/a.ZIP?b", "http://x.org/wp-login.php",
        "http://ads12.x.org/", "http://x.org/" + "a/" * 50_000 + "login.php", "http://x.net/de/\nfile.exe", "http://x.org/é/checkout/pay"]


def plain(url, host_rules=U.HOST_RULES, patterns=U.PATTERN_RULES):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host):])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in host_rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.host + r.path))
        return host, path, best.host + best.path, best.verdict
    hit = url is not None and any(re.search(p.pattern, url.lower()) for p in patterns)
    return host, path, None, "block" if hit else "allow"


def check(spark, data, **rules):
    df = spark.createDataFrame(list(enumerate(data)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(df, **rules).collect()}
    want = {i: plain(u, rules.get("host_rules", U.HOST_RULES), rules.get("pattern_rules", U.PATTERN_RULES))
            for i, u in enumerate(data)}
    assert got == want


def test_edge_cases(spark):
    check(spark, URLS + URLS)


def test_other_rules(spark):
    rules = (U.HostRule("block", "org", "/"), U.HostRule("allow", "x.org", "/en/"))
    check(spark, URLS, host_rules=rules, pattern_rules=())
    check(spark, URLS, host_rules=(), pattern_rules=U.PATTERN_RULES)


def test_sample(spark):
    pages = [r.url for r in registry.table(spark, SF001, "pages").collect()]
    check(spark, pages)


def test_rules_are_filed_under_their_rarest_token():
    index = U.pattern_index(U.PATTERN_RULES, {"casino": 9, "win": 2, "ads": 5, "track": 1, "ad": 3, "php": 1, "add": 7})
    filed = {t: {n for n, _ in rules} for t, rules in index.items()}
    assert filed == {"win": {"gambling"}, "track": {"ad_host"}, "cheap": {"pharmacy"},
                     "ads": {"ad_server"}, "ad": {"ad_server"}, "login": {"login"}, "cart": {"cart"},
                     "checkout": {"cart"}, "bet": {"betting"}, "bets": {"betting"},
                     "zip": {"archive_file"}, "rar": {"archive_file"}, "exe": {"archive_file"},
                     "iso": {"archive_file"}}
    assert None not in index


def test_tokens_are_in_every_match():
    tokens = re.compile(U.TOKEN).findall
    for pattern, texts in {
            r"a(b|cd)?e\d*\.x": ["abe12.x", "acde.xy", "ae7.x"], r"/x[0-9]y(?=z)": ["/x1yz"], r"(foo|ba[rz])+[./]": ["foobar/"],
            r"[.-]foo[.-]": ["q-foo.z"], r"foo": ["afoob"], r"://foo\.(bar|b[ae]z)(/|$)": ["://foo.baz", "://foo.bar/"],
            r"(?i)/FOO/": ["/foo/"], r"/a{2,3}/": ["/aa/"], r"/é/x/": ["/é/x/"], r"\bfoo\b": ["a foo b"], r"(a|b|c){3}/d/": ["abc/d/"],
            r"^foo-?9$": ["foo9", "foo-9"], r"x.y/[^a]/z": ["xay/b/z"]}.items():
        need = U.required_tokens(pattern)
        for t in texts:
            assert re.search(pattern, t) and any(w <= set(tokens(t)) for w in need), (pattern, t, need)


def test_ten_thousand_rules(spark):
    rules = tuple(U.PatternRule(f"r{i}", rf"://([^/?#]*\.)?site{i}x\.(example|test)[/:]") for i in range(10_000))
    index = U.pattern_index(rules, {})
    assert None not in index
    urls = [f"http://a.site{i}x.test/p" for i in range(0, 20_000, 501)] + ["http://site7x.org/", "http://xsite7x.test/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").coalesce(1)
    got = {r.page_id: r.pattern for r in U.judge(df, host_rules=(), pattern_rules=rules).collect()}
    assert got == {i: f"r{n}" if (n := 501 * i) < 10_000 and i < 40 else None for i in range(len(urls))}


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://x.com/", "h"), (1, "http://x.com/", "h"), (None, None, None)],
                               "page_id long, url string, html string")
    a = sorted(map(repr, U.judge(df).collect()))
    b = sorted(map(repr, U.judge(df.selectExpr("*", "1 AS host", "2 AS path", "3 AS rule", "4 AS verdict")).collect()))
    assert a == b and len(a) == 3
    assert U.judge(df.limit(0)).collect() == []
